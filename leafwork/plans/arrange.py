"""Queries on sources of splits, items across them, table edges, drags, nudges, folded rows and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrange
from ..sources import relations as R
from . import sqltext as S
from .grid import K, items

QUERIES, ORACLES = {}, {}
_IMAGES = f"images as ({S.IMAGES})"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _images(spark, sf_dir):
    return R.relation(spark, sf_dir, R.IMAGES)


@query(f"""with {_IMAGES}, s as (select page, page % 4 + seq % 3 priority, x split from images where (page + seq) % 3 <> 0)
select page, priority, split from s join (select page, min(priority) priority from s group by page) using (page, priority)""")
def chosen_splits(spark, sf_dir):
    found = _images(spark, sf_dir).where((F.col("page") + F.col("seq")) % 3 != 0)
    return arrange.chosen_splits(found.select("page", (F.col("page") % 4 + F.col("seq") % 3).alias("priority"), F.col("x").alias("split")), K)


@query(f"""with items as ({S.ITEMS}), i as (select page, idx, vx, vx + coalesce(v_width, 0) r, 200e0 + page % 7 a, 400e0 b from items)
select page, idx from i where ((vx < a and r > a) or (vx < b and r > b)) and not (r <= a + 5 or (vx >= a - 5 and r <= b + 5) or vx >= b - 5)""")
def full_width_items(spark, sf_dir):
    it = items(spark, sf_dir)
    splits = it.select("page").distinct().select("page", F.explode(F.array(F.lit(200.0) + F.col("page") % 7, F.lit(400.0))).alias("split"))
    return arrange.full_width(it, splits, K).select("page", "idx")


@query(f"""with {_IMAGES}, g as (select page, list([x] order by seq) l, list(x order by seq) x from images where seq % 4 = 0 group by page), s as (select page, list([x] order by seq) l from images where seq % 4 <> 0 group by page),
e as (select page, list_reduce(list_prepend(coalesce(x, []), coalesce(s.l, [])), lambda a, v: case when len(list_filter(a, lambda t: abs(t - v[1]) < 30)) > 0 then a else list_concat(a, v) end) e from g full join s using (page))
select page, unnest(range(len(e))) n, unnest(e) x from e""")
def table_edges(spark, sf_dir):
    im = _images(spark, sf_dir)
    return arrange.table_edges(im.where("seq % 4 = 0"), im.where("seq % 4 <> 0"), K, "seq", F.lit(30.0))


@query(f"""with {_IMAGES}, i as (select page, seq, w * 4 a, h * 4 b, 100e0 c, seq % 61 - 30 d from images)
select page, seq, case when seq % 2 = 0 then greatest(40e0, a + d) else a end width_a, case when seq % 2 = 0 then greatest(40e0, b - d) else greatest(40e0, b + d) end width_b, case when seq % 2 = 1 then greatest(40e0, c - d) else c end width_c, case when seq % 5 < 4 then seq % 5 + 1 else seq % 5 end cols from i""")
def dragged_columns(spark, sf_dir):
    widths = arrange.dragged(F.array(F.col("w") * 4, F.col("h") * 4, F.lit(100.0)), F.col("seq") % 2, F.col("seq") % 61 - 30)
    out = _images(spark, sf_dir).select("page", "seq", widths.alias("_w"), arrange.one_more_column(F.col("seq") % 5).alias("cols"))
    return out.select("page", "seq", *[F.col("_w")[i].alias(n) for i, n in enumerate(("width_a", "width_b", "width_c"))], "cols")


@query(f"""with {_IMAGES}, i as (select page, seq, case when seq % 5 <> 0 then w::bigint end pad, case when seq % 7 <> 0 then w::bigint end tx, case when seq % 3 <> 0 then h::bigint end ty, case when seq % 3 = 0 then 1 else 4 end step from images),
m as (select *, (coalesce(tx, 0) + case seq % 5 when 0 then -step when 1 then step else 0 end)::bigint nx, (coalesce(ty, 0) + case seq % 5 when 2 then -step when 3 then step else 0 end)::bigint ny from i)
select page, seq, nx, ny, concat_ws('; ', case when pad is not null then concat('padding: ', pad, 'px') end, case when tx is not null or ty is not null then concat('transform: translate(', coalesce(tx, 0), 'px,', coalesce(ty, 0), 'px)') end) style from m""")
def nudged_regions(spark, sf_dir):
    some = lambda n, c: F.when(F.col("seq") % n != 0, F.col(c).cast("long"))
    key = F.element_at(F.array(*map(F.lit, ("ArrowLeft", "ArrowRight", "ArrowUp", "ArrowDown", "Enter"))), (F.col("seq") % 5 + 1).cast("int"))
    at = arrange.nudged(some(7, "w"), some(3, "h"), key, F.col("seq") % 3 == 0)
    return _images(spark, sf_dir).select("page", "seq", at["tx"].alias("nx"), at["ty"].alias("ny"), arrange.placement_style(some(5, "w"), some(7, "w"), some(3, "h")).alias("style"))


@query(f"""with {_IMAGES} select page, seq, seq % 5 <> 0 and coalesce(last_value(case when seq % 5 = 0 then seq % 10 = 0 end ignore nulls) over (partition by page order by seq), false) hidden from images""")
def folded_rows(spark, sf_dir):
    return arrange.folded_rows(_images(spark, sf_dir).select("page", "seq"), K, "seq", F.col("seq") % 5 == 0, F.col("seq") % 10 == 0)


@query(f"""with {_IMAGES} select page, seq, case when seq % 4 <> 0 then seq % 3 = page % 3 else seq % 8 = 0 end active from images""")
def active_cells(spark, sf_dir):
    classes = F.when(F.col("seq") % 4 != 0, F.array(F.lit("wide"), F.concat(F.lit("sp-"), (F.col("seq") % 3).cast("string")))).otherwise(F.array(F.lit("wide")))
    return _images(spark, sf_dir).select("page", "seq", arrange.active_cells(classes, F.col("seq") % 8 == 0, (F.col("page") % 3).cast("string")).alias("active"))


@query(f"""with {_IMAGES}, k as (select page from images where (page + seq) % 11 = 0 or seq % 13 = 0 or seq % 17 = 0 group by page),
j as (select page, coalesce(string_agg(distinct concat('T', seq % 4), ',' order by concat('T', seq % 4)) filter ((page + seq) % 11 = 0), '') skip, coalesce(string_agg(concat('c', seq), ',' order by concat('c', seq)) filter (seq % 13 = 0), '') customs,
coalesce(string_agg(distinct x::bigint::varchar, ',' order by x::bigint::varchar) filter (seq % 17 = 0), '') splits from images group by page) select j.* from j join k using (page)""")
def extraction_requests(spark, sf_dir):
    im = _images(spark, sf_dir)
    named = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    layers = im.select("page", named("T", F.col("seq") % 4).alias("type"), ((F.col("page") + F.col("seq")) % 11 != 0).alias("on"))
    splits = im.where("seq % 17 = 0").select("page", F.col("x").cast("long").cast("string").alias("split"))
    out = arrange.requests(layers, im.where("seq % 13 = 0").select("page", named("c", F.col("seq")).alias("id")), splits, K)
    return out.select("page", *[F.array_join(c, ",").alias(c) for c in ("skip", "customs", "splits")])


@query(f"""with {_IMAGES} select page, seq, w * 0.75e0 * 2e0 band, coalesce(case when seq % 6 <> 0 then (seq % 10) / 10e0 end, 0e0) >= 0.5e0 passes from images""")
def threshold_marks(spark, sf_dir):
    confidence = F.when(F.col("seq") % 6 != 0, (F.col("seq") % 10) / F.lit(10.0))
    return _images(spark, sf_dir).select("page", "seq", arrange.threshold_px(F.col("w"), 0.75, 2.0).alias("band"), arrange.passes(confidence, 0.5).alias("passes"))


@query(f"""with {_IMAGES} select page, seq, seq % 5 in (0, 3, 4) allowed, case when page % 3 = 0 then case when seq % 100 < 25 then 'left' when seq % 100 > 75 then 'right' end end side from images""")
def drops(spark, sf_dir):
    kind = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("seq") % 5 + 1).cast("int"))
    allowed = arrange.can_drop(kind("zone", "zone", "column", "region", "region"), kind("zone", "region", "zone", "region", "column"))
    return _images(spark, sf_dir).select("page", "seq", allowed.alias("allowed"), arrange.drop_side(F.col("seq") % 100, F.lit(100.0), F.col("page") % 3 + 1).alias("side"))


@query(f"""with {_IMAGES}, e as (select *, min(seq) over (partition by page) lo, max(seq) over (partition by page) hi from images)
select page, seq, row_number() over (partition by page order by case when seq = lo and page % 3 <> 0 then hi + case when page % 2 = 0 then 0.5e0 else -0.5e0 end else seq end, seq) - 1 place from e""")
def reordered_regions(spark, sf_dir):
    rows = _images(spark, sf_dir).select("page", "seq", F.col("seq").alias("place"))
    moves = rows.where("page % 3 <> 0").groupBy("page").agg(F.min("seq").alias("moved"), F.max("seq").alias("target")).withColumn("after", F.col("page") % 2 == 0)
    return arrange.reordered(rows, moves, K, "seq", "place")
