"""Queries on items and segments: scale, bands, clusters, gutters, lines, rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, scale, segments
from ..sources import relations as R
from . import sqltext as S

K = ["page"]
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relation(spark, sf_dir, R.ITEMS)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relation(spark, sf_dir, R.SEGMENTS)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the scale of their page."""
    it = items(spark, sf_dir)
    return it.join(scale.page_scale(it, K), K)


ITEMS = f"items as ({S.ITEMS})"
SEGS = f"segs as ({S.SEGMENTS})"
BANDS = f"{ITEMS}, {S.scale()}, sized as (select items.*, s from items join scale using (page)), {S.fold('sized', 'banded', 'page', 'vy', 'idx', 's * 0.45e0', 'running')}"
BAND_Y = f"{BANDS}, bands as (select page, grp band, arg_max(ref, rn) y, count(*) n_items from banded group by 1, 2)"


@query(f"with {ITEMS} select page, idx, 2 * vx + 10 vx, 1600 - 2 * vy vy, 2 * v_width v_width, 2 * v_font v_font, v_font font_size, idx % 4 = 3 italic from items")
def affine_text_meta(spark, sf_dir):
    it = items(spark, sf_dir)
    slant = F.when(F.col("idx") % 4 == 3, 0.25).otherwise(0.0)
    raw = it.select("page", "idx", "str", F.array("v_font", F.lit(0.0), slant, "v_font", "vx", "vy").alias("transform"), F.col("v_width").alias("width"), F.lit("F1").alias("font_name"))
    pages = it.select("page").distinct().withColumn("vp", F.array(*[F.lit(float(x)) for x in (2, 0, 0, -2, 10, 1600)]))
    return scale.text_meta(raw, pages, K).select("page", "idx", "vx", "vy", "v_width", "v_font", "font_size", "italic")


@query(f"with {SEGS}, o as (select page, {S.ORIENT} o from segs) select page, count(*) n_total, count(*) filter (o = 'H') n_h, count(*) filter (o = 'V') n_v, count(*) filter (o = 'diag') n_diag from o group by page")
def segment_orientation_counts(spark, sf_dir):
    return segments.orientation_counts(ruled(spark, sf_dir), K)


@query(f"with {ITEMS}, {S.scale()} select page, s, s * 0.45 y_band_tol, s * 1.8 para_gap, greatest(2, s * 0.8) table_pad, s * 0.6 proximity, s * 0.8 col_tol, s * 1.5 col_gap_min from scale")
def page_scale_mode(spark, sf_dir):
    return scale.page_scale(items(spark, sf_dir), K).select("page", "s", "y_band_tol", "para_gap", "table_pad", "proximity", "col_tol", "col_gap_min")


@query(f"with {ITEMS}, {S.scale()}, o as (select page, cast(page % 3 as double) / 2 + 0.25 r_y_band, case when page % 2 = 0 then 2.0e0 end r_para_gap from scale) select page, s * r_y_band y_band_tol, s * coalesce(r_para_gap, 1.8e0) para_gap from scale join o using (page)")
def scale_overrides(spark, sf_dir):
    it = items(spark, sf_dir)
    own = it.select("page").distinct().select("page", (F.col("page") % 3 / 2 + 0.25).alias("r_y_band"), F.when(F.col("page") % 2 == 0, 2.0).alias("r_para_gap"), F.lit(None).cast("double").alias("r_col_gap_min"), F.lit(None).cast("double").alias("stream_confidence"))
    return scale.page_scale(it, K, overrides=own).select("page", "y_band_tol", "para_gap")


@query(f"with recursive {BANDS} select page, idx, grp band from banded")
def y_bands(spark, sf_dir):
    return clusters.y_bands(scaled(spark, sf_dir), K, F.col("y_band_tol")).select("page", "idx", "band")


@query(f"with recursive {ITEMS}, {S.scale()}, sized as (select items.*, s from items join scale using (page)), {S.fold('sized', 'c', 'page', 'vx', 'idx', 's * 0.8e0', 'members')} select page, idx, grp as cluster from c")
def x_clusters(spark, sf_dir):
    return clusters.x_clusters(scaled(spark, sf_dir), K, F.col("col_tol")).select("page", "idx", "cluster")


@query(f"with recursive {ITEMS}, {S.fold('items', 'c', 'page', 'vy', 'idx', '15', 'members')} select page, grp as cluster, avg(vy) mean, count(*) n from c group by 1, 2")
def value_clusters(spark, sf_dir):
    return clusters.value_clusters(items(spark, sf_dir), K, "vy", 15.0)


@query(f"""with recursive {BAND_Y}, g as (select *, y - lag(y) over (partition by page order by y) gap from bands),
m as (select page, list_sort(list(gap))[len(list(gap)) // 2 + 1] median from g where gap is not null group by page),
b as (select g.*, median from g left join m using (page))
select page, band, cast(sum(case when gap is null or gap > greatest(median * 2.5e0, 20) then 1 else 0 end) over (partition by page order by y rows unbounded preceding) - 1 as bigint) section from b""")
def band_gap_sections(spark, sf_dir):
    banded = clusters.y_bands(scaled(spark, sf_dir), K, F.col("y_band_tol"))
    return clusters.band_sections(clusters.band_positions(banded, K), K).select("page", "band", "section")


_COVER = """px as (select distinct page, band, unnest(range(greatest(0, cast(floor(vx) as bigint)), cast(ceil(vx + v_width) as bigint) + 1)) x from b),
cov as (select page, x, count(*) n from px group by 1, 2),
edge as (select page, max(x) last, (select count(distinct band) from b b2 where b2.page = cov.page) bands from cov group by page),
grid as (select page, bands, unnest(range(0, last + 1)) x from edge),
flag as (select grid.page, grid.x, coalesce(n, 0) < bands * {share} low from grid left join cov on cov.page = grid.page and cov.x = grid.x),
runs as (select *, x - row_number() over (partition by page, low order by x) r from flag),
gaps as (select page, min(x) lo, max(x) + 1 hi, max(max(x)) over (partition by page) last_x from runs where low group by page, r),
full_end as (select page, max(x) last from grid group by page)"""


@query(f"with recursive {BANDS}, b as (select *, grp band from banded), {_COVER.format(share='0.6e0')} select page, (lo + hi) / 2 x, hi - lo width from gaps join full_end using (page) where hi - lo >= 4 and hi <= last")
def gutters(spark, sf_dir):
    return clusters.gutters(clusters.y_bands(scaled(spark, sf_dir), K, F.col("y_band_tol")), K)


@query(f"""with recursive {BANDS}, b as (select *, grp as line, 0 band from banded), {_COVER.format(share='1')},
empty as (select page, (lo + hi) / 2 x from gaps join full_end using (page) where hi - lo >= 18 and hi <= last),
sides as (select page, line, min(vx) lo, max(vx) hi from b group by 1, 2),
cut as (select e.page, x, count(*) filter (lo < x and hi > x) c, count(*) n from empty e join sides s on s.page = e.page group by 1, 2)
select page, x from cut where c / n >= 0.12""")
def zero_coverage_columns(spark, sf_dir):
    return clusters.separating_gaps(clusters.y_bands(scaled(spark, sf_dir), K, F.col("y_band_tol")), K)


_RECTS = f"rects as (select page, seq, x1 x, y1 y, x2 - x1 w, y2 - y1 h from segs union all select page, seq + 1000, x1, y1, 40 + x2 - x1, 30 + y2 - y1 from segs where seq % 5 = 0)"


@query(f"""with {SEGS}, {_RECTS}, l as (select *, x + w r, y + h b from rects)
select page, seq, 0::bigint edge, x x1, (y + b) / 2 y1, r x2, (y + b) / 2 y2 from l where h < 4
union all select page, seq, 0, (x + r) / 2, y, (x + r) / 2, b from l where h >= 4 and w < 4
union all select page, seq, 0, x, y, r, y from l where h >= 4 and w >= 4 union all select page, seq, 1, r, y, r, b from l where h >= 4 and w >= 4
union all select page, seq, 2, x, b, r, b from l where h >= 4 and w >= 4 union all select page, seq, 3, x, y, x, b from l where h >= 4 and w >= 4""")
def thin_rect_collapse(spark, sf_dir):
    seg = ruled(spark, sf_dir)
    flat = seg.select("page", "seq", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    wide = flat.where("seq % 5 = 0").select("page", (F.col("seq") + 1000).alias("seq"), "x", "y", (F.col("w") + 40).alias("w"), (F.col("h") + 30).alias("h"))
    return segments.thin_rects(flat.unionByName(wide)).select("page", "seq", "edge", "x1", "y1", "x2", "y2")


@query(f"""with {SEGS}, o as (select *, {S.ORIENT} o from segs), p as (select page, seq, o orient, case o when 'H' then x1 else y1 end lo, case o when 'H' then x2 else y2 end hi, case o when 'H' then y1 else x1 end pos,
  floor((case o when 'H' then (y1 + y2) / 2 else (x1 + x2) / 2 end) / 4 + 0.5) * 4 band from o where o in ('H', 'V')),
q as (select *, greatest(8, 0.4 * avg(hi - lo) over (partition by page, orient, band)) lim, max(hi) over (partition by page, orient, band order by lo, seq rows between unbounded preceding and 1 preceding) reach from p),
r as (select *, sum(case when reach is null or lo - reach >= lim then 1 else 0 end) over (partition by page, orient, band order by lo, seq rows unbounded preceding) run from q)
select page, orient, band, min(lo) lo, max(hi) hi, arg_min(pos, lo * 100000 + seq) across, count(*) pieces from r group by page, orient, band, run""")
def dash_runs(spark, sf_dir):
    return segments.dash_runs(ruled(spark, sf_dir), K).select("page", "orient", "band", "lo", "hi", "across", "pieces")


def _collinear_sql(kind: str) -> str:
    at, lo, hi = ("y1", "x1", "x2") if kind == "H" else ("x1", "y1", "y2")
    return f"""with recursive {SEGS}, one as (select page, seq, {at} at0, {lo} lo, {hi} hi from (select *, case when abs(y2 - y1) <= 5 and abs(x2 - x1) > 5 then 'H' when abs(x2 - x1) <= 5 and abs(y2 - y1) > 5 then 'V' end o from segs) where o = '{kind}'),
{S.fold('one', 'g', 'page', 'at0', 'seq', '5', 'anchor')}, m as (select page, grp, avg(at0) over (partition by page, grp) pos, lo, hi from g), {S.merged('m', 'lines', 'page, grp, pos', 'lo', 'hi', '10')} select page, pos, lo, hi, members from lines"""


@query(_collinear_sql("H"))
def collinear_merge_h(spark, sf_dir):
    return segments.collinear(ruled(spark, sf_dir), K, "H").select("page", "pos", "lo", "hi", "members")


@query(_collinear_sql("V"))
def collinear_merge_v(spark, sf_dir):
    return segments.collinear(ruled(spark, sf_dir), K, "V").select("page", "pos", "lo", "hi", "members")


@query(f"""with {SEGS}, o as (select *, {S.ORIENT} o from segs), h as (select page, seq, (y1 + y2) / 2 y, x1 l, x2 r from o where o = 'H'), v as (select page, (x1 + x2) / 2 x, y1 t, y2 b from o where o = 'V'),
p as (select a.page, a.seq, b.seq seq_2, (a.l + b.l) / 2 x1, least(a.y, b.y) y1, (a.r + b.r) / 2 x2, greatest(a.y, b.y) y2 from h a join h b on a.page = b.page and a.seq < b.seq and abs(a.l - b.l) <= 6 and abs(a.r - b.r) <= 6 and abs(a.y - b.y) >= 4)
select * from p where exists (select 1 from v where v.page = p.page and abs(v.x - x1) <= 6 and t <= y1 + 6 and b >= y2 - 6) and exists (select 1 from v where v.page = p.page and abs(v.x - x2) <= 6 and t <= y1 + 6 and b >= y2 - 6)""")
def closed_rects(spark, sf_dir):
    return segments.closed_rects(ruled(spark, sf_dir), K)


_CURVE = "c as (select page, seq, x1 a0, x1 + (seq * 37) % 101 - 50 a1, x2 + (seq * 53) % 97 - 48 a2, x2 a3, y1 b0, y1 + (seq * 29) % 89 - 44 b1, y2 + (seq * 31) % 83 - 41 b2, y2 b3 from segs where seq % 4 = 0)"


def _extreme(p: str) -> str:
    """Cubic values at both ends and at inner roots of the derivative, as a list."""
    a, b, c = f"({p}1 - {p}0)", f"({p}2 - {p}1)", f"({p}3 - {p}2)"
    q2, q1 = f"({a} - 2 * {b} + {c})", f"(2 * ({b} - {a}))"
    disc = f"({q1} * {q1} - 4 * {q2} * {a})"
    roots = f"(case when abs({q2}) > 1e-6 and {disc} >= 0 then [(-{q1} + sqrt({disc})) / (2 * {q2}), (-{q1} - sqrt({disc})) / (2 * {q2})] when abs({q2}) <= 1e-6 and abs({q1}) > 1e-6 then [-{a} / {q1}] else [] end)"
    return f"list_concat([{p}0, {p}3], list_transform(list_filter({roots}, lambda t: t > 0 and t < 1), lambda t: (1 - t) * (1 - t) * (1 - t) * {p}0 + 3 * (1 - t) * (1 - t) * t * {p}1 + 3 * (1 - t) * t * t * {p}2 + t * t * t * {p}3))"


@query(f"with {SEGS}, {_CURVE}, e as (select page, seq, {_extreme('a')} xs, {_extreme('b')} ys from c) select page, seq, round(list_min(xs), 6) x_min, round(list_max(xs), 6) x_max, round(list_min(ys), 6) y_min, round(list_max(ys), 6) y_max from e")
def bezier_bbox(spark, sf_dir):
    c = ruled(spark, sf_dir).where("seq % 4 = 0")
    s = F.col("seq")
    px = F.array("x1", F.col("x1") + s * 37 % 101 - 50, F.col("x2") + s * 53 % 97 - 48, "x2")
    py = F.array("y1", F.col("y1") + s * 29 % 89 - 44, F.col("y2") + s * 31 % 83 - 41, "y2")
    out = segments.bezier_bounds(c.select("page", "seq", px.alias("px"), py.alias("py")))
    return out.select("page", "seq", *[F.round(n, 6).alias(n) for n in ("x_min", "x_max", "y_min", "y_max")])


@query(f"""with {SEGS}, c as (select *, (y1 + y2) / 2 yc, count(*) over (partition by page) n, max((y1 + y2) / 2) over (partition by page) - min((y1 + y2) / 2) over (partition by page) rng from (select page, seq, x1, y1 + case when seq > 20 then 200 else 0 end y1, x2, y2 + case when seq > 20 then 200 else 0 end y2 from segs)),
k as (select distinct page, rng, floor(yc / 5 + 0.5) * 5 pos from c where n >= 4 and rng >= 50), d as (select page, (pos + p) / 2 cut from (select *, lag(pos) over (partition by page order by pos) p from k) where pos - p > greatest(24, rng * 0.1e0)),
z as (select c.page, c.seq, (select count(*) from d where d.page = c.page and d.cut < c.yc) as cluster from c where n >= 4 and not exists (select 1 from d where d.page = c.page and d.cut = c.yc)),
w as (select *, count(*) over (partition by page, cluster) size from z), m as (select *, max(size) over (partition by page) most from w)
select page, seq, case when most < 8 then 0 else cluster end as cluster from m where size >= 8 or most < 8 or not exists (select 1 from d where d.page = m.page)""")
def spatial_y_clusters(spark, sf_dir):
    seg = ruled(spark, sf_dir)
    down = F.when(F.col("seq") > 20, 200.0).otherwise(0.0)
    seg = seg.withColumn("y1", F.col("y1") + down).withColumn("y2", F.col("y2") + down)
    return clusters.spatial_clusters(seg, K, "y", 24.0, 0.10).select("page", "seq", "cluster")


@query(f"with {{}} select page, seq, x, y, w, h from images where w >= 20 and h >= 20".replace("{}", f"images as ({S.IMAGES})"))
def image_filter(spark, sf_dir):
    return R.relation(spark, sf_dir, R.IMAGES).where("w >= 20 and h >= 20")


@query(f"""with recursive images as ({S.IMAGES}), big as (select *, row_number() over (partition by page order by y, x, seq) rn from images where w >= 20 and h >= 20),
f(page, rn, cs) as (select page, rn, [{{'seq': cast(seq as bigint), 'x': x, 'y': y, 'r': x + w, 'b': y + h, 'n': 1::bigint}}] from big where rn = 1
 union all select i.page, i.rn, case when list_position(list_transform(f.cs, lambda c: i.x <= c.r + 8 and i.x + i.w >= c.x - 8 and i.y <= c.b + 8 and i.y + i.h >= c.y - 8), true) > 0
  then list_transform(f.cs, lambda c, k: case when k = list_position(list_transform(f.cs, lambda d: i.x <= d.r + 8 and i.x + i.w >= d.x - 8 and i.y <= d.b + 8 and i.y + i.h >= d.y - 8), true) then {{'seq': c.seq, 'x': least(c.x, i.x), 'y': least(c.y, i.y), 'r': greatest(c.r, i.x + i.w), 'b': greatest(c.b, i.y + i.h), 'n': c.n + 1}} else c end)
  else list_append(f.cs, {{'seq': cast(i.seq as bigint), 'x': i.x, 'y': i.y, 'r': i.x + i.w, 'b': i.y + i.h, 'n': 1::bigint}}) end
  from f join big i on i.page = f.page and i.rn = f.rn + 1),
l as (select page, unnest(arg_max(cs, rn)) c from f group by page) select page, c.seq seq, c.x x, c.y y, c.r - c.x w, c.b - c.y h, c.n n_images from l""")
def image_clusters(spark, sf_dir):
    return clusters.image_clusters(R.relation(spark, sf_dir, R.IMAGES), K)
