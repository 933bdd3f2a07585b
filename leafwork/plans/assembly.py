"""Queries on usable lines, column rules, columns and layout of regions, structure tables, labels and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly
from ..sources import relations as R
from . import sqltext as S
from .grid import K, items, ruled

QUERIES, ORACLES = {}, {}
_IMAGES = f"images as ({S.IMAGES})"
_PAGE = f"items as ({S.ITEMS}), segs as ({S.SEGMENTS})"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _images(spark, sf_dir):
    return R.relation(spark, sf_dir, R.IMAGES)


@query(f"""with {_IMAGES}, s as (select page, seq, x x1, y y1, x + case when seq % 3 = 0 then 2 else w end x2, y + case when seq % 3 = 1 then 3 else h end y2 from images), d as (select *, abs(x2 - x1) dx, abs(y2 - y1) dy from s)
select page, seq, case when dy <= 4 then 'H' else 'V' end kind from d where sqrt(dx * dx + dy * dy) >= 12 and (dy <= 4 and dx > 4 or dx <= 4 and dy > 4 and dy <= 45)""")
def usable_lines(spark, sf_dir):
    im = _images(spark, sf_dir)
    segs = im.select("page", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.when(F.col("seq") % 3 == 0, 2.0).otherwise(F.col("w"))).alias("x2"), (F.col("y") + F.when(F.col("seq") % 3 == 1, 3.0).otherwise(F.col("h"))).alias("y2"))
    return assembly.usable_lines(segs, 15.0).select("page", "seq", "kind")


@query(f"""with {_PAGE}, e as (select page, min(vy - v_font) top, max(vy) bottom from items where length(trim(str)) > 0 group by page)
select page, seq from segs join e using (page) where abs(x2 - x1) <= 4 and abs(y2 - y1) >= 12 and bottom > top and abs(y2 - y1) >= (bottom - top) * 0.6e0 and (x1 + x2) / 2 between 66e0 and 594e0""")
def column_rules(spark, sf_dir):
    return assembly.column_rules(ruled(spark, sf_dir), items(spark, sf_dir), K, F.lit(660.0)).select("page", "seq")


@query(f"""with {_IMAGES}, r as (select page, seq, x, w * 8 w, case when seq % 7 = 0 then 1 else -1 end c from images)
select page, seq, case when c <> -1 or page % 3 = 0 or w >= 325 or (x < 145 and x + w > 155) or (x < 295 and x + w > 305) then c else case when x + w / 2 < 150 then 0 when x + w / 2 < 300 then 1 else 2 end end as column from r""")
def region_columns(spark, sf_dir):
    im = _images(spark, sf_dir)
    splits = im.where("page % 3 <> 0").select("page").distinct().select("page", F.explode(F.array(F.lit(150.0), F.lit(300.0))).alias("split"))
    found = im.select("page", "seq", "x", (F.col("w") * 8).alias("w"), F.when(F.col("seq") % 7 == 0, 1).otherwise(-1).alias("column"))
    return assembly.region_columns(found, splits, K, F.lit(500.0)).select("page", "seq", "column")


@query(f"""with {_IMAGES}, r as (select page, seq, x, floor(y / 300) * 300 y, case when page % 3 = 0 and x < 250 then 'IMAGE' when seq % 3 = 0 then 'HEADING' else 'PARAGRAPH' end type from images),
g as (select distinct page from (select page from r where type = 'HEADING' group by page, y having count(*) >= 3)),
f as (select page from r group by page having max(page % 2) = 1 and coalesce(bool_and(type <> 'PARAGRAPH') filter (x < 250), false) and bool_or(x >= 250 and type = 'PARAGRAPH'))
select p.page, case when g.page is not null then 'layout-card-grid' when f.page is not null then 'layout-feature' else 'layout-equal' end layout from (select distinct page from r) p left join g on g.page = p.page left join f on f.page = p.page""")
def layout_classes(spark, sf_dir):
    kind = F.when((F.col("page") % 3 == 0) & (F.col("x") < 250), "IMAGE").when(F.col("seq") % 3 == 0, "HEADING").otherwise("PARAGRAPH")
    found = _images(spark, sf_dir).select("page", "seq", "x", (F.floor(F.col("y") / 300) * 300).alias("y_center"), F.lit(-1).alias("column"), kind.alias("type"))
    return assembly.layout_class(found, K, "seq", F.col("page") % 2 + 1, F.lit(500.0))


@query("select distinct conv_id from conversations where turn % 5 = 3")
def table_trees(spark, sf_dir):
    nodes = R.table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 5 == 3, "TD").otherwise("P").alias("role"))
    return assembly.has_table_roles(nodes, ["conv_id"])


@query(f"""with items as ({S.ITEMS}), c as (select *, idx // 12 t from items)
select page, t table_id, min(vx) x, min(vy - v_font) y, max(vx + v_width) - min(vx) w, max(vy) - min(vy - v_font) h, count(*) n_cells from c group by page, t""")
def struct_tables(spark, sf_dir):
    it = items(spark, sf_dir)
    cells = it.select("page", F.floor(F.col("idx") / 12).alias("table_id"), F.floor(F.col("idx") / 4).alias("r"), (F.col("idx") % 4).alias("c"), F.array("idx").alias("idxs"))
    return assembly.struct_tables(cells, it, K)


@query(f"""with {_IMAGES}, t as (select page, concat('s', seq) id, x, y, w * 4 w, h * 4 h from images where seq % 5 = 0), r as (select page, concat('r', seq) id, x, y, w, h from images where seq % 5 <> 0)
select * from r where not exists (select 1 from t where t.page = r.page and r.y + r.h / 2 between t.y and t.y + t.h and r.x >= t.x - 10 and r.x + r.w <= t.x + t.w + 10) union all select * from t""")
def struct_replaced(spark, sf_dir):
    im = _images(spark, sf_dir)
    named = lambda df, mark, by: df.select("page", F.concat(F.lit(mark), F.col("seq").cast("string")).alias("id"), "x", "y", (F.col("w") * by).alias("w"), (F.col("h") * by).alias("h"))
    return assembly.struct_replaced(named(im.where("seq % 5 <> 0"), "r", 1), named(im.where("seq % 5 = 0"), "s", 4), K)


@query(f"""with {_IMAGES}, f as (select page, seq, case when seq % 4 <> 0 then [(seq % 16) / 15e0, (seq % 8) / 7e0, (seq % 4) / 3e0] end fill from images)
select page, seq, case when fill is null or (fill[1] > 0.92e0 and fill[2] > 0.92e0 and fill[3] > 0.92e0) or (fill[1] < 0.08e0 and fill[2] < 0.08e0 and fill[3] < 0.08e0) then ''
else concat('background:rgb(', floor(fill[1] * 255 + 0.5)::bigint, ',', floor(fill[2] * 255 + 0.5)::bigint, ',', floor(fill[3] * 255 + 0.5)::bigint, ')') end style from f""")
def fill_styles(spark, sf_dir):
    part = lambda n: (F.col("seq") % n) / F.lit(n - 1.0)
    fill = F.when(F.col("seq") % 4 != 0, F.array(part(16), part(8), part(4)))
    return _images(spark, sf_dir).select("page", "seq", assembly.fill_style(fill).alias("style"))


@query(f"""with {_IMAGES}, i as (select page, seq, case when seq % 6 = 0 then 0e0 else w end w, h from images)
select page, seq, floor(w / 4 + 0.5)::bigint shown, concat('width: ', least(100, floor(w / 40 * 100 + 0.5)::bigint), '%; ', case when w > 0 and h > 0 then concat('aspect-ratio: ', floor(w + 0.5)::bigint, ' / ', floor(h + 0.5)::bigint, '; height: auto;') else 'min-height: 120px;' end) style from i""")
def image_displays(spark, sf_dir):
    w = F.when(F.col("seq") % 6 == 0, 0.0).otherwise(F.col("w"))
    return _images(spark, sf_dir).select("page", "seq", assembly.crop_size(w).alias("shown"), assembly.placeholder_style(w, F.col("h"), F.lit(40.0)).alias("style"))


@query(f"with {_IMAGES} select page, seq, concat('Page ', row_number() over (partition by page order by seq), ' of ', count(*) over (partition by page)) label from images")
def page_labels(spark, sf_dir):
    return assembly.page_labels(_images(spark, sf_dir).select("page", "seq"), K, "seq")


@query(f"""with {_IMAGES}, v as (select page, seq, least(y + h, 300e0) - greatest(y, 100e0) shown from images)
select page, seq from (select *, row_number() over (partition by page order by shown desc, seq) n from v where shown > 0) where n = 1""")
def visible_pages(spark, sf_dir):
    return assembly.most_visible(_images(spark, sf_dir), K, "seq", F.lit(100.0), F.lit(300.0))
