"""Queries on spatial questions and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing, spatial
from ..sources import relations as R
from . import sqltext as S
from .grid import ITEMS, SEGS, K, items, ruled

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _boxes(spark, sf_dir):
    """One box a page around the second ruled row."""
    return ruled(spark, sf_dir).where("seq = 0").select("page", F.lit("b").alias("id"), F.lit(180.0).alias("x"), F.lit(50.0).alias("y"), F.lit(200.0).alias("w"), F.lit(60.0).alias("h"))


@query(f"with {SEGS}, p as (select distinct page from segs) select p.page, count(s.page) n, count(s.page) / (200.0e0 * 60) * 10000 density from p left join segs s on s.page = p.page and (x1 + x2) / 2 between 180 and 380 and (y1 + y2) / 2 between 50 and 110 group by p.page")
def segment_density(spark, sf_dir):
    return spatial.segment_density(ruled(spark, sf_dir), _boxes(spark, sf_dir), K).drop("box_id")


@query(f"with {ITEMS} select page, idx from items where vx between 180 and 380 and vy between 50 and 110")
def points_in_boxes(spark, sf_dir):
    return spatial.points_in_boxes(items(spark, sf_dir), _boxes(spark, sf_dir), K, "vx", "vy").select("page", "idx")


@query(f"""with {ITEMS}, c as (select page, idx % 4 as col, count(*) n from items group by 1, 2), b as (select page, min(n) / max(n) balance from c group by page),
e as (select page, count(*) / (count(distinct floor(vy + 0.5)) * 4) fill, avg(length(trim(str))) avg_len from items group by page)
select page, fill, avg_len, balance, case when fill < 0.3 then 'sparse' when avg_len > 20 then 'prose' when balance < 0.2 then 'unbalanced' else 'table' end reason from e join b using (page)""")
def tabular_signature(spark, sf_dir):
    return spatial.tabular_signature(items(spark, sf_dir).withColumn("column", F.col("idx") % 4), K, F.lit(4))


@query(f"with {ITEMS}, h as (select * from items where abs(vy - 74) <= 6) select page, idx, row_number() over (partition by page order by vx, idx) - 1 ord from h")
def band_query(spark, sf_dir):
    return spatial.along(items(spark, sf_dir), K, "y", F.lit(74.0), 6.0).select("page", "idx", "ord")


_PLACED = f"images as ({S.IMAGES})"


@query(f"with {_PLACED}, z as (select page, seq, x, floor(y + h / 2 + 0.5) ry, seq % 3 - 1 c from images), j as (select *, case when ry < 300 then 0 else 1 end zn, case when ry < 300 then 1 else 3 end nc from z) select page, seq, cast(zn as bigint) as zone, cast(case when nc = 1 then 0 when c >= 0 and c < nc then c else least(floor(floor(x + 0.5) / 500 * nc), nc - 1) end as bigint) as column from j")
def zone_application(spark, sf_dir):
    im = R.relation(spark, sf_dir, R.IMAGES).withColumn("column", (F.col("seq") % 3 - 1).cast("long"))
    z = im.select("page").distinct().select("page", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("zone"), F.lit(0).alias("y0"), F.lit(300).alias("y1"), F.lit(1).alias("cols")), F.struct(F.lit(1).cast("long").alias("zone"), F.lit(300).alias("y0"), F.lit(99999).alias("y1"), F.lit(3).alias("cols")))).alias("z")).select("page", "z.*")
    return editing.apply_zones(im, z, K, F.lit(500.0)).select("page", "seq", "zone", "column")


@query(f"with {_PLACED} select page, seq from images where x <= 300 and x + w >= 100 and y <= 400 and y + h >= 200")
def marquee_selection(spark, sf_dir):
    return editing.marquee(R.relation(spark, sf_dir, R.IMAGES), F.lit(100.0), F.lit(200.0), F.lit(200.0), F.lit(200.0)).select("page", "seq")
