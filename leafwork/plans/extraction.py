"""Whole pages: items, segments and images to typed regions, and regions to page results.

Detectors run in order of priority. Each gives regions and the items that they claim; what is
claimed is taken out of the items before the next detector. A page's items and segments are packed
once and go through all detectors in one task (pageregions), so the plan does not grow with the
detectors and nothing is written between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import box_role, escape
from ..functions.lineage import cut
from ..operators import clusters, pageregions, regions
from ..sources import relations as R
from .grid import ruled

QUERIES, ORACLES = {}, {}

REGION = ("type", "x", "y", "w", "h", "font_size", "role", "confidence", "column", "text")


def classify(items: DataFrame, segs: DataFrame, images: DataFrame | None, pages: DataFrame, keys: list[str], overrides: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Regions of pages. items: idx, str, vx, vy, v_width, v_font; segs: seq, x1, y1, x2, y2; pages: width, height.

    skip names region types that are not looked for; headings and lists that are skipped become paragraphs.
    """
    drawn = cut(clusters.image_clusters(images, keys)) if images is not None else None
    rows = pageregions.found(items, segs, drawn, pages, keys, overrides, skip)
    sample = F.when(F.col("id").startswith("n"), F.upper("sample")).otherwise(F.substring(F.upper("sample"), 1, 60))
    rows = rows.withColumn("role", F.when(F.col("type") == "BOX", box_role(sample))).withColumn("y_center", F.col("y") + F.col("h") / 2)
    whole = regions.running_heads(rows, F.col("height"), F.col("s")).select(*keys, "id", *REGION)
    if drawn is None:
        return whole
    blank = {"font_size": "double", "role": "string", "confidence": "double", "column": "long", "text": "string"}
    boxes = drawn.withColumns({"id": F.concat(F.lit("i"), "seq"), "type": F.lit("IMAGE"), **{c: F.col(c).cast("double") for c in "xywh"}, **{c: F.lit(None).cast(t) for c, t in blank.items()}})
    return whole.unionByName(boxes.select(*keys, "id", *REGION))


def page_results(found: DataFrame, keys: list[str]) -> DataFrame:
    """html and text of each page: regions by vertical centre, one element each; tables counted."""
    tag = F.when(F.col("type") == "HEADING", "h3").when(F.col("type") == "LIST", "li").when(F.col("type") == "BOX", "aside").when(F.col("type").isin("HEADER", "FOOTER"), F.lower("type")).otherwise("p")
    body = escape(F.coalesce("text", F.lit("")))
    one = F.when(F.col("type") == "DIVIDER", "<hr>").when(F.col("type") == "IMAGE", F.concat(F.lit('<img alt="'), "id", F.lit('">'))).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">")))
    order = [(F.col("y") + F.col("h") / 2).alias("y_center"), "x", "id"]
    rows = found.dropna(subset=keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, one.alias("_h"), F.coalesce("text", F.lit("")).alias("_t")))).alias("_r"), F.count_if(F.col("type").isin("LATTICE_TABLE", "STREAM_TABLE")).alias("tables"))
    joined = lambda name, joint: F.array_join(F.filter(F.transform("_r", lambda r: r[name]), lambda t: t != ""), joint)
    return rows.select(*keys, joined("_h", "\n").alias("html"), joined("_t", "\n\n").alias("text"), "tables")


def reextracted(results: DataFrame, page: DataFrame, items: DataFrame, segs: DataFrame, images: DataFrame | None, pages: DataFrame, keys: list[str], overrides: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """results with the pages of page (keys) extracted again, under overrides, in place of the old ones."""
    only = lambda df: df.join(page.select(*keys), keys, "left_semi")
    fresh = page_results(classify(only(items), only(segs), only(images) if images is not None else None, only(pages), keys, overrides, skip), keys)
    return results.join(page.select(*keys), keys, "left_anti").unionByName(fresh)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, the ruled grid of every page, and page sizes."""
    items = R.relation(spark, sf_dir, R.ITEMS)
    return items, ruled(spark, sf_dir), items.select("page").distinct().withColumn("width", F.lit(660.0)).withColumn("height", F.lit(800.0))


def extracted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, segs, pages = _inputs(spark, sf_dir)
    return classify(items, segs, None, pages, ["page"]).drop("text")


def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, segs, pages = _inputs(spark, sf_dir)
    return page_results(classify(items, segs, None, pages, ["page"]), ["page"])


QUERIES |= {"extracted_regions": extracted_regions, "extracted_pages": extracted_pages}
