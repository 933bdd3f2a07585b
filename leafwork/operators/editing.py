"""Edits of laid-out pages as relational updates: zones, selections, overlays, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up


def apply_zones(regions: DataFrame, zones: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Regions with zone (whose y0 <= rounded centre < y1) and column, by their left edge in equal columns unless they have a valid one."""
    z = zones.select(*keys, "zone", "y0", "y1", "cols")
    ry, rx = half_up(F.col("y") + F.col("h") / 2), half_up(F.col("x"))
    out = regions.withColumn("_ry", ry).withColumn("_rx", rx).withColumn("_w", width).join(z, keys).where((F.col("_ry") >= F.col("y0")) & (F.col("_ry") < F.col("y1")))
    own = (F.col("column") >= 0) & (F.col("column") < F.col("cols"))
    placed = F.least(F.floor(F.col("_rx") / F.col("_w") * F.col("cols")), F.col("cols") - 1).cast("long")
    return out.withColumn("column", F.when(F.col("cols") == 1, F.lit(0).cast("long")).when(own, F.col("column")).otherwise(placed)).drop("_ry", "_rx", "_w", "y0", "y1", "cols")


def cycle_columns(zones: DataFrame, chosen: Column) -> DataFrame:
    """One more column in chosen zones; four become one."""
    return zones.withColumn("cols", F.when(chosen, F.col("cols") % 4 + 1).otherwise(F.col("cols")))


def split_zones(zones: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Zones cut in two at the cut of their page that lies inside them."""
    out = zones.join(cuts.select(*keys, "cut"), keys, "left")
    inside = (F.col("cut") > F.col("y0")) & (F.col("cut") < F.col("y1"))
    at = F.floor("cut").cast("long")
    parts = F.when(F.coalesce(inside, F.lit(False)), F.array(F.struct(F.col("y0").alias("y0"), at.alias("y1")), F.struct(at.alias("y0"), F.col("y1").alias("y1")))).otherwise(F.array(F.struct(F.col("y0").alias("y0"), F.col("y1").alias("y1"))))
    out = out.withColumn("_p", F.explode(parts)).drop("y0", "y1", "zone", "cut").select("*", "_p.*").drop("_p")
    return out.withColumn("zone", (F.row_number().over(Window.partitionBy(*keys).orderBy("y0")) - 1).cast("long"))


def promoted_heading(regions: DataFrame, keys: list[str], least: float = 20.0) -> DataFrame:
    """Regions with is_h1: the largest heading (the first on ties, by seq) of a document's first page, if over least."""
    first = regions.where("type = 'HEADING' and page_num = 1").groupBy(*keys).agg(F.max_by("seq", F.struct("font_size", -F.col("seq"))).alias("_seq"), F.max("font_size").alias("_top"))
    out = regions.join(first, keys, "left")
    return out.withColumn("is_h1", F.coalesce((F.col("page_num") == 1) & (F.col("seq") == F.col("_seq")) & (F.col("_top") > least), F.lit(False))).drop("_seq", "_top")


def heading_tag(font_size: Column, is_h1: Column) -> Column:
    return F.when(is_h1, "h1").when(font_size > 18, "h2").otherwise("h3")


def marquee(regions: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Regions that a dragged rectangle meets; touching counts."""
    return regions.where((F.col("x") <= x + w) & (F.col("x") + F.col("w") >= x) & (F.col("y") <= y + h) & (F.col("y") + F.col("h") >= y))


def text_overlay(items: DataFrame, zoom: Column | float = 1.0) -> DataFrame:
    """Where each item's text is laid over a page image: left, top, size."""
    size = F.hypot(F.col("transform")[2], F.col("transform")[3]) * zoom
    return items.withColumns({"left": F.col("vx") * zoom, "top": F.col("vy") * zoom - size, "size": size})


def crop_boxes(images: DataFrame, width: Column, height: Column, zoom: float = 2.0, least: float = 4.0) -> DataFrame:
    """Image boxes in a rendering at zoom, clamped to it; slivers are dropped."""
    left, top = F.greatest(F.lit(0.0), F.floor(F.col("x") * zoom)), F.greatest(F.lit(0.0), F.floor(F.col("y") * zoom))
    right, low = F.least(width * zoom, F.ceil((F.col("x") + F.col("w")) * zoom)), F.least(height * zoom, F.ceil((F.col("y") + F.col("h")) * zoom))
    out = images.withColumns({"cx": left, "cy": top, "cw": right - left, "ch": low - top})
    return out.where((F.col("cw") >= least) & (F.col("ch") >= least))


def overlay_alpha(confidence: Column) -> Column:
    return F.least(F.lit(0.5), F.greatest(F.lit(0.12), F.coalesce(confidence, F.lit(1.0)) * 0.5))


def styled_markdown(text: Column, bold: Column, italic: Column) -> Column:
    """A run of text with its marks; underlining has none."""
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.concat(mark, text, mark)
