"""Spatial questions about pages: grid cells, densities, bordered boxes, tabular signatures, bands around a line, containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import inside
from .segments import closed_rects

CELL = 40.0


def bucketed(df: DataFrame, x: str, y: str, cell: float = CELL) -> DataFrame:
    """df with gx, gy, the grid cell of a point."""
    return df.withColumn("gx", F.floor(F.col(x) / cell).cast("long")).withColumn("gy", F.floor(F.col(y) / cell).cast("long"))


def spread(df: DataFrame, reach: float = 0.0, cell: float = CELL) -> DataFrame:
    """Boxes (x, y, w, h) repeated for each grid cell within reach, so that a range join by point becomes an equality join on page and cell."""
    span = lambda lo, hi: F.sequence(F.floor((lo - reach) / cell).cast("long"), F.floor((hi + reach) / cell).cast("long"))
    out = df.withColumn("gx", F.explode(span(F.col("x"), F.col("x") + F.col("w"))))
    return out.withColumn("gy", F.explode(span(F.col("y"), F.col("y") + F.col("h"))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], px: str, py: str, pad: float = 0.0) -> DataFrame:
    """Pairs of points and the boxes that hold them, by grid cells: keys, the points' columns, box_id."""
    b = spread(boxes.withColumnRenamed("id", "box_id"), pad)
    hit = bucketed(points, px, py).join(b.select(*keys, "box_id", "x", "y", "w", "h", "gx", "gy"), [*keys, "gx", "gy"])
    return hit.where(inside(F.col(px), F.col(py), F.col("x"), F.col("y"), F.col("w"), F.col("h"), pad)).select(*points.columns, "box_id")


def segment_density(segments: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Segments whose middle lies in each box, per 10 000 square pixels: keys, box_id, n, density. Empty boxes have 0."""
    mid = segments.withColumn("mx", (F.col("x1") + F.col("x2")) / 2).withColumn("my", (F.col("y1") + F.col("y2")) / 2)
    n = points_in_boxes(mid, boxes, keys, "mx", "my").groupBy(*keys, "box_id").agg(F.count("*").alias("n"))
    out = boxes.withColumnRenamed("id", "box_id").join(n, [*keys, "box_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    area = F.col("w") * F.col("h")
    return out.select(*keys, "box_id", "n", F.when(area > 0, F.col("n") / area * 10000).otherwise(0.0).alias("density"))


def border_boxes(segments: DataFrame, keys: list[str], thick: float = 1.5) -> DataFrame:
    """Closed rectangles (8 pixels of slack) with thick: whether their horizontals are that wide on average."""
    rects = closed_rects(segments, keys, 8.0)
    width = segments.select(*keys, "seq", F.col("stroke_width").alias("sw") if "stroke_width" in segments.columns else F.lit(1.0).alias("sw"))
    out = rects.join(width, [*keys, "seq"]).join(width.select(*keys, F.col("seq").alias("seq_2"), F.col("sw").alias("sw_2")), [*keys, "seq_2"])
    return out.withColumn("thick", (F.col("sw") + F.col("sw_2")) / 2 >= thick).drop("sw", "sw_2")


def tabular_signature(items: DataFrame, keys: list[str], n_cols: Column) -> DataFrame:
    """How much a group of items (with column) looks like a table: fill (items over distinct rows and columns), avg_len, balance (least over largest column), reason."""
    by_col = items.groupBy(*keys, "column").agg(F.count("*").alias("n"))
    balance = by_col.groupBy(*keys).agg((F.min("n") / F.max("n")).alias("balance"), F.count("*").alias("cols"))
    each = items.withColumn("_cols", n_cols).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("vy") + 0.5)).alias("rows"), F.avg(F.char_length(F.trim("str"))).alias("avg_len"), F.max("_cols").alias("_cols"))
    out = each.join(balance, keys).withColumn("fill", F.col("n") / (F.col("rows") * F.col("_cols")))
    reason = F.when(F.col("fill") < 0.3, "sparse").when(F.col("avg_len") > 20, "prose").when(F.col("balance") < 0.2, "unbalanced").otherwise("table")
    return out.select(*keys, "fill", "avg_len", "balance", reason.alias("reason"))


def region_kind(regions: DataFrame, tables: DataFrame, framed: DataFrame, keys: list[str], near: float = 60.0) -> DataFrame:
    """Regions with kind: lattice (centre in a table), bordered-box (in a frame), near-table (within near of a table), else open-text."""
    c = regions.withColumn("_cx", F.col("x") + F.col("w") / 2).withColumn("_cy", F.col("y") + F.col("h") / 2).select(*keys, "id", "_cx", "_cy")
    named = lambda boxes, pad, name: points_in_boxes(c, boxes, keys, "_cx", "_cy", pad).select(*keys, "id").distinct().withColumn(name, F.lit(True))
    out = regions
    for boxes, pad, name in ((tables, 0.0, "_in"), (framed, 0.0, "_framed"), (tables, near, "_near")):
        out = out.join(named(boxes, pad, name), [*keys, "id"], "left")
    kind = F.when(F.col("_in"), "lattice").when(F.col("_framed"), "bordered-box").when(F.col("_near"), "near-table").otherwise("open-text")
    return out.withColumn("kind", kind).drop("_in", "_framed", "_near")


def along(items: DataFrame, keys: list[str], axis: str, at: Column, tol: Column | float) -> DataFrame:
    """Items within tol of a line on axis y (ordered by x) or x (ordered by y): adds ord."""
    pos, other = ("vy", "vx") if axis == "y" else ("vx", "vy")
    hit = items.where(F.abs(F.col(pos) - at) <= tol)
    return hit.withColumn("ord", (F.row_number().over(Window.partitionBy(*keys).orderBy(other, "idx")) - 1).cast("long"))


def column_hint(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """The largest upward jump of leaves in tree order: keys, jump, at_ord. It counts with 6 leaves, a span of 40 and a jump of a fifth of the span."""
    w = Window.partitionBy(*keys).orderBy("ord")
    jumps = leaves.withColumn("jump", F.lag("vy").over(w) - F.col("vy"))
    out = jumps.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("vy") - F.min("vy")).alias("span"), F.max("jump").alias("jump"), F.max_by("ord", F.struct("jump", -F.col("ord"))).alias("at_ord"))
    return out.where("n >= 6 and span >= 40 and jump >= 0.2 * span").select(*keys, "jump", "at_ord")
