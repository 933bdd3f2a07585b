"""Boxes of a layout model: decoding and greedy suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import iou

#: Thresholds of confidence and overlap.
LEAST_CONFIDENCE, MOST_OVERLAP = 0.25, 0.45


def decoded(raw: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Centre boxes with class scores (cx, cy, w, h, scores) as corner boxes with the best class, where that reaches least."""
    best = F.array_max("scores")
    out = raw.withColumn("conf", best).withColumn("class_id", (F.array_position("scores", best) - 1).cast("long")).where(F.col("conf") >= least)
    return out.withColumns({"x": F.col("cx") - F.col("w") / 2, "y": F.col("cy") - F.col("h") / 2}).drop("cx", "cy", "scores")


def suppressed(boxes: DataFrame, keys: list[str], most: float = MOST_OVERLAP) -> DataFrame:
    """Boxes (id, x, y, w, h, conf) kept by greedy suppression: best first (lower id on ties), each dropped if it overlaps a kept one by more than most. One fold over a page's boxes."""
    box = F.struct((-F.col("conf")).alias("o"), "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "conf")])
    pages = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("a"))
    none = F.array().cast(dict(pages.dtypes)["a"])
    four = lambda s: [s[c] for c in "xywh"]

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(*four(k), *four(b)) > most), kept).otherwise(F.concat(kept, F.array(b)))

    return pages.select(*keys, F.explode(F.aggregate("a", none, step)).alias("b")).select(*keys, "b.id", "b.x", "b.y", "b.w", "b.h", "b.conf")
