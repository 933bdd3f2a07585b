"""Versions of pages and documents: upserts, undo history, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order: last write wins. A partial aggregate, so hot keys meet already reduced."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def patched(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with equal keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def history(snapshots: DataFrame, keys: list[str], order: list[str], content: str, cap: int = 50) -> DataFrame:
    """Undo history: equal neighbours count once, and the newest cap versions stay: adds version, from 0 for the oldest kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = snapshots.withColumn("_before", F.lag(content).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col(content).eqNullSafe(F.col("_before")))
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    kept = fresh.withColumn("_age", age).where(F.col("_age") <= cap)
    return kept.withColumn("version", (F.row_number().over(w) - 1).cast("long")).drop("_before", "_first", "_age")


def hit(regions: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """The topmost (last by seq) region that contains a point."""
    inside = (x >= F.col("x")) & (x <= F.col("x") + F.col("w")) & (y >= F.col("y")) & (y <= F.col("y") + F.col("h"))
    return regions.where(inside).groupBy(*keys).agg(F.max("seq").alias("seq"))


def resized(regions: DataFrame, dx: Column, dy: Column, handle: str, least: float = 4.0) -> DataFrame:
    """Regions with a handle (of n, s, e, w and corners) moved; no side gets under least."""
    out = {}
    if "w" in handle:
        move = F.least(dx, F.col("w") - least)
        out |= {"x": F.col("x") + move, "w": F.col("w") - move}
    elif "e" in handle:
        out["w"] = F.greatest(F.lit(least), F.col("w") + dx)
    if "n" in handle:
        move = F.least(dy, F.col("h") - least)
        out |= {"y": F.col("y") + move, "h": F.col("h") - move}
    elif "s" in handle:
        out["h"] = F.greatest(F.lit(least), F.col("h") + dy)
    return regions.withColumns(out)


def split_lists(edits: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Manual column splits of pages: placed ones without those that a removal within 8 lies near, inside 5 % to 95 % of the width, sorted. edits: action, x."""
    each = edits.withColumn("_w", width).groupBy(*keys).agg(F.collect_set(F.when(F.col("action") == "place", F.col("x"))).alias("p"), F.collect_set(F.when(F.col("action") == "remove", F.col("x"))).alias("r"), F.max("_w").alias("w"))
    near = lambda x: F.exists("r", lambda r: F.abs(r - x) <= 8)
    return each.select(*keys, F.array_sort(F.filter("p", lambda x: (x > F.col("w") * 0.05) & (x < F.col("w") * 0.95) & ~near(x))).alias("splits"))
