"""One-dimensional grouping inside pages: folds over sorted arrays, and islands by windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_groups(df: DataFrame, keys: Sequence[str], value: Column, order: Sequence[str], tol: Column, mode: str, name: str) -> DataFrame:
    """df with the column name: the number (from 0) of each row's group within its page, by value.

    Rows are taken by (value, order); a row joins the last group if its value is within tol of the
    group's reference, else it opens one. The reference is, by mode: ``running``, a mean that is
    updated row by row; ``members``, the mean of the members; ``anchor``, the first member. For
    sorted rows the last group is the only one that can take a row, so one state is enough.
    tol must be constant within a page.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(value.cast("double").alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_r"), tol.cast("double").alias("_tol")).alias("_s"))
    pages = packed.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("n"), F.lit(-1).cast("long").alias("g"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        v, m, n = s["_v"], acc["m"], acc["n"]
        reference = m / n if mode == "members" else m
        joins = (n > 0) & (F.abs(reference - v) <= s["_tol"])
        if mode == "running":
            moved = (m * n + v) / (n + 1)
        elif mode == "members":
            moved = m + v
        else:
            moved = m
        g = F.when(joins, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(F.when(joins, moved).otherwise(v).alias("m"), F.when(joins, n + 1).otherwise(F.lit(1.0)).alias("n"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    grouped = pages.select(*keys, F.arrays_zip(F.col("_a").alias("a"), F.aggregate("_a", start, step, lambda acc: acc["out"]).alias("g")).alias("_z"))
    return grouped.select(*keys, F.explode("_z").alias("_z")).select(*keys, "_z.a._r.*", F.col("_z.g").alias(name))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], opens: Column, name: str) -> DataFrame:
    """df with the column name: how many rows up to this one (by order, within keys) open an island, less one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_opens", opens.cast("long"))
    return flagged.withColumn(name, F.sum("_opens").over(w) - 1).drop("_opens")


def merged_intervals(df: DataFrame, keys: Sequence[str], lo: str, hi: str, slack: Column | float, order: Sequence[str] = ()) -> DataFrame:
    """Intervals of each key, merged where one starts within slack of the farthest end so far: keys, lo, hi, members."""
    ordered = [lo, *order] if order else [lo, hi]
    before = Window.partitionBy(*keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    reach = df.withColumn("_reach", F.max(hi).over(before))
    opens = F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + slack)
    run = islands(reach, keys, ordered, opens, "_run")
    return run.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("members")).drop("_run")


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the sorted values of a group."""
    a = F.array_sort(F.collect_list(values))
    return F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))


def population_deviation(values: Column) -> Column:
    """Standard deviation of a group; 0 for fewer than two values."""
    return F.when(F.count(values) < 2, F.lit(0.0)).otherwise(F.stddev_pop(values))
