"""Differences of documents: longest common subsequences of lines, words or characters, as runs of parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units(text: Column, by: str) -> Column:
    """The units a text is compared by: lines, words (runs of white space are units of their own), or characters."""
    if by == "lines":
        return F.split(text, "\n", -1)
    if by == "words":
        return F.regexp_extract_all(text, F.lit(r"\s+|[^\s]+"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))


def common_length(a: list[str], b: list[str]) -> int:
    return _choices(a, b)[1]


def _choices(a: list[str], b: list[str]) -> tuple[np.ndarray, int]:
    """Of each pair of suffixes, a bit that tells whether leaving out the left one's first unit keeps as much as leaving out the right one's; and the length of the longest common subsequence.

    A row of lengths is one running maximum over the row below, as rows of such a table never fall; only one row is held, and a bit a cell.
    """
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[x] for x in b], np.int64)
    bits = np.zeros((len(a), -(-len(b) // 8)), np.uint8)
    below = np.zeros(len(b) + 1, np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.zeros(len(b) + 1, np.int32)
        step = np.where(y == codes[a[i]], below[1:] + 1, below[:-1])
        row[:-1] = np.maximum.accumulate(step[::-1])[::-1]
        bits[i] = np.packbits(below[:-1] >= row[1:])
        below = row
    return bits, int(below[0])


def parts(a: list[str], b: list[str]) -> list[tuple[str, list[str]]]:
    """(kind, values) runs with kind same, removed or added; removals come before additions."""
    lead = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    bits, _ = _choices(a[lead:], b[lead:])
    steps = [("same", x) for x in a[:lead]]
    i, j, left, right = 0, 0, a[lead:], b[lead:]
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i] == right[j]:
            steps.append(("same", left[i]))
            i, j = i + 1, j + 1
        elif i < len(left) and (j == len(right) or bits[i, j >> 3] >> (7 - (j & 7)) & 1):
            steps.append(("removed", left[i]))
            i += 1
        else:
            steps.append(("added", right[j]))
            j += 1
    out: list[tuple[str, list[str]]] = []
    for kind, value in steps:
        if out and out[-1][0] == kind:
            out[-1][1].append(value)
        else:
            out.append((kind, [value]))
    return out


def diff_parts(pairs: DataFrame, keys: list[str], by: str = "lines") -> DataFrame:
    """Runs of each pair (left, right texts): keys, part, kind, value, n. Each pair is compared by itself, in Arrow batches, with no shuffle."""
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema}
    joint = "\n" if by == "lines" else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = [getattr(row, k) for k in keys]
                out += [(*key, i, kind, joint.join(v), len(v)) for i, (kind, v) in enumerate(parts(list(row.left), list(row.right)))]
            yield pd.DataFrame(out, columns=[*keys, "part", "kind", "value", "n"])

    given = pairs.select(*keys, units(F.coalesce("left", F.lit("")), by).alias("left"), units(F.coalesce("right", F.lit("")), by).alias("right"))
    return given.mapInPandas(run, ", ".join(f"{k} {fields[k]}" for k in keys) + ", part long, kind string, value string, n long")


def diff_stats(found: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of parts, not of units: added, removed, same; and units_same."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return found.groupBy(*keys).agg(n("added").alias("added"), n("removed").alias("removed"), n("same").alias("same"), F.coalesce(F.sum(F.when(F.col("kind") == "same", F.col("n"))), F.lit(0)).alias("units_same"))


def diff_views(found: DataFrame, keys: list[str], joint: str = "\n") -> DataFrame:
    """Left (removed and same), right (added and same) and unified (all, marked) texts."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "kind", "value")))
    shown = lambda kinds: F.array_join(F.transform(F.filter("_p", lambda p: p["kind"].isin(*kinds)), lambda p: p["value"]), joint)
    mark = lambda p: F.concat(F.when(p["kind"] == "added", "+").when(p["kind"] == "removed", "-").otherwise(" "), p["value"])
    out = found.groupBy(*keys).agg(ordered.alias("_p"))
    return out.select(*keys, shown(["removed", "same"]).alias("left"), shown(["added", "same"]).alias("right"), F.array_join(F.transform("_p", mark), joint).alias("unified"))


def page_pairs(left: DataFrame, right: DataFrame, keys: list[str], filler: str = "No page") -> DataFrame:
    """Pages of two documents side by side, by page number: keys, left_text, right_text."""
    a, b = left.select(*keys, F.col("text").alias("left_text")), right.select(*keys, F.col("text").alias("right_text"))
    out = a.join(b, keys, "full_outer")
    return out.select(*keys, F.coalesce("left_text", F.lit(filler)).alias("left_text"), F.coalesce("right_text", F.lit(filler)).alias("right_text"))
