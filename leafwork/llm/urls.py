"""URL filters: host and path rules, and a character language-model ratio for all other URLs.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows
up to ``?``, ``#`` or the end. A rule ``host/path`` fits its host and all subdomains if the URL's path
starts with the rule's; the longest fitting rule gives the verdict.

The method: URLs that allow rules accept, and those that block rules reject, are the texts of two
variable-order Markov models over UTF-8 bytes with contexts of 0 to ``ORDER`` bytes, each order
smoothed towards the next lower one. Counts are of all such URLs and live in hashed tables of ``ORDER + 1`` times B cells, where
B grows with the number of such URLs, from ``LEAST_BUCKETS`` to ``MOST_BUCKETS``; so what the driver and the executors hold is
bounded. A URL scores its
log-likelihood difference per byte; at the calibrated threshold or above it is allowed. One fifth of
the ruled URLs, by crc32, is not counted but calibrates: the threshold parts the two kinds
best, from a histogram of scores in steps of 1 / ``STEPS``.

Defined cases: a null URL, or one without ``://``, has an empty host and path, and no rule; null and empty
URLs score 0; without ruled URLs of both kinds every score is 0 and the threshold 0, so all are allowed;
null ids stay; repeated rows are judged, and counted, one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 18
PRIOR = 4.0
STEPS, FARTHEST = 200, 10.0
HELD_OUT = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_rules(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (allow or block by rule, else null)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    out = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, ruled = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for verdict, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, tail = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + tail)
        rule, ruled = rule.when(fits, text), ruled.when(fits, verdict)
    return out.withColumn("rule", rule.cast("string")).withColumn("ruled", ruled.cast("string"))


def cells(data: np.ndarray, offsets: np.ndarray, size: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and order: the cell of its context, and the cell of context and byte. Shape (order + 1, bytes)."""
    n, shift = len(data), np.uint64(64 - size.bit_length() + 1)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    value = data.astype(np.uint64)
    context = np.full(n, 0x9AE16A3B2F90404F, np.uint64)
    contexts, both = np.empty((order + 1, n), np.int64), np.empty((order + 1, n), np.int64)
    for k in range(order + 1):
        if k:
            before = np.full(n, 256, np.uint64)
            before[k:] = value[:-k] if n > k else value[:0]
            before[place < k] = 256  # before the start
            context = blocks.mix(context * np.uint64(257) + before)
        contexts[k] = context >> shift
        both[k] = blocks.mix(context + value + np.uint64(1)) >> shift
    return contexts, both


class Model:
    """Hashed counts of one kind of URL: of contexts and of contexts with the next byte."""

    def __init__(self, contexts: np.ndarray, both: np.ndarray):
        self.contexts, self.both, self.size = contexts, both, contexts.shape[1]

    def log_likelihood(self, contexts: np.ndarray, both: np.ndarray) -> np.ndarray:
        p = np.full(contexts.shape[1], 1 / 256)
        for k in range(len(contexts)):
            p = (self.both[k][both[k]] + PRIOR * p) / (self.contexts[k][contexts[k]] + PRIOR)
        return np.log(p)


def _counting() -> Column:
    return F.crc32(F.col("url").cast("binary")) % HELD_OUT != 0


def buckets(n_urls: int) -> int:
    """Cells of a table: four for each URL, as a power of two within the bounds."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, 4 * n_urls - 1).bit_length()))


def fit(ruled: DataFrame) -> tuple[Model, Model] | None:
    """Models of rejected and accepted URLs, or None without one kind. Partitions add up their own tables first."""

    known = ruled.where(F.col("ruled").isNotNull() & _counting()).select("url", (F.col("ruled") == "allow").cast("int").alias("kind"))
    size = buckets(known.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, 2, ORDER + 1, size), np.int64)
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for lo, hi, data, offsets in blocks.text_slices(batch.column(0)):
                contexts, both = cells(data, offsets, size)
                mine = np.repeat(kinds[lo:hi], np.diff(offsets))
                for kind in (0, 1):
                    for k in range(ORDER + 1):
                        tables[kind, 0, k] += np.bincount(contexts[k][mine == kind], minlength=size)
                        tables[kind, 1, k] += np.bincount(both[k][mine == kind], minlength=size)
        flat = tables.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["cell", "n"])

    rows = known.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(4 * (ORDER + 1) * size)
    flat[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    tables = flat.reshape(2, 2, ORDER + 1, size).astype(np.float32)
    if not tables[0].any() or not tables[1].any():
        return None
    return Model(*tables[0]), Model(*tables[1])


def scored(ruled: DataFrame, models: tuple[Model, Model] | None) -> DataFrame:
    """Adds score: the accepted model's log-likelihood less the rejected one's, per byte."""
    if models is None:
        return ruled.withColumn("score", F.lit(0.0))
    fields = ruled.schema
    names = ruled.columns
    at = names.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rejected, accepted = models
        for batch in batches:
            for lo, hi, data, offsets in blocks.text_slices(batch.column(at)):
                contexts, both = cells(data, offsets, accepted.size)
                gain = np.concatenate(([0.0], np.cumsum(accepted.log_likelihood(contexts, both) - rejected.log_likelihood(contexts, both))))
                score = (gain[offsets[1:]] - gain[offsets[:-1]]) / np.maximum(1, np.diff(offsets))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, "score"])

    return ruled.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double")


def calibrate(ruled: DataFrame, models: tuple[Model, Model] | None) -> float:
    """The threshold that parts the held-out ruled URLs best, half-way to the next lower score; from at most 2 * STEPS * FARTHEST * 2 counts."""
    if models is None:
        return 0.0
    held = scored(ruled.where(F.col("ruled").isNotNull() & ~_counting()), models)
    step = F.floor(F.least(F.greatest("score", F.lit(-FARTHEST)), F.lit(FARTHEST)) * STEPS).cast("int")
    rows = held.groupBy(step.alias("step"), (F.col("ruled") == "allow").alias("ok")).count().collect()
    ok = {r["step"]: r["count"] for r in rows if r["ok"]}
    bad = {r["step"]: r["count"] for r in rows if not r["ok"]}
    if not ok or not bad:
        return 0.0
    best, at, below = -1.0, 0.0, None
    for s in sorted({*ok, *bad}):
        kept = sum(n for k, n in ok.items() if k >= s) / sum(ok.values())
        dropped = sum(n for k, n in bad.items() if k < s) / sum(bad.values())
        if kept + dropped > best + 1e-12:
            best, at = kept + dropped, s if below is None else (s + below) / 2
        below = s
    return at / STEPS


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each row of pages (of which only page_id and url are read)."""
    ruled = with_rules(pages, rules)
    models = fit(ruled)
    cut = calibrate(ruled, models)
    verdict = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored(ruled, models).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
