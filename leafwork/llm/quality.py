"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words are runs of ``[^\\x20\\x09-\\x0D]``, as they stand. Base counts (code points in words,
symbols, repeated lines, words in repeated 8-word windows) decide ``base_failed``. The method
hashes words and word pairs into ``BUCKETS`` buckets, counts them over trusted documents and over
all documents, and scores a document by its mean log ratio of the two smoothed multinomials.
A document that did not fail the base rules is kept if its score reaches a fixed threshold;
nothing is drawn at random.

Trusted text: every document labelled quality 1. Raw counts cover every document. No document takes part in its own
score: documents fall into two folds by a hash of doc_id, each fold has its own two multinomials, and a document is scored by
those of the other fold. The threshold is placed on such scores too, of every labelled document: executors count them by
steps of ``1 / STEPS``, so the driver gets a row for each step that occurs. It is the step that parts documents labelled 1 from
those labelled 0 best (the mean of the two rates kept right), but never one that would drop over ``LOSS`` of the trusted ones.

Trusted ids go to the executors as one sorted array if there are at most ``IDS_SENT`` of them; else rows are
marked by a shuffle join. Both count the same.

Defined cases: a null text has no words and fails the base rules; without trusted labels in a fold
the ratio that it gives is 0, and without any every document that passes the base rules is kept; null ids are never
trusted; repeated labels count once; repeated rows are counted and judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .store import Scratch

BUCKETS = 1 << 16
STEPS = 1 << 14  # of the threshold, to a unit of score
LOSS = 0.002
IDS_SENT = 4_000_000
SMOOTHING = 1.0
REPEAT_WINDOW = 8

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def buckets(words: blocks.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words, buckets of pairs, and which pairs lie within one text."""
    pairs = blocks.windows(words.hash, 2)
    inside = np.ones(len(pairs), bool)
    ends = words.first[1:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(pairs))]] = False
    return (words.hash >> _SHIFT).astype(np.int64), (pairs >> _SHIFT).astype(np.int64), inside


def base_counts(words: blocks.Words) -> dict[str, np.ndarray]:
    data, offsets, first = words.data, words.offsets, words.first
    space = blocks.WHITE[data]
    lead = (data & 0xC0) != 0x80
    # repeated windows: equal (text, window) hashes
    grams = blocks.windows(words.hash, REPEAT_WINDOW)
    owner = blocks.window_owner(first, REPEAT_WINDOW, len(grams))
    keys = blocks.mix(grams ^ blocks.mix(owner.astype(np.uint64)))
    keys, at = keys[owner >= 0], np.flatnonzero(owner >= 0)
    again = at[_repeated(keys)]
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT_WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
    # lines with a word, by the hash of their bytes
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    text = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = np.empty_like(starts)
    if len(starts):
        same = text[1:] == text[:-1]
        ends[:-1] = np.where(same, starts[1:] - 1, offsets[text[:-1] + 1])
        ends[-1] = offsets[text[-1] + 1]
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, text = starts[full], ends[full], text[full]
    lines = blocks.mix(words.spans(starts, ends) ^ blocks.mix(text.astype(np.uint64)))
    n_lines = np.bincount(text, minlength=len(offsets) - 1)
    _, where = np.unique(lines, return_index=True)
    return {
        "n_words": words.n_words,
        "word_chars": words.per_text(lead & ~space),
        "n_symbols": words.per_text(_SYMBOLS[data]),
        "n_dup_lines": n_lines - np.bincount(text[where], minlength=len(offsets) - 1),
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
    }


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True at the values that occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def _given(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(2)), F.lit(0)).cast("int").alias("fold"))


def judging_ids(labels: DataFrame, quality: int, most: int | None = None) -> DataFrame:
    """The ids with this label, once each; with most, so many at most: those with the least hash."""
    ids = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids if most is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def counts(docs: DataFrame, trusted: DataFrame, sent: int = IDS_SENT) -> np.ndarray:
    """How often each bucket stands in the texts: [fold, all or trusted, bucket]. trusted has doc_id; partitions add up their own counts first."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = None
    given = _given(docs)
    if ids.count() <= sent:
        known = np.sort(ids.toArrow()["doc_id"].to_numpy())
        given = given.withColumn("trusted", F.lit(False))
    else:
        given = given.join(ids.withColumn("trusted", F.lit(True)).hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "fold", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * BUCKETS, np.int64)
        for batch in batches:
            ids, fold = batch.column(0), batch.column(2).to_numpy()
            marked = batch.column(3).to_numpy(zero_copy_only=False)
            if known is not None and len(known):
                mine = ids.fill_null(0).to_numpy()
                marked = (known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine) & ids.is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, words in blocks.word_slices(batch.column(1), blocks.WHITE, blocks.EXACT):
                one, two, inside = buckets(words)
                owner = words.text_of_word()
                cell = np.concatenate((one, two[inside]))
                text = lo + np.concatenate((owner, owner[: len(two)][inside]))
                at = fold[text] * (2 * BUCKETS) + cell
                total += np.bincount(at, minlength=4 * BUCKETS)
                total += np.bincount(at[marked[text]] + BUCKETS, minlength=4 * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = given.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * BUCKETS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(2, 2, BUCKETS)


def log_ratios(counted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(P(bucket | trusted) / P(bucket | all)) by the fold of the document to be scored: from the counts of the other fold."""
    out = np.zeros((2, BUCKETS))
    for fold in (0, 1):
        raw, target = counted[1 - fold] + smoothing
        if counted[1 - fold, 1].any():
            out[fold] = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return out


def assess(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, the base counts and score (the mean log ratio; 0 without words) of each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    flat = ratios.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words in blocks.word_slices(batch.column(1), blocks.WHITE, blocks.EXACT):
                counts = base_counts(words)
                one, two, inside = buckets(words)
                shift = batch.column(2).to_numpy()[lo:hi][words.text_of_word()].astype(np.int64) * BUCKETS
                value = flat[shift + one]
                value[: len(two)] += np.where(inside, flat[shift[: len(two)] + two], 0)
                total = np.concatenate(([0.0], np.cumsum(value)))
                n = words.n_words
                score = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(1, n + np.maximum(n - 1, 0))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(counts[c].astype(np.int64)) for c in names], pa.array(score)], names=["doc_id", *names, "score"])

    return _given(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", score double")


def threshold(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The step (of ascending ones, with the numbers of good and bad documents on them) that parts good from bad best, but at which no more than the given share of good is lost."""
    if not good.sum():
        return float("-inf")
    lost, dropped = (np.cumsum(n) - n for n in (good, bad))  # below each step
    most = steps[lost <= loss * good.sum()][-1]
    if not bad.sum():
        return float(most)
    return float(min(most, steps[np.argmax(dropped / bad.sum() - lost / good.sum())]))


def quality_rules(docs: DataFrame, labels: DataFrame, trusted: int | None = None, rejected: int | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row of docs.

    The threshold counts every labelled document; trusted and rejected bound how many of either label, if given.
    """
    ratios = log_ratios(counts(docs, labels.where("quality = 1")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # texts are scored once; counts and scores, written, serve the threshold and the result
    out = Scratch(docs.sparkSession, "quality").keep(assess(docs, ratios).withColumn("base_failed", failed), "scored")
    known = judging_ids(labels, 1, trusted).withColumn("good", F.lit(True)).unionByName(judging_ids(labels, 0, rejected).withColumn("good", F.lit(False)))
    step = F.floor(F.col("score") * STEPS)
    rows = out.where("not base_failed").join(known, "doc_id").groupBy(step.alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("step").toArrow()
    cut = threshold(*(rows[c].to_numpy() for c in ("step", "good", "bad")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (step >= cut)).alias("kept"), "score")
