"""Language identification by cross-parsing: the language whose labelled text parses a document into the fewest phrases.

Each language has a suffix automaton of a sample of labelled text. A document is read from
the left; a phrase is the longest run that occurs in the sample, and the next phrase starts
after it. ``phrases * log2(sample length) / symbols`` estimates the cross entropy
(Ziv-Merhav), and the least one wins; ties go to the first language by name.

Symbols: text is lower-cased, letters stand for themselves, all else is one blank, and runs
of blanks are one. The parse of a text is exact, but worked off in blocks of ``BLOCK`` symbols that advance together, one array step
per symbol: each block is first parsed as if a phrase began at its start. Then the open phrase of each block is
carried on into the following ones until a phrase begins where one of theirs begins; from there on both parses are the same, as a
greedy parse depends on nothing before a phrase's begin. Phrases are counted along these joints.

Fitting uses at most ``DOCS_PER_LANG`` labelled documents per language, those with the least hash of the id, and
``SYMBOLS_PER_LANG`` symbols of them: a run of each, which begins at a keyed place of the whole text; what short
texts leave goes to the others. Prediction sees the text alone. A table of transitions is an array, or a hash table where the
alphabet is too wide for one of ``MAX_CELLS`` cells; both give the same parse.

Defined cases: a null text, or one with no letter, is ``und`` with score 0; without any labelled
text all documents are ``und``; labels that are null or empty teach nothing; repeated rows and
null ids are judged like others (a null id is never fitted on).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks

DOCS_PER_LANG = 96
SYMBOLS_PER_LANG = 24_000
MAX_CELLS = 8_000_000
BLOCK = 512
SLICE_BYTES = 1 << 21

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def symbols(text: str) -> np.ndarray:
    """Code points of a lower-cased text, 0 for runs of anything but letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(letter_table()[points], points, 0)
    if len(points) > 1:
        points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
    return points


class Automaton:
    """Transitions of a suffix automaton as (state, symbol, target) arrays; symbols are 1.. in ``alphabet`` order."""

    def __init__(self, sample: list[int]):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sample:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size = len(sample)
        self.states = len(nexts)
        self.edges = np.array([(s, c, t) for s, n in enumerate(nexts) for c, t in n.items()], np.int32).reshape(-1, 3)

    def table(self, width: int, cells: int = MAX_CELLS) -> Transitions:
        return Transitions(self.edges, self.states, width, cells)


class Transitions:
    """Targets by state and symbol; 0 where there is none, as the root is no target. States are given and got times the width."""

    def __init__(self, edges: np.ndarray, states: int, width: int, cells: int):
        state, symbol, target = edges.astype(np.int64).T
        keys, values = state * width + symbol, (target * width)
        self.dense = states * width <= cells
        if self.dense:
            self.values = np.zeros(states * width, np.int32)
            self.values[keys] = values
            return
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for key, at, value in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist(), strict=True):
            while self.slots[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.slots[at], self.values[at] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (blocks.mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.values.take(keys, mode="clip")
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.values[at], 0)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % (1 << self.bits)
            hit = self.slots[at[open_]] == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (self.slots[at[open_]] >= 0)]
        return out


def shares(lengths: list[int], budget: int) -> list[int]:
    """How much of each text is taken: an even share of the budget, and what short texts leave goes to the others."""
    out, left, rest = [0] * len(lengths), budget, len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        out[i] = min(lengths[i], left // rest)
        left, rest = left - out[i], rest - 1
    return out


class Model:
    """Automata by language, and the symbols they share."""

    def __init__(self, samples: dict[str, list[str]], budget: int = SYMBOLS_PER_LANG, cells: int = MAX_CELLS):
        texts = {lang: [symbols(t) for t in sorted(ts)] for lang, ts in sorted(samples.items())}
        texts = {lang: [t for t in ts if t.any()] for lang, ts in texts.items()}
        texts = {lang: ts for lang, ts in texts.items() if ts}
        self.langs, self.cells = list(texts), cells
        self.alphabet = np.unique(np.concatenate([t for ts in texts.values() for t in ts])) if texts else np.zeros(0, np.uint32)
        self.width = len(self.alphabet) + 2  # 0 is a symbol that no sample has
        self.automata = []
        for ts in texts.values():
            sample: list[int] = []
            for t, share in zip(ts, shares([len(t) for t in ts], max(len(ts), budget)), strict=True):
                sample += (np.searchsorted(self.alphabet, t[:share]) + 1).tolist()
                sample.append(self.width - 1)  # a mark between texts, which no document has
            self.automata.append(Automaton(sample))
        self._ready: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def ready(self) -> tuple[np.ndarray, list[Transitions]]:
        if self._ready is None:
            codes = np.zeros(int(self.alphabet[-1]) + 2 if len(self.alphabet) else 1, np.int32)
            codes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            self._ready = codes, [a.table(self.width, self.cells) for a in self.automata]
        return self._ready

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Estimated bits a symbol: a row for each text (as symbols()), a column for each language."""
        codes, tables = self.ready()
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        if not lengths.sum() or not self.langs:
            return out
        flat = np.concatenate(texts)
        flat = codes[np.minimum(flat, len(codes) - 1)]
        per = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), per)
        ends = np.cumsum(lengths)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = (ends - lengths)[owner] + nth * BLOCK
        size = np.minimum(BLOCK, lengths[owner] - nth * BLOCK)
        for k, (table, automaton) in enumerate(zip(tables, self.automata, strict=True)):
            out[:, k] = phrases(table, flat, lengths, start, size, owner, per) * math.log2(automaton.size + 1)
        return out / np.maximum(lengths, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the lead of the best over the second, from 0 to 1."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        for lo, hi, data, offsets in blocks.text_slices(texts, SLICE_BYTES):
            known = [symbols(data[a:b].tobytes().decode()) for a, b in zip(offsets, offsets[1:], strict=False)]
            if self.langs and any(len(t) for t in known):
                bits = self.entropies(known)
                best = bits.argmin(1)
                ranked = np.sort(bits, 1)
                second = ranked[:, 1] if bits.shape[1] > 1 else np.full(len(bits), 2 * math.log2(len(self.alphabet) + 2))
                lead = np.clip(1 - ranked[:, 0] / np.maximum(second, 1e-9), 0, 1)
                for i in range(lo, hi):
                    if known[i - lo].any():
                        langs[i], scores[i] = self.langs[best[i - lo]], float(lead[i - lo])
        return langs, scores


def phrases(table: Transitions, flat: np.ndarray, lengths: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Phrases of the greedy parse of each text. start, size and owner tell the blocks in order of place, per their number in each text."""
    # each block by itself: where phrases begin, and the state at its end
    order = np.argsort(-size, kind="stable")
    active = len(size) - np.searchsorted(size[order][::-1], np.arange(BLOCK), "right")  # blocks longer than t
    begins = np.zeros(len(flat) + 1, bool)
    state, at = np.zeros(len(size), np.int64), start[order]
    for t in range(BLOCK):
        n = active[t]
        if not n:
            break
        c, here = flat[at[:n] + t], state[:n]
        to = table[here + c]
        new = to == 0
        missed = np.flatnonzero(new & (here != 0))
        to[missed] = table[c[missed]]  # a phrase ends here; the symbol opens the next or is one by itself
        begins[at[:n] + t] = new | (here == 0)
        state[:n] = to
    last = np.empty(len(size), np.int64)
    last[order] = state
    # the open phrase of each block goes on, up to where a phrase of a later block begins
    text_end = np.cumsum(lengths)[owner]
    stop, extra = start + size, np.zeros(len(size), np.int64)
    lanes = np.flatnonzero(stop < text_end)
    state = last[lanes]
    while len(lanes):
        c = flat[stop[lanes]]
        to = table[state + c]
        new = (to == 0) | (state == 0)
        joined = new & begins[stop[lanes]]
        lanes, state, to, c, new = lanes[~joined], state[~joined], to[~joined], c[~joined], new[~joined]
        missed = np.flatnonzero((to == 0) & (state != 0))
        to[missed] = table[c[missed]]
        extra[lanes[new]] += 1
        stop[lanes] += 1
        on = stop[lanes] < text_end[lanes]
        lanes, state = lanes[on], to[on]
    # along the joints of each text
    before = np.concatenate(([0], np.cumsum(begins)))
    total, texts = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths > 0)
    first = (np.cumsum(per) - per)[texts]
    block, place = first.copy(), start[first]
    while len(texts):
        total[texts] += before[start[block] + size[block]] - before[place] + extra[block]
        place = stop[block]
        on = place < text_end[block]
        texts, first, block, place = texts[on], first[on], block[on], place[on]
        block = first + (place - start[first]) // BLOCK
    return total


def fit_rows() -> Column:
    """True where a document may teach: the crc32 of its id, as text, modulo 3 is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, budget: int = SYMBOLS_PER_LANG, may_teach: Column | None = None) -> Model:
    """Chooses ids first, reading no text (a top-k per language), then reads a run of each of their texts."""
    ids = docs.where(may_teach if may_teach is not None else fit_rows()).where("doc_id is not null and lang is not null and lang <> ''").select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = [r["doc_id"] for r in ids.withColumn("r", rank).where(F.col("r") <= docs_per_lang).select("doc_id").collect()]
    samples: dict[str, list[str]] = {}
    if chosen:
        wanted = docs.where(F.col("doc_id").isin(chosen)).where("lang is not null and lang <> '' and text is not null")
        counts = {r["lang"]: r["count"] for r in wanted.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
        span = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, max(1, 4 * budget // n))])[F.col("lang").cast("string")] if counts else F.lit(1)
        place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.char_length("text") - span + 1)).cast("int") + 1
        for r in wanted.select(F.col("lang").cast("string").alias("lang"), F.substring(F.col("text"), place, span).alias("text")).collect():
            samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples, budget)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score for each row; or, with keep, those columns of docs before the two (text must be among them). A result column replaces a kept one of its name."""
    given = docs.select(*[F.col(f"`{c}`") for c in (keep or ["doc_id"]) if c.lower() not in ("lang_pred", "score")], F.col("text").cast("string").alias("_text"))
    fields = given.schema.fields[:-1]
    n = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(n))
            arrays = [batch.column(i) for i in range(n)] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields] + ["lang_pred", "score"])

    return given.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows that may teach, applied to all rows."""
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(~fit_rows(), F.lit(False)).alias("held_out"), "lang_pred", "score")
