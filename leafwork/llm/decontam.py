"""Benchmark leaks: passages of a text within a few word edits of a benchmark item.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any other non-ASCII
characters, so case, punctuation and line breaks don't matter. An item of L words is leaked
by a document if some run of its words is within ``e = L * percent // 100`` word insertions, deletions and replacements
of the item; so items of fewer than five words are leaked by their own words only.

The search works on item-sized windows of the document:

1. A lossless prefilter of window starts: an item is cut into e + 1 pieces; within e edits one piece is left
   whole, so each leak holds the first words of a piece (four, or as many as every piece has). Runs of so many words of all
   texts are looked up in a bitmap, then exactly; windows may start within e words of where such a
   piece places an item of that length. A window is known by its start and length: items that share a piece share windows.
2. Each window is embedded by CGK random walks: a walk copies the current word and moves on, or stays, as a keyed bit of
   the word and the step says. Edits become a bounded number of differing positions.
3. Bit sampling makes the candidates: in each of ``REPEATS`` walks the words at ``SAMPLES`` positions are the key of a bucket; items of the
   window's length in one of its buckets are its candidates. (A test measures that recall at the full e edits is 0.99 or more.)
4. Windows of a text and candidate that overlap are joined, and verified exactly by bit-parallel edit distance between the
   item and any run inside them, widened by e words.

The benchmark goes to the executors in blocks of at most ``ITEMS_PER_BLOCK`` items, each block
searched in its own pass over the documents.

Defined cases: null and wordless texts leak nothing; null and wordless items are not searched, nor items of fewer than ``least_words`` words
(1 if not given); equal items are searched once and reported by each id; of runs with equally few edits the first end is told; a repeated
row is reported as often as it stands; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

PERCENT = 20
PIECE = 4
REPEATS, SAMPLES = 48, 2
SEED = 0x5EED
ITEMS_PER_BLOCK = 20_000
WINDOWS = 4096  # embedded at a time
_PAD = np.uint64(0)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return blocks.Words(data, np.array([0, len(data)]), blocks.NOT_ALNUM, blocks.LOWER).hash


def allowed_edits(n_words: int, percent: int = PERCENT) -> int:
    return n_words * percent // 100


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end): the least edit distance from item to any run text[i:end], with its least end. Bit-parallel over the item."""
    n = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    whole, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score, best, end = whole, 0, n, n, 0
    for at, w in enumerate(text.tolist()):
        equal = where.get(w, 0)
        x = equal | minus
        d0 = (((equal & plus) + plus) ^ plus) | x
        up, down = minus | (whole & ~(d0 | plus)), d0 & plus
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & whole, down << 1 & whole
        plus, minus = down | (whole & ~(d0 | up)), d0 & up
        if score < best:
            best, end = score, at + 1
    return best, end


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, ids: list[int], texts: list[str], percent: int = PERCENT, repeats: int = REPEATS, samples: int = SAMPLES, seed: int = SEED, least_words: int = 1):
        self.repeats, self.samples, self.seed = repeats, samples, seed
        known: dict[bytes, list[int]] = {}
        for i, text in zip(ids, texts, strict=True):
            h = word_hashes(text)
            if len(h) >= max(1, least_words):
                known.setdefault(h.tobytes(), []).append(i)
        self.ids = list(known.values())
        self.words = [np.frombuffer(h, np.uint64) for h in known]
        self.length = np.array([len(h) for h in self.words], np.int64)
        self.edits = np.array([allowed_edits(len(h), percent) for h in self.words], np.int64)
        # the prefilter, by words of a piece: keys, and of each key the distinct (length, place in the item, edits)
        pieces: dict[int, dict[int, set[tuple[int, int, int]]]] = {}
        for h, e in zip(self.words, self.edits.tolist(), strict=True):
            size = min(PIECE, len(h) // (e + 1))
            grams = blocks.windows(h, size).tolist()
            for at in {j * len(h) // (e + 1) for j in range(e + 1)}:
                pieces.setdefault(size, {}).setdefault(grams[at], set()).add((len(h), at, e))
        self.gates = {}
        for size, table in sorted(pieces.items()):
            keys = np.array(sorted(table), np.uint64)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(keys >> np.uint64(44)).astype(np.int64)] = True
            entries = [sorted(table[k]) for k in keys.tolist()]
            self.gates[size] = bitmap, keys, np.cumsum([0] + [len(x) for x in entries]), np.array([x for few in entries for x in few], np.int64)
        # buckets, by length of item
        self.buckets = {}
        for n in sorted(set(self.length.tolist())):
            mine = np.flatnonzero(self.length == n)
            flat = np.concatenate([self.words[k] for k in mine])
            found = self.keys(flat, np.arange(len(mine)) * n, np.full(len(mine), n), n).reshape(-1)
            order = np.argsort(found, kind="stable")
            self.buckets[n] = found[order], np.repeat(mine, repeats)[order]

    def keys(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, full: int) -> np.ndarray:
        """Bucket keys of windows: array (window, repeat).

        A walk may take 2 * full steps, in which it is expected to reach the end of a whole window; positions are drawn from them.
        A window that its text cuts short goes on with padding.
        """
        r, seed = self.repeats, np.uint64(self.seed)
        lane = np.arange(r, dtype=np.uint64)
        out = np.repeat(blocks.mix(seed ^ (lane + np.uint64(1)) * _ODD)[None], len(starts), 0)
        chosen = np.stack([blocks.mix(seed + lane * np.uint64(64) + np.uint64(s)) % np.uint64(2 * full) for s in range(self.samples)]).astype(np.int64)
        padded = np.append(words, _PAD)
        at, end = np.repeat(starts[:, None], r, 1), (starts + lengths)[:, None]
        for j in range(int(chosen.max()) + 1):
            symbol = np.where(at < end, padded[np.minimum(at, len(words))], _PAD)
            for s in range(self.samples):
                mine = np.flatnonzero(chosen[s] == j)
                if len(mine):
                    out[:, mine] = blocks.mix((out[:, mine] + np.uint64(s)) * _ODD ^ symbol[:, mine])
            key = blocks.mix(seed * np.uint64(31) + (lane << np.uint64(32)) + np.uint64(j))
            at += (blocks.mix(symbol ^ key[None]) & np.uint64(1)).astype(np.int64)
        return out

    def windows(self, words: blocks.Words) -> np.ndarray:
        """The (length, start) of all windows that the prefilter leaves, each once, in order."""
        total, out = len(words.hash) + 1, [np.zeros(0, np.int64)]
        for size, (bitmap, keys, first, entries) in self.gates.items():
            grams = blocks.windows(words.hash, size)
            at = np.flatnonzero(bitmap[(grams >> np.uint64(44)).astype(np.int64)])
            key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            owner = np.searchsorted(words.first, at, "right") - 1
            real = (keys[key] == grams[at]) & (at + size <= words.first[owner + 1])
            at, key, owner = at[real], key[real], owner[real]
            some = max(1, (1 << 22) // max(1, int(np.diff(first).max() * (2 * entries[:, 2].max() + 1))))
            for lo in range(0, len(at), some):
                count = np.diff(first)[key[lo : lo + some]]
                length, place, edits = entries[blocks.ranges(first[key[lo : lo + some]], count)].T
                begin, text = np.repeat(at[lo : lo + some], count) - place, np.repeat(owner[lo : lo + some], count)
                spread = 2 * edits + 1
                start, length, text = blocks.ranges(begin - edits, spread), np.repeat(length, spread), np.repeat(text, spread)
                low = words.first[text]
                start = np.clip(start, low, np.maximum(low, words.first[text + 1] - length))
                out.append(np.unique(length * total + start))
        codes = np.unique(np.concatenate(out))
        return np.stack([codes // total, codes % total])

    def candidates(self, words: blocks.Words) -> np.ndarray:
        """The distinct (item, start) of windows and the items in their buckets, in order."""
        length, start = self.windows(words)
        total, out = len(words.hash) + 1, [np.zeros(0, np.int64)]
        end = words.first[np.searchsorted(words.first, start, "right")]
        for n in np.unique(length).tolist():
            keys, items = self.buckets[n]
            mine = np.flatnonzero(length == n)
            for lo in range(0, len(mine), WINDOWS):
                s = start[mine[lo : lo + WINDOWS]]
                found = self.keys(words.hash, s, np.minimum(n, end[mine[lo : lo + WINDOWS]] - s), n).reshape(-1)
                left = np.searchsorted(keys, found, "left")
                count = np.searchsorted(keys, found, "right") - left
                out.append(np.unique(items[blocks.ranges(left, count)] * total + np.repeat(np.repeat(s, self.repeats), count)))
        codes = np.unique(np.concatenate(out))
        return np.stack([codes // total, codes % total])

    def search(self, words: blocks.Words) -> list[tuple[int, int, int, int]]:
        """(text, item id, edits, end word) of the leaks in a slice, one for each text and item at most."""
        item, start = self.candidates(words)
        if not len(item):
            return []
        text = np.searchsorted(words.first, start, "right") - 1
        reach = self.length[item] + 2 * self.edits[item]
        new = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (start[1:] - start[:-1] > reach[1:]))))
        last = np.append(new[1:], len(item)) - 1
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k, x, a, b in zip(item[new].tolist(), text[new].tolist(), start[new].tolist(), start[last].tolist(), strict=True):
            e = int(self.edits[k])
            low = max(int(words.first[x]), a - e)
            edits, end = least_edits(self.words[k], words.hash[low : min(int(words.first[x + 1]), b + int(self.length[k]) + e)])
            if edits <= e:
                one = (edits, low + end - int(words.first[x]))
                found[x, k] = min(found.get((x, k), one), one)
        return sorted((x, i, *v) for (x, k), v in found.items() for i in self.ids[k])


def item_blocks(benchmark: DataFrame, per_block: int = ITEMS_PER_BLOCK, **options: int) -> Iterator[Items]:
    """The benchmark's items in blocks of about per_block at most; a block is all that is held and sent at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-items.count() * 5 // (4 * per_block)))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], **options)


def leaks(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """doc_id, item_id, edits, end_word: one row for each leak of an item in a row of docs, at its least edits."""
    schema = "doc_id long, item_id long, edits int, end_word long"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, items in enumerate(item_blocks(benchmark, **options)):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column(0), []
                for lo, _, words in blocks.word_slices(batch.column(1), blocks.NOT_ALNUM, blocks.LOWER):
                    rows += [(lo + x, i, e, end) for x, i, e, end in items.search(words)]
                if rows:
                    at, item, edits, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "edits", "end_word"])

        part = given.mapInArrow(run, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of docs, with all their columns, whose text leaks no item; no shuffle."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, words in blocks.word_slices(batch.column(at), blocks.NOT_ALNUM, blocks.LOWER):
                    for found in items.search(words):
                        clean[lo + found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
