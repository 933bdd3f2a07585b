"""Sub-word encoding with seeded merge-dropout, and lossless decoding, for BPE models with byte fallback.

An agenda of adjacent pairs whose join is a piece is worked off by score, leftmost first. Each
candidate merge that the agenda offers is decided by itself, by a keyed hash of (seed, text, place of the word in
the text, number of the candidate in the word's agenda): with the dropout rate it is skipped for good.
So segmentations vary from place to place, yet one seed always gives the same ones. Rate 0 gives the model's own
encoding.

No piece of such a model has a blank behind another character, so merges never cross the
start of a run of blanks and a text is encoded word by word. The words of a slice of texts are worked off together: their
symbols are rows of a matrix, and in each round every word that still has a candidate takes its best one, draws, and merges
or skips; so the round is the number of the candidate. Words of over ``LONG_WORD`` characters have a heap of their own.
Nothing is remembered from slice to slice: memory is bounded by a slice or the longest text.

Decoding joins the pieces' bytes. Encoding puts one blank before the text and writes a blank as
U+2581; a U+2581 of the text itself is always written as its three byte pieces, and so is
any character that the model lacks. Hence decode(encode(text)) == text for every text; ``lossless`` is found by decoding.

Defined cases: a null text has null pieces and counts; an empty one has no pieces; white space only is encoded
like any text. Repeated texts get equal pieces. Null piece lists decode to null; ids that the model lacks decode to
nothing, and bytes that are no UTF-8 to U+FFFD. A result column replaces a kept one of its name. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SEED = 17
DROPOUT = 0.1
LONG_WORD = 64
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 40, LONG_WORD)  # of the matrices, by length of word
SLICE_BYTES = 1 << 20
_NEVER = (1 << 31) - 1
_NONE = -2  # no symbol; an unknown character c is the symbol _OTHER - c
_OTHER = -10
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


class Codec:
    """A piece model's vocabulary. Pickles to executors; nothing is read from a path there."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], seed: int = SEED, dropout: float = DROPOUT):
        ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.seed, self.dropout = seed, dropout
        self.key = hashlib.blake2b(f"merge {seed}".encode(), digest_size=16).digest()
        self.byte_ids = np.array(byte_ids, np.int32)
        self.bytes = [p.replace(BLANK, " ").encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        order = {s: r for r, s in enumerate(sorted({s for p, s in pieces if p}, reverse=True))}
        self.rank = np.array([order[s] if p else _NEVER for p, s in pieces], np.int32)
        # symbols: the pieces, then characters that stand in pieces but are none
        self.extra = sorted({c for p in ids for c in p} - ids.keys())
        symbol = ids | {c: len(pieces) + i for i, c in enumerate(self.extra)}
        self.n_symbols = len(pieces) + len(self.extra)
        self.characters = {" " if c == BLANK else c: i for c, i in symbol.items() if len(c) == 1}
        joins = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.joins = np.array(joins, np.int32).reshape(-1, 3)
        self._ready: tuple | None = None
        self._found: dict[int, tuple[int, int]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None, "_found": None}

    def ready(self) -> tuple[np.ndarray, ...]:
        """Tables of a worker: symbol by code point, slots and values of the joins, bytes of the pieces with places and sizes."""
        if self._ready is None:
            points = _OTHER - np.arange(0x110000, dtype=np.int32)
            for c, i in self.characters.items():
                points[ord(c)] = i
            slots, values = np.full(1 << _SLOTS, -1, np.int64), np.full(1 << _SLOTS, -1, np.int32)
            keys = self.joins[:, 0].astype(np.int64) * self.n_symbols + self.joins[:, 1]
            for key, at, value in zip(keys.tolist(), self._slot(keys).tolist(), self.joins[:, 2].tolist(), strict=True):
                while slots[at] >= 0:
                    at = (at + 1) % (1 << _SLOTS)
                slots[at], values[at] = key, value
            size = np.array([len(b) for b in self.bytes], np.int64)
            self._ready = points, slots, values, np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(size) - size, size
        return self._ready

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _STEP >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        _, slots, values, *_ = self.ready()
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n_symbols + right, -1)
        at = self._slot(keys)
        there = slots[at]
        out = np.where((there == keys) & (keys >= 0), values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % (1 << _SLOTS)
            there = slots[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    @classmethod
    def load(cls, path: str = MODEL, **options: float) -> Codec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            plain = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            pieces.append((piece if plain else "", sp.get_score(i)))
        assert all(BLANK not in p.lstrip(BLANK) for p, _ in pieces), "a piece has a blank inside: words are no units"
        return cls(pieces, byte_ids, **options)

    def _skipped(self, keys: np.ndarray, number: int | np.ndarray) -> np.ndarray:
        """Whether the words with these keys skip the candidate of that number."""
        share = blocks.mix(keys + np.asarray(number, np.uint64) * _STEP) >> np.uint64(11)
        return share < np.uint64(min(1.0, max(0.0, self.dropout)) * (1 << 53))

    def rounds(self, symbols: np.ndarray, keys: np.ndarray) -> None:
        """Works off the agendas of words in place. A row is a word between columns of no symbol; merged symbols go to the left one's place."""
        n, width = symbols.shape
        flat = symbols.reshape(-1)
        made = np.full(n * width, -1, np.int32)  # what a symbol and the next one make
        made[:-1] = self.join(flat[:-1], flat[1:])
        rank = np.where(made >= 0, self.rank[made], _NEVER).astype(np.int32)
        after = np.arange(1, n * width + 1, dtype=np.int64)
        before = np.arange(-1, n * width - 1, dtype=np.int64)
        rows, number = np.arange(n), 0
        while len(rows):
            table = rank.reshape(n, width)
            best = (table if len(rows) == n else table[rows]).argmin(1)
            at = rows * width + best
            more = rank[at] != _NEVER
            rows, at = rows[more], at[more]
            if self.dropout > 0:
                skip = self._skipped(keys[rows], number)
                rank[at[skip]] = _NEVER
                at = at[~skip]
            number += 1
            gone = after[at]
            flat[at] = made[at]
            flat[gone] = _NONE
            rank[gone] = _NEVER
            then, ahead = after[gone], before[at]
            after[at], before[then] = then, at
            # the pairs on both sides are candidates anew
            changed = np.concatenate((at, ahead))
            new = self.join(flat[changed], np.concatenate((flat[then], flat[at])))
            made[changed] = new
            rank[changed] = np.where(new >= 0, self.rank[new], _NEVER)

    def agenda(self, symbols: list[int], key: int) -> list[int]:
        """The same for one word, with a heap: n log n steps for any length."""
        if self._found is None:
            pairs = self.joins[:, 0].astype(np.int64) * self.n_symbols + self.joins[:, 1]
            self._found = {p: (i, r) for p, i, r in zip(pairs.tolist(), self.joins[:, 2].tolist(), self.rank[self.joins[:, 2]].tolist(), strict=True)}
        n, number, found = len(symbols), 0, self._found
        skips = self._skipped(np.array([key], np.uint64), np.arange(3 * n)).tolist() if self.dropout > 0 else [False] * (3 * n)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0 and symbols[left] >= 0 and symbols[right] >= 0:
                made = found.get(symbols[left] * self.n_symbols + symbols[right])
                if made is not None:
                    heapq.heappush(agenda, (made[1], left, symbols[left], symbols[right]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, one, two = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] != one or right < 0 or symbols[right] != two:
                continue
            number += 1
            if skips[number - 1]:
                continue
            symbols[left], symbols[right] = found[one * self.n_symbols + two][0], _NONE
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [s for s in symbols if s != _NONE]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them, lossless) of whole texts given as UTF-8 bytes and offsets."""
        points = self.ready()[0]
        n_texts, full = len(offsets) - 1, np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64), np.ones(n_texts, bool)
        leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        begins = leads[offsets]  # in characters
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        where = begins + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        chars = np.insert(chars, begins[full], 32)
        blank = chars == 32
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[where[full]] = True
        starts = np.flatnonzero(opens)
        lengths = np.diff(np.append(starts, len(chars)))
        first = np.searchsorted(starts, where)
        owner = np.searchsorted(where[full], starts, "right") - 1
        prints = [int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8, key=self.key).digest(), "little") for a, b in zip(offsets[full], offsets[full + 1], strict=True)]
        place = np.arange(len(starts)) - first[full][owner]
        keys = blocks.mix(np.array(prints, np.uint64)[owner] ^ blocks.mix(place.astype(np.uint64)))

        symbols = points[chars]
        low = 0
        for width in WIDTHS:
            some = np.flatnonzero((lengths > max(1, low)) & (lengths <= width))
            low = width
            if len(some):
                matrix = np.full((len(some), width + 2), _NONE, np.int32)
                real = blocks.ranges(starts[some], lengths[some])
                cells = blocks.ranges(np.arange(len(some)) * (width + 2) + 1, lengths[some])
                matrix.reshape(-1)[cells] = symbols[real]
                self.rounds(matrix, keys[some])
                symbols[real] = matrix.reshape(-1)[cells]
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            lo, hi = starts[i], starts[i] + lengths[i]
            got = self.agenda(symbols[lo:hi].tolist(), int(keys[i]))
            symbols[lo:hi] = _NONE
            symbols[lo : lo + len(got)] = got

        left = symbols != _NONE
        counts = np.concatenate(([0], np.cumsum(left)))
        ids, at = symbols[left], counts[where]
        if (ids < 0).any() or (len(self.extra) and (ids >= len(self.bytes)).any()):
            ids, at = self._in_bytes(ids, at)
        return ids, at, self._same(ids, at, data, offsets)

    def _in_bytes(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as their byte pieces."""
        n = len(self.bytes)
        other = np.flatnonzero((ids < 0) | (ids >= n))
        extra = np.array([ord(c) for c in self.extra] or [0], np.int64)
        points = np.where(ids[other] < 0, _OTHER - ids[other].astype(np.int64), extra[np.clip(ids[other] - n, 0, len(extra) - 1)])
        raw = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)
        size = np.ones(len(ids), np.int64)
        size[other] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        to = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(ids, size)
        out[blocks.ranges(to[other], size[other])] = self.byte_ids[raw]
        return out, to[at]

    def _same(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text, whether its ids decode to it."""
        *_, flat, begins, size = self.ready()
        made = flat[blocks.ranges(begins[ids], size[ids])]
        ends = np.concatenate(([0], np.cumsum(size[ids])))[at]
        out = np.zeros(len(at) - 1, bool)
        full = np.diff(ends) > 0
        alike = np.where(full, np.diff(ends) - 1, 0) == np.diff(offsets)
        if alike.all():
            lead = np.zeros(len(made), bool)
            lead[ends[:-1][full]] = True
            right = np.concatenate(([0], np.cumsum(made[~lead] != data)))
            return (np.diff(right[offsets]) == 0) & ((made[lead] == 32).all() if full.any() else True)
        for i in np.flatnonzero(alike):
            out[i] = bytes(made[ends[i] + 1 : ends[i + 1]]) == bytes(data[offsets[i] : offsets[i + 1]])
        return out

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_slice(data, np.array([0, len(data)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        n = len(self.bytes)
        return b"".join([self.bytes[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, codec: Codec, keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """The kept columns (doc_id by default) and n_pieces, ids_crc32, lossless and, if asked for, piece_ids."""
    more = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())]
    if ids:
        more.append(T.StructField("piece_ids", T.ArrayType(T.IntegerType())))
    taken = {f.name.lower() for f in more}
    columns = [F.col(f"`{c}`") for c in (keep or ["doc_id"]) if c.lower() not in taken]
    fields = docs.select(*columns).schema.fields
    n = len(fields)
    names = [f.name for f in fields + more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column(n).is_null().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in blocks.text_slices(batch.column(n), SLICE_BYTES):
                got, places, same = codec.encode_slice(data, offsets)
                raw = got.astype("<i4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(places.tolist(), places[1:].tolist())]  # noqa: B905
                null = missing[lo:hi]
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(n)]
                arrays += [pa.array(np.diff(places), pa.int64(), mask=null), pa.array(np.array(crc, np.int64), mask=null), pa.array(same, mask=null)]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(places.astype(np.int32), mask=np.append(null, False)), pa.array(got)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, T.StructType(fields + more))


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """encoded (doc_id, piece_ids) back to doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))
