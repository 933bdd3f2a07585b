"""Token counts of flat token files: documents run on end to end, an end-of-document id after each, and there is no index.

A file is read as fixed-size blocks. Each block is searched for the separator in one array
pass, which gives the ends of the documents that end in it. A document may have begun in any
earlier block, so block boundaries are stitched by a prefix scan over small summaries (tokens, place of the
last separator): running sums and maxima within runs of ``RUN`` blocks, then over the runs. No
step holds more than one block, or one summary a block.

``write_blocks`` lays documents out so: each input partition is one file. Its doc_ids column names
the documents that end in a block, in order; only the final answer is labelled with it.

A text is encoded in runs of bounded length that end where the pre-tokeniser must end a token anyway: before a blank between two
letters, and around long runs of white space, which are one token's bytes but for the last character. That changes no token.

Defined cases: null and empty texts are documents of 0 tokens; tokens after a file's last separator are an
unfinished document (``scan`` gives it as ``open_tokens`` of the last block); a block without a separator ends nothing;
repeated rows and null ids stay; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern of the vocabulary's public encoder.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END = 50_256
BLOCK_TOKENS = 1 << 16
RUN = 1024
RUN_CHARS = 1 << 20
LONG_SPACE = 1000
_SPACE = " \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BETWEEN = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


class Encoder:
    """A byte-level BPE vocabulary that pickles to executors."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = pattern
        self._encoding = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    def encode(self, text: str, run: int = RUN_CHARS, long_space: int = LONG_SPACE) -> np.ndarray:
        """The ids of a text, as if it were encoded whole."""
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        if len(text) <= long_space:
            return np.array(self._encoding.encode_ordinary(text), np.uint16)
        parts, at = [], 0
        for space in re.finditer(f"[{_SPACE}]{{{long_space},}}", text):
            lo, hi = space.span()
            whole = hi == len(text)
            parts += self._runs(text[at:lo], run)
            parts.append(self._encoding._encode_single_piece(text[lo : hi if whole else hi - 1]))
            at = hi if whole else hi - 1
        parts += self._runs(text[at:], run)
        return np.concatenate([np.array(p, np.uint16) for p in parts]) if parts else np.zeros(0, np.uint16)

    def _runs(self, text: str, run: int) -> list[list[int]]:
        out, at = [], 0
        while at < len(text):
            cut = _BETWEEN.search(text, at + run) if len(text) - at > run else None
            to = cut.start() if cut else len(text)
            out.append(self._encoding.encode_ordinary(text[at:to]))
            at = to
        return out


def write_blocks(docs: DataFrame, encoder: Encoder, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens (binary, little-endian uint16), doc_ids of the documents that end in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        open_parts: list[np.ndarray] = []
        size, ending = 0, []  # ending: (place of the separator, id)

        def cut(tokens: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([tokens.astype("<u2").tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "doc_ids"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.append(encoder.encode(text) if text else np.zeros(0, np.uint16), np.uint16(end))
                open_parts.append(tokens)
                size += len(tokens)
                ending.append((size - 1, doc_id))
                if size >= block_tokens:
                    flat = np.concatenate(open_parts)
                    while size >= block_tokens:
                        yield cut(flat[:block_tokens], [d for at, d in ending if at < block_tokens])
                        ending = [(at - block_tokens, d) for at, d in ending if at >= block_tokens]
                        flat, size, block = flat[block_tokens:], size - block_tokens, block + 1
                    open_parts = [flat]
        if size:
            yield cut(np.concatenate(open_parts), [d for _, d in ending])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "file int, block long, tokens binary, doc_ids array<long>")


def read_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of existing flat files (uint16 ids) under a path: file (its path), block, tokens. One file is read at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer())
                for block, lo in enumerate(range(0, len(view), 2 * block_tokens)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([bytes(view[lo : lo + 2 * block_tokens])], pa.binary())], names=["file", "block", "tokens"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, tokens binary")


def separators(stored: DataFrame, end: int = END) -> DataFrame:
    """The blocks with n_tokens and ends, the places of the separator in each, in place of the tokens."""
    kept = [c for c in stored.columns if c != "tokens"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*kept).schema) + ", n_tokens int, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(len(kept))]
            ends = [np.flatnonzero(b == end).astype(np.int32) for b in blocks]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([len(b) for b in blocks], pa.int32()), pa.array(ends, pa.list_(pa.int32()))], names=[*kept, "n_tokens", "ends"])

    return stored.select(*kept, "tokens").mapInArrow(run, schema)


def scan(found: DataFrame) -> DataFrame:
    """found (file, block, n_tokens, ends, ...) with base (tokens before the block in its file), lengths (of the documents that end here) and open_tokens.

    The prefix scan: within runs of RUN blocks, over the runs, and back. Its windows see one summary a block, or one a run.
    """
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1).cast("long") + 1)
    out = found.withColumn("run", F.floor(F.col("block") / RUN).cast("long"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))
    out = out.withColumn("stop", F.max(F.col("inner") + last).over(before))
    runs = out.groupBy("file", "run").agg(F.sum("n_tokens").cast("long").alias("whole"), F.max(F.col("inner") + last).alias("run_stop"))
    earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_base", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).cast("long"))
    runs = runs.withColumn("run_from", F.coalesce(F.max(F.col("run_base") + F.col("run_stop")).over(earlier), F.lit(0)).cast("long")).drop("whole", "run_stop")
    out = out.join(runs, ["file", "run"])
    base = F.col("run_base") + F.col("inner")
    begun = F.coalesce(F.col("run_base") + F.col("stop"), F.col("run_from"))  # where the document open at the block's start began
    starts = F.concat(F.array(begun - base), F.transform("ends", lambda e: e.cast("long") + 1))
    lengths = F.zip_with("ends", F.slice(starts, 1, F.greatest(F.size("ends"), F.lit(0))), lambda e, s: e - s)
    tail = F.when(F.size("ends") > 0, F.col("n_tokens") - last).otherwise(base + F.col("n_tokens") - begun)
    return out.select(*found.columns, base.alias("base"), F.transform(lengths, lambda x: x.cast("long")).alias("lengths"), tail.cast("long").alias("open_tokens"))


def token_counts(docs: DataFrame, encoder: Encoder, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file, start (token offset in the file) of each row of docs, from files written and then scanned."""
    scratch = Scratch(docs.sparkSession, "tokens")
    stored = scratch.keep(write_blocks(docs, encoder, block_tokens=block_tokens), "blocks")
    found = scratch.keep(separators(stored), "ends")  # small: the blocks themselves can go
    scratch.drop_all_but(found)
    each = scan(found).select("file", F.explode(F.arrays_zip("doc_ids", "lengths", F.transform("ends", lambda e: F.col("base") + e).alias("stops"))).alias("d"))
    return each.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("n_tokens"), "file", (F.col("d.stops") - F.col("d.lengths")).alias("start"))
