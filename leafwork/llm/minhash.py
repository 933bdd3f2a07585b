"""Near-duplicates of word shingles: MinHash, banding, verification on full sets, large-star and small-star components.

Definition. A-Z is lower-cased; words are runs of ``[^\\x20\\x09-\\x0D]``. A document's set
holds its distinct five-word shingles; a shorter document has its whole word sequence as
its one shingle; a null or wordless one has the empty set. Documents are linked when
``100 * |A & B| >= 75 * |A | B|``; a component is what links reach.

Plan, with no list of all pairs at any point:

1. One Arrow pass gives each row its set size, a 128-bit fingerprint of the set and
   ``hashes`` minima of universal multiply-add hashes (the top 32 bits of each).
2. Rows with equal fingerprints form a class; only one row with its smallest doc_id goes on. So a group
   of exact copies, however large, is one row from here. A class is known by that doc_id or, where several
   classes have the same (repeated ids with different texts), by it and a number.
3. Bands of the signature are bucket keys. In each bucket every class is paired with the
   bucket's pivot, the member that shares most buckets with others; pairs that the signatures leave possible are confirmed on full sets.
   Components come from the confirmed links. Then classes outside of their pivot's
   component get a second pivot, and last, all pairs of a bucket whose classes are still in
   different components are compared, so that no link is lost to the choice of pivots:
   links inside one component change nothing.

With 300 hashes in 50 bands of 6 a pair at similarity 0.75 escapes all buckets with
probability 6e-5, and the signature filter (an estimate below 0.67) with 7e-4; both fall fast above.

Nulls and ties: rows with a null doc_id keep a null component_id and stay (kept is true);
rows that repeat a doc_id are documents of their own with the same id, linked by their own texts, and both stay if
that id is the smallest of its component; an empty table gives an empty result. ``deduplicated`` keeps one row of each component,
and all rows without words or without an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .store import Scratch

SHINGLE = 5
PERCENT = 75
HASHES, ROWS_PER_BAND = 300, 6
SEED = 20240229
LEAST_ESTIMATE = 0.67

FEATURES = "doc_id long, n_shingles long, fp_a long, fp_b long, signature array<int>"


def coefficients(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 1 << 64, hashes, np.uint64, endpoint=False) | np.uint64(1)
    return a, draw.integers(0, 1 << 64, hashes, np.uint64, endpoint=False)


def shingle_sets(words: blocks.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and their offsets."""
    hashes, first = words.hash, words.first
    grams = blocks.windows(hashes, size)
    parts, counts = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        lo, hi = first[i], first[i + 1]
        n = hi - lo
        if n >= size:
            part = np.sort(grams[lo : hi - size + 1])
            fresh = part[1:] != part[:-1]
            if not fresh.all():
                part = part[np.concatenate(([True], fresh))]
        elif n:
            part = blocks.mix(blocks.windows(hashes[lo:hi], int(n)) ^ np.uint64(n))
        else:
            continue
        parts.append(part)
        counts[i] = len(part)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(counts)))


def signatures(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp_a, fp_b, minima) of each non-empty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(a)), np.int32)
    minima = np.empty((len(starts), len(a)), np.uint64)
    work = np.empty_like(flat)
    for k in range(len(a)):
        np.multiply(flat, a[k], out=work)
        work += b[k]
        minima[:, k] = np.minimum.reduceat(work, starts)
    fp_a = np.add.reduceat(blocks.mix(flat ^ np.uint64(0xA0761D6478BD642F)), starts)
    fp_b = np.bitwise_xor.reduceat(blocks.mix(flat ^ np.uint64(0xE7037ED1A0B428DB)), starts)
    return fp_a.view(np.int64), fp_b.view(np.int64), (minima >> np.uint64(32)).astype(np.uint32).view(np.int32)


def features(docs: DataFrame, hashes: int = HASHES, seed: int = SEED) -> DataFrame:
    """One row per row of docs: set size, fingerprint and signature (null for an empty set)."""
    a, b = coefficients(hashes, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words in blocks.word_slices(batch.column(1), blocks.WHITE, blocks.LOWER):
                flat, offsets = shingle_sets(words)
                fp_a, fp_b, minima = signatures(flat, offsets, a, b)
                n = np.diff(offsets)
                full = n > 0
                where = np.full(hi - lo + 1, len(fp_a) * len(a), np.int64)
                place = np.zeros(hi - lo, np.int64)
                place[full] = np.arange(len(fp_a))
                where[:-1] = (np.cumsum(full) - full) * len(a)
                put = lambda x: pa.array(x[place] if len(x) else np.zeros(hi - lo, np.int64), mask=~full)
                lists = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(minima.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), put(fp_a), put(fp_b), lists], names=["doc_id", "n_shingles", "fp_a", "fp_b", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FEATURES)


def shingle_arrays(docs: DataFrame) -> DataFrame:
    """docs (with text, without its column) with fp_a, fp_b (null for an empty set) and shingles: distinct shingle hashes of each row."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    fields = [*kept, T.StructField("fp_a", T.LongType()), T.StructField("fp_b", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in blocks.word_slices(batch.column(len(kept)), blocks.WHITE, blocks.LOWER):
                flat, offsets = shingle_sets(words)
                full = np.diff(offsets) > 0
                prints = [np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)]
                for put, got in zip(prints, signatures(flat, offsets, none, none), strict=False):
                    put[full] = got
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[: len(kept)]], *[pa.array(x, mask=~full) for x in prints], lists], names=[f.name for f in fields])

    return docs.select(*[f"`{f.name}`" for f in kept], "text").mapInArrow(run, T.StructType(fields))


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of an edge: the smallest node reachable, by alternating large-star and small-star.

    edges: columns a, b (long). Each half-round is one aggregation and one join by node, and
    its result is written to the shared folder. Only row counts reach the driver.
    """
    current = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = scratch.keep(small, "small")
        scratch.drop(current)
        scratch.drop(large)
        current = small
        # done once the edges are stars: no node has two targets, and no target has one
        inner = small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1)
        if small.count() == small.select("a").distinct().count() and inner.isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _agreement(x: str, y: str) -> Column:
    same = F.zip_with(x, y, lambda p, q: (p == q).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, v: s + v)


def _sizes_allow(x: str, y: str, percent: int) -> Column:
    """|A & B| <= min, |A | B| >= max: a pair beyond this can't be linked."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, hashes: int = HASHES, rows_per_band: int = ROWS_PER_BAND, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (columns doc_id and text; others are ignored)."""
    return judged(docs, percent, hashes, rows_per_band, seed).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component. Texts move only for ids that stand in several rows."""
    verdicts = judged(docs, **options).where("doc_id is not null")
    scratch = Scratch(docs.sparkSession, "deduplicated")
    ids = scratch.keep(verdicts.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.max("kept").alias("_any")), "ids")
    # written by themselves, so that their size tells whether they can go to the texts
    apart = scratch.keep(ids.where("not _any or _rows > 1").select("_id"), "apart")
    plain = docs.join(apart, F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    again = ids.where("_any and _rows > 1")
    if again.isEmpty():
        return plain
    # an id of several rows: the fingerprint tells which of them stay, and of equal ones one does
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = shingle_arrays(named.join(again.select(F.col("_id").alias("doc_id")), "doc_id", "left_semi")).drop("shingles")
    stay = verdicts.where("kept").select(*[F.col(c).alias(c + "_") for c in ("doc_id", "fp_a", "fp_b")]).distinct()
    rows = rows.join(stay, (F.col("doc_id") == F.col("doc_id_")) & F.col("fp_a").eqNullSafe(F.col("fp_a_")) & F.col("fp_b").eqNullSafe(F.col("fp_b_")), "left_semi")
    once = rows.where("fp_a is not null").dropDuplicates(["doc_id", "fp_a", "fp_b"])
    # two classes of one component may have the same smallest id
    per_component = verdicts.where("kept and fp_a is not null").groupBy("component").agg(F.min(F.struct("fp_a", "fp_b")).alias("p")).select(F.col("p.fp_a").alias("fp_a"), F.col("p.fp_b").alias("fp_b"))
    once = once.join(per_component, ["fp_a", "fp_b"], "left_semi")
    return plain.unionByName(once.unionByName(rows.where("fp_a is null")).select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def judged(docs: DataFrame, percent: int = PERCENT, hashes: int = HASHES, rows_per_band: int = ROWS_PER_BAND, seed: int = SEED) -> DataFrame:
    """near_duplicates() with fp_a and fp_b, the fingerprint of each row's set, and component, the class that names it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bands = hashes // rows_per_band
    # the bands' keys come from whole minima; of those a byte each is kept: equal minima have equal bytes, so the estimate never falls, and links are confirmed on full sets
    keys = F.when(F.col("signature").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows_per_band + 1, rows_per_band))))
    short = F.transform("signature", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    feats = scratch.keep(features(base, hashes, seed).select("doc_id", "n_shingles", "fp_a", "fp_b", short.alias("signature"), keys.alias("keys")), "features")
    known = feats.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("fp_a", "fp_b", "doc_id").agg(F.count("*").alias("rows"), F.first("n_shingles").alias("n"))
    classes = scratch.keep(classes.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("doc_id"), F.min_by("rows", "doc_id").alias("rows"), F.first("n").alias("n")), "classes")
    # nodes are ordered as the smallest ids of their classes: a component's least node tells its smallest id
    spread = classes.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    stored = classes
    if spread == 1:
        classes = classes.withColumn("rep", F.col("doc_id"))
    else:
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("fp_a", "fp_b")) - 1
        classes = stored = scratch.keep(classes.withColumn("rep", (F.col("doc_id").cast("decimal(20,0)") * F.lit(spread).cast("decimal(17,0)") + number.cast("decimal(17,0)")).cast("decimal(38,0)")), "named")
    repeated = not classes.where("rows > 1").isEmpty()
    once = (lambda df: df.dropDuplicates(["rep"])) if repeated else (lambda df: df)
    reps = once(known.join(classes.select("fp_a", "fp_b", "doc_id", "rep"), ["fp_a", "fp_b", "doc_id"]).select("fp_a", "fp_b", "doc_id", "rep", F.col("n_shingles").alias("n"), "signature", "keys"))

    bands = reps.select(F.explode("keys").alias("key"), "rep", "n")
    crowded = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    joint = scratch.keep(bands.join(crowded, "key"), "joint")
    # how many others a class meets over all buckets: the middle of a group of copies has the most
    buckets = scratch.keep(joint.join(joint.groupBy("rep").agg(F.sum("members").alias("meets")), "rep").drop("members"), "buckets")
    scratch.drop(joint)
    middle = F.max(F.struct("meets", F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"))).alias("p")
    shared = buckets.groupBy("key").agg(middle).select("key", "p.pivot", "p.pivot_n")
    signed = scratch.keep(reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "fp_a", "fp_b", "n", "signature", "keys"), "signed")

    def possible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) whose signatures leave the link possible."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        left = signed.select(F.col("rep").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
        right = signed.select(F.col("rep").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
        return pairs.join(left, "a").join(right, "b").where(_agreement("sa", "sb") >= int(LEAST_ESTIMATE * hashes)).select("a", "b", "na", "nb")

    if spread == 1:
        wanted = base.join(signed.select("doc_id", "rep", F.col("fp_a").alias("want_a"), F.col("fp_b").alias("want_b")), "doc_id")
        sets = shingle_arrays(wanted).where("fp_a = want_a and fp_b = want_b")
    else:  # an id of many texts meets its classes by fingerprint
        sets = shingle_arrays(base.join(signed.select("doc_id"), "doc_id", "left_semi")).join(signed.select("doc_id", "fp_a", "fp_b", "rep"), ["doc_id", "fp_a", "fp_b"])
    one_set = scratch.keep(once(sets.select("rep", "shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = one_set.select(F.col("rep").alias("a"), F.col("shingles").alias("xa"))
        right = one_set.select(F.col("rep").alias("b"), F.col("shingles").alias("xb"))
        both = F.size(F.array_intersect("xa", "xb"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")

    def grouped(links: DataFrame) -> DataFrame:
        return scratch.keep(connected_components(links, scratch), "components")

    def so_far(components: DataFrame) -> DataFrame:
        return components.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def placed(components: DataFrame) -> DataFrame:
        """Buckets with the component of each member."""
        return buckets.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    star = buckets.join(shared, "key").where(_sizes_allow("n", "pivot_n", percent)).select(F.col("rep").alias("x"), F.col("pivot").alias("y"))
    links = scratch.keep(confirmed(possible(star)), "links")
    components = grouped(links)

    # second pivots, among the classes outside of the first pivot's component
    where = components.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_component"))
    loose = placed(components).join(shared.select("key", "pivot"), "key").join(where, "pivot", "left").where(F.col("component") != F.coalesce("pivot_component", "pivot"))
    loose = scratch.keep(loose.select("key", "rep", "n", "meets"), "loose")
    second = loose.groupBy("key").agg(F.count("*").alias("members"), middle).where("members > 1").select("key", "p.pivot", "p.pivot_n")
    star = loose.join(second, "key").where(_sizes_allow("n", "pivot_n", percent)).select(F.col("rep").alias("x"), F.col("pivot").alias("y"))
    links = scratch.keep(confirmed(possible(star)).unionByName(so_far(components)), "links")
    components = grouped(links)

    # the rest: members of one bucket in different components
    at = placed(components)
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = scratch.keep(at.select("key", "rep", "component").join(mixed, "key", "left_semi").join(signed, "rep"), "mixed")
    side = lambda x: rest.select("key", *[F.col(c).alias(c + x) for c in ("rep", "n", "component", "signature", "keys")])
    p, q = side("_x"), side("_y")
    # a pair counts in the first bucket that it shares
    first = F.element_at("keys_x", F.array_position(F.zip_with("keys_x", "keys_y", lambda x, y: x == y), True).cast("int")) == p["key"]
    alike = _agreement("signature_x", "signature_y") >= int(LEAST_ESTIMATE * hashes)
    close = p.join(q, (p["key"] == q["key"]) & (F.col("component_x") < F.col("component_y")) & _sizes_allow("n_x", "n_y", percent) & first & alike)
    swap = F.col("rep_x") > F.col("rep_y")
    pick = lambda c, x, y: F.when(swap, F.col(c + y)).otherwise(F.col(c + x))
    more = close.select(pick("rep", "_x", "_y").alias("a"), pick("rep", "_y", "_x").alias("b"), pick("n", "_x", "_y").alias("na"), pick("n", "_y", "_x").alias("nb"))
    links = scratch.keep(confirmed(more).unionByName(so_far(components)), "links")
    components = grouped(links)

    scratch.drop_all_but(feats, stored, components)

    final = classes.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp_a", "fp_b", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n_shingles", "fp_a", "fp_b").join(final, ["fp_a", "fp_b"], "left")
    least = F.col("component") if spread == 1 else F.floor(F.col("component") / F.lit(spread).cast("decimal(17,0)")).cast("long")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(least, "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
