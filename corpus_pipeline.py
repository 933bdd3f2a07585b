"""A training-data pipeline: language, near-duplicates, benchmark leaks, personal data, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. run() chains them with each result written and read again.

Defined cases: an empty table passes through as one; null texts go at the language stage, as they
have no language; rows with a null doc_id are near-duplicates of nothing and stay; columns
besides those of documents are carried along up to the last stage, whatever their names. Repeated rows: of rows that are near-duplicates, under one
doc_id or several, one stays; rows without words all stay. Ties: the smallest doc_id, then the least fingerprint. Very long texts
are worked on whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import decontam, langid, minhash, pieces, pii
from leafwork.llm.store import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (und) go; lang becomes the predicted one."""
    found = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    known = langid.identify(docs.withColumn(found, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), langid.fit(docs), keep=[found]).where("lang_pred <> 'und'")
    return known.select(*[(F.col("lang_pred") if c == "lang" else F.col(found)[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with the smallest doc_id (of its rows, one)."""
    return minhash.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets; n_chars follows."""
    return pii.redact(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids_crc32, lossless, piece_ids."""
    return pieces.encode(docs, pieces.Codec.load(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("piece_encoding", piece_encoding),
]

#: Learned models, hashed signatures and keyed merges decide; SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
