"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import Encoder, token_counts

    return token_counts(_table(spark, sf_dir, "documents"), Encoder())


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_labels

    return license_labels(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_ids

    return language_ids(_table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import Codec, encode

    return encode(_table(spark, sf_dir, "documents"), Codec.load())


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_langid": op2_langid,
    "op3_pieces": op3_pieces,
    "op4_urls": op4_urls,
    "op5_tokens": op5_tokens,
    "op6_minhash": op6_minhash,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_decontam": op10_decontam,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    "op6_minhash": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) s from w),
n as (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, b from reach join both_ways on a = r),
least as (select doc_id, min(r) c from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) n_shingles, c component_id, d.doc_id = c kept from documents d join least using (doc_id) left join n using (doc_id)""",
}
