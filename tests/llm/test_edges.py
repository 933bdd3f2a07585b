"""Every operator on nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import random

import pytest

from leafwork.llm import decontam, langid, licenses, minhash, pieces, pii, quality, tokenfiles, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, spans string, rep long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["the", "der", "una", "licence", "x9", "naïve", "日本", "a-b", "|"]
    texts = [None, "", " \n\t ", "one", "É", "word " * 30000, "ab" * 40000, "\x00", "a\x00b ▁c", "same text " * 12, "same text " * 12]
    texts += [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    rows = [(i, t, ["en", "de", None, ""][i % 4], None, None, 0.5, None, "z", i) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all for this text", "en", "s", 1, None, True, None, None), rows[9]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def operators(spark, labels):
    bench = spark.createDataFrame([(1, "same text same text same text same text"), (2, None), (3, "a b"), (4, "")], "item_id long, text string")
    codec = pieces.Codec.load()
    return {
        "quality": lambda d: quality.quality_rules(d, labels),
        "langid": langid.language_ids,
        "pieces": lambda d: pieces.encode(d, codec),
        "tokens": lambda d: tokenfiles.token_counts(d, tokenfiles.Encoder(), 512),
        "minhash": minhash.near_duplicates,
        "licenses": licenses.license_labels,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "pii": pii.personal_data,
        "leaks": lambda d: decontam.leaks(d, bench),
    }


@pytest.mark.parametrize("name", ["quality", "langid", "pieces", "tokens", "minhash", "licenses", "toxicity", "pii"])
def test_a_row_for_each_row(operators, docs, name):
    got = operators[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert operators[name](docs.limit(0)).count() == 0
    if name == "pieces":
        assert all(r["lossless"] in (True, None) for r in got)


def test_leaks(operators, docs):
    got = {(r["doc_id"], r["item_id"]) for r in operators["leaks"](docs).collect()}
    assert {g for g in got if g[1] != 3} == {(9, 1), (10, 1)} and {g[0] for g in got if g[1] == 3} <= set(range(8, 23)) and len(got) > 5
    assert operators["leaks"](docs.limit(0)).count() == 0


def test_leak_filter_keeps_columns(spark, docs):
    bench = spark.createDataFrame([(1, "same text same text same text same text")], "item_id long, text string")
    left = decontam.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontam.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.net/x", "h", 1.0), (2, None, "h", 1.0), (3, "", None, None), (4, "ftp", None, None), (None, "https://m.example.NET/en/1?q", None, None), (6, "https://b.org/fr/1", None, None), (6, "https://b.org/fr/1", None, None)], "page_id long, url string, host string, score double")
    got = urls.url_verdicts(pages).collect()
    assert len(got) == 7 and all(r["verdict"] in ("allow", "block") for r in got)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("a.net", "/x", "net/", "block")
    assert (by[None]["rule"], by[None]["verdict"]) == ("example.net/en/", "allow")
    assert (by[2]["host"], by[2]["path"], by[2]["rule"]) == ("", "", None)
    assert urls.url_verdicts(pages.limit(0)).count() == 0


def test_toxicity_without_labels(spark, docs, labels):
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_quality_without_labels(spark, docs, labels):
    got = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_language_without_labels(docs):
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in langid.language_ids(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
