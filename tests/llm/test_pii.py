import hashlib
import random
import re

from leafwork.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [[("email", *m.span()) for m in EMAIL.finditer(text)]]
    out += [[("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]]
    out += [[("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]]
    out += [[("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]]
    return out


def test_base_spans_against_brute_force(spark):
    rng = random.Random(5)
    pieces = ["4111 1111 1111 1111", "a.b@c.de+f@g.hi", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "+49 (30) 123-4567 ", "é中", "@", ".", "5500-0000-0000-0004", "+1", " ", "-", "12", "x", "\n", "4222222222222", "me@x.org", "😀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "1 " * 30000, "a" * 30000, "+1" + " " * 5000]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, code string")
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t or "")
        got = rows[i]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [len(x) for x in want], (t, got)
        told = ",".join(f"{k}:{s}:{e}" for part in want for k, s, e in part)
        assert got.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), t
        assert got.spans.startswith(told) and got.found == bool(got.spans)


def test_method_adds_secrets_and_leaves_prose(spark):
    rows = [(i, f"Some prose here. password={'%016x' % (i * 7919 + 10**15)}e3 and more prose of {1900 + i}.") for i in range(40)]
    rows += [(100 + i, "The chapter 123456 of prose on page 2000-10 and version 10.2 has no one in it.") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("secret:" in got[i] for i in range(40))
    assert all(got[100 + i] == "" for i in range(40))


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "write to me@x.org now", "en", 21), (2, None, "en", 0), (3, "nothing", None, 7)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1].text == "write to [EMAIL] now" and got[1].n_chars == 20
    assert got[2].text is None and got[3].text == "nothing"
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.redact(docs).columns == docs.columns


def test_many_spans_take_linear_steps(spark):
    n = 12_000
    text = " ".join(f"a{i}@b.de" for i in range(n)) + " é " + " ".join(f"key=abc{i:06d}x" for i in range(300))
    docs = spark.createDataFrame([(1, text, "x", "y", "z")], "doc_id long, text string, _text string, _spans string, _digit string")
    got = pii.personal_data(docs).first()
    assert got.n_email == n
    told = [t for t in got.spans.split(",") if t.startswith("email")]
    assert told == [f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(text)]
    new = pii.redact(docs).first()
    assert new.text.startswith("[EMAIL] [EMAIL] ") and new.text.count("[EMAIL]") == n and "@" not in new.text and " é " in new.text
    assert (new["_text"], new["_spans"], new["_digit"]) == ("x", "y", "z")


def test_candidates_without_digits_and_names_beyond_the_list(spark):
    rows = [(i, f"the login has password={'qwertzuiop'[i % 5:]}asdf and so on, {i}.") for i in range(30)]
    rows += [(100 + i, f"please contact Dr. {['Anna', 'Xaver', 'Zoltan'][i % 3]} Meier about it, {i}.") for i in range(30)]
    rows += [(200 + i, "New York is large. The Big Apple it is.") for i in range(30)]
    rows += [(300, "x" * 100 + "1" + "y" * 10 + " token=" + "abcdefgh" * 3)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("secret:" in got[i] for i in range(30)), got
    assert all("name:" in got[100 + i] for i in range(0, 30, 3))
    assert not any(got[200 + i] for i in range(30))


def test_running_folds_of_long_arrays(spark):
    from pyspark.sql import functions as F

    from leafwork.llm import arrays

    rng = random.Random(2)
    rows = [([rng.randint(-5, 9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 100, 101, 1000, 1023)]
    for r in spark.createDataFrame(rows, "x array<int>").select("x", arrays.sums(F.col("x")).alias("s"), arrays.running(F.col("x"), "int", lambda a, b: F.greatest(a, b)).alias("m")).collect():
        assert r.s == [sum(r.x[: i + 1]) for i in range(len(r.x))] and r.m == [max(r.x[: i + 1]) for i in range(len(r.x))]


def test_clear_of_many_spans(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.randint(1, 6)))(rng.randint(0, 400))
    rows = [([(5 * i, 5 * i + rng.randint(1, 5)) for i in range(90)], [span() for _ in range(n)]) for n in (0, 3, 64, 65, 80)]
    kind = "array<struct<start:int,end:int>>"
    for r in spark.createDataFrame(rows, f"s {kind}, o {kind}").select("s", "o", pii._clear(F.col("s"), F.col("o")).alias("c")).collect():
        assert r.c == [s for s in r.s if not any(b.start < s.end and s.start < b.end for b in r.o)]
