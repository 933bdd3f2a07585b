"""Personal data: exact base spans, and further spans by weak supervision. DataFrame functions only.

Base kinds, leftmost and non-overlapping per kind (a failing match is dropped, never retried):
email, ip (each part at most 255), card (13 to 19 digits that pass Luhn), phone (9 to 15
digits). Spans are code points, the end exclusive.

Further spans. Candidates: tokens with a digit, what stands after a secret's name and ``=`` or ``:``, and pairs of
capitalised words. Labelers vote on each one (yes, no, abstain): a strict format, the token's make-up, the words before it, gazetteers
(prefixes and ordinary numbers; first names), and the characters before it. Votes of all candidates of the corpus are counted by
pattern; for tokens and for names apart, expectation-maximisation over the counts estimates each labeler's reliability and
each pattern's posterior; a logistic span classifier is then fitted to the posteriors. Besides the votes it sees what no labeler
does: the candidate's length, letter case, signs and the character before it. Patterns are at most 2 * 3**5 * ``SHAPES``, so what
the driver gets does not grow with the corpus. A candidate that overlaps a base span is left out, and of overlapping candidates the first kind's stays.

The regular expressions are the contract's, made linear: possessive where nothing can be
given back, and started only where a run starts or the last match ended.

Nulls: a null text counts as empty; null ids stay. Repeated rows are judged one by one. Other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import earlier, let, running, sums
from .store import Scratch

_LOCAL = r"A-Za-z0-9._%+\-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# Labelers' word lists.
FIRST_NAMES = (
    "Adam Alice Andrea Anna Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emily Emma Eva Felix Francesco Frank George Hans "
    "Helen Henry Isabel Jack James Jan Jane Jean Jennifer John Jorge Joseph Juan Julia Karl Kevin Laura Linda Louis Lucia Luis Maria Marie Martin Mary Michael "
    "Miguel Monika Nicole Oliver Pablo Patricia Paul Peter Pierre Richard Robert Sabine Sandra Sarah Sofia Sophie Stefan Susan Thomas Ursula William"
).split()
SECRET_WORDS = "password|passwd|pwd|passwort|contraseña|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization"
PERSON_WORDS = "ssn|social security|iban|account|konto|cuenta|compte|passport|passnummer|tax id|driver|licence no|license no|patient|customer id|member id|born|name is|mr\\.?|mrs\\.?|ms\\.?|dr\\.?|herr|frau|señor|señora|monsieur|madame|contact|signed"
PLAIN_WORDS = "page|pages|chapter|section|figure|fig\\.?|table|version|release|year|vol\\.?|volume|issue|step|room|part|line|item|no\\.|isbn|doi"
TOKEN_PREFIXES = "sk-|pk-|ghp_|gho_|AKIA|ASIA|xox[abp]-|AIza|eyJ|ya29"
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"

TOKEN = r"(?<![A-Za-z0-9_/+\-])[A-Za-z_/+\-]*+[0-9][A-Za-z0-9_/+\-]*+"
KEYED = r"(?i)(?<=(?:password|passwd|pwd|passwort|contraseña|secret|token|key)[\x20\"']{0,2}[=:][\x20\"']{0,2})[^\x00-\x20\"'=:,;<>()\[\]]{6,}+"
KEYED_GATE = r"(?i)(?:passw|pwd|contrase|secret|token|key)[a-zñ]{0,4}+[\x20\"']{0,2}[=:]"
NAME = r"(?<![A-Za-z])[A-Z][a-z]++\x20[A-Z][a-z]++(?![A-Za-z])"

LABELERS = 5
#: What only the classifier sees, as the digits of a number: mixed letters and digits, capitals, signs, length, the character before.
SHAPE = (2, 2, 2, 4, 4)
SHAPES = int(np.prod(SHAPE))
PATTERNS = 3**LABELERS * SHAPES
CONTEXT = 28


def found(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, end, match, before>> of the matches of a pattern; gate says where one is possible at all.

    The gaps between matches are split() by the same pattern; positions are the running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("g"))
    told = lambda p, end: F.struct((end - F.char_length(p["m"])).alias("start"), end.alias("end"), p["m"].alias("match"), F.right(p["g"], F.lit(CONTEXT)).alias("before"))
    listed = let(F.filter(pairs, lambda p: p["m"].isNotNull()), lambda pairs: F.zip_with(pairs, sums(F.transform(pairs, lambda p: F.char_length(p["g"]) + F.char_length(p["m"]))), told))
    return F.when(gate, listed).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,before:string>>"))


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, 1).cast("int")
    part = F.transform(places, lambda i: F.when(i % 2 == 1, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, v: a + v) % 10 == 0


def _kept(kind: str, spans: Column) -> Column:
    if kind == "ip":
        return F.filter(spans, lambda s: F.forall(F.split(s["match"], r"\."), lambda p: (F.char_length(F.ltrim(F.lit("0"), p)) <= 3) & (p.try_cast("int") <= 255)))
    if kind == "card":
        digits = lambda s: F.regexp_replace(s["match"], r"[\x20-]", "")
        return F.filter(spans, lambda s: F.when(F.char_length(digits(s)).between(13, 19), _luhn(digits(s))).otherwise(False))
    if kind == "phone":
        return F.filter(spans, lambda s: F.char_length(F.regexp_replace(s["match"], "[^0-9]", "")).between(9, 15))
    return spans


def _own(docs: DataFrame) -> DataFrame:
    """The rows of docs as one column _row, with _text, the non-null text: no other column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))


def base_spans(own: DataFrame) -> DataFrame:
    """own (with _text) with columns _email, _ip, _card, _phone: their base spans."""
    text = F.col("_text")
    out = own.withColumn("_digit", text.rlike("[0-9]"))
    gates = {"email": text.contains("@"), "ip": F.col("_digit") & text.rlike(r"[0-9]\.[0-9]"), "card": F.col("_digit"), "phone": F.col("_digit") & text.contains("+")}
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        out = out.withColumn(f"_{kind}", found(text, pattern, gates[kind]))
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", _kept(kind, F.col(f"_{kind}")))
    return out


def _vote(yes: Column, no: Column) -> Column:
    """2 for yes, 1 for no, 0 for an abstention."""
    return F.when(yes, 2).when(no, 1).otherwise(0)


def _code(name: bool, span: Column) -> Column:
    """Kind of candidate, votes and shape of a candidate as one number."""
    token, before = span["match"], F.lower(span["before"])
    near = lambda words: before.rlike(rf"(?<![a-z])(?:{words})[^a-z]{{0,6}}$")
    mixed = token.rlike("[A-Za-z]") & token.rlike("[0-9]")
    if name:
        first = F.array_contains(F.array(*map(F.lit, FIRST_NAMES)), F.split(token, " ")[0])
        votes = [
            _vote(before.rlike(r"(?<![a-z])(?:mr|mrs|ms|dr|prof|herr|frau|señora?|monsieur|madame)\.? $"), F.lit(False)),
            _vote(F.lit(False), span["before"].rlike("[A-Z][a-z]+ $")),
            _vote(near(PERSON_WORDS), near(PLAIN_WORDS)),
            _vote(first, ~first),
            _vote(span["before"].rlike("[a-z,:] ?$"), span["before"].rlike("(?:^|[.!?\n][\x20\"']*)$")),
        ]
    else:
        strict = token.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | token.rlike(rf"^(?:{IBAN_COUNTRIES})[0-9]{{2}}[A-Z0-9]{{11,30}}$")
        votes = [
            _vote(strict, token.rlike("^[A-Za-z]+[0-9]{1,2}$")),
            _vote(mixed & (F.char_length(token) >= 16) & ~token.rlike("[A-Za-z]{12}"), token.rlike("^[0-9]{1,4}[a-z]*$") | token.rlike("[A-Za-z]{12}")),
            _vote(near(SECRET_WORDS) | near(PERSON_WORDS), near(PLAIN_WORDS)),
            _vote(token.rlike(rf"^(?:{TOKEN_PREFIXES})"), token.rlike(r"^(?:1[5-9]|20)[0-9]{2}(?:[/-][0-9]{1,4}){0,2}$")),
            _vote(span["before"].rlike("[=:][\\x20\"']{0,2}$"), span["before"].rlike("[A-Za-z.,] ?$")),
        ]
    size, last = F.char_length(token), F.right(span["before"], F.lit(1))
    shape = [
        mixed.cast("int"),
        token.rlike("[A-Z]").cast("int"),
        token.rlike("[^A-Za-z0-9 ]").cast("int"),
        F.when(size < 9, 0).when(size < 16, 1).when(size < 24, 2).otherwise(3),
        F.when(last == " ", 0).when(last.isin("=", ":"), 1).when(last.rlike("[\"'(\\[]"), 2).otherwise(3),
    ]
    code = F.lit(int(name))
    for radix, digit in [*[(3, v) for v in votes], *zip(SHAPE, shape, strict=True)]:
        code = code * radix + digit
    return code


def _kind_of(span: Column) -> Column:
    token = span["match"]
    return F.when(token.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(token.rlike(rf"^(?:{IBAN_COUNTRIES})[0-9]{{2}}[A-Z0-9]{{11,30}}$"), "iban").when(token.contains(" "), "name").otherwise("secret")


def with_candidates(own: DataFrame) -> DataFrame:
    """Adds the base spans and _cand: array<struct<start, end, kind, code>>, without what overlaps a base span or an earlier kind of candidate."""
    text = F.col("_text")
    out = base_spans(own).withColumn("_tokens", F.filter(found(text, TOKEN, F.col("_digit")), lambda s: F.char_length(s["match"]) >= 6))
    out = out.withColumn("_keyed", found(text, KEYED, text.rlike(KEYED_GATE))).withColumn("_names", found(text, NAME, text.rlike(NAME)))
    ends = lambda *columns: F.concat(*[F.transform(c, lambda s: F.struct(s["start"], s["end"])) for c in columns])
    base = [f"_{k}" for k in KINDS]
    for column, others in (("_tokens", base), ("_keyed", [*base, "_tokens"]), ("_names", [*base, "_tokens", "_keyed"])):
        out = out.withColumn(column, _clear(F.col(column), ends(*others)))
    one = lambda name: lambda s: F.struct(s["start"], s["end"], _kind_of(s).alias("kind"), _code(name, s).alias("code"))
    return out.withColumn("_cand", F.concat(F.transform("_tokens", one(False)), F.transform("_keyed", one(False)), F.transform("_names", one(True)))).drop("_tokens", "_keyed", "_names", "_digit")


def _clear(spans: Column, others: Column) -> Column:
    """Spans (in order) that overlap none of the others: with few others each is looked at; else by a merge of both by place and a running maximum of ends."""
    few = lambda spans, others: F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def many(spans: Column, others: Column) -> Column:
        # an entry for each span's end and each other's start, others after spans at the same place: the farthest end of others that start before a span's end
        mine = F.transform(spans, lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("side"), i.alias("i"), F.lit(-1).alias("far")))
        theirs = F.transform(others, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("side"), F.lit(-1).alias("i"), b["end"].alias("far")))
        return let(F.array_sort(F.concat(mine, theirs)), lambda both: let(
            running(F.transform(both, lambda x: x["far"]), "int", lambda a, b: F.greatest(a, b)),
            lambda far: let(F.transform(F.filter(F.zip_with(both, far, lambda x, f: F.struct(x["i"].alias("i"), f.alias("f"))), lambda x: x["i"] >= 0), lambda x: x["f"]), lambda f: F.filter(spans, lambda s, i: F.get(f, i) <= s["start"])),
        ))

    return let(spans, lambda s: let(others, lambda o: F.when((F.size(s) == 0) | (F.size(o) == 0), s).when(F.size(o) <= 64, few(s, o)).otherwise(many(s, o))))


def _digits(code: int) -> tuple[list[int], list[int]]:
    """Votes and shape of a pattern."""
    out = []
    for radix in [*SHAPE[::-1], *[3] * LABELERS]:
        code, digit = divmod(code, radix)
        out.append(digit)
    return out[: len(SHAPE) - 1 : -1], out[len(SHAPE) - 1 :: -1]


def _votes(code: int) -> list[int]:
    return _digits(code)[0]


def reliabilities(counts: dict[int, int], rounds: int = 60) -> tuple[float, np.ndarray, dict[int, float]]:
    """(prior, P(vote | class) of each labeler, posterior by code) by expectation-maximisation over counted patterns.

    Votes are taken as independent given the class. The start trusts each labeler somewhat
    and the counts get one pseudo-vote each in that sense, so classes can't swap.
    """
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    votes = np.array([_votes(c) for c in codes]).reshape(-1, LABELERS)
    start = np.array([[[0.5, 0.4, 0.1], [0.5, 0.1, 0.4]]] * LABELERS)
    tables, prior = start.copy(), 0.5
    posterior = np.zeros(len(codes))
    for _ in range(rounds if codes else 0):
        score = np.log([1 - prior, prior])[None, :] + np.log(tables[np.arange(LABELERS)[:, None], :, votes.T]).sum(0)
        posterior = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        for k in range(LABELERS):
            for c, p in enumerate((1 - posterior, posterior)):
                total = np.bincount(votes[:, k], weight * p, 3) + 4 * start[k, c]
                tables[k, c] = total / total.sum()
        prior = float(((weight * posterior).sum() + 1) / (weight.sum() + 2))
    return prior, tables, dict(zip(codes, posterior.tolist(), strict=True))


def features(code: int) -> list[float]:
    """What the classifier sees of a pattern: a constant, two for each labeler (no, yes), and one for each value of each shape digit."""
    votes, shape = _digits(code)
    out = [1.0]
    for v in votes:
        out += [float(v == 1), float(v == 2)]
    for size, digit in zip(SHAPE, shape, strict=True):
        out += [float(digit == k) for k in range(size)]
    return out


def span_classifier(counts: dict[int, int], posterior: dict[int, float], steps: int = 400) -> np.ndarray:
    """Weights over features(), of a logistic regression fitted to the posteriors; without candidates all is rejected."""
    codes = sorted(counts)
    if not codes:
        return np.array([-50.0] + [0.0] * (len(features(0)) - 1))
    x = np.array([features(c) for c in codes])
    y = np.array([posterior[c] for c in codes])
    weight = np.sqrt([counts[c] for c in codes])
    weight /= weight.sum()
    w, memory = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (weight * (p - y)) + 1e-4 * w
        memory += g * g
        w -= 0.5 * g / np.sqrt(memory)
    return w


def _logit(code: Column, w: np.ndarray) -> Column:
    """The classifier's logit of a pattern."""
    total, at, below = F.lit(float(w[0])), 1, code
    parts = []
    for _ in range(LABELERS):
        parts.append((3, [0.0, float(w[at]), float(w[at + 1])]))
        at += 2
    for size in SHAPE:
        parts.append((size, w[at : at + size].tolist()))
        at += size
    for radix, values in parts[::-1]:
        total = total + F.element_at(F.array(*map(F.lit, values)), (F.pmod(below, F.lit(radix)) + 1).cast("int"))
        below = F.floor(below / radix).cast("int")
    return total


Classifier = tuple[np.ndarray, np.ndarray]  # of tokens, of names


def classifiers(counts: dict[int, int]) -> Classifier:
    """By kind of candidate, from the counts of the patterns."""
    out = []
    for name in (0, 1):
        mine = {c - name * PATTERNS: n for c, n in counts.items() if c // PATTERNS == name}
        out.append(span_classifier(mine, reliabilities(mine)[2]))
    return out[0], out[1]


def _fitted(candidates: DataFrame) -> Classifier:
    # explode() would have the optimiser test each text's candidates in a filter of its own, and so find them twice or more
    rows = candidates.select(F.explode_outer("_cand.code").alias("code")).where("code is not null").groupBy("code").count().collect()
    return classifiers({r["code"]: r["count"] for r in rows})


def fit(docs: DataFrame) -> Classifier:
    """The span classifiers of a corpus: vote patterns are counted over every candidate of every text."""
    return _fitted(with_candidates(_own(docs.select("text"))))


def accepted(candidates: DataFrame, classifier: Classifier, least: float = 0.5) -> DataFrame:
    """_more (array<struct<start, end, kind>>), the further spans, in place of _cand."""
    cut = float(np.log(least / (1 - least)))
    yes = lambda s: F.when(s["code"] < PATTERNS, _logit(s["code"], classifier[0])).otherwise(_logit(s["code"] - PATTERNS, classifier[1])) >= cut
    return candidates.withColumn("_more", F.array_sort(F.transform(F.filter("_cand", yes), lambda s: F.struct(s["start"], s["end"], s["kind"])))).drop("_cand")


def _told(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def personal_data(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (whether there is any span): one row per row of docs.

    Spans and candidates are found once and kept.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    spans = [F.transform(f"_{k}", lambda s: F.struct(s["start"], s["end"])).alias(f"_{k}") for k in KINDS]
    kept = scratch.keep(with_candidates(_own(docs.select("doc_id", "text"))).select(F.col("_row.doc_id").alias("doc_id"), *spans, "_cand"), "spans")
    found_all = accepted(kept, _fitted(kept) if classifier is None else classifier)
    base = F.concat(*[_told(k) for k in KINDS])
    further = F.transform(F.array_sort(F.transform("_more", lambda s: F.struct(s["kind"], s["start"], s["end"]))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found_all.select("doc_id", *counts, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", base, further).alias("spans"), (F.size(base) + F.size("_more") > 0).alias("found"))


def redact(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; other columns stay, but n_chars (if there) follows the new text.

    Overlapping spans become one, named by the first. Texts without spans (and null texts) stay as they are.
    """
    found_all = accepted(with_candidates(_own(docs)), fit(docs) if classifier is None else classifier)
    named = lambda k: F.transform(f"_{k}", lambda s: F.struct(s["start"], s["end"], F.lit(k).alias("kind")))
    text, size = F.col("_text"), F.size("_spans")
    # of spans in order, those that begin behind all earlier ones, with the end of these
    ends = earlier(running(F.transform("_spans", lambda s: s["end"]), "int", lambda a, b: F.greatest(a, b)), F.lit(0))
    heads = F.filter(F.zip_with("_spans", ends, lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("from"))), lambda s: s["start"] >= s["from"])
    # cutting one piece out of a text takes a walk from its start: for many spans the characters are listed first
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    label = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))

    def put(piece: Callable[[Column, Column], Column]) -> Column:
        return F.concat(F.array_join(F.transform("_heads", lambda s: F.concat(piece(s["from"], s["start"] - s["from"]), label(s))), ""), piece(last, F.char_length(text) - last))

    whole = F.when(size <= 64, put(lambda at, n: text.substr(at + 1, n))).otherwise(let(chars, lambda c: put(lambda at, n: F.array_join(F.slice(c, at + 1, n), ""))))
    out = found_all.withColumn("_spans", F.array_sort(F.concat(*map(named, KINDS), F.col("_more")))).withColumn("_heads", heads).withColumn("_new", F.when(size > 0, whole))
    columns = []
    for c in docs.columns:
        value = F.col("_row")[c]
        if c == "text":
            value = F.coalesce("_new", value.cast("string"))
        elif c == "n_chars":
            value = F.when(F.col("_new").isNotNull(), F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
