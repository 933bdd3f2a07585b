"""Methods against brute force, exact round trips and planted cases."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafwork.llm import blocks, decontam, langid, licenses, minhash, pieces, quality, tokenfiles, toxicity, urls

RNG = random.Random(7)
SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "ves", "zor", "pha", "bri", "dun"]


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_words_and_hashes():
    texts = ["a B\tb \x0b\x1fc\xa0d", "", None, "é中 x", " ", "b"]
    seen = {}
    for lo, hi, data, offsets in blocks.text_slices(pa.array(texts), 4):
        words = blocks.Words(data, offsets, blocks.WHITE, blocks.EXACT)
        for i in range(lo, hi):
            want = (texts[i] or "").encode().split()
            a, b = words.first[i - lo], words.first[i - lo + 1]
            assert [bytes(data[s:e]) for s, e in zip(words.starts[a:b], words.ends[a:b])] == want
            for w, h in zip(want, words.hash[a:b]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = prose(rng.randint(30, 120), rng).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(SYLLABLES)
            texts.append(" ".join(copy).title() if rng.random() < 0.2 else " ".join(copy))
    texts += ["a b", "A  b", "a b c d", "", None, "x " * 500, "x " * 700]
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (find(i) == i) for i in range(len(texts)))


def test_repeated_ids_keep_their_own_texts(spark):
    t1, t2 = prose(60, random.Random(1)), prose(60, random.Random(2))
    near = " ".join([*t2.split()[:-1], "other"])
    rows = [(1, t1), (5, t2), (5, t1), (7, t2), (9, near), (5, t2), (None, t1), (11, None), (11, None), (12, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (11, 11, True), (12, 12, True)]
    kept = [tuple(r) for r in minhash.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, t1), (5, t2), (None, t1), (11, None), (11, None), (12, " ")], key=str)


def test_pairs_at_the_threshold_are_linked(spark):
    for seed in (1, 2, 3):
        rng, rows = random.Random(seed), []
        for i in range(150):
            words = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]  # noqa: B023, E731
            shared = words(64)
            rows += [(2 * i, " ".join(shared + words(10))), (2 * i + 1, " ".join(shared + words(10)))]  # 60 of 80 shingles
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), seed=seed).collect()}
        assert sum(got[2 * i + 1] == 2 * i for i in range(150)) >= 149


def test_components_of_paths_and_stars(spark):
    from leafwork.llm.store import Scratch

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(205, 201), (203, 205)]
    got = {r["node"]: r["component"] for r in minhash.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and {got[201], got[203], got[205]} == {201}


def test_quality_counts_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["\n".join(" ".join(rng.choice(["a", "b#", "é|", "<x>", "cc"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    texts += ["a b c d e f g h a b c d e f g h", "a\n\na\n \n \na", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.assess(docs, np.zeros((2, quality.BUCKETS))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        where = {}
        for k in range(len(words) - 7):
            where.setdefault(tuple(words[k : k + 8]), []).append(k)
        covered = {p for v in where.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t


def quality_by_dictionary(spark, texts, trusted):
    """Scores by dictionaries of hashed words and pairs; each document by the counts of the other fold."""
    folds = {r["doc_id"]: r["fold"] for r in quality._given(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    cells = []
    for text in texts:
        (_, _, words), = blocks.word_slices(pa.array([text]), blocks.WHITE, blocks.EXACT)
        one, two, inside = quality.buckets(words)
        cells.append([*one.tolist(), *two[inside].tolist()])
    out = []
    for i, mine in enumerate(cells):
        raw, target = {}, {}
        for j, other in enumerate(cells):
            for c in other if folds[j] != folds[i] else ():
                raw[c] = raw.get(c, 0) + 1
                target[c] = target.get(c, 0) + (j in trusted)
        n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
        ratio = [np.log((target.get(c, 0) + 1) / m) - np.log((raw.get(c, 0) + 1) / n) for c in mine] if sum(target.values()) else [0.0]
        out.append(sum(ratio) / max(1, len(mine)))
    return out


def test_quality_scores_are_the_cross_fitted_multinomials(spark):
    texts = [prose(30, random.Random(i)) + f" only{i} {'good' if i < 8 else 'bad'}" for i in range(14)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8), 0) for i in range(14)] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    want = quality_by_dictionary(spark, texts, set(range(8)))
    # every trusted document counts, whatever the size of the threshold's sample, and by either way of marking
    for sent in (quality.IDS_SENT, 0):
        ratios = quality.log_ratios(quality.counts(docs, labels.where("quality = 1"), sent))
        got = {r["doc_id"]: r["score"] for r in quality.assess(docs, ratios).collect()}
        assert np.allclose([got[i] for i in range(14)], want)
    few = {r["doc_id"]: r["score"] for r in quality.quality_rules(docs, labels, trusted=2, rejected=2).collect()}
    assert np.allclose([few[i] for i in range(14)], want)


def test_quality_verdict_holds_beyond_the_labels(spark):
    rng = random.Random(21)
    rows = []
    for i in range(900):
        good = i % 4 != 0
        words = [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(60)]
        rows.append((i, " ".join(words if good else [w + rng.choice(["xq", "jj"]) if rng.random() < 0.5 else w for w in words]), good))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows if i < 600], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, labels).collect()}
    new = [(got[i], g) for i, _, g in rows if i >= 600]
    assert sum(k for k, g in new if g) / sum(g for _, g in new) > 0.97 and not any(k for k, g in new if not g)


def naive_phrases(text, sample):
    """Phrases of a greedy parse, by searching the sample."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_cross_parsing_against_naive_search():
    rng = random.Random(5)
    samples = {"x": ["".join(rng.choice("abc ") for _ in range(300))], "y": ["".join(rng.choice("abd ") for _ in range(300))]}
    model = langid.Model(samples, 10_000)
    wide = langid.Model(samples, 10_000, cells=10)  # with hash tables
    for k in range(60):
        t = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 400 if k < 40 else 3000)))
        if k > 50:  # verbatim copies over the ends of blocks
            t = t[: rng.randint(0, 900)] + (samples["x"][0] * 6)[rng.randint(0, 50) :] + t
        assert (model.entropies([langid.symbols(t)]) == wide.entropies([langid.symbols(t)])).all()
        shown = langid.symbols(t)
        bits = model.entropies([shown])[0]
        for k, lang in enumerate(model.langs):
            ref = "".join(map(chr, langid.symbols(samples[lang][0])))
            want = naive_phrases("".join(map(chr, shown)), ref)
            assert abs(bits[k] * len(shown) / np.log2(model.automata[k].size + 1) - want) < 1e-6


def test_held_out_languages(spark):
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    got = langid.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_pieces_equal_the_model_without_dropout_and_decode_with_it():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, dropped, again, other = pieces.Codec.load(dropout=0.0), pieces.Codec.load(), pieces.Codec.load(), pieces.Codec.load(seed=99)
    rng = random.Random(2)
    parts = [" ", "  ", "a", "the", "\n", "\t", "中", "😀", "é", "<s>", "<0x0A>", "\r\n", "ing", "Unbelievable", "▁", "\x00"]
    differ = 0
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        if "▁" not in t and "\x00" not in t:
            assert plain.encode(t) == sp.encode(t)
        assert dropped.decode(dropped.encode(t)) == t == other.decode(other.encode(t)) == plain.decode(plain.encode(t))
        assert dropped.encode(t) == again.encode(t)
        differ += dropped.encode(t) != other.encode(t)
    assert differ > 100


def test_merge_dropout_decides_each_candidate_by_itself(monkeypatch):
    codec = pieces.Codec.load()
    rng = random.Random(9)
    texts = [prose(60, rng) + " " + " ".join("".join(rng.choice("abcdeing▁é") for _ in range(rng.randint(1, 60))) for _ in range(20)) for _ in range(20)]
    whole = [codec.encode(t) for t in texts]
    # one text at a time, or all as one slice; with the matrix, or with the heap
    data = "".join(texts).encode()
    ids, at, same = codec.encode_slice(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))))
    assert same.all() and [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == whole
    monkeypatch.setattr(pieces, "LONG_WORD", 1)
    monkeypatch.setattr(pieces, "WIDTHS", ())
    assert [codec.encode(t) for t in texts] == whole
    monkeypatch.undo()
    # the same draws in a plain loop over pairs
    word, pair = "understanding", {}
    for a, b, c in codec.joins.tolist():
        pair[a, b] = c
    text = " ".join([word] * 3000)
    got, seen, skipped, offered = codec.encode(text), [], 0, 0
    key = int.from_bytes(__import__("hashlib").blake2b(text.encode(), digest_size=8, key=codec.key).digest(), "little")
    keys = blocks.mix(np.uint64(key) ^ blocks.mix(np.arange(3000).astype(np.uint64)))
    for i in range(3000):
        symbols, dead, number = [codec.characters[c] for c in " " + word], set(), 0
        while True:
            open_ = [(codec.rank[pair[s]], k) for k, s in enumerate(zip(symbols, symbols[1:], strict=False)) if s in pair and k not in dead]
            if not open_:
                break
            k = min(open_)[1]
            number += 1
            if codec._skipped(keys[i : i + 1], number - 1)[0]:
                skipped += 1
                dead.add(k)
                continue
            symbols[k : k + 2] = [pair[symbols[k], symbols[k + 1]]]
            dead = {d - (d > k) for d in dead if d not in (k - 1, k, k + 1)}
        offered += number
        seen += symbols
    assert got == seen and codec.decode(got) == text
    assert abs(skipped / offered - pieces.DROPOUT) < 0.01
    starts = [i for i, piece in enumerate(got) if codec.bytes[piece].startswith(b" ")] + [len(got)]
    assert len({tuple(got[a:b]) for a, b in zip(starts, starts[1:], strict=False)}) > 20


def test_pieces_of_nulls_and_bad_ids(spark):
    codec = pieces.Codec.load()
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, " a  b ", 7)], "doc_id long, text string, n_pieces int")
    got = pieces.encode(docs, codec, keep=["doc_id", "n_pieces", "text"])
    assert got.columns == ["doc_id", "text", "n_pieces", "ids_crc32", "lossless", "piece_ids"]
    assert [r["text"] for r in pieces.decode(got, codec).orderBy("doc_id").collect()] == [None, "", " a  b "]
    assert codec.decode([codec.encode("x")[0], -1, 10**6, None]) in ("x", "")


def test_token_scan_against_direct_counts(spark):
    encoder = tokenfiles.Encoder()
    texts = [prose(RNG.randint(0, 60)) for _ in range(80)] + [None, "", prose(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: len(encoder.encode(t)) if t else 0 for i, t in enumerate(texts)}
    for block in (7, 64, 4096):
        got = {r["doc_id"]: r["n_tokens"] for r in tokenfiles.token_counts(docs, encoder, block).collect()}
        assert got == want


def test_token_files_from_disk(spark, tmp_path):
    tokens = [3, 4, 9, 9, 5, 9, 1, 2]  # 9 ends a document
    (tmp_path / "a.bin").write_bytes(np.array(tokens, "<u2").tobytes())
    found = tokenfiles.scan(tokenfiles.separators(tokenfiles.read_files(spark, str(tmp_path), 3), 9)).orderBy("block").collect()
    assert [n for r in found for n in r["lengths"]] == [2, 0, 1] and found[-1]["open_tokens"] == 2


def plain_edits(item, text):
    """Least edits from item to any run of text, by the textbook table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_least_edits_against_the_table():
    rng = random.Random(17)
    for _ in range(300):
        item, text = [rng.randint(1, 4) for _ in range(rng.randint(1, 70))], [rng.randint(1, 4) for _ in range(rng.randint(0, 90))]
        edits, end = decontam.least_edits(np.array(item, np.uint64), np.array(text, np.uint64))
        assert edits == plain_edits(item, text)
        assert edits == len(item) or plain_edits(item, text[:end]) == edits < plain_edits(item, text[: end - 1])


def test_leak_recall_and_precision():
    rng = random.Random(4)
    lengths = [*range(1, 12), *[rng.randint(12, 70) for _ in range(60)], 300]
    texts = [" ".join(f"w{rng.randint(1, 400)}" for _ in range(n)) for n in lengths]
    items = decontam.Items(list(range(len(texts))), texts)
    where = {k: i for i, ids in enumerate(items.ids) for k in ids}
    other = lambda: prose(40, rng)
    hit = total = 0
    for i, t in enumerate(texts):
        for kind in "sid":
            w = t.split()
            for _ in range(decontam.allowed_edits(len(w))):
                p = rng.randrange(len(w))
                if kind == "s":
                    w[p] = "other"
                elif kind == "i":
                    w.insert(p, "other")
                else:
                    del w[p]
            text = other() + "\n" + " ".join(w).upper() + ". " + other()
            for _, _, words in blocks.word_slices(pa.array([text]), blocks.NOT_ALNUM, blocks.LOWER):
                truth = {k for k in range(len(texts)) if plain_edits(items.words[where[k]].tolist(), words.hash.tolist()) <= decontam.allowed_edits(lengths[k])}
                found = {k for _, k, _, _ in items.search(words)}
                assert found <= truth and i in truth
                total += len(truth)
                hit += len(found)
    assert hit / total >= 0.99 and total > 200


def test_many_items_of_one_template():
    rng = random.Random(14)
    opening = prose(12, rng)
    texts = [f"{opening} {prose(20, rng)}" for _ in range(300)]
    items = decontam.Items([*range(300), 900], [*texts, texts[0]])
    text = " ".join(texts)
    for _, _, words in blocks.word_slices(pa.array([text]), blocks.NOT_ALNUM, blocks.LOWER):
        assert {k for _, k, e, _ in items.search(words) if e == 0} == {*range(300), 900}


def test_license_rules(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc,cc-by-nc-sa",
        "under  the MIT licence": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "it is under the GNU Lesser General Public License version 3": "lgpl-3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "SPDX-License-Identifier: MPL-2.0": "mpl-2",
        "a licensed plumber has a permit": "",
        "the community of the summit": "",
    }
    got = {r["doc_id"]: r for r in licenses.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert got[i]["labels"] == want, (t, got[i])
    assert len(licenses.rules()) > 300


def _made(parsed, rng):
    """A text that a parsed regular expression matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "IN":
            pick = rng.choice([a for a in arg if str(a[0]) != "NEGATE"])
            out += "q" if str(arg[0][0]) == "NEGATE" else chr(pick[1] if str(pick[0]) == "LITERAL" else rng.randint(*pick[1]))
        elif name == "BRANCH":
            out += _made(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += _made(arg[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(_made(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], 6))))
        else:
            assert name == "ASSERT" or name == "ASSERT_NOT", name
    return out


def test_each_license_rule_fires_on_its_match_alone(spark):
    rng = random.Random(12)
    made = []
    for r in licenses.rules():
        parsed = re._parser.parse(r["pattern"])
        texts = {_made(parsed, rng) for _ in range(60)}
        for t in texts:
            starts = lambda words: any(f" {t}".find(f" {w}") >= 0 for w in words)  # noqa: B023, E731
            assert starts(r["words"]) and (starts(r["also"]) or not r["also"]), (t, r)
        made += [(len(made) + i, t, r["label"], r["priority"]) for i, t in enumerate(sorted(texts)[:2])]
    assert len({m[0] for m in made}) == len(made)
    docs = spark.createDataFrame([(i, t.upper()) for i, t, _, _ in made], "doc_id long, text string")
    got = {r["doc_id"]: {(d["label"], d["priority"]) for d in r["_all"]} for r in licenses.scan(docs).select("doc_id", "_all").collect()}
    for i, t, label, priority in made:
        assert (label, priority) in got[i], (t, label, got[i])


def test_licenses_need_no_word_besides_their_match(spark):
    texts = {
        "Distributed under the BSD 3-Clause terms": "bsd-3",
        "This is Apache 2.0": "apache-2",
        "released under the MIT": "mit",
        "MPL 2.0": "mpl-2",
        "EPL 2.0": "epl-2",
        "All rights\nreserved": "all-rights-reserved",
        "All-rights-reserved.": "all-rights-reserved",
        "placed in the public\tdomain": "public-domain",
    }
    got = {r["doc_id"]: r for r in licenses.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert got[i]["labels"] == want and got[i]["score"] > 0, (t, got[i])


def test_ftrl_finds_the_word(spark):
    rng = random.Random(6)
    rows = [(i, prose(40, rng) + (" vilest " if i % 4 == 0 else " ") + prose(40, rng), int(i % 4 == 0)) for i in range(1200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.98


def test_url_model_parts_unruled_urls(spark):
    rng = random.Random(8)
    good = [f"https://{rng.choice(['news', 'wiki'])}.site.org/fr/{rng.randint(1, 9999)}" for _ in range(300)]
    bad = [f"http://{rng.choice(['pills', 'casino'])}.shop.net/buy/{rng.randint(1, 9999)}?ref=spam" for _ in range(300)]
    new = ["https://news.other.com/fr/77", "http://casino.other.com/buy/12?ref=spam"]
    pages = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages).collect()}
    assert got[600] == "allow" and got[601] == "block" and got[0] == "allow" and got[300] == "block"


def test_long_copies_are_one_phrase():
    text = prose(300, random.Random(44))
    model = langid.Model({"x": [text], "y": ["zzz"]})
    shown = langid.symbols(text[3 : 3 + 1728])
    assert round(model.entropies([shown, shown[:0], shown])[2, 0] * len(shown) / np.log2(model.automata[0].size + 1)) == 1


def test_language_learns_from_whole_texts(spark):
    one = "aa " * 20_000 + "zebra quagga okapi " * 5_000
    assert langid.shares([10, 1000, 1000], 1010) == [10, 500, 500]
    docs = spark.createDataFrame([(i, one if i == 0 else prose(50), ["q", "p"][i > 0]) for i in range(5)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = langid.fit(docs, may_teach=F.lit(True))
    assert dict(zip(model.langs, [a.size for a in model.automata], strict=True))["q"] > 20_000


def test_long_texts_are_encoded_as_if_whole():
    encoder = tokenfiles.Encoder()
    encoder.encode("a")
    whole = lambda t: encoder._encoding.encode_ordinary(t)
    rng = random.Random(3)
    parts = [" ", "   ", "\n\n", "\t", "word", "it's", "12 34", "é", "日本", "-- ", " ", "　", "\x1c", "x"]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(t, run=5, long_space=2).tolist() == whole(t), repr(t)
    blank = " " * 2_000_000
    assert len(encoder.encode(blank + "a b")) == len(encoder.encode(blank)) + 1
    assert len(encoder.encode("a " * 1_000_000)) == 1_000_001


def test_url_models_against_dictionaries(spark):
    rng = random.Random(15)
    rows = [(i, f"https://{rng.choice('abc')}.{rng.choice(['org/fr/', 'x.net/'])}{rng.randint(1, 99)}") for i in range(200)] + [(900, "https://q.com/a"), (901, "ftp"), (902, "")]
    ruled = urls.with_rules(spark.createDataFrame(rows, "page_id long, url string"))
    models = urls.fit(ruled)
    got = {r["page_id"]: r["score"] for r in urls.scored(ruled, models).collect()}
    counts = {"allow": {}, "block": {}}
    seen = [(r["url"].encode(), r["ruled"]) for r in ruled.collect() if r["ruled"]]
    for url, kind in seen:
        if zlib.crc32(url) % urls.HELD_OUT:
            for i in range(len(url)):
                for k in range(urls.ORDER + 1):
                    context = (k, (b"\xff" * k + url)[i : i + k])
                    for key in (context, (*context, url[i])):
                        counts[kind][key] = counts[kind].get(key, 0) + 1

    def loglik(url, table):
        total = 0.0
        for i in range(len(url)):
            p = 1 / 256
            for k in range(urls.ORDER + 1):
                context = (k, (b"\xff" * k + url)[i : i + k])
                p = (table.get((*context, url[i]), 0) + urls.PRIOR * p) / (table.get(context, 0) + urls.PRIOR)
            total += np.log(p)
        return total

    for i, url in rows:
        want = (loglik(url.encode(), counts["allow"]) - loglik(url.encode(), counts["block"])) / max(1, len(url))
        assert abs(got[i] - want) < 1e-3, (url, got[i], want)
    assert urls.buckets(10) == urls.LEAST_BUCKETS < urls.buckets(40_000) <= urls.MOST_BUCKETS == urls.buckets(10**9)


def test_ftrl_steps_against_a_plain_loop():
    rng = random.Random(4)
    model, z, n, bias = toxicity.Ftrl(size=50, l1=0.5), [0.0] * 50, [0.0] * 50, [0.0, 0.0]
    a, b = model.alpha, model.beta
    for _ in range(300):
        at, y = sorted(rng.sample(range(50), rng.randint(0, 9))), rng.randint(0, 1)
        w = {i: 0.0 if abs(z[i]) <= 0.5 else -(z[i] - (0.5 if z[i] > 0 else -0.5)) / ((b + n[i] ** 0.5) / a) for i in at}
        wb = -bias[0] / ((b + bias[1] ** 0.5) / a)
        g = 1 / (1 + np.exp(-(sum(w.values()) + wb))) - y
        for i in at:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
        s = ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / a
        bias = [bias[0] + g - s * wb, bias[1] + g * g]
        model.learn(np.array(at, np.int64), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose(model.bias, bias)


def test_toxicity_bias_follows_all_labelled_rows(spark):
    rng = random.Random(13)
    rows = [(i, prose(30, rng), int(i % 10 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    full, cut = toxicity.fit(docs, labels), toxicity.fit(docs, labels, toxic=60, clean=60)
    assert full.bias < cut.bias < -1.2  # without the shift it would be near 0.6


def test_quality_threshold_counts_every_labelled_document(spark, monkeypatch):
    rng, seen = random.Random(31), []
    known = quality.threshold
    monkeypatch.setattr(quality, "threshold", lambda *a: (seen.append((int(a[1].sum()), int(a[2].sum()))), known(*a))[1])
    texts = [" ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + ("xq" if i % 3 and rng.random() < 0.3 else "") for _ in range(24)) for i in range(6400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(6400)] + [(1, 0)], "doc_id long, quality int")
    got = quality.quality_rules(docs, labels).collect()
    judged = [r for r in got if not r["base_failed"]]
    assert seen == [(sum(r["doc_id"] % 3 == 0 for r in judged), sum(r["doc_id"] % 3 > 0 for r in judged))] and seen[0][1] > 4000
    step = {r["doc_id"]: np.floor(r["score"] * quality.STEPS) for r in judged}
    good, bad = (np.array([s for i, s in step.items() if (i % 3 == 0) == g]) for g in (True, False))
    cuts = [c for c in sorted(set(step.values())) if (good < c).mean() <= quality.LOSS]
    best = max(sorted(set(step.values())), key=lambda c: ((bad < c).mean() - (good < c).mean(), -c))
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, s in step.items() if s >= min(best, cuts[-1])}


def test_op3_returns_its_pieces(spark, tmp_path):
    from leafwork.llm import queries

    texts = ["plain words and ünïcode ▁", "", None, "  two  blanks"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    codec = pieces.Codec.load()
    for r in queries.op3_pieces(spark, str(tmp_path)).collect():
        ids = r["piece_ids"]
        if texts[r["doc_id"]] is None:
            assert ids is None and r["n_pieces"] is None
        else:
            assert codec.decode(ids) == texts[r["doc_id"]] and len(ids) == r["n_pieces"] and zlib.crc32(np.array(ids, "<i4").tobytes()) == r["ids_crc32"]


def test_near_duplicates_keep_a_byte_of_each_minimum(spark, monkeypatch):
    from leafwork.llm.store import Scratch

    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": kept.setdefault(name, keep(self, df, name)) if name == "features" else keep(self, df, name))
    base = prose(200, random.Random(5)).split()
    near = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 200, 20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near, "far from it " * 9, None])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {**dict.fromkeys(range(10), 0), 10: 10, 11: 11}
    assert kept["features"].schema["signature"].dataType.elementType.typeName() == "byte"
    whole = minhash.features(docs.limit(1)).first()["signature"]
    assert kept["features"].where("doc_id = 0").first()["signature"] == [(x & 255) - 128 for x in whole]
