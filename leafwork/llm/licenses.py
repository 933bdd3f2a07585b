"""Licence scans: ordered signature rules over a text's words, with keyword gates. DataFrame functions only.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, that is of ASCII letters
and digits and of non-ASCII characters. Rules are regular
expressions over the words with one blank between them, anchored at words.

A rule has a label, a priority and two lists of word starts: each of its matches has a word that
starts with one of ``words`` and, where ``also`` is not empty, one that starts with one of ``also``. One
search collects the words of a text that start so, and a rule runs only where both its lists
are met; so no match is lost, and there is no other gate. Detections are word
intervals. One is suppressed if another of higher priority contains it, or a larger one of
equal priority; base phrases always stay. The score is the highest priority left, as a share of the highest one.

Defined cases: a null text is empty: no words, no labels, score 0; null ids stay; repeated rows are
judged one by one; of equal intervals of one priority all labels stay (a tie); an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import earlier, let, running, sums

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licences: label, names as they stand in text (regular expressions over words), keyword.
NAMES = [
    ("mit", "mit|expat|x11", "mit|expat|x11"),
    ("mit-0", "mit no attribution|mit 0", "mit"),
    ("apache-1", "apache(?: software)? license(?: version)? 1(?: [01])?|apache 1(?: [01])?", "apache"),
    ("apache-2", "apache(?: software)? license(?: version)? 2(?: 0)?|apache 2(?: 0)?|asl 2(?: 0)?", "apache|asl"),
    ("gpl-1", "(?:gnu )?general public license(?: version)? 1(?: 0)?|gpl ?v? ?1(?: 0)?", "public|gpl"),
    ("gpl-2", "(?:gnu )?general public license(?: version)? 2(?: 0)?|gpl(?: version| v)? ?2(?: 0)?|gplv2", "public|gpl"),
    ("gpl-3", "(?:gnu )?general public license(?: version)? 3(?: 0)?|gpl(?: version| v)? ?3(?: 0)?|gplv3", "public|gpl"),
    ("lgpl-2", "(?:gnu )?(?:lesser|library) general public license(?: version)? 2(?: [01])?|lgpl(?: version| v)? ?2(?: [01])?|lgplv2", "lesser|library|lgpl"),
    ("lgpl-3", "(?:gnu )?lesser general public license(?: version)? 3(?: 0)?|lgpl(?: version| v)? ?3(?: 0)?|lgplv3", "lesser|lgpl"),
    ("agpl-3", "(?:gnu )?affero general public license(?: version)? 3(?: 0)?|agpl(?: version| v)? ?3(?: 0)?|agplv3", "affero|agpl"),
    ("fdl-1", "(?:gnu )?free documentation license(?: version)? 1(?: [0-3])?|gfdl(?: 1(?: [0-3])?)?", "documentation|gfdl"),
    ("bsd-0", "zero clause bsd|bsd zero clause|0bsd|bsd 0 clause", "bsd|0bsd"),
    ("bsd-2", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", "bsd|freebsd"),
    ("bsd-3", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", "bsd"),
    ("bsd-4", "bsd 4 clause|4 clause bsd|original bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("mpl-1", "mozilla public license(?: version)? 1(?: [01])?|mpl ?1(?: [01])?", "mozilla|mpl"),
    ("mpl-2", "mozilla public license(?: version)? 2(?: 0)?|mpl ?2(?: 0)?", "mozilla|mpl"),
    ("epl-1", "eclipse public license(?: version| v)? 1(?: 0)?|epl 1(?: 0)?", "eclipse|epl"),
    ("epl-2", "eclipse public license(?: version| v)? 2(?: 0)?|epl 2(?: 0)?", "eclipse|epl"),
    ("cddl-1", "common development and distribution license(?: version)?(?: 1(?: [01])?)?|cddl(?: 1(?: [01])?)?", "development|cddl"),
    ("eupl-1", "european union public licen[cs]e(?: v?(?: version)? ?1(?: [0-2])?)?|eupl(?: v)?(?: 1(?: [0-2])?)?", "european|eupl"),
    ("artistic-1", "artistic license(?: version)? 1(?: 0)?", "artistic"),
    ("artistic-2", "artistic license(?: version)? 2(?: 0)?", "artistic"),
    ("bsl-1", "boost software license(?: version)?(?: 1(?: 0)?)?", "boost"),
    ("zlib", "zlib|zlib libpng|libpng", "zlib|libpng"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public license", "wtfpl|fuck"),
    ("ms-pl", "microsoft public license|ms pl", "microsoft|pl"),
    ("ms-rl", "microsoft reciprocal license|ms rl", "microsoft|rl"),
    ("osl-3", "open software license(?: version)?(?: 3(?: 0)?)?|osl 3(?: 0)?", "software|osl"),
    ("afl-3", "academic free license(?: version)?(?: 3(?: 0)?)?|afl 3(?: 0)?", "academic|afl"),
    ("psf-2", "python software foundation license(?: version)?(?: 2)?|psf(?: license)?(?: 2)?", "python|psf"),
    ("ruby", "ruby", "ruby"),
    ("php-3", "php license(?: version)?(?: 3(?: 0(?: 1)?)?)?", "php"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl|original ssleay", "openssl|ssleay"),
    ("ofl-1", "sil open font license(?: version)?(?: 1(?: [01])?)?|open font license(?: version)?(?: 1(?: [01])?)?|ofl 1 1", "font|ofl"),
    ("cecill-2", "cecill(?: [abc])?(?: version)?(?: 2(?: [01])?)?", "cecill"),
    ("cpl-1", "common public license(?: version)?(?: 1(?: 0)?)?", "common"),
    ("ipl-1", "ibm public license(?: version)?(?: 1(?: 0)?)?", "ibm"),
    ("sspl-1", "server side public license(?: version)?(?: 1)?|sspl(?: v)?(?: 1)?", "server|sspl"),
    ("busl-1", "business source license(?: 1(?: 1)?)?|busl 1 1", "business|busl"),
    ("elastic-2", "elastic license(?: 2(?: 0)?)?", "elastic"),
    ("mulan-2", "mulan permissive software license(?: version| v)?(?: 2)?|mulanpsl 2 0", "mulan|mulanpsl"),
    ("odbl-1", "open database license(?: v)?(?: 1 0)?|odbl(?: 1 0)?", "database|odbl"),
    ("odc-by-1", "open data commons attribution license(?: v)?(?: 1 0)?|odc by(?: 1 0)?", "commons|odc"),
    ("pddl-1", "public domain dedication and license|pddl(?: 1 0)?", "dedication|pddl"),
    ("ogl-3", "open government licen[cs]e(?: v)?(?: [123] 0)?", "government"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?|cc zero|creative commons zero", "cc0|zero"),
    ("cc-by", "cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?", "cc|commons"),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?", "cc|commons"),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc|commons"),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?", "cc|commons"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc|commons"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc|commons"),
]

#: Frames around a name: priority, pattern and starts of words of which each match has one. A tag or address beats a grant, a grant beats a mention.
FRAMES = [
    (4, "spdx license identifier (?:{name})(?: or later| only)?", ["spdx"]),
    (4, "(?:opensource|spdx|creativecommons|gnu|apache) org licen[cs]es? (?:{name})", ["licen"]),
    (3, "(?:is |are |was )?(?:licen[cs]ed|released|distributed|published|available|provided|covered|made available) under (?:the terms (?:and conditions )?of )?(?:the |an? )?(?:{name})(?: licen[cs]e)?", ["under"]),
    (3, "(?:subject to|pursuant to|in accordance with|under) the (?:terms of the )?(?:{name})(?: licen[cs]e)?", ["subject", "pursuant", "accordance", "under"]),
    (3, "licen[cs]e (?:is )?(?:the )?(?:{name})(?: licen[cs]e)?", ["licen"]),
    (2, "(?:{name}) licen[cs]e", ["licen"]),
    (1, "(?:{long})", []),
]

#: Sentences of the licences' own texts.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3", "neither the name of (?:the )?(?:[^ ]+ ){1,6}nor the names of its contributors may be used", "contributors"),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied"),
    ("cc0", "to the extent possible under law (?:[^ ]+ ){1,8}waived all copyright", "waived"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public"),
    ("all-rights-reserved", "all rights reserved", "reserved"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright"),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "verbatim"),
    ("no-warranty", "without warranties or conditions of any kind", "warranties"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software without restriction", "hereby"),
    ("x11", "except as contained in this notice the name of (?:the )?(?:[^ ]+ ){1,6}shall not be used in advertising", "advertising"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("bsd-patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants", "hereby"),
    ("apache-1", "this product includes software developed by the apache (?:group|software foundation)", "apache"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable"),
    ("apache-2", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants", "hereby"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "gnu"),
    ("gpl", "either version [123] of the license or (?:at your option )?any later version", "later"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", "lesser"),
    ("agpl-3", "you should have received a copy of the gnu affero general public license along with this program", "affero"),
    ("agpl-3", "remote network interaction use with the gnu general public license", "remote"),
    ("classpath", "as a special exception the copyright holders of this library give you permission to link", "exception"),
    ("fdl-1", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license", "eclipse"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "development"),
    ("mpl-1", "the contents of this file are subject to the mozilla public license version 1", "mozilla"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("bsl-1", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("zlib", "altered source versions must be plainly marked as such", "altered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone"),
    ("ofl-1", "the font software may be sold as part of a larger software package", "font"),
    ("ofl-1", "no reserved font names?", "reserved"),
    ("python", "this license agreement is between the python software foundation", "python"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided", "hereby"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose", "documentation"),
    ("hpnd", "in advertising or publicity pertaining to distribution of the software without specific", "publicity"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service", "functionality"),
    ("busl-1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software", "sell"),
    ("json", "the software shall be used for good not evil", "evil"),
    ("beerware", "if we meet some ?day and you think this stuff is worth it you can buy me a beer in return", "beer"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate"),
    ("cc-by-nc", "you may not use the (?:material|work) for commercial purposes", "commercial"),
    ("cc-by-sa", "you must distribute your contributions under the same license as the original", "contributions"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "deed"),
    ("odbl-1", "you are free to share create and adapt the database", "adapt"),
    ("public-domain", "this (?:work|file|software|text) is (?:hereby )?in the public domain", "public"),
    ("public-domain", "(?:i|we|the authors?) (?:hereby )?(?:dedicate|release|disclaim) (?:[^ ]+ ){1,8}public domain", "public"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:[^ ]+ ){0,12}(?:is )?(?:strictly )?prohibited", "unauthori"),
    ("proprietary", "no part of this (?:publication|book|document|work) may be reproduced", "reproduced"),
    ("proprietary", "this (?:software|document) contains (?:confidential|proprietary) (?:and (?:confidential|proprietary) )?information", "confidential|proprietary"),
    ("proprietary", "(?:all )?other rights reserved", "reserved"),
    ("no-commercial", "for non ?commercial use only", "commercial|noncommercial"),
    ("no-commercial", "for (?:personal|educational|academic|research) use only", "personal|educational|academic|research"),
    ("no-derivatives", "no derivative works (?:are )?(?:allowed|permitted)", "derivative"),
    ("attribution", "reproduced (?:here )?with (?:the )?permission (?:of|from)", "reproduced"),
    ("attribution", "may be freely (?:copied|distributed|reproduced|used) (?:[^ ]+ ){0,8}(?:provided|as long as|with attribution)", "freely"),
    ("government-work", "(?:is )?a work of the (?:united states|u s) government", "government"),
    ("patent", "(?:this|the) (?:product|software) is protected by (?:one or more )?(?:u s |united states )?patents", "patents"),
    ("trademark", "(?:is a|are) (?:registered )?trademarks? of", "trademark"),
]

HIGHEST = 5


def rules() -> list[dict]:
    """All rules: label, priority, words and also (word starts, of each of which a match has one), pattern."""
    out = [{"label": label, "priority": HIGHEST, "words": word.split("|"), "also": [], "pattern": pattern} for label, pattern, word in TEXTS]
    for label, names, words in NAMES:
        for priority, frame, also in FRAMES:
            # a name of one word is no mention by itself
            pattern = frame.replace("{name}", names).replace("{long}", names if " " in names else f"(?:{names}) licen[cs]ed")
            out.append({"label": label, "priority": priority, "words": words.split("|"), "also": also, "pattern": pattern})
    out += [{"label": label, "priority": 2, "words": [phrase.split()[0]], "also": [phrase.split()[2]], "pattern": phrase} for phrase, label in BASE.items()]
    return [r | {"pattern": f"(?<= )(?:{r['pattern']})(?= )"} for r in out]


def _starts(words: list[str]) -> str:
    """A regular expression that matches where one of the words does, by shared first letters."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    return "(?:" + "|".join(h + _starts([w[1:] for w in words if w[0] == h]) for h in heads) + ")"


def _count_blanks(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


def _intervals(text: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches in the padded words."""
    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("m"), F.split(text, rule["pattern"], F.lit(-1)).alias("g")), lambda p: p["m"].isNotNull())
    lasts = sums(F.transform(pairs, lambda p: _count_blanks(p["g"]) + _count_blanks(p["m"])))
    one = lambda p, last: F.struct((last - 1 - _count_blanks(p["m"])).alias("start"), last.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
    return let(pairs, lambda pairs: F.zip_with(pairs, lasts, one))


def _unsuppressed(found: Column) -> Column:
    """Detections that none of higher priority, and no larger one of equal priority, contains.

    In order of start (longest and highest first) a container stands before what it contains, so the farthest end of each
    priority up to there decides; of equally far ends the earliest start does.
    """
    ordered = F.array_sort(found, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["end"] != y["end"], y["end"] - x["end"]).otherwise(y["priority"] - x["priority"]))
    none = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("back"))

    def farthest(of: Column, p: Column) -> Column:
        mine = F.transform(of, lambda d: F.when(d["priority"] == p, F.struct(d["end"].alias("end"), (-d["start"]).alias("back"))).otherwise(none))
        return earlier(running(mine, "struct<end:int,back:int>", lambda a, b: F.greatest(a, b)), none)

    def kept(of: Column, far: Column) -> Column:
        def stays(d: Column, i: Column) -> Column:
            above = F.exists(far, lambda f: (f["p"] > d["priority"]) & (F.get(f["v"], i)["end"] >= d["end"]))
            own = lambda f: (f["p"] == d["priority"]) & ((F.get(f["v"], i)["end"] > d["end"]) | ((F.get(f["v"], i)["end"] == d["end"]) & (-F.get(f["v"], i)["back"] < d["start"])))
            return ~(above | F.exists(far, own))

        return F.filter(of, stays)

    by_priority = lambda of: F.transform(F.array(*[F.lit(p) for p in range(1, HIGHEST + 1)]), lambda p: F.struct(p.alias("p"), farthest(of, p).alias("v")))
    return let(ordered, lambda of: let(by_priority(of), lambda far: kept(of, far)))


def scan(docs: DataFrame) -> DataFrame:
    """docs with _n_words, _words (padded), _hits (the words that start like a rule's), _base and _found (array<struct<start, end, priority, label>>)."""
    kind = "array<struct<label:string,priority:int,words:array<string>,also:array<string>,pattern:string>>"
    given = rules()
    table, phrases = F.from_json(F.lit(json.dumps(given)), kind), F.from_json(F.lit(json.dumps(given[-len(BASE) :])), kind)
    key = " " + _starts(sorted({w for r in given for w in r["words"] + r["also"]})) + "[^ ]*"
    out = docs.withColumn("_text", F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = out.withColumn("_n_words", F.regexp_count("_text", F.lit(WORD)).cast("long"))
    out = out.withColumn("_words", F.concat(F.lit(" "), F.trim(F.regexp_replace("_text", NOT_WORD, " ")), F.lit(" ")))
    out = out.withColumn("_hits", F.array_join(F.array_distinct(F.regexp_extract_all("_words", F.lit(key), F.lit(0))), ""))
    stands = lambda w: F.col("_hits").contains(F.concat(F.lit(" "), w))
    runs = lambda r: F.exists(r["words"], stands) & ((F.size(r["also"]) == 0) | F.exists(r["also"], stands))
    empty = F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>")
    found = lambda of: F.when(F.col("_hits") != "", F.flatten(F.transform(F.filter(of, runs), lambda r: _intervals(F.col("_words"), r)))).otherwise(empty)
    out = out.withColumn("_all", found(table)).withColumn("_base", found(phrases))
    return out.withColumn("_found", F.when(F.size("_all") > 0, _unsuppressed(F.array_distinct("_all"))).otherwise(empty))


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs."""
    found = scan(docs.select("doc_id", "text"))
    starts, named = F.transform("_base", lambda s: s["start"]), F.transform("_base", lambda s: s["label"])
    labels = F.array_sort(F.array_distinct(F.concat(named, F.transform("_found", lambda s: s["label"]))))
    best = F.array_max(F.transform(F.concat("_base", "_found"), lambda s: s["priority"]))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(best.cast("double") / HIGHEST, F.lit(0.0)).alias("score"),
    )
