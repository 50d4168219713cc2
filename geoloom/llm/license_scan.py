"""License scans with DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words, runs of digits, a-z and non-ASCII characters, with one space before
and after each. Ordered rules, several hundred regexes composed of the hand-written names, phrasings, identifiers and marks below, each have a
priority, a confidence, a label and one or two keywords. A first pass keeps the texts in which some keyword can occur; a rule is
matched only where its own keywords do, once per block of BLOCK words. Of two detections, one that lies within the other's interval is dropped unless it has
the higher priority; equal intervals go to the higher priority, then to the earlier rule.

Base phrases are counted at every place where their words stand one after the other; their labels are always kept.

A null or empty text has no words and no detection: counts and score are 0, places null and label lists empty. Ids may be
null or repeated, each row gives one row. Everything happens within a row, so there is no shuffle and no group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same class of characters where capitals A-Z stand for a-z.
_NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases that are counted, with their labels.
BASE = [("mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Fixed values: (label, keyword of every name that follows, names as regexes over words). Hand-written.
NAMES = [
    ("mit", "licen", ["mit license", "mit licence", "mit x11 license", "mit style license", "expat license", "mit expat license", "mit open source license"]),
    ("mit-0", "mit no attribution", ["mit no attribution(?: license)?"]),
    ("mit-0", "mit 0", ["mit 0 license"]),
    ("x11", "licen", ["x11 license", "x consortium license"]),
    ("apache-2", "apache", ["apache license (?:version |v ?)?2(?: 0)?", "apache 2(?: 0)?(?: license)?", "apache software license (?:version )?2(?: 0)?", "apache public license 2(?: 0)?"]),
    ("apache-1.1", "apache", ["apache (?:software )?license (?:version )?1 1"]),
    ("apache-1.0", "apache", ["apache (?:software )?license (?:version )?1 0"]),
    ("gpl-3", "gnu", ["gnu general public license (?:version |v ?)3(?: 0)?", "gnu gpl (?:version )?v?3"]),
    ("gpl-3", "gpl", ["gpl ?v?3(?: 0)?", "gpl version 3(?: 0)?"]),
    ("gpl-2", "gnu", ["gnu general public license (?:version |v ?)2(?: 0)?", "gnu gpl (?:version )?v?2"]),
    ("gpl-2", "gpl", ["gpl ?v?2(?: 0)?", "gpl version 2(?: 0)?"]),
    ("gpl", "gnu", ["gnu general public license", "gnu gpl", "gnu public license"]),
    ("lgpl-3", "lesser", ["gnu lesser general public license (?:version |v ?)3(?: 0)?"]),
    ("lgpl-3", "lgpl", ["lgpl ?v?3(?: 0)?", "lgpl version 3(?: 0)?"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license (?:version |v ?)2 1"]),
    ("lgpl-2.1", "lgpl", ["lgpl ?v?2 1", "lgpl version 2 1"]),
    ("lgpl", "gnu", ["gnu (?:lesser|library) general public license", "gnu lgpl"]),
    ("agpl-3", "affero", ["gnu affero general public license(?: (?:version |v ?)3(?: 0)?)?"]),
    ("agpl-3", "agpl", ["agpl ?v?3(?: 0)?", "gnu agpl(?: version 3)?"]),
    ("fdl", "documentation", ["gnu free documentation license(?: (?:version |v ?)1 [123])?"]),
    ("bsd-4-clause", "bsd", ["(?:4|four) clause bsd(?: license)?", "original bsd license", "bsd (?:4|four) clause(?: license)?"]),
    ("bsd-3-clause", "bsd", ["(?:3|three) clause bsd(?: license)?", "bsd (?:3|three) clause(?: license)?", "(?:new|modified|revised) bsd license"]),
    ("bsd-2-clause", "bsd", ["(?:2|two) clause bsd(?: license)?", "bsd (?:2|two) clause(?: license)?", "(?:simplified|freebsd) bsd license"]),
    ("bsd", "bsd", ["bsd license", "bsd style license", "bsd licence"]),
    ("0bsd", "bsd", ["zero clause bsd(?: license)?", "0bsd(?: license)?"]),
    ("isc", "licen", ["isc license", "internet systems consortium license"]),
    ("mpl-2", "mozilla", ["mozilla public license (?:version |v ?)?2(?: 0)?"]),
    ("mpl-2", "mpl", ["mpl ?v?2(?: 0)?"]),
    ("mpl-1.1", "mozilla", ["mozilla public license (?:version |v ?)?1 1"]),
    ("mpl", "mozilla", ["mozilla public license"]),
    ("epl-2", "eclipse", ["eclipse public license (?:version |v ?)?2(?: 0)?"]),
    ("epl-2", "epl", ["epl ?v?2(?: 0)?"]),
    ("epl", "eclipse", ["eclipse public license", "eclipse public license (?:version |v ?)?1(?: 0)?"]),
    ("cddl", "common development", ["common development and distribution license(?: 1 [01])?"]),
    ("cddl", "cddl", ["cddl(?: license)?(?: 1 [01])?"]),
    ("cpl", "common public", ["common public license(?: (?:version )?1 0)?"]),
    ("eupl", "european union public", ["european union public licen[cs]e(?: (?:version |v ?)?1 [12])?"]),
    ("eupl", "eupl", ["eupl(?: ?v?1 [12])?"]),
    ("artistic", "artistic", ["artistic license(?: 2 0)?", "perl artistic license", "clarified artistic license"]),
    ("boost", "boost", ["boost software license(?: (?:version )?1 0)?", "boost license"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"]),
    ("unlicense", "unlicense", ["unlicense", "unlicense license"]),
    ("wtfpl", "wtfpl", ["wtfpl(?: license)?(?: version 2)?"]),
    ("cc0", "cc0", ["cc0(?: 1 0)?(?: universal)?(?: license)?"]),
    ("cc0", "creative commons", ["creative commons zero(?: 1 0)?(?: universal)?"]),
    ("cc-by-nc-nd", "cc by", ["cc by nc nd(?: [1-4] 0)?"]),
    ("cc-by-nc-nd", "creative commons", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?"]),
    ("cc-by-nc-sa", "cc by", ["cc by nc sa(?: [1-4] 0)?"]),
    ("cc-by-nc-sa", "creative commons", ["creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"]),
    ("cc-by-nc", "cc by", ["cc by nc(?: [1-4] 0)?"]),
    ("cc-by-nc", "creative commons", ["creative commons attribution non ?commercial(?: [1-4] 0)?"]),
    ("cc-by-nd", "cc by", ["cc by nd(?: [1-4] 0)?"]),
    ("cc-by-nd", "creative commons", ["creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?"]),
    ("cc-by-sa", "cc by", ["cc by sa(?: [1-4] 0)?"]),
    ("cc-by-sa", "creative commons", ["creative commons attribution share ?alike(?: [1-4] 0)?"]),
    ("cc-by", "cc by", ["cc by(?: [1-4] 0)?"]),
    ("cc-by", "creative commons", ["creative commons attribution(?: [1-4] 0)?(?: (?:international|unported|generic))?"]),
    ("odbl", "database", ["open database license(?: (?:version |v ?)?1 0)?", "open data commons open database license"]),
    ("odc-by", "open data commons", ["open data commons attribution license(?: (?:version |v ?)?1 0)?"]),
    ("pddl", "public domain dedication and", ["public domain dedication and license(?: 1 0)?"]),
    ("ofl", "font", ["sil open font license(?: (?:version )?1 [01])?", "open font license"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"]),
    ("python", "licen", ["python software foundation license", "psf license", "python license"]),
    ("ms-pl", "microsoft public", ["microsoft public license"]),
    ("openssl", "openssl", ["openssl license"]),
    ("php", "php", ["php license(?: (?:version )?3 0[01]?)?"]),
    ("vim", "vim", ["vim license"]),
    ("beerware", "beer", ["beer ?ware license"]),
    ("polyform-nc", "polyform", ["polyform non ?commercial license(?: 1 0 0)?"]),
    ("bsl", "business source", ["business source license(?: (?:version )?1 1)?"]),
    ("sspl", "server side public", ["server side public license(?: (?:version |v ?)?1)?"]),
    ("openrail", "rail", ["(?:creative ml |bigscience )?open ?rail(?: m)?(?: license)?"]),
]

# Fixed values: (label, SPDX identifiers as words). Hand-written.
SPDX = [
    ("mit", "mit"), ("mit-0", "mit 0"), ("x11", "x11"), ("apache-2", "apache 2 0"), ("apache-1.1", "apache 1 1"), ("apache-1.0", "apache 1 0"), ("gpl-3", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "gpl 2 0(?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"), ("lgpl-2.1", "lgpl 2 1(?: only| or later)?"), ("agpl-3", "agpl 3 0(?: only| or later)?"),
    ("fdl", "gfdl 1 [123](?: only| or later)?"), ("bsd-4-clause", "bsd 4 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-2-clause", "bsd 2 clause"), ("0bsd", "0bsd"), ("isc", "isc"),
    ("mpl-2", "mpl 2 0"), ("mpl-1.1", "mpl 1 1"), ("epl-2", "epl 2 0"), ("epl", "epl 1 0"), ("cddl", "cddl 1 [01]"), ("cpl", "cpl 1 0"), ("eupl", "eupl 1 [12]"), ("artistic", "artistic 2 0"),
    ("boost", "bsl 1 0"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0", "cc0 1 0"), ("cc-by-nc-nd", "cc by nc nd [1-4] 0"), ("cc-by-nc-sa", "cc by nc sa [1-4] 0"),
    ("cc-by-nc", "cc by nc [1-4] 0"), ("cc-by-nd", "cc by nd [1-4] 0"), ("cc-by-sa", "cc by sa [1-4] 0"), ("cc-by", "cc by [1-4] 0"), ("odbl", "odbl 1 0"), ("odc-by", "odc by 1 0"),
    ("pddl", "pddl 1 0"), ("ofl", "ofl 1 [01]"), ("postgresql", "postgresql"), ("python", "(?:python|psf) 2 0"), ("ms-pl", "ms pl"), ("openssl", "openssl"), ("php", "php 3 01"), ("vim", "vim"),
    ("beerware", "beerware"), ("polyform-nc", "polyform noncommercial 1 0 0"), ("bsl", "busl 1 1"), ("sspl", "sspl 1 0"),
]

# Fixed values: (keyword, phrasing around a name, priority, confidence). Hand-written.
PHRASINGS = [
    ("licensed", "(?:licensed|relicensed|sublicensed) (?:to you )?under (?:the )?(?:terms of (?:the )?)?{}", 3, 0.95),
    ("under", "(?:released|distributed|published|redistributed) under (?:the )?(?:terms of (?:the )?)?{}", 3, 0.95),
    ("under", "(?:available|provided|offered|made available|shared) under (?:the )?(?:terms of (?:the )?)?{}", 3, 0.9),
    ("by", "(?:governed by|covered by) (?:the )?(?:terms of (?:the )?)?{}", 3, 0.9),
    ("subject to", "subject to (?:the )?(?:terms of (?:the )?)?{}", 3, 0.9),
    ("licen", "licen[sc]e (?:is )?(?:the )?{}", 2, 0.8),
    ("see", "see (?:the )?{}", 2, 0.7),
]

# Fixed values: (label, keyword, opening words of license texts and other marks, priority, confidence). Hand-written.
MARKS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee", 4, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 4, 1.0),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 4, 0.9),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display", 4, 0.9),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", 4, 1.0),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it", 4, 1.0),
    ("apache-2", "in compliance with the license", "you may not use this file except in compliance with the license", 4, 0.8),
    ("mpl-2", "source code form is subject", "this source code form is subject to the terms of the mozilla public license", 4, 1.0),
    ("boost", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4, 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 4, 1.0),
    ("zlib", "provided", "this software is provided as is without any express or implied warranty in no event will the authors", 4, 0.9),
    ("ofl", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 4, 1.0),
    ("cc0", "waived all copyright", "has waived all copyright and related or neighboring rights", 4, 1.0),
    ("public-domain", "public domain", "(?:is|are|in|into|to) the public domain", 2, 0.7),
    ("public-domain", "public domain", "public domain dedication", 2, 0.8),
    ("public-domain", "no known copyright", "no known copyright restrictions", 2, 0.7),
    ("proprietary", "rights reserved", "all rights reserved", 1, 0.5),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 1, 0.6),
    ("proprietary", "license", "commercial license (?:is )?required", 1, 0.6),
    ("proprietary", "without prior written permission", "(?:reproduced|copied|distributed) without prior written permission", 1, 0.5),
]

#: What a text must hold, whatever its case, for any rule or base phrase to match.
_GAP = r"[^0-9a-z\x80-\x{10FFFF}]+"
GATE = "(?i)licen|" + "|".join(x.replace(" ", _GAP) for x in ("cc by", "cc0", "gpl", "bsd", "spdx", "apache", "public domain", "creative commons", "rights reserved", "proprietary", "wtfpl", "mpl", "epl", "eupl", "cddl", "permission", "redistribution", "unencumbered", "provided as", "free software", "mit no", "mit 0", "endorse or", "advertising materials", "openrail", "open rail", "known copyright", "waived all", "public licence"))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, str]
    regex: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order: marks of license texts, identifiers, each phrasing around the names, bare names.

    Names that share a label and a keyword are alternatives of one regex. A rule's keywords are those of its name and of its phrasing.
    """
    out = [Rule(label, (word, word), regex, p, c) for label, word, regex, p, c in MARKS]
    out += [Rule(label, ("spdx", "spdx"), f"spdx license identifier {spdx}", 5, 1.0) for label, spdx in SPDX]
    for key, phrase, priority, confidence in PHRASINGS:
        out += [Rule(label, (word, key), phrase.format(f"(?:{'|'.join(names)})"), priority, confidence) for label, word, names in NAMES]
    out += [Rule(label, (word, word), f"(?:{'|'.join(names)})", 1, 0.6) for label, word, names in NAMES]
    return [Rule(r.label, r.keywords, f" {r.regex}(?= )", r.priority, r.confidence) for r in out]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


#: Words that are scanned at once, further words that a detection may reach into, and what a block's number is multiplied by in places.
BLOCK, OVER, _FAR = 2000, 40, 1 << 32
_FOUND = "array<struct<start:bigint,back:bigint,rank:int,ord:int,label:string,confidence:double>>"


def _blocks(words: Column, parts: Column, n_words: Column, block: int) -> Column:
    """Array of (words of a block and OVER more, place where the next block begins): the work for many detections stays linear."""
    own = lambda k: F.array_join(F.slice(parts, k + 1, block), " ")
    wide = lambda k: F.array_join(F.slice(parts, k + 1, block + OVER), " ")
    many = F.transform(F.sequence(F.lit(0), n_words.cast("int") - 1, F.lit(block)), lambda k: F.struct(F.concat(F.lit(" "), wide(k), F.lit(" ")).alias("words"), (F.length(own(k)) + 1).alias("next")))
    return F.when(n_words <= block, F.array(F.struct(words.alias("words"), (F.length(words) + 1).alias("next")))).otherwise(many)


def _detections(blocks: Column, live: Column) -> Column:
    """Array of (start, -stop, -priority, order, label, confidence) of all live rules in all blocks, in places of the whole text."""

    def of(block: Column, number: Column) -> Column:
        def by(rule: Column) -> Column:
            # Each match between two marks that no text has here; then the text is cut at the first of them.
            marked = F.regexp_replace(block["words"], rule["regex"], F.lit("\u0001$0\u0002"))
            parts = F.split(marked, "\u0001", -1)
            first = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(_FOUND).alias("out"))

            def step(acc: Column, part: Column) -> Column:
                at, stop = acc["at"], acc["at"] + F.instr(part, "\u0002") - 1
                base = number.cast("bigint") * _FAR
                found = F.struct(
                    (base + at).alias("start"),
                    (-F.when(stop > block["next"], base + _FAR + stop - block["next"]).otherwise(base + stop)).alias("back"),
                    (-rule["priority"]).alias("rank"),
                    rule["ord"].alias("ord"),
                    rule["label"].alias("label"),
                    rule["confidence"].alias("confidence"),
                )
                here = F.when(at < block["next"], F.concat(acc["out"], F.array(found).cast(_FOUND))).otherwise(acc["out"])
                return F.struct((at + F.length(part) - 1).alias("at"), here.alias("out"))

            found = F.aggregate(F.slice(parts, 2, F.length(marked)), first, step)["out"]
            return F.when(F.contains(marked, F.lit("\u0001")), found).otherwise(F.array().cast(_FOUND))

        return F.flatten(F.transform(live, by))

    return F.flatten(F.transform(blocks, of))


def _outermost(detections: Column, priorities: int) -> Column:
    """(distinct labels, highest confidence) of those that no detection of at least the same priority contains: one sweep over sorted intervals."""
    state = F.struct(F.array(*[F.lit(-1).cast("bigint")] * priorities).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        stop, priority = -d["back"], -d["rank"]
        inside = F.get(acc["reach"], priority - 1) >= stop
        reach = F.transform(acc["reach"], lambda x, k: F.when((k < priority) & (x < stop), stop).otherwise(x))
        labels = F.when(inside | F.array_contains(acc["labels"], d["label"]), acc["labels"]).otherwise(F.concat(acc["labels"], F.array(d["label"])))
        best = F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], d["confidence"]))
        return F.struct(reach.alias("reach"), labels.alias("labels"), best.alias("best"))

    return F.aggregate(F.array_sort(detections), state, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    every = rules()
    table = F.array(*[F.struct(F.lit(r.keywords[0]).alias("name"), F.lit(r.keywords[1]).alias("phrase"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(k).alias("ord"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence")) for k, r in enumerate(every)])
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _NOT_WORDS, " ")), F.lit(" ")).alias("words"), text.rlike(GATE).alias("gate"))
    count = F.when(F.col("words") == "  ", F.lit(0)).otherwise(_spaces(F.col("words")) - 1)
    base = base.select("doc_id", count.cast("long").alias("n_words"), F.when(F.col("gate"), _lower(F.col("words"))).alias("words"))

    # Words of long texts, cut once; keywords that occur, then rules that have theirs.
    base = base.withColumn("parts", F.when(F.col("n_words") > block, F.split(F.trim("words"), " ", -1)))
    keywords = sorted({k for r in every for k in r.keywords})
    base = base.withColumn("present", F.when(F.col("words").isNotNull(), F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("words"), k))))
    base = base.withColumn("live", F.filter(table, lambda r: F.array_contains(F.col("present"), r["name"]) & F.array_contains(F.col("present"), r["phrase"])))
    between = [F.split(F.col("words"), f" {phrase}(?= )", -1).alias(f"p{k}") for k, (phrase, _) in enumerate(BASE)]
    rows = base.select("doc_id", "n_words", *[F.when(F.col("words").isNotNull(), x).alias(f"p{k}") for k, x in enumerate(between)], F.when(F.col("words").isNotNull(), _outermost(_detections(_blocks(F.col("words"), F.col("parts"), F.col("n_words"), block), F.col("live")), max(r.priority for r in every))).alias("kept"))
    places = [F.coalesce(F.size(F.col(f"p{k}")) - 1, F.lit(0)) for k in range(len(BASE))]
    places = [F.when(F.col(f"p{k}").isNull(), 0).otherwise(n) for k, n in enumerate(places)]
    first = [F.when(n > 0, _spaces(F.get(F.col(f"p{k}"), F.lit(0)))) for k, n in enumerate(places)]
    last = [F.when(n > 0, F.col("n_words") - (_spaces(F.element_at(F.col(f"p{k}"), -1)) - 1) - len(phrase.split())) for k, (n, (phrase, _)) in enumerate(zip(places, BASE, strict=True))]
    labels = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for n, (_, label) in zip(places, BASE, strict=True)]))
    kept = F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))
    n_base = sum(places[1:], places[0])
    best = F.coalesce(F.col("kept.best"), F.lit(0.0))
    return rows.select(
        F.col("doc_id"),
        F.col("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, kept)), ",").alias("labels"),
        F.greatest(best, F.when(n_base > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
    )
