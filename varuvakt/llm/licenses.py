"""License detection by ordered signature rules.

Rules are families times phrasings, and signatures of license bodies and standard headers, each an expression over the lower-cased
text whose blanks stand for white space and comment signs. An expression runs only where the literals occur that any match of its
phrasing and of its name must hold; both are derived from the expressions. A detection that lies inside another one of the same or a better class, and is not the
better of two equal ones, is suppressed. Class 0 (a license tag) goes before 1 (a grant), 2 (a named license) and 3 (a bare name).

The base labels come from phrases of whole words. Everything is Column expressions in one pass without a shuffle.

Cases: null texts are empty ones; a text without words has n_words 0, no labels and score 0. Repeated rows and rows without
doc_id come back one by one; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import re._parser as expressions
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.llm.common import ascii_lower, texts_of
from varuvakt.llm.secrets import alternatives
from varuvakt.llm.spans import bound, match_spans, running

#: Fixed table of families: label, expression of the name.
FAMILIES = (
    ("mit", r"mit"),
    ("apache-1.1", r"apache[ -](?:software )?(?:licen[cs]e,? )?(?:version |v\.? ?)?1\.1"),
    ("apache-2.0", r"apache[ -](?:software )?(?:licen[cs]e,? )?(?:version |v\.? ?)?2(?:\.0)?"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[cs]e|gpl),?[ -]?(?:version |v\.? ?)?2(?:\.0)?"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[cs]e|gpl),?[ -]?(?:version |v\.? ?)?3(?:\.0)?"),
    ("lgpl-2.1", r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),?[ -]?(?:version |v\.? ?)?2\.1"),
    ("lgpl-3.0", r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),?[ -]?(?:version |v\.? ?)?3(?:\.0)?"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[cs]e|agpl),?[ -]?(?:version |v\.? ?)?3(?:\.0)?"),
    ("fdl-1.3", r"gnu free documentation licen[cs]e(?:,? version 1\.[123])?"),
    ("bsd-2-clause", r"(?:simplified bsd|bsd[ -]2[ -]clause|2[ -]clause bsd)"),
    ("bsd-3-clause", r"(?:modified bsd|new bsd|bsd[ -]3[ -]clause|3[ -]clause bsd)"),
    ("mpl-1.1", r"(?:mozilla public licen[cs]e|mpl),?[ -]?(?:version |v\.? ?)?1\.1"),
    ("mpl-2.0", r"(?:mozilla public licen[cs]e|mpl),?[ -]?(?:version |v\.? ?)?2(?:\.0)?"),
    ("epl-1.0", r"(?:eclipse public licen[cs]e|epl),?[ -]?(?:version |v\.? ?)?1(?:\.0)?"),
    ("epl-2.0", r"(?:eclipse public licen[cs]e|epl),?[ -]?(?:version |v\.? ?)?2(?:\.0)?"),
    ("cddl-1.0", r"(?:common development and distribution licen[cs]e|cddl)(?:[ -]?1\.[01])?"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?:,?[ -]?(?:version |v\.? ?)?1\.[012])?"),
    ("isc", r"isc"),
    ("zlib", r"zlib(?:/libpng)?"),
    ("boost-1.0", r"(?:boost software licen[cs]e|bsl),?[ -]?(?:version )?1\.0"),
    ("artistic-2.0", r"artistic[ -](?:licen[cs]e )?2(?:\.0)?"),
    ("postgresql", r"postgresql"),
    ("python-2.0", r"(?:python software foundation|psf)(?: licen[cs]e)?(?:,? version 2)?"),
    ("ofl-1.1", r"(?:sil open font licen[cs]e|ofl)(?:,?[ -]?(?:version )?1\.1)?"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"(?:do what the fuck you want to public licen[cs]e|wtfpl)"),
    ("cc0-1.0", r"(?:creative commons zero|cc0)(?:[ -]?1\.0)?(?: universal)?"),
    ("cc-by", r"(?:creative commons attribution|cc[ -]by)[ -](?:[1-4]\.0)"),
    ("cc-by-sa", r"(?:creative commons attribution[ -]share[ -]?alike|cc[ -]by[ -]sa)[ -]?(?:[1-4]\.0)?"),
    ("cc-by-nc", r"(?:creative commons attribution[ -]non[ -]?commercial|cc[ -]by[ -]nc)[ -](?:[1-4]\.0)"),
    ("cc-by-nd", r"(?:creative commons attribution[ -]no[ -]?deriv\w*|cc[ -]by[ -]nd)[ -]?(?:[1-4]\.0)?"),
    ("cc-by-nc-sa", r"(?:creative commons attribution[ -]non[ -]?commercial[ -]share[ -]?alike|cc[ -]by[ -]nc[ -]sa)[ -]?(?:[1-4]\.0)?"),
    ("cc-by-nc-nd", r"(?:creative commons attribution[ -]non[ -]?commercial[ -]no[ -]?deriv\w*|cc[ -]by[ -]nc[ -]nd)[ -]?(?:[1-4]\.0)?"),
)
#: Fixed table of phrasings: class, expression with the name in place of NAME.
PHRASINGS = (
    (0, r"spdx-licen[cs]e-identifier:\s*NAME\b"),
    (1, r"(?:licen[cs]ed|released|distributed|published|available|provided) under (?:a |the )?(?:terms of (?:a |the )?)?NAME(?: licen[cs]e)?\b"),
    (1, r"(?:subject to|governed by|under) the terms (?:and conditions )?of the NAME(?: licen[cs]e)?\b"),
    (1, r"redistribut\w+ (?:it )?(?:and/or modify it )?under (?:the terms of )?the NAME\b"),
    (2, r"copy of the NAME(?: licen[cs]e)?\b"),
    (2, r"\bNAME,? (?:licen[cs]e|licen[cs]ed)\b"),
    (2, r"\blicen[cs]e\s*[:=]\s*[\"']?NAME\b"),
    (3, r"\bgnu NAME\b"),
)
PUBLISHED = r"gnu %sgeneral public licen[cs]e,? as published by the free software foundation[,;:]? (?:either )?(?:version |v\.? ?)"
#: Fixed table of license bodies and standard headers: label, expression. All are grants. The BSD text runs on to its third clause
#: where it has one, and then holds the shorter match.
SIGNATURES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("boost-1.0", r"permission is hereby granted, free of charge, to any person or organi[sz]ation obtaining a copy of the software"),
    ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("bsd-2-clause", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd-3-clause",
        r"redistribution and use in source and binary forms, with or without modification, are permitted"
        r"(?:(?!redistribution and use in|neither the names? of|may not be used to endorse)[\s\S])*+(?:neither the names? of|may not be used to endorse)",
    ),
    ("gpl-2.0", PUBLISHED % "" + r"2\b"),
    ("gpl-3.0", PUBLISHED % "" + r"3\b"),
    ("lgpl-2.0", PUBLISHED % "(?:lesser|library) " + r"2\b(?!\.1)"),
    ("lgpl-2.1", PUBLISHED % "(?:lesser|library) " + r"2\.1\b"),
    ("lgpl-3.0", PUBLISHED % "(?:lesser|library) " + r"3\b"),
    ("agpl-3.0", PUBLISHED % "affero " + r"3\b"),
    ("apache-2.0", r"apache licen[cs]e,? version 2\.0, january 2004"),
    ("zlib", r"this software is provided ['\"]?as[ -]is['\"]?, without any express or implied warranty\. in no event will the authors? be held liable"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"you just do what the fuck you want to"),
)
#: Words of a way to read an expression that its gate asks for, the longest first.
MOST_WORDS = 3
#: A blank of the tables above in a text: white space, perhaps with comment signs before the next word.
BLANK = r"(?:\s+(?:[*#/;%>|-]+\s*)?)"
CONFIDENCE = (1.0, 0.95, 0.85, 0.6)
#: Score of a phrase of whole words alone.
PHRASE_SCORE = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

DETECTION = "array<struct<start:int,back:int,class:int,label:string>>"
PLACES = "array<struct<label:string,at:int>>"


def spaced(expression: str, blank: str = BLANK) -> str:
    """A table's expression with ``blank`` for each of its blanks."""
    return expression.replace("[ -]", "(?:-| )").replace(" ", blank)


def weakest(sets: set[frozenset[str]]) -> list[frozenset[str]]:
    """Without the sets of words that another one follows from, as parts of their words."""

    def follows(own: frozenset[str], other: frozenset[str]) -> bool:
        return all(any(word in longer for longer in own) for word in other)

    return [q for q in sorted(sets, key=sorted) if not any(follows(q, other) and (not follows(other, q) or sorted(other) < sorted(q)) for other in sets)]


def needed(expression: str) -> list[frozenset[str]]:
    """Sets of literals, one of which all lie in any match, as in the trigram queries of ``secrets``; an empty set asks for nothing."""
    runs = ["".join("\n" if c is None else c for c in way).split("\n") for way in alternatives(expressions.parse(spaced(expression, r"\s")))]
    return weakest({frozenset(sorted(filter(None, own), key=lambda w: (-len(w), w))[:MOST_WORDS]) for own in runs})


def rules() -> list[tuple[int, str, str, str, str]]:
    """class, expression without its name, name, expression, label; in order of class."""
    made = [(c, text.replace("NAME", r"\s"), name, text.replace("NAME", f"(?:{name})"), label) for c, text in PHRASINGS for label, name in FAMILIES]
    made += [(1, text, r"\s", text, label) for label, text in SIGNATURES]
    return sorted(((c, text, name, spaced(whole), label) for c, text, name, whole, label in made), key=lambda rule: rule[0])


def holds(text: Column, *any_of: str) -> Column:
    """Whether ``text`` holds what a match of one of the expressions must hold."""
    sets = weakest({words for e in any_of for words in needed(e)})
    return reduce(or_, [reduce(and_, [F.contains(text, F.lit(word)) for word in sorted(words, key=lambda w: (-len(w), w))], F.lit(True)) for words in sets])


def phrase_places(words: Column) -> Column:
    """Places of the three phrases: struct(label, at)."""

    def place(word: Column, i: Column) -> Column:
        before, earlier = F.get(words, i - 1), F.get(words, i - 2)
        return (
            F.when(word != "license", F.lit(None))
            .when(before.isin("mit", "apache"), F.struct(before.alias("label"), (i - 1).alias("at")))
            .when((before == "public") & (earlier == "general"), F.struct(F.lit("gpl").alias("label"), (i - 2).alias("at")))
        )

    return F.filter(F.transform(words, place), lambda p: p.isNotNull())


def detections(lower: Column, gated: bool = True) -> Column:
    """Unsuppressed detections, by start: struct(start, back = -end, class, label)."""
    made = rules()
    # What phrasings and names need is looked up once a text, not once a rule.
    asked, named = ({e: k for k, e in enumerate(dict.fromkeys(rule[n] for rule in made))} for n in (1, 2))
    rows = [(c, asked[text], named[name], pattern, label) for c, text, name, pattern, label in made]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("class", "asked", "named", "pattern", "label"), row, strict=True)]) for row in rows])
    held = F.struct(*[F.array(*[holds(lower, e) if gated else F.lit(True) for e in of]).alias(n) for n, of in (("asked", asked), ("named", named))])
    open_rules = bound(held, lambda h: F.filter(table, lambda r: F.get(h["asked"], r["asked"]) & F.get(h["named"], r["named"])))
    found = F.flatten(
        F.transform(open_rules, lambda r: F.transform(match_spans(lower, r["pattern"]), lambda s: F.struct(s["start"], (-s["end"]).alias("back"), r["class"], r["label"])))
    )
    classes = len(CONFIDENCE)

    def sweep(reached: Column, d: Column) -> Column:
        # Ends reached so far by each class; whatever starts earlier or ends later has been seen.
        inside = F.exists(F.slice(reached, 1, d["class"] + 1), lambda end: end >= -d["back"])
        ends = F.transform(reached, lambda end, c: F.when(c == d["class"], F.greatest(end, -d["back"])).otherwise(end))
        return F.struct(ends.alias("state"), F.struct(d.alias("d"), (~inside).alias("kept")).alias("out"))

    one = DETECTION.removeprefix("array<").removesuffix(">")
    swept = running(F.array_sort(found), F.array(*[F.lit(-1)] * classes), sweep, f"struct<d:{one},kept:boolean>")
    return F.transform(F.filter(swept, lambda s: s["kept"]), lambda s: s["d"])


def scan(docs: DataFrame, gated: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections; ``gated`` only spares work."""
    rows = texts_of(docs).withColumn("n_words", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long"))
    # ASCII letters only are folded where positions and words count.
    folded = ascii_lower(F.col("text"))
    rows = rows.withColumn("lower", folded)
    gate = holds(F.col("lower"), "license", *dict.fromkeys(rule[1] for rule in rules()))
    rows = rows.withColumn("folded", F.when(gate if gated else F.lit(True), F.col("lower")).otherwise(F.lit("")))
    places = F.when(F.contains("folded", F.lit("license")), bound(F.regexp_extract_all("folded", F.lit(WORD), F.lit(0)), phrase_places)).otherwise(F.array().cast(PLACES))
    kept = F.when(F.col("folded") != "", detections(F.col("folded"), gated)).otherwise(F.array().cast(DETECTION))
    rows = rows.select("doc_id", "n_words", places.alias("places"), kept.alias("kept"))
    at = F.transform("places", lambda p: p["at"].cast("long"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("kept", lambda d: d["label"])
    confidence = F.array(*map(F.lit, CONFIDENCE))
    best = F.coalesce(F.array_max(F.transform("kept", lambda d: F.get(confidence, d["class"]))), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"),
        F.transform("kept", lambda d: F.concat_ws(":", d["label"], d["start"], -d["back"])).alias("detections"),
    )
