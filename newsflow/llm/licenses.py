"""License scans by ordered signature rules.

A rule is a regular expression over a text's words, with a keyword, a label, a priority and a weight. The rules are
the license names below, spelled as people spell them, in every form of mention, and sentences out of license
texts. Rules of one form share phrases, one of which stands in every match; a text's words are looked up for these
phrases, then for the rule's name, and only then for its expression, so that no match is lost. Detections are intervals of words. In order of their start, longest first, a detection inside an earlier one is
suppressed, and of two that overlap the one of higher priority stays.

The base phrases are counted at every place, suppressed or not, and their labels are always reported.
Null and empty texts have no words and no labels; positions are then null and the score is 0.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels to be counted.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing
# The two letters beyond ASCII whose lower case has an ASCII letter, and one that stands for them.
TO_ASCII, KEPT = ("\u0130", "\u212a"), "\u00e6"

NAMES = {
    "mit": ["mit", "expat", "x11"],
    "apache": ["apache", "apache software", "asl"],
    "gpl": ["gpl", "gnu gpl", "general public", "gnu general public"],
    "lgpl": ["lgpl", "gnu lgpl", "lesser general public", "gnu lesser general public", "library general public"],
    "agpl": ["agpl", "gnu agpl", "affero general public", "gnu affero general public"],
    "gfdl": ["gfdl", "free documentation", "gnu free documentation"],
    "bsd": ["bsd", "new bsd", "simplified bsd", "modified bsd", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd"],
    "mpl": ["mpl", "mozilla", "mozilla public"],
    "isc": ["isc", "internet systems consortium"],
    "epl": ["epl", "eclipse", "eclipse public"],
    "cddl": ["cddl", "common development and distribution"],
    "eupl": ["eupl", "european union public"],
    "artistic": ["artistic", "perl artistic"],
    "boost": ["boost", "boost software", "bsl"],
    "zlib": ["zlib", "zlib libpng", "libpng"],
    "cc-by": ["cc by", "creative commons attribution", "creative commons"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc0": ["cc0", "creative commons zero"],
    "unlicense": ["unlicense", "the unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public"],
    "ofl": ["ofl", "sil ofl", "sil open font", "open font"],
    "odbl": ["odbl", "open database"],
    "python": ["psf", "python software foundation"],
    "php": ["php"],
    "ruby": ["ruby"],
    "openssl": ["openssl", "ssleay"],
    "postgresql": ["postgresql"],
    "ms-pl": ["ms pl", "microsoft public"],
}

VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "covered")
LICENSE = ("license", "licence")

# Phrases, one of which stands in every match; form, priority (1 is strongest), weight. {} is a name.
FORMS = [
    (("spdx license identifier",), r"spdx license identifier {}(?: \d+){{0,2}}(?: only| or later)?", 1, 1.0),
    (tuple(f"{v} under" for v in VERBS), rf"(?:{'|'.join(VERBS)}) under (?:the )?(?:terms of (?:the )?)?{{}}"
     r"(?: licen[sc]e)?(?: version)?(?: v?\d+){{0,2}}", 2, 0.95),
    (LICENSE, r"{} licen[sc]e (?:version )?v?\d+(?: \d+)?", 3, 0.9),
    (LICENSE, r"see (?:the )?{} licen[sc]e(?: for(?: more)? details)?", 4, 0.85),
    (LICENSE, r"{} licen[sc]e", 5, 0.8),
    (LICENSE, r"licen[sc]e {}(?: v?\d+){{0,2}}", 6, 0.6),
]

# Sentence, label, priority, weight.
SENTENCES = [
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 1, 1.0),
    ("in no event shall the authors or copyright holders be liable", "mit", 4, 0.7),
    ("redistribution and use in source and binary forms(?: with or without modification)?", "bsd", 1, 1.0),
    ("may be used to endorse or promote products derived", "bsd", 3, 0.9),
    ("you may not use this file except in compliance with the license", "apache", 1, 1.0),
    ("distributed on an as is basis without warranties or conditions of any kind", "apache", 2, 0.9),
    ("free software you can redistribute it and or modify it", "gpl", 1, 1.0),
    ("without even the implied warranty of merchantability", "gpl", 3, 0.8),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 1, 1.0),
    ("free and unencumbered software released into the public domain", "unlicense", 1, 1.0),
    ("(?:is|are) (?:hereby )?(?:placed|released|dedicated)? ?(?:in|into|to) the public domain", "public-domain", 2, 0.9),
    ("boost software license version 1 0", "boost", 1, 1.0),
    ("the origin of this software must not be misrepresented", "zlib", 1, 1.0),
    ("subject to the terms of the mozilla public license", "mpl", 1, 1.0),
    ("waived all copyright and related or neighboring rights", "cc0", 1, 1.0),
    ("proprietary and confidential", "proprietary", 2, 0.8),
    ("all rights reserved", "all-rights-reserved", 6, 0.3),
]


def fixed_part(expression: str) -> str:
    """The longest run of words outside all groups: every match contains it."""
    return max(re.split(r"\(\?:[^()]*\)\??| \?", expression), key=len).strip()


def rule_groups() -> dict[tuple[str, ...], list[tuple[str, str, str, int, float]]]:
    """The rules by the phrases of which every match contains one: words in every match, regular expression, label,
    priority, weight."""
    groups: dict[tuple[str, ...], list[tuple[str, str, str, int, float]]] = {}
    for phrases, form, priority, weight in FORMS:
        rules = [(name, form.format(name), label, priority, weight) for label, names in NAMES.items() for name in names]
        groups.setdefault(phrases, []).extend(rules)
    for sentence, *rest in SENTENCES:
        groups.setdefault((fixed_part(sentence),), []).append((fixed_part(sentence), sentence, *rest))
    return groups


def signature_rules() -> list[tuple[str, str, str, int, float]]:
    """All rules: words in every match, regular expression, label, priority, weight."""
    return [rule for rules in rule_groups().values() for rule in rules]


def _whole(expression: Column | str) -> Column:
    """The expression between blanks."""
    return F.concat(F.lit("(?<= )(?:"), expression if isinstance(expression, Column) else F.lit(expression), F.lit(")(?= )"))


def _places(words: Column, expression: Column | str) -> Column:
    """First and last word numbers of every match, as an array of (start, end); ``words`` has blanks around each word."""
    marked = F.split(F.trim(F.regexp_replace(words, _whole(expression), F.lit("\u0001$0\u0002"))), " ")
    at = F.transform(marked, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    starts = F.transform(F.filter(at, lambda x: x["w"].startswith("\u0001")), lambda x: x["i"])
    ends = F.transform(F.filter(at, lambda x: x["w"].endswith("\u0002")), lambda x: x["i"])
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def _holds(words: Column, phrase: Column | str) -> Column:
    return F.contains(words, F.concat(F.lit(" "), F.lit(phrase), F.lit(" ")))


def _matching_rules(words: Column) -> Column:
    """The rules whose phrase, then whose words and then whose expression is found."""
    names = ("word", "regex", "label", "priority", "weight")
    of_groups = []
    for phrases, rules in rule_groups().items():
        listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rules])
        in_text = reduce(or_, [_holds(words, p) for p in phrases])
        of_groups.append(F.when(in_text, F.filter(listed, lambda r: _holds(words, r["word"]))))
    gated = F.flatten(F.array_compact(F.array(*of_groups)))
    return F.filter(gated, lambda r: F.regexp_like(words, _whole(r["regex"])))


def _detections(words: Column, rules: Column) -> Column:
    def found(rule: Column) -> Column:
        return F.transform(
            _places(words, rule["regex"]),
            lambda p: F.struct(
                p["start"].alias("start"),
                (-p["end"]).alias("minus_end"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
                rule["weight"].alias("weight"),
            ),
        )

    return F.sort_array(F.flatten(F.transform(rules, found)))


def _surviving(detections: Column) -> Column:
    """Detections left after suppression; they come in order of start, longest first, strongest first."""
    none = F.slice(detections, 1, 0)

    def step(kept: Column, new: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        inside = new["minus_end"] >= last["minus_end"]
        overlaps = new["start"] <= -last["minus_end"]
        stronger = new["priority"] < last["priority"]
        return (
            F.when(F.size(kept) == 0, F.array(new))
            .when(inside, kept)
            .when(overlaps & stronger, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(new)))
            .when(overlaps, kept)
            .otherwise(F.concat(kept, F.array(new)))
        )

    return F.aggregate(detections, none, step)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: word count, the base phrases' places and labels, all labels and a score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    no_places = F.array().cast("array<struct<start:int,end:int>>")
    no_hits = F.array().cast("array<struct<start:int,minus_end:int,priority:int,label:string,weight:double>>")
    beyond = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(KEPT)), TO_ASCII, text)
    rows = docs.select(
        "doc_id",
        # Rules are ASCII, so that letters beyond it may change their case as long as they stay beyond it.
        F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(beyond), SEPARATORS, " ")), F.lit(" ")).alias("words"),
    )
    blanks = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" ")))
    rows = rows.withColumn("n_words", F.when(F.col("words") == "  ", 0).otherwise(blanks - 1).cast("long"))
    for phrase, label in BASE.items():
        places = F.when(F.contains("words", F.lit(f" {phrase} ")), _places(F.col("words"), phrase))
        rows = rows.withColumn(f"at_{label}", F.coalesce(places, no_places))
    # Each step is a column that the next one names twice; written in one, the steps would be repeated.
    rows = rows.withColumn("rules", _matching_rules(F.col("words")))
    rows = rows.withColumn("found", F.when(F.size("rules") > 0, _detections(F.col("words"), F.col("rules"))))
    rows = rows.withColumn("hits", F.coalesce(F.when(F.size("found") > 0, _surviving(F.col("found"))), no_hits))
    places = F.concat(*[F.transform(f"at_{label}", lambda p: p["start"]) for label in BASE.values()])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in BASE.values()]))
    rows = rows.withColumns({"places": places, "base": base_labels})
    every_label = F.array_union("base", F.transform("hits", lambda h: h["label"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every_label), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["weight"])), F.lit(0.0)).alias("score"),
        F.transform("hits", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"), (-h["minus_end"]).alias("end"))).alias("spans"),
    )
