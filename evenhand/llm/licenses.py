"""License scans by ordered signature rules.

A text is brought to words once: runs of ASCII letters, digits and other letters, lower
case, with single spaces. A rule is a regular expression over such words with a keyword
(whole words) that every match contains, a priority and a weight. Rules are tried only
where their keyword occurs, and those that speak of a license only in texts with that
word. All places of the tried
rules become word intervals; an interval that lies inside one of the same or a better
priority is suppressed (of equal intervals the better priority stays, then the earlier
rule). The labels of the remaining ones, and the base labels, are the result.

Everything is built-in functions inside one projection: no shuffle, nothing collected.
Nulls: a null text has no words, null first and last word, empty labels and score 0.
Repeated rows give repeated rows; extra columns are carried in a struct.
"""

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import let

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_L = "licen[cs]es?"

#: label, keyword of the name, name, keyword of the short form, short form; over words.
FAMILIES = [
    ("apache-1.1", "apache", f"apache (?:software )?{_L} (?:version )?1 1", "apache", "apache 1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?{_L} (?:version )?2(?: 0)?", "apache", "apache 2(?: 0)?"),
    ("gpl-1.0", "gnu", f"gnu general public {_L} (?:version |v)1(?: 0)?", "gpl", "gpl v?1(?: 0)?"),
    ("gpl-2.0", "gnu", f"gnu general public {_L} (?:version |v)2(?: 0)?", "gpl", "gpl (?:version )?v?2(?: 0)?"),
    ("gpl-3.0", "gnu", f"gnu general public {_L} (?:version |v)3(?: 0)?", "gpl", "gpl (?:version )?v?3(?: 0)?"),
    ("gpl", "gnu", f"gnu general public {_L}", "gpl", "gnu gpl"),
    ("lgpl-2.0", "gnu", f"gnu library general public {_L}", "lgpl", "lgpl v?2(?: 0)?"),
    ("lgpl-2.1", "gnu", f"gnu lesser general public {_L} (?:version |v)2 1", "lgpl", "lgpl v?2 1"),
    ("lgpl-3.0", "gnu", f"gnu lesser general public {_L} (?:version |v)3(?: 0)?", "lgpl", "lgpl v?3(?: 0)?"),
    ("lgpl", "lesser", f"lesser general public {_L}", "lgpl", "gnu lgpl"),
    ("agpl-3.0", "affero", f"gnu affero general public {_L}(?: (?:version |v)3(?: 0)?)?", "agpl", "agpl v?3(?: 0)?"),
    ("gfdl-1.3", "gnu", f"gnu free documentation {_L}", "gfdl", "gfdl(?: 1 [0-3])?"),
    ("mit", "mit", f"mit {_L}", "expat", f"expat {_L}"),
    ("mit-0", "mit no attribution", f"mit no attribution(?: {_L})?", "mit 0", "mit 0"),
    ("bsd-2-clause", "bsd", f"(?:simplified|freebsd|2 clause|two clause) bsd {_L}", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", f"(?:new|revised|modified|3 clause|three clause) bsd {_L}", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", f"(?:original|old|4 clause|four clause) bsd {_L}", "bsd", "bsd 4 clause"),
    ("bsd", "bsd", f"(?:berkeley software distribution|bsd) {_L}", "bsd", "bsd style"),
    ("0bsd", "bsd", f"(?:zero clause|free public) bsd {_L}", "0bsd", "0bsd"),
    ("isc", "isc", f"isc {_L}", "isc", "isc style"),
    ("mpl-1.1", "mozilla", f"mozilla public {_L} (?:version |v)?1 1", "mpl", "mpl v?1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_L}(?: (?:version |v)?2 0)?", "mpl", "mpl v?2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public {_L} (?:version |v)?1(?: 0)?", "epl", "epl v?1 0"),
    ("epl-2.0", "eclipse", f"eclipse public {_L}(?: (?:version |v)?2(?: 0)?)?", "epl", "epl v?2 0"),
    ("cddl-1.0", "distribution", f"common development and distribution {_L}", "cddl", "cddl(?: 1 [01])?"),
    ("cpl-1.0", "common", f"common public {_L}", "cpl", "cpl 1 0"),
    ("ipl-1.0", "ibm", f"ibm public {_L}", "ipl", "ipl 1 0"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_L}", "zlib", "zlib acknowledgement"),
    ("libpng", "libpng", f"libpng {_L}", "libpng", "libpng 2 0"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("cc0-1.0", "zero", "creative commons zero(?: 1 0)?(?: universal)?", "cc0", "cc0(?: 1 0)?"),
    ("cc-by-3.0", "attribution", f"creative commons attribution 3 0(?: {_L})?", "cc by", "cc by 3 0"),
    ("cc-by-4.0", "attribution", f"creative commons attribution 4 0(?: international)?(?: {_L})?", "cc by", "cc by 4 0"),
    ("cc-by", "attribution", f"creative commons attribution(?: {_L})?", "cc by", "cc by"),
    ("cc-by-sa-3.0", "attribution", "creative commons attribution share ?alike 3 0", "cc by", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "attribution", "creative commons attribution share ?alike 4 0", "cc by", "cc by sa 4 0"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike", "cc by", "cc by sa"),
    ("cc-by-nc-4.0", "attribution", "creative commons attribution non ?commercial 4 0", "cc by", "cc by nc 4 0"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial", "cc by", "cc by nc"),
    ("cc-by-nd-4.0", "attribution", "creative commons attribution no ?derivatives 4 0", "cc by", "cc by nd 4 0"),
    ("cc-by-nd", "attribution", "creative commons attribution no ?derivatives", "cc by", "cc by nd"),
    ("cc-by-nc-sa-4.0", "attribution", "creative commons attribution non ?commercial share ?alike(?: 4 0)?", "cc by", "cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-nd-4.0", "attribution", "creative commons attribution non ?commercial no ?derivatives(?: 4 0)?", "cc by", "cc by nc nd(?: 4 0)?"),
    ("artistic-1.0", "artistic", f"artistic {_L} (?:version )?1(?: 0)?", "artistic", "artistic 1 0"),
    ("artistic-2.0", "artistic", f"artistic {_L}(?: (?:version )?2(?: 0)?)?", "artistic", "artistic 2 0"),
    ("bsl-1.0", "boost", f"boost software {_L}", "bsl", "bsl 1 0"),
    ("busl-1.1", "business", f"business source {_L}", "busl", "busl 1 1"),
    ("ofl-1.1", "font", f"(?:sil )?open font {_L}", "ofl", "ofl 1 [01]"),
    ("wtfpl", "want", f"do what the fuck you want to public {_L}", "wtfpl", "wtfpl"),
    ("python-2.0", "python", f"python software foundation {_L}", "psf", f"psf {_L}"),
    ("php-3.01", "php", f"php {_L}", "php", "php 3 01"),
    ("ruby", "ruby", f"ruby {_L}", "ruby", f"same {_L} as ruby"),
    ("eupl-1.2", "european", f"european union public {_L}", "eupl", "eupl(?: v?1 [0-2])?"),
    ("ms-pl", "microsoft", f"microsoft public {_L}", "ms pl", "ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_L}", "ms rl", "ms rl"),
    ("osl-3.0", "open", f"open software {_L}(?: 3 0)?", "osl", "osl 3 0"),
    ("afl-3.0", "academic", f"academic free {_L}", "afl", "afl 3 0"),
    ("ecl-2.0", "educational", f"educational community {_L}", "ecl", "ecl 2 0"),
    ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}", "uiuc", f"uiuc {_L}"),
    ("postgresql", "postgresql", f"postgresql {_L}", "postgresql", "postgresql style"),
    ("openssl", "openssl", f"openssl {_L}", "ssleay", f"ssleay {_L}"),
    ("zpl-2.1", "zope", f"zope public {_L}", "zpl", "zpl 2 [01]"),
    ("vim", "vim", f"vim {_L}", "charityware", "charityware"),
    ("odbl-1.0", "database", f"open database {_L}", "odbl", "odbl(?: 1 0)?"),
    ("odc-by-1.0", "commons", f"open data commons attribution {_L}", "odc", "odc by(?: 1 0)?"),
    ("pddl-1.0", "dedication", f"public domain dedication and {_L}", "pddl", "pddl(?: 1 0)?"),
    ("cecill-2.1", "cecill", f"cecill(?: free software)? {_L}", "cecill", "cecill 2 [01]"),
    ("qpl-1.0", "public", f"q public {_L}", "qpl", "qpl 1 0"),
    ("sleepycat", "sleepycat", f"sleepycat {_L}", "sleepycat", "sleepycat software"),
    ("w3c", "w3c", f"w3c(?: software)?(?: notice and)? {_L}", "w3c", "w3c 20150513"),
    ("unicode", "unicode", f"unicode {_L}(?: agreement)?", "unicode", "unicode dfs"),
    ("curl", "curl", f"curl {_L}", "curl", "curl style"),
    ("bzip2", "bzip2", f"bzip2 {_L}", "bzip2", "bzip2 1 0"),
    ("sspl-1.0", "server", f"server side public {_L}", "sspl", "sspl(?: v?1(?: 0)?)?"),
    ("elastic-2.0", "elastic", f"elastic {_L}(?: 2 0)?", "elv2", "elv2"),
    ("commons-clause", "commons", f"commons clause(?: {_L})?", "commons", "commons clause restriction"),
    ("public-domain", "domain", "(?:in|into|to) the public domain", "domain", "public domain work"),
    ("all-rights-reserved", "reserved", "all rights (?:are )?reserved", "reserved", "rights reserved by"),
]

# Versions written in one word, and sentences of the licenses themselves:
# label, keyword, pattern, over words.
JOINED = [
    ("gpl-2.0", "gplv2", "gplv2(?: 0)?"),
    ("gpl-2.0", "gpl2", "gpl2"),
    ("gpl-3.0", "gplv3", "gplv3(?: 0)?"),
    ("gpl-3.0", "gpl3", "gpl3"),
    ("lgpl-2.0", "lgplv2", "lgplv2(?: 0)?"),
    ("lgpl-2.1", "lgplv2", "lgplv2 1"),
    ("lgpl-3.0", "lgplv3", "lgplv3(?: 0)?"),
    ("agpl-3.0", "agplv3", "agplv3(?: 0)?"),
    ("mpl-1.1", "mplv1", "mplv1 1"),
    ("mpl-2.0", "mplv2", "mplv2(?: 0)?"),
    ("epl-1.0", "eplv1", "eplv1(?: 0)?"),
    ("epl-2.0", "eplv2", "eplv2(?: 0)?"),
    ("apache-2.0", "apache2", "apache2"),
]
BODIES = [
    ("mit", "hereby granted free", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsl-1.0", "hereby granted free", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "permission to use", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", "neither the name of (?:[^ ]+ ){1,12}(?:nor|or) the names of its contributors may be used to endorse"),
    ("apache-2.0", "unless required by", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("gpl", "program is free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "library is free", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim or modified", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed"),
    ("cc0-1.0", "associated a work", "the person who associated a work with this deed has dedicated the work to the public domain"),
]
#: Families whose bare identifier names them after a grant; their short forms are others.
NAMED_BY_ID = (
    "mit isc zlib unlicense ncsa postgresql curl openssl vim ruby w3c python-2.0 elastic-2.0 sleepycat bsd apache-2.0 gpl lgpl"
).split()

_GRANT = (
    "(?:licen[cs]ed|released|distributed|available|published|provided) (?:to you )?(?:under|with)"
    " (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
)
_UNDER = "(?:licen[cs]ed|released|distributed|available|published|provided) under "
_LATER = "(?: or later| only)?"
#: priority (0 best), weight, template, which of a family's forms.
TEMPLATES = [
    (0, 1.0, "spdx licen[cs]e identifier {}" + _LATER, "id"),
    (0, 1.0, "spdx licen[cs]e identifier {}", "short"),
    (1, 0.95, _GRANT + "{}", "name"),
    (1, 0.9, _GRANT + "{}", "short"),
    (2, 0.8, "{}", "name"),
    (3, 0.6, "{}", "short"),
]
BASE_WEIGHT = 0.6


def needs_license(pattern: str) -> bool:
    """Whether every match has a word that begins like license: it stands in the pattern
    outside all optional groups and alternatives."""
    held = None
    while held != pattern:
        held = pattern
        pattern = re.sub(r"\(\?:[^()|]*\)(?!\?)", lambda m: m[0][3:-1], pattern)
        pattern = re.sub(r"\(\?:[^()]*\)\??", "", pattern)
    return re.search(r"(^| )licen\[cs\]", pattern) is not None


def rules(families=None, templates=None) -> list[dict]:
    """All rules in order: every template for every family, then the written-out ones."""
    out = []

    def add(priority, weight, label, key, pattern):
        out.append(
            {
                "priority": priority,
                "place": len(out),
                "label": label,
                "weight": weight,
                "keyword": f" {key} ",
                "license": needs_license(pattern),
                "pattern": f"(?<= )(?:{pattern})(?= )",
            }
        )

    for priority, weight, template, form in templates or TEMPLATES:
        for label, name_key, name, short_key, short in families or FAMILIES:
            words_ = label.replace("-", " ").replace(".", " ")
            key, body = {"name": (name_key, name), "short": (short_key, short), "id": (words_, words_)}[form]
            add(priority, weight, label, key, template.format(f"(?:{body})"))
    if templates is None:
        for label, key, body in JOINED:
            add(1, 0.9, label, key, _GRANT + body + _LATER)
            add(3, 0.6, label, key, body + _LATER)
        for label, key, body in BODIES:
            add(1, 0.95, label, key, body)
        for label in NAMED_BY_ID:
            words_ = label.replace("-", " ").replace(".", " ")
            for article in ("", "the "):
                add(1, 0.9, label, f"under {article}{words_}", f"{_UNDER}{article}{words_}")
    return out


_RULE = "array<struct<priority:int,place:int,label:string,weight:double,keyword:string,license:boolean,pattern:string>>"
_FOUND = "array<struct<start:int,back:int,priority:int,place:int,label:string,weight:double>>"
_OPEN, _CLOSE = "\x01", "\x02"


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def words(text: Column) -> Column:
    """The words of ``text`` in lower case, with single spaces."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _SEPARATORS, " ")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # only A-Z: other letters have lower cases among a-z; a text without them is lowered faster
    ascii_ = F.octet_length(plain) == F.length(plain)
    return F.trim(F.when(ascii_, F.lower(plain)).otherwise(F.translate(plain, letters, letters.lower())))


def places(norm: Column, rule: Column) -> Column:
    """Word intervals [start, end) of all matches of one rule; ``back`` is -end."""
    marked = F.regexp_replace(norm, rule["pattern"], F.lit(f"{_OPEN}$0{_CLOSE}"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(a: Column, piece: Column) -> Column:
        size = spaces(F.substring_index(piece, _CLOSE, 1)) + 1
        one = F.struct(
            (a["at"] - 1).alias("start"),
            (-(a["at"] - 1 + size)).alias("back"),
            rule["priority"].alias("priority"),
            rule["place"].alias("place"),
            rule["label"].alias("label"),
            rule["weight"].alias("weight"),
        )
        held = F.when(piece.contains(_CLOSE), F.concat(a["out"], F.array(one))).otherwise(a["out"])
        return F.struct((a["at"] + spaces(piece)).alias("at"), held.alias("out"))

    return F.aggregate(F.split(marked, _OPEN), start, step, lambda a: a["out"])


def resolved(found: Column, levels: int) -> Column:
    """Labels and best weight of the intervals that no other of the same or a better
    priority contains. In order of start and then of falling end, a container comes
    first, so the largest end so far of each priority decides."""
    start = F.struct(
        F.array_repeat(F.lit(-1), levels).alias("ends"),
        F.array().cast("array<string>").alias("labels"),
        F.lit(0.0).alias("score"),
    )

    def step(a: Column, d: Column) -> Column:
        end = -d["back"]
        kept = F.array_max(F.slice(a["ends"], F.lit(1), d["priority"] + 1)) < end
        ends = F.transform(
            a["ends"], lambda x, i: F.when(i == d["priority"], F.greatest(x, end)).otherwise(x)
        )
        return F.struct(
            F.when(kept, ends).otherwise(a["ends"]).alias("ends"),
            F.when(kept, F.array_union(a["labels"], F.array(d["label"]))).otherwise(a["labels"]).alias("labels"),
            F.when(kept, F.greatest(a["score"], d["weight"])).otherwise(a["score"]).alias("score"),
        )

    done = F.aggregate(F.array_sort(found), start, step)
    return let(done, lambda a: F.struct(a["labels"].alias("labels"), a["score"].alias("score")))


def scan(docs: DataFrame, carry: list[str], chosen: list[dict] | None = None) -> DataFrame:
    """``_row`` (the carried columns), the base columns, ``labels`` and ``score``."""
    chosen = chosen or rules()
    levels = max(r["priority"] for r in chosen) + 1
    table = F.from_json(F.lit(json.dumps(chosen)), _RULE)
    base = " (?=(?:" + "|".join(PHRASES) + ") )"
    norm = F.col("norm")
    any_of = lambda keys: reduce(lambda a, k: a | norm.contains(k), sorted(keys), F.lit(False))
    licensed = norm.contains(" licen")
    granted = norm.contains("ed under ") | norm.contains("available under ")
    keys = {r["keyword"] for r in chosen if not r["license"]}
    under = {k for k in keys if k.startswith(" under ")}  # these follow a grant
    gate = (licensed & any_of({r["keyword"] for r in chosen if r["license"]})) | any_of(keys - under)
    gate = gate | (granted & any_of(under))
    has_base = F.lit(False)
    for p in PHRASES:
        has_base = has_base | norm.contains(f" {p} ")
    prepared = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        words(F.col("text").cast("string")).alias("trimmed"),
    ).select(
        "_row",
        F.when(F.col("trimmed") == "", 0).otherwise(spaces(F.col("trimmed")) + 1).cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.col("trimmed"), F.lit(" ")).alias("norm"),
    )
    empty = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    hits = F.filter(table, lambda r: norm.contains(r["keyword"]) & (~r["license"] | licensed))
    found = F.flatten(F.transform(hits, lambda r: places(norm, r)))
    marked = prepared.select(
        "_row",
        "n_words",
        F.when(has_base, F.regexp_count(norm, F.lit(base))).otherwise(0).cast("long").alias("n_base"),
        F.when(has_base, spaces(F.expr("substring(norm, 1, regexp_instr(norm, '%s'))" % base)) - 1)
        .cast("long")
        .alias("first_word"),
        F.when(has_base, spaces(F.regexp_extract(norm, f"(?s)^(.*){base}", 1)))
        .cast("long")
        .alias("last_word"),
        F.filter(
            F.array(*[F.when(norm.contains(f" {p} "), F.lit(x)) for p, x in PHRASES.items()]),
            lambda x: x.isNotNull(),
        ).alias("base"),
        F.when(gate, resolved(found, levels)).otherwise(empty).alias("method"),
    )
    return marked.select(
        "_row",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.col("method.labels"))), ",").alias("labels"),
        F.greatest(
            F.col("method.score"), F.when(F.col("n_base") > 0, BASE_WEIGHT).otherwise(0.0)
        ).alias("score"),
    )
