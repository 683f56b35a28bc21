import re

import pytest

from evenhand.llm import licenses, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_base(text):
    w, starts, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), labels


def brute_method(text, rules):
    norm = f" {' '.join(words(text))} "
    found = []
    for r in rules:
        for m in re.finditer(r["pattern"], norm):
            start = norm[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r["priority"], r["place"], r["label"], r["weight"]))
    kept = [
        d
        for d in found
        if not any(
            e is not d
            and e[0] <= d[0]
            and e[1] >= d[1]
            and e[2] <= d[2]
            and (e[:2] != d[:2] or e[2:4] < d[2:4])
            for e in found
        )
    ]
    return {d[4] for d in kept}, max([d[5] for d in kept], default=0.0)


TEXTS = [
    None,
    "",
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License. MIT License mit LICENSE",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. CC BY 4.0, cc-by-sa",
    "SPDX-License-Identifier: GPL-2.0\nGNU Lesser General Public License v2.1 or the gnu gpl",
    "the mozilla public license 2.0 and the BSD 3-clause; 3-clause BSD license; all rights reserved",
    "permit license apachelicense cc bye été MİT License mit licensé",
    "x " * 5000 + "cc by " * 300 + "mit license",
    "dedicated to the public domain under CC0 1.0 Universal; unlicense.org",
    "CC0 1.0 Universal",
    "Creative Commons Zero 1.0 Universal, MIT No Attribution, MIT-0",
    "released under the MS-PL and Creative Commons Attribution ShareAlike 3.0",
]


def test_against_brute_force(spark):
    rules = licenses.rules()
    assert 200 <= len(rules) and all(re.compile(r["pattern"]) for r in rules)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.scan(docs, ["doc_id"]).collect():
        text = TEXTS[r._row.doc_id]
        n, places, first, last, base = brute_base(text)
        labels, score = brute_method(text, rules)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, places, first, last)
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | labels)), text[:80]
        assert r.score == max(score, 0.6 if places else 0.0)


def test_containment(spark):
    docs = spark.createDataFrame([(1, "licensed under the GNU General Public License, version 3")], "doc_id long, text string")
    r = licenses.scan(docs, ["doc_id"]).first()
    assert r.labels == "gpl,gpl-3.0" and r.score == 0.95
    short = licenses.scan(spark.createDataFrame([(1, "GPLv3")], "doc_id long, text string"), ["doc_id"]).first()
    assert short.labels == "gpl-3.0"


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: MIT", "mit"),
        ("// SPDX-License-Identifier: ISC", "isc"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
        ("SPDX-License-Identifier: Unlicense", "unlicense"),
        ("Released under MIT.", "mit"),
        ("It is distributed under the zlib.", "zlib"),
        ("GPLv3 or later", "gpl-3.0"),
        ("LGPLv2.1", "lgpl-2.1"),
        ("AGPLv3", "agpl-3.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd-3-clause"),
        ("Er kommt mit dem Zug und wird mit uns fahren", ""),
    ],
)
def test_common_marks(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first().labels == labels


def test_every_keyword_is_in_its_rule():
    for r in licenses.rules():
        assert r["keyword"].strip() in r["pattern"], r
    by = {(r["label"], r["priority"]): r for r in licenses.rules()}
    assert by["mit", 2]["license"] and not by["gpl-3.0", 3]["license"]
    assert not by["cc-by-4.0", 2]["license"] and by["apache-2.0", 0]["license"]


def test_query(spark, rows, docs, crowded, none, as_table):
    run = queries.QUERIES["op5_licenses"]
    got = run(spark, as_table(docs)).collect()
    want = sorted(((r[0], *brute_base(r[1])[:4]) for r in rows), key=repr)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want
    plan = licenses.scan(crowded, crowded.columns)
    assert plan.count() == len(rows)
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    assert run(spark, as_table(none)).count() == 0
