import random
import time
import hashlib
import re

from hypothesis import given, settings, strategies as st

import numpy as np

from evenhand.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text("ab_.@+-() 0123459\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_known_base_spans():
    text = "a@b.c_d@e.f 1.2.3.4.5.6.7.8; 4111 1111 1111 1111; +1 (743) 555-3824; 999.1.1.1"
    assert pii.base_spans(text) == brute(text)
    assert [s[0] for s in pii.base_spans(text)] == ["email", "email", "ip", "ip", "card", "phone"]


def corpus(spark):
    rows, k = [], 0
    for i in range(400):
        a, b, c = 100 + i % 900, 1000 + (i * 37) % 9000, i % 250
        for text in (
            f"mail {chr(97 + i % 26)}x{i}@mail{i % 9}.example.com now",
            f"call +1 ({a}) 555-{b} today, page {i}",
            f"host {c}.{(c * 7) % 256}.3.{i % 256} is up since 19{i % 90 + 10}",
            f'the token = "{hashlib.md5(str(i).encode()).hexdigest()}" here',
            f"version 3.{i} of chapter {i} and extraordinarilylongish words",
        ):
            rows.append((k, text))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_added_spans(spark):
    judge = pii.fit(corpus(spark), fit_docs=2000)
    assert len(judge.trees) == 20 and judge.least
    texts = [
        "please call (830) 555-5433 soon",
        'a secret = "9f86d081884c7d659a2feaa0c55ad015" there',
        "chapter 12 of version 3.7, in 1987",
        "only words here and there",
    ]
    added = [[text[a:b] for _, a, b in m] for text, (_, m) in zip(texts, judge.spans(texts))]
    assert added[0] and "555-5433" in added[0][0]
    assert added[1] == ["9f86d081884c7d659a2feaa0c55ad015"]
    assert added[2] == [] and added[3] == []
    for base, more in judge.spans(["x +1 (743) 555-3824 y a@b.co"]):
        spans = sorted((a, b) for _, a, b in base + more)
        assert len(base) == 2 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    judge = pii.fit(docs.where("doc_id % 2 = 0"))
    right = total = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        base = pii.base_spans(r.text)
        for c in pii.proposals(r.text):
            label = pii.weak_label(r.text, pii.Taken(base), c)
            if label is not None:
                chance = judge.chance(__import__("numpy").array([pii.features(r.text, c[0], c[2], c[3])], float))[0]
                right += (chance >= 0.5) == (label == 1)
                total += 1
    assert right / total > 0.97


def test_query(spark, rows, docs, none, as_table):
    run = queries.QUERIES["op3_pii"]
    found = run(spark, as_table(docs)).collect()
    want = []
    for r in rows:
        b = brute(r[1] or "")
        text = ",".join(f"{k}:{x}:{y}" for k, x, y in b)
        want.append((r[0], *(sum(s[0] == k for s in b) for k in PATTERNS), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(want, key=repr)
    assert run(spark, as_table(none)).count() == 0


def test_redact(spark, crowded):
    judge = pii.Judge()
    out = pii.redact(crowded, judge)
    assert out.columns == crowded.columns and out.count() == crowded.count()
    one = spark.createDataFrame([(1, "a@b.co and 1.2.3.4", 18), (2, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(one, judge).collect()}
    assert got == {1: ("<EMAIL> and <IP>", 16), 2: (None, None)}
    assert pii.redacted("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a<IP>f"


def test_runs_of_groups_are_proposed_by_their_digits():
    text = "paid 41 11 11 11 11 11 11 11 12 26 today"
    spans = {text[a:b] for _, _, a, b in pii.proposals(text)}
    assert "41 11 11 11 11 11 11 11" in spans and "41 11 11 11 11 11 11 11 12 26" in spans
    assert all(4 <= sum(c.isdigit() for c in s) <= 24 for s in spans)


def test_overlaps_against_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        spans = [("x", a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 12)))]
        taken = pii.Taken(spans)
        for a in range(0, 70, 3):
            b = a + rng.randint(1, 8)
            want = sorted(s for s in spans if a < s[2] and s[1] < b)
            assert taken.meets(a, b) == bool(want) and sorted(taken.over(a, b)) == want


def test_long_texts_take_time_in_proportion():
    judge = pii.Judge(trees=[(1.0, np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.ones(1))], least={k: 0.5 for k in pii.KINDS})
    line = "call +1 663 555 6869 or mail bob@x.org, order 12-34-56-78, key a8f7 "
    times = []
    for n in (500, 4000):
        start = time.process_time()
        judge.spans([line * n])
        times.append(time.process_time() - start)
    assert times[1] < 30 * times[0]
