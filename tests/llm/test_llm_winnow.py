import hashlib
import random

import numpy as np

from evenhand.llm import queries, winnow


def hashed(text):
    return int(winnow.grams(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(text))[0])


def brute(text, gram, window):
    if not text:
        return []
    one = lambda t: int(winnow.grams(np.frombuffer(t.encode("utf-32-le"), "<u4"), gram)[0])
    if len(text) < gram:
        return [(one(text), 0)]
    h = [one(text[i : i + gram]) for i in range(len(text) - gram + 1)]
    out = []
    for s in range(max(1, len(h) - window + 1)):
        part = h[s : s + window]
        at = s + max(i for i, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("ab é😀", k=rng.randint(0, 60)))
        gram, window = rng.choice([1, 2, 4, 8]), rng.randint(1, 12)
        keys = winnow.winnow(text, gram, window)
        got = [(int(k) >> 32, 0xFFFFFFFF - (int(k) & 0xFFFFFFFF)) for k in keys]
        assert got == brute(text, gram, window)


def test_shared_passage_is_found():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for _ in range(50):
        passage = text(8 + 12 - 1)
        a, b = (winnow.winnow(text(40) + passage + text(40), 8, 12) for _ in range(2))
        assert set(a >> np.uint64(32)) & set(b >> np.uint64(32))


def test_query(spark, rows, docs, crowded, none, as_table):
    run = queries.QUERIES["op2_winnowing"]
    got = run(spark, as_table(docs)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = []
    for k, r in enumerate(order):
        after = texts[(k + 1) % len(texts)]
        text = texts[k]
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        mine, other, follow = (winnow.winnow(t) for t in (text, new, after))
        want.append(
            (
                r[0],
                len(text),
                hashlib.sha256(new.encode()).hexdigest(),
                winnow.written(mine),
                winnow.written(other),
                winnow.likeness(mine, other),
                winnow.likeness(mine, follow),
            )
        )
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(map(repr, run(spark, as_table(crowded)).collect())) == sorted(map(repr, got))
    assert run(spark, as_table(none)).count() == 0


def test_parts_join_up(spark, monkeypatch):
    monkeypatch.setattr(winnow, "PART_BYTES", 200)
    rows = [(3 * i, f"text number {i} " * 4) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in winnow.compare(docs).collect()}
    for k, (i, text) in enumerate(rows):
        new = winnow.edited(text, rows[(k + 1) % 200][1])
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    one = winnow.compare(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_written_fingerprints_are_read_again():
    rng = random.Random(4)
    for n, gram, window in [(0, 4, 3), (5, 8, 4), (300, 4, 5), (900, 2, 400), (70_000, 1, 40_000)]:
        keys = winnow.winnow("".join(rng.choices("abcdefé", k=n)), gram, window)
        want = [(int(k) >> 32, 0xFFFFFFFF - (int(k) & 0xFFFFFFFF)) for k in keys]
        assert winnow.read(winnow.written(keys)) == want


def test_half_of_a_short_text_is_seen():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    for n in (64, 90, 127, 253):
        a, b = text(n), text(400)
        new = winnow.edited(a, b)
        assert winnow.likeness(winnow.winnow(a), winnow.winnow(new)) > 0


def test_ids_of_any_kind_repeated_and_null(spark, monkeypatch):
    """String ids, one id and the null id with many rows: all rows are there, in order."""
    monkeypatch.setattr(winnow, "PART_BYTES", 300)
    rows = [(f"id-{k:03}", f"text {k} " * 3) for k in range(60)]
    rows += [("id-030", f"again {k} " * 3) for k in range(60)]
    rows += [(None, f"none {k} " * 3) for k in range(60)] + [(None, None), ("id-000", "")]
    rows += [("id-059", "copy")] * 20
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        new = winnow.edited(text or "", order[(k + 1) % len(order)][1] or "")
        want.append((i or "", hashlib.sha256(new.encode()).hexdigest()))
    got = [(r.doc_id or "", r.edited_sha256) for r in winnow.compare(docs).collect()]
    assert sorted(got) == sorted(want)
