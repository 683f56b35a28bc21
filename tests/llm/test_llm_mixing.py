import re
from collections import Counter

import numpy as np

from evenhand.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(totals):
    """Water-filling, one round after another."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(totals.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * totals[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * totals[s]
            left -= out[s]
        open_ -= over
    return out


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        image = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(image) == list(range(n))
    a, b = (mixing.permute(np.arange(50), np.full(50, 50), np.full(50, s)) for s in (1, 2))
    assert list(a) != list(b)


def totals_of(rows):
    out = Counter()
    for r in rows:
        out[r[3]] += size(r[1])
    return out


def test_query(spark, rows, docs, none, as_table):
    run = queries.QUERIES["op6_mixing"]
    folder = as_table(docs)
    got = run(spark, folder).collect()
    totals = totals_of(rows)
    target = brute_targets(totals)
    source = {(r[0], size(r[1])): r[3] for r in rows}
    assert sorted(((r.doc_id, r["size"]) for r in got), key=repr) == sorted(
        ((r[0], size(r[1])) for r in rows), key=repr
    )
    taken = Counter()
    for r in got:
        s = source[(r.doc_id, r["size"])]
        assert r.source_size == totals[s] and abs(r.target - target[s]) < 1e-6 * max(target[s], 1)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in totals:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 2 * mixing.BLOCK_WORDS)
    again = run(spark, folder).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert run(spark, as_table(none)).count() == 0


def test_no_block_is_used_three_times(spark, docs):
    known, taken = mixing.mix(docs, block=16, shard_blocks=32)
    assert taken.agg({"times": "max"}).first()[0] <= 2
    shards = mixing.slots(mixing.targets(known.select("source", "size")), 16, 32, 20)
    per = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert max(per) <= 32


def test_mixed_documents(crowded, docs, rows, none):
    out = mixing.mixed(crowded, block=16)
    assert out.columns == crowded.columns
    got = out.collect()
    report = mixing.report(docs, block=16)
    assert sum(size(r.text) for r in got) == report.agg({"taken": "sum"}).first()[0]
    have = Counter()
    for r in rows:
        have[(r[0], r[1])] += 2
    for r in got:
        whole = [t for (i, t), n in have.items() if i == r.doc_id and t is not None]
        assert r.n_chars == len(r.text)
        assert any(all(part in t for part in r.text.split("\n") if part.strip()) for t in whole)
    assert mixing.mixed(none).count() == 0


def test_targets_with_caps(spark):
    totals = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 77}
    sizes = spark.createDataFrame([(s, n) for s, n in totals.items()], "source string, size long")
    want = brute_targets(totals)
    for r in mixing.targets(sizes).collect():
        assert abs(r.target - want[r.source]) < 1e-6
    assert abs(sum(want.values()) - 1.5 * sum(totals.values())) < 1e-6
