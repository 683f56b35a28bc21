import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from evenhand.llm import queries, sharding


def check(got, rows, shards=40):
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (r[0], size(r[1]), crc(r[1])) for r in rows
    )
    slots, loads = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_query(spark, rows, docs, crowded, none, as_table):
    run = queries.QUERIES["op8_sharding"]
    folder = as_table(docs)
    got = run(spark, folder).collect()
    check(got, rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert Counter(run(spark, folder).collect()) == Counter(got)
    check(run(spark, as_table(crowded)).collect(), rows)
    assert run(spark, as_table(none)).count() == 0


def test_even_bytes_with_a_hot_text(spark):
    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(4000)]
    rows += [(10_000 + i, "the same text again " * 12) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(docs, shards=20).collect()
    loads = check(got, rows, 20)
    assert max(loads.values()) < 1.03 * min(loads.values()) and len(loads) == 20
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    hot = zlib.crc32(("the same text again " * 12).encode())
    assert len(places.pop(hot)) > 1
    assert all(len(s) == 1 for s in places.values())


def test_ranges_against_plain_order():
    rng = np.random.default_rng(1)
    keys = pd.DataFrame({"group": rng.integers(0, 9, 500), "sub": rng.integers(0, 99, 500), "weight": 1.0})
    s = sharding.quantiles(keys, 20, False)
    bounds = list(zip(s.group.tolist(), s.sub.tolist()))
    assert bounds == sorted(bounds)
    got = s.ranges(keys["group"].to_numpy(), keys["sub"].to_numpy())
    want = [sum(b <= k for b in bounds) for k in zip(keys["group"], keys["sub"])]
    assert got.tolist() == want
