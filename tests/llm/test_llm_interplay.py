import itertools
import re

from pyspark.sql import functions as F

from evenhand.llm import interplay, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    w = WORD.findall(text)
    return {
        "A": len(w) < 100,
        "B": 100 * len(set(w)) < 80 * len(w),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(rows, labels):
    """Every order applied to every document, one after another."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, part, *_ in rows:
        bad = {k for k, v in fails(text or "").items() if v}
        if any(i is not None and r[0] is not None and r[0] < i and (r[1] or "") == (text or "") for r in rows):
            bad.add("E")
        docs.append((i, part or "", bad))
    out, removed = {}, {}
    for part in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                go = [d for d in left if f in d[2]]
                keep = [d for d in left if f not in d[2]]
                gone_before = [d for d in own if d not in left]
                out[part, "".join(order), step] = [
                    len(keep),
                    len(go),
                    sum(f in d[2] for d in own) - len(go),
                    sum(d[2] == {f} for d in own),
                    sum(d[0] in good for d in go),
                    sum(d[0] in toxic for d in go),
                ]
                assert out[part, "".join(order), step][2] == sum(f in d[2] for d in gone_before)
                removed[part, f] = removed.get((part, f), 0) + len(go)
                left = keep
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_every_order_against_brute_force(spark, rows, crowded, as_table):
    extra = [
        (200, "ABC " * 200, "en", "a", 800),
        (201, "ABC " * 200, "fr", "a", 800),
        (202, " ".join(f"w{i}" for i in range(150)), "en", "a", 1),
        (203, " ".join(f"w{i}" for i in range(150)) + " #", "en", "a", 1),
        (203, " ".join(f"w{i}" for i in range(150)) + " #", "en", "a", 1),
        (204, "", "fr", "a", 0),
    ]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = crowded.unionByName(more, allowMissingColumns=True)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 210, 3)] + [(0, 1, 1), (3, None, None), (None, 1, 1), (202, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    folder = as_table(docs)
    marks.write.parquet(f"{folder}/labels.parquet")
    got = {
        (r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES)
        for r in queries.op13_filter_interaction(spark, folder).collect()
    }
    want = brute([*rows, *extra], [x for x in labels if x[0] is not None])
    assert len(got) == 3 * 600 and got == want


def test_rows_without_an_id_are_no_copies(spark):
    docs = spark.createDataFrame([(None, "x", "en"), (None, "x", "en"), (1, "x", "en"), (2, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = interplay.failures(docs, labels).where("n > 0").collect()
    assert sum(r.n for r in cells if r["mask"] & 16) == 1 and sum(r.n for r in cells) == 4


def test_an_empty_table_gives_no_rows(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interplay.audit(none, labels).count() == 0


def test_potentials_give_shapley_values(spark):
    # a game that is no sum: v(S) by number of members, squared, plus one for filter 2
    v = [bin(s).count("1") ** 2 * 10 + (s >> 2 & 1) * 7 for s in range(32)]
    q = spark.range(1).select(interplay.potentials(F.array(*[F.lit(x).cast("long") for x in v])).alias("q")).first().q
    for k in range(5):
        total = 0
        for order in itertools.permutations(range(5)):
            s = sum(1 << i for i in order[: order.index(k)])
            total += v[s | 1 << k] - v[s]
        assert q[31] - 5 * q[31 ^ 1 << k] == total
