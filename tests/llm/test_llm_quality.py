import re
from collections import Counter

from evenhand.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_counts(spark, docs, rows, as_table):
    got = queries.QUERIES["op1_quality_rules"](spark, as_table(docs)).collect()
    want = Counter()
    for r in rows:
        n = brute(r[1])
        want[(r[0], *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def high(values, rise):
    """Middle of the first rise of the 200-quantiles above the median."""

    def bucket(v):
        if v < 64:
            return v
        e = v.bit_length() - 6
        return 64 + (e - 1) * 32 + (v >> e) - 32

    top = {b: max(v for v in values if bucket(v) == b) for b in map(bucket, values)}
    values = sorted(values)
    q = [top[bucket(values[-(-k * len(values) // 200) - 1])] for k in range(1, 201)]
    for k in range(99, 200):
        if q[min(k + 2, 199)] - q[k] > rise:
            return (q[k] + q[min(k + 2, 199)]) / 2
    return float("inf")


def corpus(spark, rows):
    distinct = [(d, g, s, " ".join(f"{w}{k % 9}{k}" for k, w in enumerate(t.split()))) for d, g, s, t in rows]
    return spark.createDataFrame(distinct, "doc_id long, lang string, source string, text string")


def test_limits_follow_the_group(spark):
    plain = "word " * 40
    rows = [(i, "en", "a", f"{plain} {'#' * (i % 5)} w{i}") for i in range(60)]
    rows += [(100 + i, "en", "b", f"{plain} {'#' * (60 + i % 7)} w{i}") for i in range(60)]
    rows += [(200, "en", "a", f"{plain} {'#' * 68}"), (201, "en", "b", f"{plain} {'#' * 68}")]
    rows += [(202, "en", "small", f"{plain} x"), (203, "en", "b", f"{plain} {'#' * 200}")]
    rule = [r for r in quality.rules() if r.name == "symbols"]
    judged = quality.judge(corpus(spark, rows), ["doc_id", "source"], rule, min_docs=50).collect()
    value = {r._row.doc_id: 1000 * r.n_symbols // r.word_chars for r in judged}
    for source in ("a", "b"):
        limit = high([value[r._row.doc_id] for r in judged if r._row.source == source and not r.base_failed], 40)
        for r in judged:
            if r._row.source == source and not r.base_failed:
                assert r.kept == (value[r._row.doc_id] <= limit)
    kept = {r._row.doc_id: r.kept for r in judged}
    assert not kept[200] and kept[201]  # as many symbols, but usual in its source
    assert kept[202]  # a small source takes the sketch of its language
    assert not kept[203]


def test_a_part_that_breaks_away_goes_however_large(spark):
    plain = "word " * 40
    rows = [(i, "en", "a", f"{plain} {'#' * (i % 2)} w{i}") for i in range(210)]
    rows += [(300 + i, "en", "a", f"{plain} {'#' * (90 + i)} w{i}") for i in range(60)]
    rule = [r for r in quality.rules() if r.name == "symbols"]
    kept = {r._row.doc_id: r.kept for r in quality.judge(corpus(spark, rows), ["doc_id"], rule).collect()}
    assert all(kept[i] == (i < 300) for i in kept)


def test_words_shorter_than_all_others_go(spark):
    text = lambda w, i: " ".join(f"{w}{chr(97 + (k * 7 + i) % 26)}" for k in range(60))
    rows = [(i, "en", "a", text("wonder", i)) for i in range(230)] + [(300 + i, "en", "a", text("o", i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    rule = [r for r in quality.rules() if r.low]
    kept = {r._row.doc_id: r.kept for r in quality.judge(docs, ["doc_id"], rule, repeat_percent=100).collect()}
    assert all(kept[i] == (i < 300) for i in kept)


def test_keep_good(crowded, docs, none):
    kept = quality.keep_good(crowded)
    assert kept.columns == crowded.columns
    assert kept.count() == quality.judge(docs, ["doc_id"]).where("kept").count() > 0
    assert quality.keep_good(none).count() == 0


def test_only_built_in_functions(docs):
    plan = quality.judge(docs, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
