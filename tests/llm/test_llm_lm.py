import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

from evenhand.llm import lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), ""]


def test_query(spark, rows, docs, crowded, none, as_table, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(lm, "SPAN", 300)
    run = queries.QUERIES["op9_lm_scores"]
    got = run(spark, as_table(docs)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want.append((r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    key = lambda r: (*tuple(r)[:5], round(r[5], 6))
    assert Counter(map(key, got)) == Counter(want)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    again = run(spark, as_table(crowded)).collect()
    assert Counter(map(key, again)) == Counter(want)
    assert run(spark, as_table(none)).count() == 0


def test_the_code_is_a_prefix_code_of_least_length():
    rng = np.random.default_rng(1)
    for counts in (np.array([0, 0]), rng.integers(0, 1000, 255), 2 ** np.arange(30)):
        code = lm.Code.of(counts)
        words = set()
        for k in range(len(counts)):
            at = slice(code.first[k], code.first[k] + code.size[k])
            assert code.nodes[at][0] == len(counts) - 2  # the root
            words.add("".join(map(str, code.bits[at])))
        assert not any(x != y and y.startswith(x) for x in words for y in words)
        assert abs(sum(2.0 ** -len(w) for w in words) - 1) < 1e-9
        p = (counts + 1) / (counts + 1).sum()
        assert (p * code.size).sum() < -(p * np.log2(p)).sum() + 1


def test_chances_of_all_classes_sum_to_one():
    rng = np.random.default_rng(2)
    code = lm.Code.of(rng.integers(0, 900, lm.CLASSES))
    tables = lm.Tables.of(code, rng.integers(0, 50, 2 * code.starts[2]))
    chance = lm.learn(rng.integers(0, 30, 2 * lm.JOINT))
    every = np.arange(lm.CLASSES)
    for before, second in ((0, 0), (3, 250), (254, 7)):
        token, bit, places = code.places(every, np.full(lm.CLASSES, before), np.full(lm.CLASSES, second))
        p = chance[tables.joint(places)]
        whole = np.exp(np.bincount(token, np.log(np.where(bit == 1, p, 1 - p))))
        assert abs(whole.sum() - 1) < 1e-9


def test_bits_are_left_out_of_their_own_tables():
    rng = np.random.default_rng(3)
    code = lm.Code.of(rng.integers(0, 900, lm.CLASSES))
    counts = rng.integers(0, 4, 2 * code.starts[2])
    n0, n1 = counts.reshape(2, -1)
    tables = lm.Tables.of(code, counts)
    own, before, second = rng.integers(0, lm.CLASSES, (3, 200))
    _, bit, places = code.places(own, before, second)
    for k, x in enumerate(places):
        less = lm.states(np.maximum(n0 - (np.arange(len(n0)) == -1), 0), n1, code)
        assert (less == tables.plain).all()
        for b, at in zip(bit[:50], x[:50]):
            m0, m1 = n0.copy(), n1.copy()
            (m1 if b else m0)[at] = max((m1 if b else m0)[at] - 1, 0)
            assert tables.less[b, at] == lm.states(m0, m1, code)[at]
        if k:
            break


def test_hits_against_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(60):
        docs = [rng.integers(0, 4, int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 8)))]
        train = rng.random(len(docs)) < 0.6
        hit, kind = lm.hits(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.repeat(train, [len(d) for d in docs]))
        at = 0
        for k, d in enumerate(docs):
            run = 0
            for i in range(len(d)):
                found = None
                if i >= 2:
                    for other in range(k, -1, -1):
                        if found is None and (other == k or train[other]):
                            o = docs[other]
                            for j in range((i if other == k else len(o)) - 1, 1, -1):
                                if o[j - 1] == d[i - 1] and o[j - 2] == d[i - 2]:
                                    found = (o[j], other == k)
                                    break
                if found is None:
                    assert kind[at] == 255 and not hit[at]
                else:
                    assert hit[at] == (found[0] == d[i])
                    assert kind[at] == min(run, 7) * 2 + found[1]
                run = run + 1 if hit[at] else 0
                at += 1


def test_weights_fit_the_histogram():
    x, gate = lm.inputs()
    rng = np.random.default_rng(5)
    truth = 1 / (1 + np.exp(-(0.2 * x[:, 0] + 0.5 * x[:, 1] + 0.3 * (gate > 2) * x[:, 2])))
    n = rng.integers(0, 2000, lm.JOINT)
    ones = rng.binomial(n, truth)
    p = lm.learn(np.r_[n - ones, ones])
    loss = lambda q: -(ones * np.log(q) + (n - ones) * np.log(1 - q)).sum()
    assert loss(p) < 1.01 * loss(truth)
    assert np.isfinite(lm.learn(np.zeros(2 * lm.JOINT, np.int64))).all()


def test_held_out_scores_beat_the_base(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.QUERIES["op9_lm_scores"](spark, folder).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > 0.9 * out["sum(base_score)"]


def test_held_out_text_is_predicted(spark):
    rng = np.random.default_rng(3)
    parts = ["an", "er", "ti", "on", "re", "st", "ou", "ha"]
    text = lambda: " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(80))
    docs = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id long, text string")
    out = lm.scores(docs).where("held_out").agg({"bits_per_byte": "avg"}).first()[0]
    assert out < 2.5  # eight without a model


def test_order_of_words_counts(spark):
    rng = np.random.default_rng(4)
    pairs = [(f"left{k}", f"right{k}") for k in range(30)]
    text = lambda: " ".join(" ".join(pairs[k]) for k in rng.integers(0, 30, 40))
    rows = [(i, text()) for i in range(200)]
    held = [i for i in range(1000, 2000) if lm.held(i)][:40]
    kept = {}
    for k, i in enumerate(held[:20]):
        t = text()
        words = t.split()
        rng.shuffle(words)
        kept[i] = held[20 + k]
        rows += [(i, t), (held[20 + k], " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scores(docs).collect()}
    for i, j in kept.items():
        assert abs(got[i].base_score - got[j].base_score) < 1e-6
        assert got[i].score > got[j].score + 1  # the same words, in the order of the training texts




def test_passages_are_found_in_other_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, int(rng.integers(0, 90)))) for _ in range(60)]
    texts = [texts[int(k)] for k in rng.integers(0, 60, 120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = {r.doc_id: r for r in lm.scores(docs).collect()}
    for size in (100, 700):
        monkeypatch.setattr(lm, "BLOCK_TOKENS", size)
        parts = {r.doc_id: r for r in lm.scores(docs).collect()}
        assert all(abs(whole[i].score - parts[i].score) < 1e-6 for i in range(120))


def test_blocks_ask_and_tell_all_that_a_plain_search_finds():
    rng = np.random.default_rng(7)
    words = [b"", *(b"w%d" % k for k in range(1, 5))]
    flat = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x), dtype=np.int32), [len(d) for d in x]))
    for _ in range(40):
        docs = [rng.integers(0, 5, int(rng.integers(1, 30))) for _ in range(12)]
        train = rng.random(12) < 0.5
        tokens, doc = flat(docs)
        want = lm.hits(tokens, doc, train[doc])
        rows = []
        for b in range(4):
            t, d = flat(docs[3 * b : 3 * b + 3])
            rows += [(k, b, x, p) for k, x, p in lm._contexts(t, d, train[3 * b : 3 * b + 3][d], words)]
        far = [[] for _ in range(4)]
        for bucket in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == bucket]
            data = np.concatenate([np.frombuffer(r[2], np.uint8) for r in own]).reshape(-1, lm.PAIR_BYTES + lm.NEXT_BYTES)
            steps = [lm.unpacked(r[3]) for r in own]
            found = iter(lm._answered(data, np.concatenate(steps) & 3))
            for r, s in zip(own, steps):
                far[r[1]] += [(p, a == 2) for p, a in zip(np.cumsum(s >> 2), found) if a]
        got = []
        for b in range(4):
            t, d = flat(docs[3 * b : 3 * b + 3])
            place, hit = (np.array(x) for x in zip(*far[b])) if far[b] else (np.zeros(0, int), np.zeros(0, bool))
            got.append(lm.hits(t, d, train[3 * b : 3 * b + 3][d], (place, hit)))
        for k in range(2):
            assert (np.concatenate([g[k] for g in got]) == want[k]).all()


def test_word_pairs_are_not_written_as_a_table(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    folder = Path(lm.scratch_dir(spark).removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    answers, sizes, before = lm._answers, [], used()
    monkeypatch.setattr(lm, "_answers", lambda pairs: sizes.append(used() - before) or answers(pairs))
    lm._told(docs)
    assert len(sizes) == lm.ROUNDS
    assert max(sizes) < 1.2 * sum(map(len, texts))  # the pairs are four times as large as the texts


def test_rounds_share_all_pairs_of_a_block():
    rng = np.random.default_rng(9)
    words = [b"", *(b"w%d" % k for k in range(1, 30))]
    for n in (0, 1, 5, 3000):
        tokens = rng.integers(0, 30, n).astype(np.int32)
        doc = np.sort(rng.integers(0, 1 + n // 50, n)).astype(np.int32)
        train = (rng.random(1 + n // 50) < 0.5)[doc]
        rounds = [list(lm._contexts(tokens, doc, train, words, k)) for k in range(lm.ROUNDS)]
        assert all(b % lm.ROUNDS == k for k, rows in enumerate(rounds) for b, _, _ in rows)
        assert sorted(r for rows in rounds for r in rows) == list(lm._contexts(tokens, doc, train, words))


def test_pairs_of_very_many_words():
    rng = np.random.default_rng(10)
    tokens, doc = rng.integers(0, 6, 500), np.sort(rng.integers(0, 9, 500))
    train = (rng.random(9) < 0.5)[doc]
    few, many = (lm._pairs(tokens * by, doc, train) for by in (1, 1 << 27))  # the second does not fit one number
    assert all((x == y).all() for x, y in zip(few, many))


def test_blocks_hold_all_texts_and_end_at_their_bounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 200, int(rng.integers(0, 40)))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for most, distinct, least in ((100, 300_000, 8), (1 << 20, 50, 8), (200, 60, 6), (1 << 20, 300_000, 1)):
        monkeypatch.setattr(lm, "BLOCK_TOKENS", most)
        monkeypatch.setattr(lm, "BLOCK_WORDS", distinct)
        got, rows = [], lm._blocks(docs).collect()
        assert len(rows) >= least
        for r in rows:
            words, ids, begin = bytes(r.words).split(b" "), lm.unpacked(r.ids), np.cumsum([0, *r.sizes])
            own = [[words[k] for k in ids[a:z]] for a, z in zip(begin, begin[1:])]
            assert words[0] == b"" and len(set(words)) == len(words) == len(set().union(*own))
            assert r.n_bytes == [sum(len(w) + 1 for w in x) for x in own]
            train = Counter(w for i, x in zip(r.doc_ids, own) if not lm.held(i) for w in x)
            assert [train[w] for w in words] == lm.unpacked(r.counts).tolist()
            full = lambda x: sum(map(len, x)) >= most or len({b"", *itertools.chain(*x)}) >= distinct
            assert not full(own[:-1]) and (full(own) or r is rows[-1])
            got += [*zip(r.doc_ids, r.held, own)]
        assert got == [(i, lm.held(i), [w.encode() for w in tokens(t)]) for i, t in enumerate(texts)]
