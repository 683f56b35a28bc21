import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evenhand.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def check(texts):
    c = bpe.codec(PATH)
    for text, got in zip(texts, c.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text), repr(text)
        assert c.decode(got) == PLAIN.decode(ids_of(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check([text])


def test_awkward_texts():
    rng = random.Random(1)
    odd = [" ", "  ", "\n", "\t", " ", "　", " ", "\x85", "'s", "'", "'ll", "don't"]
    odd += ["<|endoftext|>", "<|", "|>", "é", "ß", "½", "Ⅷ", "٣", "日本", "😀", "́", "----", "aaaa"]
    odd += ["12", "...", "!!", "the", " a", "\r\n", "İ", "\x00"]
    tokens = [t.decode("utf-8", "ignore") for t in rng.sample(bpe.codec(PATH).bytes, 500)]
    check(["".join(rng.choices(odd + tokens, k=rng.randint(0, 14))) for _ in range(20_000)])


def test_cuts_lie_in_no_token():
    c = bpe.codec(PATH)
    for t in c.bytes[:50256]:
        assert c.fragments(t) == [t]
    assert c.fragments(b"one two") == [b"one", b" two"]


def test_query(spark, rows, docs, none, as_table):
    run = queries.QUERIES["op4_bpe"]
    got = sorted(map(tuple, run(spark, as_table(docs)).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [
        (
            r[0],
            len(ids_of(r[1] or "")),
            sha(np.asarray(ids_of(r[1] or ""), "<u4").tobytes()),
            sha((r[1] or "").encode()),
        )
        for r in rows
    ]
    assert got == sorted(want, key=repr)
    assert run(spark, as_table(none)).count() == 0


def test_ids_and_back(crowded):
    coded = bpe.encoded(crowded, PATH, crowded.columns)
    back = bpe.decoded(coded.select("_row.doc_id", "ids", "exact"), PATH).collect()
    texts = sorted((r.text or "" for r in crowded.collect()))
    assert sorted(r.text for r in back) == texts
    assert all(r.exact for r in back)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
