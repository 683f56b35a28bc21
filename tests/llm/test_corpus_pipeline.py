import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from evenhand.llm import pii, quality, simhash  # noqa: E402


def test_stages_in_order_over_what_is_kept(spark, crowded, rows, as_table):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "pii", "mixing sources to target weights", "bpe encoding and decoding"]
    out = corpus_pipeline.run(spark, as_table(crowded)).collect()
    assert out and all(r.exact and r.n_tokens == len(r.ids) for r in out)
    # the first stages by hand: what is left of the documents, and their texts without personal data
    good = quality.keep_good(crowded)
    one = simhash.keep_one(good, shingle=3, most=3)
    kept = {(r.doc_id, r.text) for r in pii.redact(one, pii.fit(one)).collect()}
    assert {r.doc_id for r in out} <= {i for i, _ in kept}
    assert len({r.text for r in one.collect()}) == one.count() <= good.count() <= len(rows)


def test_all_stages_keep_the_columns_of_documents(spark, docs, as_table):
    folder, at = as_table(docs), docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == docs.columns


def test_an_empty_table_gives_no_rows(spark, none, as_table):
    assert corpus_pipeline.run(spark, as_table(none)).count() == 0
