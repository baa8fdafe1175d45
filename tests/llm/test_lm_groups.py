import random

import pytest

from corpusloom.llm import ngram_lm


def test_scores_do_not_depend_on_the_bound_of_the_filter(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{int(3000 * r.random() ** 2)}" for _ in range(r.randint(1, 200)))) for i in range(120)] + [(4, "a b"), (4, "a b"), (None, "c d"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_lm, "PAIR_SEGMENT_CHARS", 10_000)
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.n_tokens, x.base_score)
    whole = sorted(ngram_lm.score_documents(docs).collect(), key=key)
    monkeypatch.setattr(ngram_lm, "MAX_FILTER_BYTES", 8_192)
    small = sorted(ngram_lm.score_documents(docs).collect(), key=key)
    assert len(small) == len(rows)
    assert [x.score for x in small] == pytest.approx([x.score for x in whole], rel=1e-9)
    assert [x[:5] for x in small] == [x[:5] for x in whole]
