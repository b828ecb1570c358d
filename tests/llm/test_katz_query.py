"""The registered query scores with one word of history."""

import pytest
from test_katz import Brute

from tallyforge.llm import katz


def test_query_is_a_bigram_model(spark, small, tmp_path):
    docs = small.filter("n_chars < 2500").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    b = Brute(rows, 2)
    words = {i: w for i, w, _ in b.docs}
    got = katz.op1_katz(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(b.score(words[r["doc_id"]]), rel=1e-9)
