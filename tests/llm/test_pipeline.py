"""The pipeline against plain Python over whole tables."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_near_dedup import brute_kept
from test_quality_limits import brute_measures

from tallyforge.llm import bpe, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.judged(docs, min_words=1).filter("kept").select("row.doc_id").collect()}
    assert all(brute_measures(rows[i]["text"])[0] for i in kept)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        got = {r["doc_id"] for r in out.collect()}
        if name == "quality_rules":
            want = kept
        elif name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"] or ""), i)
            want = set(first.values())
        else:
            want = brute_kept([(i, rows[i]["text"]) for i in want])
        assert got == want, name
    mixed = corpus_pipeline.STAGES[3][1](spark, out, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    plan = {r["doc_id"]: r for r in mixing.mix(out)[0].collect()}
    order = [r["doc_id"] for r in mixed.collect()]
    assert Counter(order) == Counter({i: r["copies"] for i, r in plan.items() if r["copies"]})
    assert max(r["copies"] for r in plan.values()) <= 2
    firsts = list(dict.fromkeys(order))  # documents come in the order of their first slots
    assert [plan[i]["first_slot"] for i in firsts] == sorted(plan[i]["first_slot"] for i in firsts)


def test_run(spark):
    enc = bpe.Encoder(bpe.read_spec(bpe.default_path()))
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got
    for r in got:
        ids = enc.encode(rows[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_tables(spark, k, edge, clashing, empty):
    stage = corpus_pipeline.STAGES[k][1]
    one, other = (sorted(map(str, stage(spark, d, SF).collect())) for d in (edge, clashing))
    assert one == other != []
    assert stage(spark, empty, SF).collect() == []


def test_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
