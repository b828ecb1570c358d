"""Candidates, trees and thresholds; the query's own columns against plain Python."""

import hashlib
import random

import pytest
from test_texts import brute_spans, texts

from tallyforge.llm import boosting, pii

SF = "/root/testdata/sf0.01"
#: Shapes and contexts that neither the trees nor the thresholds have seen.
OTHER = (
    ("phone", "you can phone me on ", "###.###.####", " after six", 1),
    ("phone", "mobile: ", "0### ### ####", "", 1),
    ("phone", "Tel ", "(0##)####-####", ", or", 1),
    ("phone", "fax: ", "00## ### ### ####", "", 1),
    ("phone", "invoice ref ", "### #### ####", "", 0),
    ("phone", "a count of ", "##########", " stars", 0),
    ("phone", "item ", "###.###.####", ".", 0),
    ("email", "write me: ", "@@@_@@@ (at) @@@@-@@@ (dot) org", "", 1),
    ("email", "name ", "@@@@@ at @@@@@@@@ dot co dot uk", "", 1),
    ("email", "they ", "@@@@@@@ at @@@.Now", " it", 0),
    ("card", "amex: ", "####.######.####L", "", 1),
    ("card", "charged to ", "####/####/####/###L", " twice", 1),
    ("card", "the number ", "################", "", 0),
    ("card", "in ", "####.####.####.####", " steps", 0),
    ("ip", "ping ", "1##[.]1##[.]#[.]##", "", 1),
    ("ip", "address ", "2001:~~~~:~~~~:~~~~::~", "", 1),
    ("ip", "from ", "0#:3#:2#", " on", 0),
    ("secret", "password: ", "^^^^^^^^^^^^^^^^^^^^^^^^^^^^", "", 1),
    ("secret", 'API key = "', "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", '"', 1),
    ("secret", "md5 ", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~", "", 0),
    ("secret", "the word ", "@@@@@@@@@@@@@@@@@@@@@@", " is long", 0),
)


def test_held_out_spellings(spark):
    made = pii.spelled(OTHER, fills=10, state=99)
    rows = [(i, before + text + after) for i, (_, text, before, after, _) in enumerate(made)]
    got = {r["doc_id"]: r["added"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {i: any((x["kind"], x["s"], x["e"]) == (pii.KINDS[k], len(b), len(b) + len(t)) for x in got[i]) for i, (k, t, b, _, _) in enumerate(made)}
    wanted = [i for i, m in enumerate(made) if m[4]]
    found, right = sum(hit[i] for i in wanted), sum(len(got[i]) for i in got)
    missed = sorted({(OTHER[i // 10][0], OTHER[i // 10][2]) for i in wanted if not hit[i]})
    wrong = sorted({(OTHER[i // 10][0], OTHER[i // 10][2]) for i, m in enumerate(made) if not m[4] and got[i]})
    assert found >= 0.9 * len(wanted), (found / len(wanted), missed)
    assert found >= 0.95 * right, (found / right, wrong)


def test_the_method_adds_spans(spark, monkeypatch):
    """With a threshold that nothing reaches only base spans are left."""
    rows = spark.createDataFrame([(1, "please call (555) 010-9999 or +1 (555) 010-9998")], "doc_id long, text string")
    assert [x["kind"] for x in pii.personal_data(rows).first()["added"]] == ["phone"]
    monkeypatch.setattr(pii, "fit_judge", lambda spark, p: (boosting.Booster().fit([[0.0] * 27], [0]), (9.0,) * 5))
    assert pii.personal_data(rows).first()["added"] == []


def test_overlaps_go_to_the_better_candidate(spark):
    rows = spark.createDataFrame([(1, "pay by card 4111.1111.1111.1111 now"), (2, "fax 5550109999"), (3, "card 4111111111111111 or 4111111111111112")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(rows).collect()}
    assert [x["kind"] for x in got[1]["added"]] == ["card"] and [x["kind"] for x in got[2]["added"]] == ["phone"]
    assert [x["kind"] for x in got[3]["base"]] == ["card"] and got[3]["added"] == []
    for r in got.values():
        spans = sorted((x["s"], x["e"]) for x in [*r["base"], *r["added"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_query_columns(spark):
    want = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op3_pii(spark, SF).collect()}
    assert set(got) == set(want) and any(r["n_added"] for r in got.values())
    for i, r in got.items():
        base = sorted(brute_spans(want[i]))
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(pii.KINDS[x[1]] == k for x in base) for k in pii.BASE_KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert r["n_spans"] == len(spans) == len(names) + r["n_added"] and set(names) <= set(spans)
        order = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in spans]
        assert order == sorted(order)
        for x in set(spans) - set(names):
            kind, s, e = x.split(":")
            assert want[i][int(s) : int(e)].strip()


def test_booster_learns_and_compiles(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [[rng.random(), rng.random(), float(rng.randint(0, 1))] for _ in range(300)]
    labels = [int(r[0] > 0.5 and r[2] == 1) for r in rows]
    model = boosting.Booster().fit(rows, labels)
    assert sum((model.margin(r) > 0) == y for r, y in zip(rows, labels)) > 290
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double")
    got = {r["i"]: r["m"] for r in df.select("i", model.column([F.col(c) for c in "abc"]).alias("m")).collect()}
    assert all(got[i] == pytest.approx(model.margin(r)) for i, r in enumerate(rows))
    assert boosting.Booster().fit([], []).margin([1.0]) == 0 and boosting.calibrated_threshold([1, 2], [0, 0], 0.5) == float("inf")
