"""Every operator on the awkward table, the empty table and clashing names: no crash, one row a document."""

from collections import Counter

import pytest

from tallyforge.llm import bpe, exact_dedup, html_text, katz, mixing, pii, quality, simhash, token_counts, url_filter

RUNS = {
    "katz": lambda d: katz.score_texts(d)[0],
    "bpe": lambda d: bpe.round_trip(d, bpe.default_path()),
    "pii": lambda d: pii.personal_data(d),
    "quality": lambda d: quality.judged(d, carry=["doc_id"]).select("row.doc_id", "kept"),
    "mixing": lambda d: mixing.mix(d)[0],
    "simhash": lambda d: simhash.near_duplicates(d),
    "exact": lambda d: exact_dedup.exact_duplicates(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_a_document(name, edge, clashing, empty):
    n = edge.count()
    rows = RUNS[name](edge).collect()
    assert len(rows) == n
    other = RUNS[name](clashing).collect()
    assert sorted(map(str, other)) == sorted(map(str, rows))
    assert RUNS[name](empty).collect() == []


def test_filters_keep_all_columns(edge, clashing, empty):
    for f in (quality.filter_quality, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        assert f(clashing).columns == clashing.columns
        assert f(clashing).count() == f(edge).count() <= edge.count()
        assert f(empty).count() == 0


def test_the_mix_holds_what_is_due(spark, edge, clashing, empty):
    prose = [f"w{i} " * 9 for i in range(20)]
    same = spark.createDataFrame([(None, "the same words", "s")] * 20 + [(None, t, "s") for t in prose] + [(i, t, "s") for i, t in enumerate(prose)] + [(7, None, None)] * 3, "doc_id long, text string, source string")
    for d in (same, edge, clashing, empty):
        due = mixing.mix(d, block_tokens=16)[0].agg({"copies": "sum"}).first()[0] or 0
        got = mixing.mixed(d, block_tokens=16)
        assert got.columns == d.columns and got.count() == due
    assert Counter(r["text"] for r in mixing.mixed(same, block_tokens=16).collect())["the same words"] <= 40


def test_repeated_rows_leave_one(edge):
    kept = exact_dedup.drop_exact_duplicates(edge).collect()
    assert sum(r["doc_id"] == 5 for r in kept) == 1
    assert sum(not (r["text"] or "").strip() for r in kept) == 2  # '' and ' ' after normalising


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://H.net/en/x?q#f", "<p>a<p>b"), (3, "http://H.net/en/x?q#f", "<p>a<p>b"), (None, "http://a.org/fr/", "<article><h1>T</h1>" + "x " * 100_000)]
    pages = spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, host string, row long")
    got = url_filter.filter_urls(pages).collect()
    assert sorted((r["host"], r["path"], r["rule"], r["verdict"]) for r in got)[0] == ("", "", None, "allow")
    assert sum(r["rule"] == "net/" for r in got) == 2 and sum(r["rule"] == "org/fr/" for r in got) == 1
    text = {(r["page_id"], r["text"][:5], r["n_chars"]) for r in html_text.main_text(pages).collect()}
    assert text == {(1, "", 0), (2, "", 0), (3, "a\nb", 3), (None, "T\nx x", 2 * 100_000 + 1)}
    none = spark.createDataFrame([], pages.schema)
    assert url_filter.filter_urls(none).collect() == [] == html_text.main_text(none).collect()


@pytest.mark.parametrize("files", [True, False])
def test_token_streams(edge, clashing, empty, files, monkeypatch):
    path = bpe.default_path()
    if not files:
        monkeypatch.setattr(token_counts, "opens", lambda p: False)
    want = sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.round_trip(edge, path).collect())
    for d in (edge, clashing):
        for block in (1, 1000, 1 << 16):
            if block > 1 or d is edge:
                got = token_counts.token_counts(d.repartition(2), path, block_tokens=block if block > 1 else 7)
                assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.token_counts(empty, path).collect() == []
    assert ("0", 0) in want and ("11", 4) in want  # null; two tokens that look like separators and two between


def test_urls_of_any_length_and_ties(spark, monkeypatch):
    rules = [("block", "aa.org/x"), ("allow", "aa.org/y"), ("block", "org/"), ("allow", "aa.org/x")]
    urls = ["http://aa.org/x" + "z" * 300_000, "http://" + "b." * 100_000 + "org/", "http://aa.org/y", "http://aa.org/x", None, "", "http://net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    want = [("aa.org/x", "block"), ("org/", "block"), ("aa.org/y", "allow"), ("aa.org/x", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    for words in (url_filter.STATE_WORDS, 3):
        monkeypatch.setattr(url_filter, "STATE_WORDS", words)
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()}
        assert [got[i] for i in range(len(urls))] == want


def test_components(spark):
    from tallyforge.llm.components import components

    links = [(1, 2), (2, 1), (3, 2), (5, 5), (7, 9), (9, 8), (None, 3), (4, None), (7, 8)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_scratch_tables(spark, edge):
    """A cluster has to name its folder; a query leaves its result and nothing else."""
    import glob
    from types import SimpleNamespace

    from tallyforge.llm import common

    for master, conf in (("spark://host:7077", None), ("local-cluster[2,1,1024]", None)):
        context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: conf)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_dir(SimpleNamespace(sparkContext=context))
    folder = common.scratch_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/tallyforge/*"))
    out = common.finished(lambda: exact_dedup.exact_duplicates(edge), "test-result")
    left = set(glob.glob(f"{folder}/tallyforge/*")) - before
    assert len(left) == 1 and "test-result" in left.pop() and out.count() == edge.count()


def test_large_groups_are_joined_where_their_rows_are(spark, edge, monkeypatch):
    from tallyforge.llm import common
    from tallyforge.llm.components import components

    plain = lambda df: sorted(map(str, df.collect()))
    links = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(40, 41), (41, 42), (None, 41)], "a long, b long")
    runs = (lambda: components(links), lambda: exact_dedup.exact_duplicates(edge), lambda: simhash.near_duplicates(edge))
    want = [plain(f()) for f in runs]
    for few, groups in ((0, 10**9), (0, 10), (1, 4)):
        monkeypatch.setattr(common, "FEW_ROWS", few)
        monkeypatch.setattr(common, "HOT_GROUPS", groups)
        assert [plain(f()) for f in runs] == want
