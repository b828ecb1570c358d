import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tallyforge.llm import bpe, exact_dedup, html_text, mixing, pii, quality, simhash, token_counts, url_filter

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


# BPE


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.read_spec(bpe.default_path()), cache=50)
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x2028, 0x3000, 0x1F600, 0x4E2D, 0x0661, 0x0300]] + ["<|endoftext|>", "'ll", "  ", "\n\n", "the", " ing"]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", "ab" * 3000, " " * 500]
    for s in cases:
        ids = own.encode(s)
        assert ids == lib.encode(s, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_encode_then_decode(small):
    back = texts(bpe.decode(bpe.encode(small, bpe.default_path()), bpe.default_path()))
    assert back == texts(small)


# PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    return [(m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if passes(kind, m.group())]


def test_base_spans(spark, small):
    rng = random.Random(7)
    bits = ["a.b@c.de", "x@y", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", " ", "é🙂", "_", ",", "7", "0012.00.0255.1", "@", "+", "-", "12345678901234567890123"]
    made = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    made += [(400 + i, t) for i, t in texts(small).items()] + [(900, "a@b.co " * 700), (901, "1 " * 5000 + "1" * 9000)]
    got = pii.personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()
    want = dict(made)
    for r in got:
        assert [(x["s"], x["k"], x["e"]) for x in r["base"]] == sorted(brute_spans(want[r["doc_id"]])), r["doc_id"]


def test_added_spans_and_redaction(spark):
    rows = [(1, "please call (555) 010-9999 today"), (2, "order 555-010-9999 shipped"), (3, "write to jane.doe (at) mail (dot) org now"), (4, "clean text of 2024 words")]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert out == {1: "please call [phone] today", 2: rows[1][1], 3: "write to [email] now", 4: rows[3][1]}


# URL filter


def test_automaton_against_globs():
    import fnmatch

    rng = random.Random(3)
    pats = ["".join(rng.choice("ab*/") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    hit = url_filter.ShiftAnd(pats).match([u.encode() for u in urls])
    for i, u in enumerate(urls):
        for j, p in enumerate(pats):
            assert hit[i, j] == fnmatch.fnmatchcase(u, p), (u, p)


def test_rules_by_hand(spark):
    urls = {"http://A.Example.NET/en/1": "example.net/en/", "x://net": None, "x://net/": "net/", "x://evilnet/": None, "x://a.org/fr": None, "x://a.org/fr/?a": "org/fr/", "x://example.com/de/#": "example.com/de/", "//net/": None, "x://a.org/x.net\n/y": None}
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(rows).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def same_as_sql(spark, f, sql, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(sql).df()
    got = f(spark, SF).toPandas()[list(want.columns)]
    key = want.columns[0]
    a, b = (x.sort_values(key).reset_index(drop=True).astype(object).where(lambda v: v.notna(), None) for x in (got, want))
    assert a.equals(b)


def test_url_sql(spark):
    same_as_sql(spark, url_filter.op4_url_filter, url_filter.OP4_SQL, "pages")


def test_exact_sql(spark):
    same_as_sql(spark, exact_dedup.op8_exact_dedup, exact_dedup.OP8_SQL, "documents")


def test_quality_sql(spark):
    same_as_sql(spark, quality.op5_quality_rules, quality.OP5_SQL, "documents")


# Exact dedup


def test_refinement(spark):
    head = "h" * 100
    rows = [(5, head + "a"), (3, head + "b"), (9, head + "a"), (4, "x  y"), (2, "x\n y"), (7, None), (6, ""), (8, " ")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"] is None) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5] == (5, 2, True, False) and got[9] == (5, 2, False, False)
    assert got[3] == (3, 1, True, False)  # same length and prefix: only the full hash tells
    assert got[4] == (2, 2, False, False) and got[6] == (6, 2, True, False) and got[7] == (6, 2, False, False)
    assert got[8] == (8, 1, True, True)  # settled by its length: never read in full


# Quality


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_measures():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\t"]) for _ in range(rng.randint(0, 80)))
        n, c, s, d, _, r, *_ = quality.measures(t)
        assert (n, c, s, d, r) == brute_base(t)


def test_sketch_quantiles(spark):
    rng = np.random.default_rng(1)
    v = rng.lognormal(2, 1, 5000)
    rows = spark.createDataFrame([("g", float(x)) for x in v], "g string, m double")
    whole = quality.sketch(rows, ["g"], ["m"])
    halves = [quality.sketch(rows.filter(f"m {op} 7"), ["g"], ["m"]) for op in ("<", ">=")]
    merged = quality.merge_sketches(*halves)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    q = quality.sketch_quantiles(merged, ["g"], {"a": (0.25, 0), "b": (0.25, 1), "c": (0.9, 0), "d": (0.9, 1)}).first()
    for low, high, p in (("a", "b", 0.25), ("c", "d", 0.9)):
        assert q[low] <= np.quantile(v, p, method="inverted_cdf") <= q[high] == pytest.approx(1.01 / 0.99 * q[low])


def test_verdicts_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert all(r["kept"] for r in good)
    assert not any(r["kept"] for r in rows if r["quality"] == 0)


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mix(small, edge, block):
    for docs in (small, edge):
        if docs is small and block == 1:
            continue
        rows = mixing.mix(docs, block_tokens=block)[0].collect()
        again = mixing.mix(docs.repartition(5), block_tokens=block)[0].collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
        sizes = {}
        for r in rows:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        want = brute_targets(sizes)
        for s in sizes:
            own = [r for r in rows if r["source"] == s]
            assert own[0]["target"] == pytest.approx(want[s])
            assert sum(r["taken"] for r in own) == min(math.floor(want[s] + 0.5), 2 * sizes[s])  # half a word counts as one
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)


def test_schedule_is_even(small):
    _, plan = mixing.mix(small, block_tokens=64)
    rows = sorted((r["slot"], r["src"], r["rank"]) for r in plan.collect())
    n = {s: sum(x[1] == s for x in rows) for s in {x[1] for x in rows}}
    for s, k in n.items():
        assert sorted(r for _, x, r in rows if x == s) == list(range(k))
        for cut in (len(rows) // 3, len(rows) // 2):  # every prefix of the mix has each source's share
            assert abs(sum(x == s for _, x, _ in rows[:cut]) - k * cut / len(rows)) < 8


def test_the_schedule_decides(small, monkeypatch):
    """Another sequence gives another order."""
    rows = lambda: {r["doc_id"]: r["first_slot"] for r in mixing.mix(small, block_tokens=64)[0].collect()}
    golden = rows()
    assert all((s is None) == (golden[i] is None) for i, s in rows().items()) and golden == rows()
    monkeypatch.setattr(mixing, "_GOLDEN", 12345)
    assert sum(golden[i] != s for i, s in rows().items()) > len(golden) // 2


# SimHash


def brute_fp(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints(small):
    for r in simhash.fingerprints(small.filter("n_chars < 3000").limit(60)).join(small, "doc_id").collect():
        assert r["fp"] % (1 << 64) == brute_fp(r["text"])


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_links_against_all_pairs(spark, crowd):
    rng = random.Random(9)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            fps.append(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randint(0, 63)
    fps = list(dict.fromkeys(fps)) + [0, 1 << 63, (1 << 64) - 1]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = simhash.components(simhash.links(df, crowd=crowd)).collect()
    comp = {r["node"]: r["root"] for r in got}
    want = brute_components(dict(enumerate(fps)))
    for i in range(len(fps)):
        for j in range(i):
            a, b = signed(fps[i]), signed(fps[j])
            assert (comp.get(a, a) == comp.get(b, b)) == (want[i] == want[j])


def test_component_names(small):
    rows = simhash.near_duplicates(small).collect()
    want = brute_components({r["doc_id"]: r["fp"] % (1 << 64) for r in rows})
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


# Token counts


@pytest.mark.parametrize("width, eod", [(2, 9), (4, 70_000)])
@pytest.mark.parametrize("by_range", [True, False])
def test_flat_files(spark, tmp_path, monkeypatch, width, eod, by_range):
    monkeypatch.setattr(token_counts, "RUN", 3)
    monkeypatch.setattr(token_counts, "RANGE", 4)
    monkeypatch.setattr(token_counts, "opens", lambda p: by_range)
    rng, want = random.Random(1), []
    for f in range(5):
        docs, ids = [rng.choice([0, 1, 6, 50]) for _ in range(40)], []
        for n in docs:
            ids += [1] * n + [eod]
        ids += [2] * (f * 7)
        (tmp_path / f"f{f}").write_bytes(np.array(ids, f"<u{width}").tobytes())
        want += [(f, i, n) for i, n in enumerate(docs + ([f * 7] if f else []))]
    (tmp_path / "f5").write_bytes(np.full(100, 3, f"<u{width}").tobytes())  # no separator at all
    (tmp_path / "f6").write_bytes(b"")
    want.append((5, 0, 100))
    got = token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path), 7, width), eod, width).collect()
    assert sorted((int(r["file"][-1]), r["ordinal"], r["n_tokens"]) for r in got) == sorted(want)
    (tmp_path / "f7").write_bytes(b"abcde")
    with pytest.raises(Exception, match="no whole number"):
        token_counts.read_flat(spark, str(tmp_path), 7, width).collect()


def test_counts_match_the_encoder(spark):
    a = {r["doc_id"]: r["n_tokens"] for r in token_counts.op9_token_counts(spark, SF).collect()}
    assert a == {r["doc_id"]: r["n_tokens"] for r in bpe.op2_bpe(spark, SF).collect()}


# HTML


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        sub = [a[i] for i in sorted(html_text.shared_lines(a, b))]
        it = iter(b)
        assert all(x in it for x in sub) and len(sub) == table[-1][-1]


def test_page_structure():
    page = """<html><head><title>t</title></head><body><header>Top</header><nav><ul><li>M</ul></nav><div class="cookie-notice">We use</div>
    <article><h1>Title &amp; more</h1><p>One <b>two<br>three</p><script>var x='</p>'</script><aside>side</aside><div class="comments"><p>hi</p></div><p>Last</article>
    <form>f</form><footer>&copy; x</footer>"""
    assert [t for w, t, _ in html_text.page_lines(page) if w == html_text.INSIDE] == ["Title & more", "One two three", "Last"]


def test_differencing(spark):
    page = "<p>Shared head<p>Own {0}<p>Shared foot"
    rows = [(i, f"http://h.a/x/{i}", page.format(i)) for i in range(4)] + [(9, "http://alone.b/", page.format(9)), (10, "http://h.a/x/2", page.format(2))]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Own 0", 1: "Own 1", 2: "Own 2", 3: "Own 3", 9: "Shared head\nOwn 9\nShared foot", 10: "Own 2"}


def test_pages_against_pattern(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)
        assert hashlib.sha256(got[r["page_id"]].encode()).digest()
