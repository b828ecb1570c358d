"""Main text by differencing, against plain Python and with the method switched off."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import html_text
from tallyforge.llm.url_filter import canonical

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def table(a, b):
    out = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + 1][j + 1] = out[i][j] + 1 if x == y else max(out[i][j + 1], out[i + 1][j])
    return out[-1][-1]


def brute_texts(rows, structure=True):
    """page_id -> text, for pages with URLs and ids of their own."""
    by_host, lines = defaultdict(list), {}
    for i, url, page in rows:
        host, path = canonical(url)
        lines[i] = html_text.page_lines(page)
        if host:
            by_host[host].append((path.encode(), i))
    shared, votes = {}, defaultdict(Counter)
    for host, pages in by_host.items():
        pages.sort()
        for k, (path, i) in enumerate(pages):
            near = [(common(path.decode(), p.decode()), side, j) for side, (p, j) in ((-1, pages[k - 1] if k else (b"", None)), (1, pages[k + 1] if k + 1 < len(pages) else (b"", None))) if j is not None]
            if not near:
                continue
            own, theirs = [t for _, t, _ in lines[i]], [t for _, t, _ in lines[max(near)[2]]]
            hits = html_text.shared_lines(*([html_text.line_hash(t) for t in x] for x in (own, theirs)))
            assert len(hits) == table(own, theirs)
            shared[i] = hits
            inside = [n for n, (w, _, _) in enumerate(lines[i]) if w == html_text.INSIDE]
            if not (2 * len(hits & set(inside)) > len(inside) if inside else len(hits) == len(own)):
                for n, (_, _, spot) in enumerate(lines[i]):
                    votes[host, spot][n in hits] += 1
    out = {}
    for i, url, _ in rows:
        host, marked, kept = canonical(url)[0], any(w == html_text.INSIDE for w, _, _ in lines[i]), []
        for n, (w, t, spot) in enumerate(lines[i]):
            v = votes[host, spot]
            if n in shared.get(i, ()) and v[True] > v[False]:
                continue
            if not structure or w == html_text.INSIDE or w == html_text.OUTSIDE and not marked:
                kept.append(t)
        out[i] = "\n".join(kept)
    return out


def got(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def made(seed=5, article=False):
    """Pages of a few hosts with menus, a notice inside the text, quoted passages and copies."""
    rng, out = random.Random(seed), []
    quote = "a passage that several pages quote"
    for h in range(6):
        menu = "".join(f"<div class=m{h}><p>entry {h} {k}</p></div>" for k in range(rng.randint(1, 5)))
        for k in range(rng.choice([1, 2, 5, 12])):
            own = "".join(f"<p>text {h} {k} {n} {rng.random()}</p>" + (f"<p>{quote}</p>" if rng.random() < 0.2 else "") for n in range(rng.randint(2, 6)))
            body = f"<h1>title {h} {k}</h1><div class=box>Subscribe to {h}</div>{own}"
            body = f"<article>{body}</article>" if article else f"<div>{body}</div>"
            page = f"<html><body>{menu}{body}<div class=end>The end of {h}</div></body></html>"
            out.append((len(out), f"http://h{h}.org/{rng.choice('ab')}/{k}", page))
            if rng.random() < 0.1:
                out.append((len(out), f"http://h{h}.org/copy/{k}", page))
    return out


@pytest.mark.parametrize("article", [False, True])
@pytest.mark.parametrize("structure", [False, True])
def test_against_brute_force(spark, article, structure):
    rows = made(article=article)
    found = got(spark, rows, structure=structure)
    assert found == brute_texts(rows, structure)
    alone = {i for i, u, _ in rows if sum(u.split("/")[2] == v.split("/")[2] for _, v, _ in rows) == 1}
    quoted = [i for i, _, page in rows if "quote" in page]
    assert alone and quoted and all("quote" in found[i] for i in quoted)
    assert all(("Subscribe" in found[i]) == (i in alone) for i, _, _ in rows)  # inside articles too


def test_without_neighbours_nothing_is_deleted(spark):
    rows = made(article=True)
    off = got(spark, [(i, None, page) for i, _, page in rows])
    on = got(spark, rows)
    assert sum(on[i] != off[i] for i in on) > len(on) // 2 and all("Subscribe" in t for t in off.values())


@pytest.mark.parametrize("structure", [False, True])
def test_pages_against_brute_force(spark, structure):
    """The test pages draw menus, adverts and footers by page, not by host: differencing alone can't find them."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(pages, structure=structure).collect()}
    assert found == brute_texts(rows, structure)


def test_ties_and_long_urls(spark):
    rows = [(i, f"http://h.a/{'x' * n}{i % 2}", f"<p>Head<p>Own {i}<p>Foot") for i, n in enumerate([0, 0, 5000, 5000, 5001])]
    assert got(spark, rows) == {i: f"Own {i}" for i in range(5)} == brute_texts(rows)
    same = spark.createDataFrame(rows + rows, SCHEMA)
    assert html_text.main_text(same).count() == 10
    assert html_text.main_text(same.withColumn("spots", F.lit(1)).withColumn("k1", F.lit(2))).count() == 10
