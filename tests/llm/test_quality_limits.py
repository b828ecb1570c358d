"""Limits come from sketches of each group, shrunk towards its language's and all texts'."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import quality

SF = "/root/testdata/sf0.001"


def words(length, n, every):
    return " ".join(f"{i:0{length}d}" if i % every else f"{i:0{length + 1}d}" for i in range(n))


def test_limits_follow_the_group(spark):
    rows = [(g * 100 + i, words(size, 60, 2 + i % 5), "en", f"s{g}") for g, size in enumerate((4, 9)) for i in range(90)]
    rows += [(900 + g, words(9, 60, 3), "en", f"s{g}") for g in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs).select("row.doc_id", "kept").collect()}
    assert not got[900] and got[901]  # the same text, out of the way in one source only
    assert all(kept for i, kept in got.items() if i != 900)
    # without groups there is one limit for all, and both pass
    one = quality.judged(docs.withColumn("source", F.lit("s"))).select("row.doc_id", "kept").collect()
    assert all(r["kept"] for r in one)


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    share = lambda x, of=n, more=50: (x + 1) / (of + more)
    return n, len(cover), {
        "symbols_per_word": share(sum(c in "#*$%&|<>" for c in text)),
        "dup_line_share": share(len(lines) - len(set(lines)), len(lines), 10),
        "mean_word_chars": sum(map(len, w)) / n if n else 0.0,
        "bare_share": share(w.count("|")),
        "upper_share": share(sum(x.isupper() and len(x) > 1 for x in w)),
    }


def brute_kept(rows, prior=30.0, fences=quality.FENCES):
    """doc_id -> (base failed, kept), by plain Python."""
    g = math.log((1 + quality.SKETCH_ERROR) / (1 - quality.SKETCH_ERROR))
    found = [(i, lang, source, *brute_measures(t)) for i, t, lang, source in rows]
    out = {}
    for m in fences:
        own, lang_, all_ = defaultdict(Counter), defaultdict(Counter), Counter()
        for _, lang, source, _, _, x in found:
            b = math.ceil(math.log(x[m]) / g) if x[m] > 0 else -math.inf
            own[lang, source][b] += 1
            lang_[lang][b] += 1
            all_[b] += 1

        def shrink(part, parent):
            total = sum(parent.values())
            return {b: part.get(b, 0) + prior * parent.get(b, 0) / total for b in {*part, *parent}}

        def edge(sk, p, e):
            total, upto = sum(sk.values()), 0.0
            for b in sorted(sk):
                upto += sk[b]
                if upto >= total * (p - 1e-9):
                    return 0.0 if b == -math.inf else math.exp((b - 1 + e) * g)

        for (lang, source), part in own.items():
            sk = shrink(part, shrink(lang_[lang], all_))
            q1, q3 = edge(sk, 0.25, 0), edge(sk, 0.75, 1)
            low, high = fences[m]
            out[lang, source, m] = (-math.inf if low is None else q1 - low * (q3 - q1), math.inf if high is None else q3 + high * (q3 - q1))
    verdict = {}
    for i, lang, source, n, rep, x in found:
        base = n < 50 or 100 * rep > 50 * n
        fits = all(out[lang, source, m][0] <= x[m] <= out[lang, source, m][1] for m in fences)
        verdict.setdefault(i, []).append((base, not base and fits))
    return verdict


@pytest.mark.parametrize("table", ["small", "edge"])
def test_verdicts_against_brute_force(table, request):
    docs = request.getfixturevalue(table)
    want = brute_kept([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
    got = defaultdict(list)
    for r in quality.judged(docs).select("row.doc_id", "base_failed", "kept").collect():
        got[r["doc_id"]].append((r["base_failed"], r["kept"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert len({v for x in got.values() for v in x}) > 1


def test_filter_is_the_verdict(edge):
    kept = quality.judged(edge, min_words=1).filter("kept").select("row.*").collect()
    assert sorted(map(str, quality.filter_quality(edge, min_words=1).collect())) == sorted(map(str, kept)) != []
