import collections
import math
import re

import numpy as np
import pytest

from tallyforge.llm import katz

K = katz.K


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + ["\n"]


class Brute:
    """The model by its definition, over plain dictionaries."""

    def __init__(self, rows, order):
        self.order, self.docs = order, [(i, words(t), katz.is_training(i)) for i, t in rows]
        counts = [collections.Counter() for _ in range(order + 1)]
        for _, w, train in self.docs:
            p = ["<s>"] * (order - 1) + w
            for t in range(order - 1, len(p) if train else 0):
                for k in range(1, order + 1):
                    counts[k][tuple(p[t - k + 1 : t + 1])] += 1
        self.n, self.v = sum(counts[1].values()), len(counts[1])
        self.c1 = counts[1]
        self.d = [None] + [katz.good_turing(np.array([sum(v == r for v in counts[k].values()) for r in range(1, K + 2)])) for k in range(1, order + 1)]
        self.after = [collections.defaultdict(dict) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.reserve = sum((1 - self.d[1][r]) * r * sum(v == r for v in self.c1.values()) for r in range(1, K + 1)) / max(1, self.n)

    def p(self, k, h, w):
        if k == 1:
            c = self.c1.get((w,), 0)
            if not self.n:
                return 1.0
            if self.reserve <= 0:
                return (c or 1) / (self.n + 1)
            return (self.d[1][c] if c <= K else 1) * c / self.n if c else self.reserve
        f = self.after[k].get(h)
        if not f:
            return self.p(k - 1, h[1:], w)
        total, c = sum(f.values()), f.get(w, 0)
        freed = sum((1 - self.d[k][x]) * x for x in f.values() if x <= K) / total
        rest = 1 - sum(self.p(k - 1, h[1:], x) for x in f)
        if freed <= 0:
            return c / (total + 1) if c else 1 / (total + 1) / rest * self.p(k - 1, h[1:], w)
        return (self.d[k][c] if c <= K else 1) * c / total if c else freed / rest * self.p(k - 1, h[1:], w)

    def score(self, w):
        p = ["<s>"] * (self.order - 1) + w
        return sum(math.log10(self.p(self.order, tuple(p[t - self.order + 1 : t]), p[t])) for t in range(self.order - 1, len(p)))


@pytest.mark.parametrize("order,block,buckets", [(1, 10**6, None), (2, 10**6, None), (2, 3000, 3), (3, 3000, 5)])
def test_brute_force(spark, small, order, block, buckets):
    docs = small.filter("n_chars < 2500").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = Brute(rows, order)
    for r in katz.score_texts(docs, order=order, block_tokens=block, buckets=buckets)[0].collect():
        w = next(w for i, w, _ in b.docs if i == r["doc_id"])
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(w), b.n, not katz.is_training(r["doc_id"]))
        assert r["n_known"] == sum((x,) in b.c1 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((b.c1.get((x,), 0) + 1) / (b.n + b.v + 1)) for x in w))
        assert r["score"] == pytest.approx(b.score(w), rel=1e-9)


def test_histories_add_up_to_one(small):
    rows = [(r["doc_id"], r["text"]) for r in small.filter("n_chars < 1500").limit(25).collect()]
    b = Brute(rows, 2)
    vocab = [w for (w,) in b.c1]
    assert sum(b.p(1, (), w) for w in vocab) + b.p(1, (), "never seen") == pytest.approx(1)
    for h in list(b.after[2])[:40] + [("nowhere",)]:
        assert sum(b.p(2, h, w) for w in vocab) + b.p(2, h, "never seen") == pytest.approx(1)


def test_beats_the_base_on_held_out_texts(small):
    rows = [r for r in katz.score_texts(small)[0].collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


def test_spread_histories(spark):
    # one history has a third of all tokens: it is spread over buckets and adds up all the same
    rows = [(i, " ".join(f"hot w{(i * 31 + j) % 500}" if j % 2 else f"c{j}" for j in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = Brute(rows, 2)
    for r in katz.score_texts(docs, block_tokens=500, buckets=16)[0].collect():
        assert r["score"] == pytest.approx(b.score(words(rows[r["doc_id"]][1])), rel=1e-9)


@pytest.mark.parametrize("order,buckets", [(1, 3), (2, 16), (3, 5)])
def test_stored_model_scores_other_texts(spark, small, order, buckets):
    rows = [(i, " ".join(f"hot w{(i * 31 + j) % 50}" if j % 2 else f"c{j}" for j in range(60))) for i in range(40)]
    rows += [(100 + r["doc_id"], r["text"]) for r in small.filter("n_chars < 1500").limit(15).collect()]
    b = Brute(rows, order)
    _, model = katz.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_tokens=700, buckets=buckets)
    other = [(0, rows[0][1] + " never seen hot c4"), (1, None), (2, rows[-1][1]), (None, "hot hot c2 w3"), (1, "x")]
    got = katz.score_with(model, spark.createDataFrame(other, "doc_id long, text string"), block_tokens=20).collect()
    want = sorted((str(i), b.n, round(b.score(words(t)), 8)) for i, t in other)
    assert sorted((str(r["doc_id"]), r["train_tokens"], round(r["score"], 8)) for r in got) == want
    # the tables hold the model: counts, discounts, and weights that make each history add up to one
    ones = katz.model_rows(model, 1).collect()
    assert sorted(r["count"] for r in ones) == sorted(b.c1.values())
    assert sum(r["p"] for r in ones) + (b.reserve or 1 / (b.n + 1)) == pytest.approx(1)
    for k in range(2, order + 1):
        found, total = collections.defaultdict(list), 0
        for r in katz.model_rows(model, k).collect():
            found[r["history"]].append(r)
            total += r["count"]
        assert total == b.n and len(found) == len(b.after[k])
        whole = [h for h in found.values() if h[0]["total"] is not None]
        assert whole and all(sum(r["count"] for r in h) == h[0]["total"] for h in whole)
        for h in whole:
            seen = sum(r["discounted"] for r in h) / h[0]["total"]
            if seen < 1 - 1e-9:  # else one count is set aside
                assert seen + h[0]["weight"] * (1 - sum(r["lower"] for r in h)) == pytest.approx(1)


def test_pack_round_trip():
    a = [np.arange(5), np.array([2**63 + 1], np.uint64), np.repeat([0.1, 0.2], 200), np.zeros(0), np.array([-3, 7])]
    for x, y in zip(a, katz.unpack(katz.pack(*a))):
        assert (np.asarray(x) == y).all() and len(x) == len(y)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    big = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    whole = [[], [5], [0, 0, 0], [1, 2, 2, 300, 70000], [3, 1], [-1, 4], big, np.sort(big), np.sort(rng.integers(0, 90, 999))]
    for a in map(np.array, [*whole, rng.random(100), np.repeat(rng.random(3), 50)]):
        (b,) = katz.unpack(katz.pack(a))
        assert np.array_equal(a, b)
    a, b, c = katz.unpack(katz.pack(np.arange(10), np.repeat([0.5, 0.25], 100), np.zeros(0)))
    assert [len(a), len(b), len(c)] == [10, 200, 0]
