"""The pipeline's near dedup against brute-force Jaccard over five-word shingles."""

import random
import re

import corpus_pipeline
import pytest

from tallyforge.llm import near_dedup


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Smallest ids of the components of pairs with a similarity of 0.8 or more."""
    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both, whole = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * whole:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}


def families(seed=3):
    rng, out = random.Random(seed), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 12, 60, 300]))]
        for _ in range(6):
            mine = list(words)
            for _ in range(rng.choice([0, 1, 2, 4]) * len(mine) // 100):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(5000)}"
            out.append((len(out), " ".join(mine).upper() if rng.random() < 0.2 else "\n".join(mine)))
    return out + [(len(out), ""), (len(out) + 1, " \n")]


@pytest.mark.parametrize("crowd, grams", [(2, 200), (near_dedup.CROWD, near_dedup.GRAMS)])
def test_against_all_pairs(spark, crowd, grams):
    rows = families()
    got = near_dedup.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, grams=grams)
    assert {r["doc_id"] for r in got.collect()} == brute_kept(rows)


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()}
    assert got == brute_kept(rows)


def test_awkward_tables(edge, clashing, empty):
    assert near_dedup.drop_similar(clashing).columns == clashing.columns
    assert near_dedup.drop_similar(clashing).count() == near_dedup.drop_similar(edge).count() <= edge.count()
    assert near_dedup.drop_similar(empty).count() == 0


def test_groups_that_batches_cut(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    keys = sorted(rng.choice([1, 2, 3, 9, 9, 9]) for _ in range(50))
    t = pa.table({"key": keys, "node": range(50)})
    seen = []
    for size in (1, 3, 7, 50):
        seen.clear()
        list(near_dedup.grouped(iter(t.to_batches(max_chunksize=size)), lambda g: seen.append((g["key"][0].as_py(), g["node"].to_pylist())) or []))
        assert seen == [(k, [i for i in range(50) if keys[i] == k]) for k in (1, 2, 3, 9)]


def test_forest_connects_what_is_near():
    rng = random.Random(8)
    for _ in range(200):
        m = rng.randint(0, 30)
        near = [[rng.random() < 0.05 for _ in range(m)] for _ in range(m)]
        ok = lambda i, rest: near_dedup.np.array([near[min(i, j)][max(i, j)] for j in rest], bool)
        edges = near_dedup.forest(m, ok)
        assert len(edges) < max(m, 1) and all(near[min(e)][max(e)] for e in edges)

        def groups(pairs):
            root = list(range(m))
            for a, b in pairs:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
            return {frozenset(i for i in range(m) if root[i] == r) for r in root}

        assert groups(edges) == groups([(i, j) for i in range(m) for j in range(i + 1, m) if near[i][j]])
