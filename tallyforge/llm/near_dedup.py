"""Near duplicates by resemblance: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. One scan sketches every text: a number for its set of shingles, a SimHash fingerprint with its row of the pivot
   distance table, `BANDS` keys of `MINIMA` minima each, and a byte of every minimum.  Equal sets are one class.
2. Classes that share a key meet: two sets with similarity 0.8 share none with probability (1 - 0.8^4)^20 = 0.00003.
   Where they meet, a pair is discarded if its sizes rule the similarity out, if its largest difference in the
   pivot table exceeds `WIDE`, if the fingerprints lie more than `WIDE` bits apart (similarity 0.8 gives about 10),
   or if fewer than `AGREE` of the minima agree (64 of 80 expected; fewer than 50 with probability 0.0001).  Not
   pairs leave this step but a spanning forest of them, at most one row for each row that came in.
3. Trees that touch form clumps.  The whole texts of a clump meet, and pairs are verified on their whole sets;
   again a forest of the links is what leaves.  Its components are the groups of near duplicates.

A forest is grown by a search that compares a class with those not yet reached only: in a dense crowd nearly all are
reached at once, and the cost is near to linear.  A key with more than `CROWD` classes, or a clump of more than
`GRAMS` shingles, is cut into parts, and each two parts meet in a task of their own: no pair is lost.

Defined cases: words and shingles are those of `simhash`; repeats in a text count once; wordless texts are copies of
one another; a null id never names a group, unless all of it is null; rows alike in id and text are one document;
an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, keyed, materialise, row_keys, with_keys, without_keys
from tallyforge.llm.components import components
from tallyforge.llm.simhash import pivots, shingle_hashes

SHINGLE = 5
PERCENT = 80
BANDS = 20
MINIMA = 4
WIDE = 24
AGREE = 50
CROWD = 1 << 15
GRAMS = 1 << 21
_ROWS = 4096
_SALTS = np.fromiter((xxhash.xxh64_intdigest(f"order {i}".encode(), 11) for i in range(BANDS * MINIMA)), np.uint64, BANDS * MINIMA)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def set_number(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.astype("<u8").tobytes())).astype(np.int64))


def sketch(h: np.ndarray, refs: np.ndarray) -> tuple[int, int, bytes, list[int], bytes]:
    """Class, fingerprint, its row of the pivot table, keys, and a byte of each minimum of a set of shingles."""
    node = set_number(h)
    if not len(h):
        return node, 0, bytes(len(refs)), [], bytes(len(_SALTS))
    ones = np.zeros(64, np.int64)
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _ROWS):
        part = h[at : at + _ROWS]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, ((part[None, :] ^ _SALTS[:, None]) * (_SALTS | np.uint64(1))[:, None]).min(axis=1), out=least)
    fp = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    keys = [xxhash.xxh64_intdigest(least[i * MINIMA : (i + 1) * MINIMA].tobytes(), i) for i in range(BANDS)]
    return node, int(fp.view(np.int64)), np.bitwise_count(fp ^ refs).astype(np.uint8).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``k1, k2, doc_id, node, n, fp, table, keys, minima`` for every row; ``n`` counts the distinct shingles."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    schema = pa.schema(list(zip(["k1", "k2", "doc_id", "node", "n", "fp", "table", "keys", "minima"], types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for b in batches:
            rows = []
            for t in b.column(3):
                h = shingle_set(t.as_py(), k)
                node, *rest = sketch(h, refs)
                rows.append((node, len(h), *rest))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([r[c] for r in rows], types[c + 3]) for c in range(6))], schema=schema)

    src = docs.select(*row_keys(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "k1 long, k2 long, doc_id long, node long, n long, fp long, table binary, keys array<long>, minima binary")


def forest(m: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of 0..m-1 under ``near(i, others)``, which says which of the others are near."""
    rest, out = np.arange(m), []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            if hit.any():
                new = rest[hit].tolist()
                rest = rest[~hit]
                todo += new
                out += [(i, j) for j in new]
    return out


def grouped(batches: Iterator[pa.RecordBatch], f: Callable[[pa.Table], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """``f``'s pairs of each run of rows with equal first column; the column comes sorted."""
    held: list[pa.RecordBatch] = []

    def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        key = t.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        pairs = [p for a, b in zip(cut, cut[1:]) if b - a > 1 for p in f(t.slice(a, b - a))]
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        start = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if held and (start or key[0] != held[-1].column(0)[0].as_py()):
            head = start if key[0] == held[-1].column(0)[0].as_py() else 0
            yield out([*held, b.slice(0, head)] if head else held)
            held, b, start = [], b.slice(head), start - head
        if start:
            yield out([b.slice(0, start)])
            b = b.slice(start)
        held.append(b)
    if held:
        yield out(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _bytes(t: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint8).reshape(t.num_rows, -1)


def plausible(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs that sizes, pivots, fingerprints and minima don't rule out."""
    node, n, fp = _column(t, "node"), _column(t, "n"), _column(t, "fp").view(np.uint64)
    table, minima = _bytes(t, "table").astype(np.int8), _bytes(t, "minima")

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
        for test in (
            lambda r: np.abs(table[r] - table[i]).max(axis=1) <= WIDE,
            lambda r: np.bitwise_count(fp[r] ^ fp[i]) <= WIDE,
            lambda r: (minima[r] == minima[i]).sum(axis=1) >= AGREE,
        ):
            left = np.flatnonzero(ok)
            if not len(left):
                break
            ok[left] = test(rest[left])
        return ok

    return [(int(node[i]), int(node[j])) for i, j in forest(t.num_rows, near) if node[i] != node[j]]


def verified(t: pa.Table, k: int, percent: int) -> list[tuple[int, int]]:
    """A forest of the pairs whose whole sets of shingles are similar."""
    node = _column(t, "node")
    sets = [shingle_set(x.as_py(), k) for x in t.column("text")]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    first = np.concatenate([[0], np.cumsum(n)])
    alive = [code, row, len(sets)]
    mark = np.zeros(len(values), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        if 2 * len(rest) < alive[2]:  # what is reached already isn't looked at again
            there = np.zeros(len(sets), bool)
            there[rest] = True
            keep = there[alive[1]]
            alive[:] = [alive[0][keep], alive[1][keep], len(rest)]
        own = code[first[i] : first[i + 1]]
        mark[own] = True
        common = np.bincount(alive[1][mark[alive[0]]], minlength=len(sets))[rest]
        mark[own] = False
        return 100 * common >= percent * (n[rest] + n[i] - common)

    return [(int(node[i]), int(node[j])) for i, j in forest(len(sets), near) if node[i] != node[j]]


def cut_up(rows: DataFrame, key: str, parts, *cols: str) -> DataFrame:
    """``rows`` under the keys that bring each two of a group's ``parts`` together."""
    t = rows.withColumn("_parts", F.greatest(parts, F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    t = t.withColumn("_own", own).withColumn("_other", F.explode(F.when(F.col("_parts") > 1, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.lit(0)))))
    new = F.when(F.col("_parts") > 1, F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other"))).otherwise(F.col(key))
    return t.select(new.alias("key"), *cols)


def candidates(classes: DataFrame, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links that connect all classes which share a key and may be similar."""
    cols = ["node", "n", "fp", "table", "minima"]
    dealt = classes.select("node", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = materialise(dealt.join(shared, "key").join(classes.select(*cols), "node"), "near-met")
    rows = cut_up(met, "key", F.ceil(F.col("size") / crowd), *cols).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: grouped(batches, lambda t: plausible(t, percent)), "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame, clumps: DataFrame, id_col: str, text_col: str, k: int, percent: int, grams: int = GRAMS) -> DataFrame:
    """``a, b``: links that connect all similar classes of a clump, from ``node, root``."""
    members = clumps.join(classes.select("node", "n", "k1", "k2"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / grams).alias("parts"))
    wanted = materialise(members.join(sizes, "root").select("k1", "k2", "node", "root", "parts"), "near-wanted")
    texts = with_keys(docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")), wanted)
    rows = cut_up(texts, "root", F.col("parts"), "node", "text").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: grouped(batches, lambda t: verified(t, k, percent)), "a long, b long").distinct()


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, crowd: int = CROWD, grams: int = GRAMS) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, with all its columns."""
    rows = materialise(sketches(docs, id_col, text_col, k), "near-sketches")
    name = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")
    classes = rows.groupBy("node").agg(F.min(name).alias("name"), *[F.first(c).alias(c) for c in ("n", "fp", "table", "keys", "minima")])
    classes = materialise(classes.select("*", "name.k1", "name.k2"), "near-classes")
    pairs = materialise(candidates(classes, percent, crowd), "near-pairs")
    clumps = materialise(components(pairs), "near-clumps")
    found = materialise(links(docs, classes, clumps, id_col, text_col, k, percent, grams), "near-links")
    roots = materialise(components(found), "near-roots")
    keep = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("name").alias("name")).select("name.k1", "name.k2")
    gone = materialise(rows.select("k1", "k2").join(keep, ["k1", "k2"], "left_anti").distinct(), "near-gone")
    discard(rows, classes, pairs, clumps, found, roots)
    return without_keys(keyed(docs, id_col, text_col), gone).select("row.*")
