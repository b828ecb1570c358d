"""Near duplicates: SimHash fingerprints linked through pivot distance tables.

1. Each text becomes one 64-bit fingerprint: a bit is 1 if set in over half the hashes of its word shingles,
   repeats included.  Equal fingerprints collapse to one row each before anything is compared.
2. Fingerprints meet where links are possible at all: within `DISTANCE` = 2 bits, at least two of four
   16-bit quarters are equal, so each fingerprint is dealt out under its six pairs of quarters (32 bits each).
   No link is lost, and no key holds all fingerprints.
3. A table of Hamming distances to `PIVOTS` reference fingerprints is computed once a fingerprint, and its rows go
   where the fingerprint goes.  By the triangle inequality, two fingerprints whose distances to any reference differ by
   more than `DISTANCE` cannot be linked: within a key, such pairs are discarded on the largest coordinate difference,
   and the survivors are verified bit by bit.  (The table can't replace the keys: random fingerprints lie 32 +- 4 bits
   from a reference, so a window that holds all that may be linked holds nearly half of all fingerprints.)
4. A key with more than `CROWD` fingerprints is never compared pairwise.  Its fingerprints name every centre
   within one bit (65 each); two fingerprints within two bits share a centre, and a centre has 65 neighbours
   at most, so linking each to its centre's smallest is exact and linear.  Within fewer bits than two, a crowded
   fingerprint is linked with those of its 64 neighbours that exist.
5. Links join classes; components give each class its smallest document.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a text with fewer
words than a shingle is one shingle; null ids get a class but never name it, unless all of it is null;
repeated rows get equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import finished, join_groups, materialise, read
from tallyforge.llm.components import components

DISTANCE = 2
PIVOTS = 16
CROWD = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROWS = 1 << 16


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, max(1, len(words) - k + 1))


def fingerprint(text: str | None, k: int = 3) -> int:
    h = shingle_hashes(text, k)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _ROWS):
        bits = np.unpackbits(h[at : at + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``doc_id, fp``; ``fp`` is the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same on every machine."""
    return np.fromiter((xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(n)), np.uint64, n)


def pivot_pairs(key: np.ndarray, fp: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs among rows with equal ``key``; rows come sorted by key."""
    left, right = [], []
    live = np.arange(len(key) - 1)
    step = 1
    while len(live):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        if not len(live):
            break
        other = live + step
        near = np.abs(table[live] - table[other]).max(axis=1) <= distance
        i, j = live[near], other[near]
        good = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        left.append(i[good])
        right.append(j[good])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp, table`` for each of ``fp``: a byte for the distance to each reference."""
    schema = pa.schema([("fp", pa.int64()), ("table", pa.binary(PIVOTS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for b in batches:
            rows = np.bitwise_count(b.column(0).to_numpy().view(np.uint64)[:, None] ^ refs[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary(PIVOTS)).cast(pa.binary())], names=["fp", "table"])

    return fps.select("fp").mapInArrow(run, "fp long, table binary")


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``a, b``: enough links between distinct fingerprints to connect all that lie within ``distance`` bits
    (2 at most)."""
    if distance > 2:
        raise ValueError("quarters and centres are exact up to two bits")
    quarter = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(n).alias("which"), (quarter(i) * 65536 + quarter(j)).alias("key")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    table = materialise(pivot_table(fps), "simhash-table")
    dealt = table.select("fp", "table", F.explode(F.array(*keys)).alias("x")).select("fp", "table", (F.col("x.key") * 6 + F.col("x.which")).alias("key"))
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(dealt.join(counts, "key"), "simhash-met")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, fp, table = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, PIVOTS), np.int8)

        def out(key, fp, table):
            i, j = pivot_pairs(key, fp, table, distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], schema=schema)

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
            table = np.concatenate([table, np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(-1, PIVOTS)])
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield out(key[:whole], fp[:whole], table[:whole])
            key, fp, table = key[whole:], fp[whole:], table[whole:]
        yield out(key, fp, table)

    few = met.filter(F.col("n") <= crowd).select("key", "fp", "table").repartition("key").sortWithinPartitions("key")
    pairs = few.mapInArrow(compare, "a long, b long")
    crowded = met.filter(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    if distance < 2:  # a centre links what lies two bits apart; only those that are fingerprints themselves may
        hubs = crowded.select(F.col("fp").alias("centre"), F.col("fp").alias("hub"))
    else:
        hubs = near.groupBy("centre").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("centre", "hub")
    spokes = near.join(hubs, "centre").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    if distance < 2:
        spokes = spokes.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pairs.unionByName(spokes).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    rows = materialise(fingerprints(docs, id_col, text_col, k), "simhash-fp")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), "simhash-classes")
    roots = materialise(components(links(classes.select("fp"), distance)), "simhash-roots")
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "first", "root")
    named = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(named, "root").select("fp", "least", F.lit(True).alias("linked"))
    final = classes.join(moved, "fp", "left").select("fp", "n_rows", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    final = materialise(final, "simhash-named")
    return join_groups(rows, final, "fp", "n_rows").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document that names each class, with all its columns; an id names one document."""
    found = near_duplicates(docs, id_col, text_col, **options)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep"]), "left_semi")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = finished(lambda: near_duplicates(read(spark, sf_dir, "documents")), "simhash-result")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
