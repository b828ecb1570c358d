"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of white space became one space.

1. One scan counts (length, prefix hash) of all texts.
2. Lengths that occur once are settled; among the others, (length, prefix hash) pairs that occur once
   are settled too.  What survives is kept as a bitmap over the pair's hash, 16 bits a pair, 16 MB at most.
3. A second scan computes the full hash (SHA-256) only for rows whose bit is set, and groups rows by
   (length, prefix hash, full hash).  A bit set by chance costs one needless hash, never a wrong group.

Texts never travel through a shuffle.  The largest group costs one row for each map task in the
aggregation, and large groups are joined back by a broadcast of bounded size.

Defined cases: a null text counts as empty; a null id never beats another id, and a group of null ids
has a null ``keep_id``; rows that repeat one id are one document and are all marked alike, though
`drop_exact_duplicates` leaves a single row of each group; an empty table gives an empty result; other columns
of the input are ignored or passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bitmap, discard, finished, join_groups, keyed, look_up, materialise, normalised, read, row_keys, with_keys, without_keys


def surviving_pairs(counts: DataFrame) -> DataFrame:
    """(length, prefix hash) pairs that more than one row has, lengths first, from ``n_chars, prefix_hash, n``."""
    lengths = counts.groupBy("n_chars").agg(F.sum("n").alias("n_same_length")).filter("n_same_length > 1").select("n_chars")
    return counts.join(lengths, "n_chars", "left_semi").filter("n > 1").select("n_chars", "prefix_hash")


def refined(docs: DataFrame, text_col: str, carry: list, prefix_chars: int, digest_all: bool = False) -> DataFrame:
    """``carry``'s columns, ``group_key`` (equal for equal texts), ``full_hash`` and, if asked for, ``digest``."""
    src = docs.select(F.struct(*carry).alias("own"), normalised(text_col).alias("norm"))
    shape = src.select("own", "norm", F.length("norm").alias("n_chars"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix_hash"))
    counts = materialise(shape.groupBy("n_chars", "prefix_hash").agg(F.count("*").alias("n")), "dedup-counts")
    pairs = materialise(surviving_pairs(counts), "dedup-pairs")
    pair = F.xxhash64("n_chars", "prefix_hash")
    pages, bits = bitmap(pairs, pair, pairs.count())
    rows = look_up(shape, pages, bits, pair, "alive")
    digest = F.sha2(F.col("norm"), 256)
    full = F.when(F.col("alive"), digest)
    rows = rows.select("own.*", F.coalesce(full, F.concat_ws(":", "n_chars", "prefix_hash")).alias("group_key"), full.alias("full_hash"), *([digest.alias("digest")] if digest_all else []))
    return materialise(rows, "dedup-rows")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``keep_id`` is the smallest id of the row's group.  ``text_sha256`` is null where refinement
    settled the row without reading its text, unless ``digest_all`` asks for it in the report.
    """
    rows = refined(docs, text_col, [F.col(id_col).alias("doc_id")], prefix_chars, digest_all)
    groups = rows.groupBy("group_key").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    many = materialise(groups.filter("group_size > 1"), "dedup-groups")
    out = join_groups(rows, many, "group_key", "group_size")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        (F.col("digest") if digest_all else F.col("full_hash")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """The row with the smallest id of each group of equal texts, with all its columns.  Only keys of rows that
    go travel; texts stay where they are."""
    name = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")
    rows = refined(docs, text_col, [F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col)], prefix_chars)
    groups = rows.groupBy("group_key").agg(F.min(name).alias("name"), F.count("*").alias("group_size"))
    many = materialise(groups.filter("group_size > 1"), "dedup-groups")
    # rows of one id and one text share a key: all of them go but one
    copies = join_groups(rows.select("group_key", "k1", "k2"), many, "group_key", "group_size").filter("group_size > 1")
    named = (F.col("k1") == F.col("name.k1")) & (F.col("k2") == F.col("name.k2"))
    gone = materialise(copies.groupBy("k1", "k2").agg(F.max(named).alias("named"), F.count("*").alias("n")).filter("NOT named OR n > 1"), "dedup-gone")
    discard(rows, many)
    whole = keyed(docs, id_col, text_col)
    left = without_keys(whole, gone)
    twice = gone.filter("named").select("k1", "k2")
    if twice.limit(1).count():
        left = left.unionByName(with_keys(whole, twice).select(*whole.columns).dropDuplicates(["k1", "k2"]))
    return left.select("row.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return finished(lambda: exact_duplicates(read(spark, sf_dir, "documents"), digest_all=True), "dedup-result")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
