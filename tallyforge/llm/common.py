"""Helpers shared by the operators: shared scratch tables, word patterns, input columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside this class.
SPACE = r"\x20\x09-\x0D"
WORD_RE = rf"[^{SPACE}]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  It comes from ``spark.checkpoint.dir``; where that is
    unset, a session on one machine takes a temporary folder and sets it as the checkpoint folder; a
    cluster has to name one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Tables written and not yet deleted, by this driver.
_MADE: list[str] = []


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a lost executor
    costs only the tasks that it ran."""
    path = f"{scratch_dir(df.sparkSession)}/tallyforge/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame, partition: str = "") -> None:
    """Delete tables that ``materialise`` wrote, or one partition (``column=value``) of each, that no later
    step reads."""
    for df in frames:
        spark = df.sparkSession
        roots = set()
        for f in df.inputFiles():
            head, found, rest = f.partition("/tallyforge/")
            if found:
                roots.add(f"{head}{found}{rest.split('/')[0]}")
        for root in roots:
            delete(spark, f"{root}/{partition}" if partition else root)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def made(folder: str) -> None:
    """Take note of a folder that `finished` is to delete."""
    _MADE.append(folder)


def finished(f: Callable[[], DataFrame], name: str) -> DataFrame:
    """``f``'s result as a table of its own; whatever else ``f`` has written is deleted."""
    before = len(_MADE)
    out = materialise(f(), name)
    for path in _MADE[before:-1]:
        delete(out.sparkSession, path)
    del _MADE[before:-1]
    return out


#: Groups that a broadcast may hold: those with over a 20,000th of all rows, of which there are fewer.
HOT_GROUPS = 20_000
#: Rows of a group that never trouble a task.
FEW_ROWS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int | None = None) -> DataFrame:
    """``rows`` left-joined with one row for each ``key``, a number or text.  Groups of more than a `HOT_GROUPS`-th of all
    rows (``total``, counted if not given) and of more than `FEW_ROWS` come to their rows by a broadcast that this bound
    keeps small.  In the join of the others such rows are dealt out by a hash of their own; what they meet there by
    chance is not looked at."""
    total = rows.count() if total is None else total
    named = groups.select(F.col(key).alias("_key"), F.struct(*[c for c in groups.columns if c != key]).alias("_group"))
    large = (F.col("_group")[size] * HOT_GROUPS > total) & (F.col("_group")[size] > FEW_ROWS)
    hot = named.filter(large).select(F.col("_key").alias(key), F.col("_group").alias("_hot"))
    kind = next(f.dataType for f in rows.schema.fields if f.name == key)
    anywhere = F.xxhash64(*rows.columns).cast(kind)
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot").isNotNull(), anywhere).otherwise(F.col(key)))
    out = marked.join(named, "_key", "left")
    return out.select(*rows.columns, F.coalesce("_hot", "_group").alias("_group")).select(*rows.columns, "_group.*")


def text_of(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def normalised(col: str = "text") -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_of(col), f"[{SPACE}]+", " ")


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD_RE)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a bitmap of keys, at most: 16 MB, whatever the input.  It has 16 bits a key where that is less.
MOST_BITS = 1 << 27
_PAGE = 32768


def bitmap(keys: DataFrame, key: Column, n: int) -> tuple[DataFrame, int]:
    """A bitmap over the hash ``key`` of ``n`` keys: (pages of 4 KB, its number of bits)."""
    bits = min(MOST_BITS, 1 << max(18, (16 * n - 1).bit_length()))
    b = F.pmod(key, F.lit(bits))
    pages = keys.select(b.alias("b")).groupBy((F.col("b") / _PAGE).cast("long").alias("_page"))
    return pages.agg(F.bitmap_construct_agg(F.col("b") % _PAGE).alias("_bits")), bits


def look_up(rows: DataFrame, pages: DataFrame, bits: int, key: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: whether the bit of ``key`` is set; every key of the bitmap is, and few others."""
    b = F.pmod(key, F.lit(bits))
    marked = rows.withColumn("_page", (b / _PAGE).cast("long")).withColumn("_at", (b % _PAGE).cast("int")).join(F.broadcast(pages), "_page", "left")
    byte = F.expr("cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int)")
    there = F.coalesce((byte / F.pow(F.lit(2), F.col("_at") % 8)).cast("int") % 2 == 1, F.lit(False))
    return marked.withColumn(out, there).drop("_page", "_at", "_bits")


def row_keys(*cols: str) -> list[Column]:
    """``k1, k2``: 128 bits that name a row by the values of ``cols``."""
    return [F.xxhash64(F.lit(n), *cols).alias(f"k{n}") for n in (1, 2)]


def keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """``row, k1, k2``: whole rows with their keys; no column's name can clash."""
    return docs.select(F.struct("*").alias("row"), *row_keys(*cols))


def with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with ``k1, k2``) whose key is in ``keys``, joined with its other columns.  A bitmap, which a
    broadcast brings to the rows, holds back most others, so that only rows like these are dealt out."""
    pages, bits = bitmap(keys, F.col("k1"), keys.count())
    return look_up(rows, pages, bits, F.col("k1"), "_in").filter("_in").drop("_in").join(keys, ["k1", "k2"])


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with ``k1, k2``) whose key is not in ``keys``.  Rows whose bit is unset stay where they are.  Of
    the others only keys are dealt out, and those that turn out to be absent bring back their few rows."""
    pages, bits = bitmap(keys, F.col("k1"), keys.count())
    marked = look_up(rows, pages, bits, F.col("k1"), "_in")
    maybe = marked.filter("_in").drop("_in")
    spared = materialise(maybe.select("k1", "k2").distinct().join(keys.select("k1", "k2"), ["k1", "k2"], "left_anti"), "spared")
    return marked.filter("NOT _in").drop("_in").unionByName(with_keys(maybe, spared).select(*rows.columns))
