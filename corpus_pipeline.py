"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and reads them back.

* quality_rules: rows outside their group's limits go, and so do those of more than half repeated words; short texts
  stay, as long as they have a word (``min_words=1``: short is not bad).
* exact_dedup, simhash_near_dedup: of each group the row with the smallest id stays (near: 0.8 of five-word shingles).
* mixing: rows come in the order of the mix, once for every pass over their source that reaches them.
* bpe: the ids themselves, with the digests of a round trip.

Defined cases: a null text counts as empty, and quality_rules drops it, as it does blank texts; null ids, languages
and sources are values like others; repeated rows are copies; a stage's empty input makes an empty output; columns
that ``documents`` doesn't have are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tallyforge.llm.common import discard, finished, read

#: Pieces that an encoder remembers here: workers that earlier stages have filled stay alive.
CACHE = 120_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, min_words=1).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_similar(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.default_path(), with_ids=True, cache=CACHE)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixture), ("bpe", encoding)]

#: Measures, fingerprints and encoding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = finished(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
