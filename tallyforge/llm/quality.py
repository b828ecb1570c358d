r"""Quality rules whose thresholds adapt to each language and source.

A scan computes a few numbers for every text.  For each (language, source, measure) a mergeable quantile
sketch is built: logarithmic buckets with a fixed relative width, so that a sketch is a set of (bucket, count)
rows, merging is adding counts, and a quantile lies in a known bucket whatever the order of merging.  A limit is a
quartile plus or minus a multiple of the distance between the quartiles; no limit is fixed, and none has a floor or a
ceiling.  Shares are smoothed by `ONE` case in `WORDS` words (or lines), so that a group whose texts have no case at
all still has a spread: that of what its texts could show, given their lengths.

A group's sketch is shrunk towards its language's, and that towards all: `PRIOR` texts spread as the parent's are
added to it, which decide in a tiny group and hardly count in a large one.  The limits are joined back and rows outside
them are rejected.

Defined cases: a null text has no words and fails the base rule; null language or source is a group of its
own; an empty table gives an empty result; repeated rows are judged alike; other columns pass through
`filter_quality` untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import finished, keyed, materialise, read, row_keys, without_keys

SKETCH_ERROR = 0.01
#: measure -> quartile distances that a text may lie below the first and above the third quartile.
FENCES = {
    "symbols_per_word": (None, 12.0),
    "dup_line_share": (None, 12.0),
    "mean_word_chars": (6.0, 6.0),
    "bare_share": (None, 12.0),
    "upper_share": (None, 12.0),
}
#: Smoothing of shares: so many cases and units that each text is taken to have besides its own.
ONE, WORDS, LINES = 1.0, 50.0, 10.0
#: Texts that a parent's sketch adds to a group's.
PRIOR = 30
#: Groups whose limits may be broadcast, a few dozen bytes each; beyond that they are joined by key.
MOST_GROUPS = 50_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper_words", "n_bare_words")


def repeated_words(words: list[str]) -> int:
    """Words covered by three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v > 2_000_000:
        _, pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        key = pairs[:-1] * v + ids[2:]
    else:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper_words, n_bare_words."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), len(lines),
        repeated_words(words), sum(w.isupper() and len(w) > 1 for w in words), sum(w == "|" for w in words),
    )


def measured(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", carry: list | None = None) -> DataFrame:
    """``row, lang, source`` and numbers for each text; ``row`` holds the columns of ``carry`` (all if None),
    so that no name of theirs can clash with a measure's."""
    src = docs.select(F.struct(*(docs.columns if carry is None else carry or [F.lit(0).alias("none")])).alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(t.as_py()) for t in b.column(3)]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["row", "lang", "source", *COUNTS])

    schema = T.StructType([*src.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    out = src.mapInArrow(run, schema)
    share = lambda a, b, more=WORDS: (F.col(a) + ONE) / (F.col(b) + more)
    return (
        out.withColumn("symbols_per_word", share("n_symbols", "n_words"))
        .withColumn("dup_line_share", share("n_dup_lines", "n_lines", LINES))
        .withColumn("mean_word_chars", F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0))
        .withColumn("bare_share", share("n_bare_words", "n_words"))
        .withColumn("upper_share", share("n_upper_words", "n_words"))
    )


def sketch(rows: DataFrame, keys: list[str], measure_cols: list[str], error: float = SKETCH_ERROR) -> DataFrame:
    """``keys, measure, bucket, n``: bucket k holds values in (g^(k-1), g^k], g = (1 + error) / (1 - error);
    zero and less fall in bucket null."""
    g = math.log((1 + error) / (1 - error))
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measure_cols])).alias("x"))
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / g)).cast("long")
    return long.select(*keys, F.col("x.measure").alias("measure"), bucket.alias("bucket")).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def sketch_quantiles(sk: DataFrame, keys: list[str], probs: dict[str, tuple[float, int]], error: float = SKETCH_ERROR) -> DataFrame:
    """``keys, measure`` and a column for each of ``probs``, name -> (probability, edge): the lower (0) or upper (1)
    edge of the bucket that holds the quantile.  A sketch has a bounded number of buckets, so the window over one
    sketch is bounded too."""
    g = math.log((1 + error) / (1 - error))
    whole = Window.partitionBy(*keys, "measure")
    run = whole.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = sk.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(whole))
    edge = lambda e: F.when(F.col("bucket").isNull(), 0.0).otherwise(F.exp((F.col("bucket") + (e - 1)) * g))
    return t.groupBy(*keys, "measure").agg(*[F.min(F.when(F.col("upto") >= F.col("total") * (p - 1e-9), edge(e))).alias(name) for name, (p, e) in probs.items()])


def _join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return a.join(b, on, how).drop(*[f"_b_{k}" for k in keys])


def shrunk(part: DataFrame, parent: DataFrame, keys: list[str], parent_keys: list[str], prior: float = PRIOR) -> DataFrame:
    """``part``'s sketches with ``prior`` texts more, spread over the buckets as the parent's are."""
    totals = parent.groupBy(*parent_keys, "measure").agg(F.sum("n").alias("total"))
    share = _join_null_safe(parent, totals, [*parent_keys, "measure"]).withColumn("n", F.col("n") * F.lit(float(prior)) / F.col("total")).drop("total")
    groups = part.select(*keys, "measure").distinct()
    more = _join_null_safe(groups, share, [*parent_keys, "measure"], "inner")
    return merge_sketches(part.withColumn("n", F.col("n").cast("double")), more.select(*part.columns))


def thresholds(rows: DataFrame, fences=FENCES, prior: float = PRIOR) -> DataFrame:
    """One row for each (language, source): ``min_`` and ``max_`` of each measure (null: no limit)."""
    sk = materialise(sketch(rows, ["lang", "source"], list(fences)), "quality-sketch")
    merged = lambda keys: sk.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    lang = shrunk(merged(["lang"]), merged([]), ["lang"], [], prior)
    own = shrunk(sk, lang, ["lang", "source"], ["lang"], prior)
    q = sketch_quantiles(own, ["lang", "source"], {"q1": (0.25, 0), "q3": (0.75, 1)})
    gap = F.col("q3") - F.col("q1")
    low = lambda m, k: F.max(F.when(F.col("measure") == m, F.col("q1") - F.lit(k) * gap)).alias(f"min_{m}")
    high = lambda m, k: F.max(F.when(F.col("measure") == m, F.col("q3") + F.lit(k) * gap)).alias(f"max_{m}")
    return q.groupBy("lang", "source").agg(*[f(m, k) for m, both in fences.items() for f, k in zip((low, high), both) if k is not None])


def judged(docs: DataFrame, fences=FENCES, min_words: int = 50, prior: float = PRIOR, **cols) -> DataFrame:
    """``measured`` plus ``base_failed`` and ``kept``."""
    rows = materialise(measured(docs, **cols), "quality-measures")
    limits = materialise(thresholds(rows, fences, prior), "quality-limits")
    limits = limits.withColumnRenamed("lang", "t_lang").withColumnRenamed("source", "t_source")
    limits = F.broadcast(limits) if limits.count() <= MOST_GROUPS else limits
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_lang", "t_source")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for m, (low, high) in fences.items():
        over = over | (F.col(m) < F.col(f"min_{m}")) if low is not None else over
        over = over | (F.col(m) > F.col(f"max_{m}")) if high is not None else over
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~F.coalesce(over, F.lit(False)))


def filter_quality(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", **options) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  Texts are measured where they are, and only keys
    of rejected rows travel."""
    cols = (text_col, lang_col, source_col)
    found = judged(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, carry=row_keys(*cols), **options)
    bad = materialise(found.filter("NOT kept").select("row.k1", "row.k2").distinct(), "quality-rejected")
    return without_keys(keyed(docs, *cols), bad).select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = finished(lambda: judged(read(spark, sf_dir, "documents"), carry=["doc_id"]).select("row", *COUNTS, "base_failed", "kept"), "quality-result")
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The verdicts in SQL: sketches are (bucket, count) rows there too; the numbers are those of `FENCES`, `PRIOR` and the smoothing.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tok AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, x || chr(31) || lead(x, 1) OVER p || chr(31) || lead(x, 2) OVER p AS g FROM tok WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
cover AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM twice, (VALUES (0), (1), (2)) AS s(k)) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper, len(list_filter(ws, lambda x: x = '|')) AS n_bare
  FROM w LEFT JOIN cover USING (r)),
v AS (SELECT r, lang, source, unnest(['symbols', 'dup', 'chars', 'bare', 'upper']) AS measure,
  unnest([(n_symbols + 1.0::DOUBLE) / (n_words + 50.0::DOUBLE), (n_dup_lines + 1.0::DOUBLE) / (n_lines + 10.0::DOUBLE), CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0 END, (n_bare + 1.0::DOUBLE) / (n_words + 50.0::DOUBLE), (n_upper + 1.0::DOUBLE) / (n_words + 50.0::DOUBLE)]) AS x FROM m),
g AS (SELECT ln(1.01::DOUBLE / 0.99::DOUBLE) AS g),
b AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / g) ELSE -1e9 END AS bucket, count(*)::DOUBLE AS n FROM v, g GROUP BY ALL),
al AS (SELECT measure, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY measure) AS total FROM b GROUP BY measure, bucket),
la AS (SELECT lang, measure, bucket, sum(n) AS n FROM (SELECT lang, measure, bucket, n FROM b UNION ALL SELECT k.lang, al.measure, bucket, 30.0 * n / total FROM (SELECT DISTINCT lang FROM b) k, al) GROUP BY ALL),
lt AS (SELECT *, sum(n) OVER (PARTITION BY lang, measure) AS total FROM la),
ow AS (SELECT lang, source, measure, bucket, sum(n) AS n FROM (SELECT lang, source, measure, bucket, n FROM b UNION ALL SELECT k.lang, k.source, lt.measure, bucket, 30.0 * n / total FROM (SELECT DISTINCT lang, source FROM b) k JOIN lt ON k.lang IS NOT DISTINCT FROM lt.lang) GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM ow),
q AS (SELECT lang, source, measure, min(CASE WHEN bucket = -1e9 THEN 0.0 ELSE exp((bucket - 1) * g) END) FILTER (upto >= total * (0.25 - 1e-9)) AS q1, min(CASE WHEN bucket = -1e9 THEN 0.0 ELSE exp(bucket * g) END) FILTER (upto >= total * (0.75 - 1e-9)) AS q3 FROM cu, g GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM v JOIN q ON v.measure = q.measure AND v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source
  WHERE x > q3 + CASE WHEN v.measure = 'chars' THEN 6 ELSE 12 END * (q3 - q1) OR v.measure = 'chars' AND x < q1 - 6 * (q3 - q1)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM f LEFT JOIN bad USING (r)
"""
