"""Open-text answers: cleaning, tokens, TF-IDF, random and diverse samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators.select import select_columns
from tallyforge.operators.tabulate import dtypes
from tallyforge.plans.state import current, on_default

SAMPLE_SIZE, MIN_CHARS, MAX_CHARS, MAX_CANDIDATES, LAMBDA = 10, 10, 300, 500, 0.6
#: English function words, left out of tokens unless others are given (fixed values).
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing would should could ought "
    "i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't "
    "aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's "
    "what's here's there's when's where's why's how's a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very will"
).split()


@on_default
def prep_comments(df: DataFrame | None, *columns, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, exclude=None, by=None) -> DataFrame:
    """``by, source, comment, length``: answers longer than ``min_chars``, none that ``exclude`` (patterns,
    ignoring case) fits, cut to ``max_chars`` with three dots; respondent by respondent, then by column."""
    df = current().resolve(df)
    names = select_columns(df, *columns)
    if not names:
        raise ValueError("Select at least one comment column.")
    by = select_columns(df, by) if by is not None else []
    kinds = dtypes(df)
    cells = [F.struct(F.lit(c).alias("source"), S.na_blank(c, dtype=kinds[c]).alias("comment")) for c in names]
    d = df.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*").filter(F.length("comment") > min_chars)
    if exclude:
        pattern = "|".join([exclude] if isinstance(exclude, str) else exclude).lower()
        d = d.filter(~F.lower("comment").rlike(pattern))
    cut = F.when(F.length("comment") > max_chars, F.concat(F.substring("comment", 1, max_chars - 3), F.lit("..."))).otherwise(F.col("comment"))
    return d.withColumn("comment", cut).withColumn("length", F.length("comment"))


@on_default
def sample_comments(df: DataFrame | None, *columns, n: int = SAMPLE_SIZE, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, exclude=None, by_column: bool = True, by=None, seed: int | None = None) -> DataFrame:
    """``n`` random comments from each source and group.  Spark keeps the n best of each group per task
    before it ranks, so a group's rows never meet in one place."""
    d = prep_comments(df, *columns, min_chars=min_chars, max_chars=max_chars, exclude=exclude, by=by)
    groups = (["source"] if by_column else []) + ([] if by is None else select_columns(current().resolve(df), by))
    draw = F.rand() if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "comment"))
    w = Window.partitionBy(*groups).orderBy("__draw", "comment") if groups else Window.orderBy("__draw", "comment")
    return d.withColumn("__draw", draw).withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).orderBy(*groups, "__k").drop("__draw", "__k")


def tokens(comment: Column | str, stopwords=STOPWORDS) -> Column:
    """Words of three letters or more, lower-cased, each once, stop words out."""
    words = F.split(F.regexp_replace(F.lower(S.col(comment)), "[^a-z0-9' ]", " "), " +")
    long = F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))
    return F.array_except(long, F.array(*[F.lit(w) for w in stopwords])) if stopwords else long


def entropy_bits(words: Column) -> Column:
    """Shannon bits of a comment's words, each of which it has once."""
    return F.when(F.size(words) > 0, F.log2(F.size(words))).otherwise(0.0)


#: Words that a broadcast may hold: those in more than a 20,000th of all (text, word) rows, of which there are fewer.
HOT_WORDS = 20_000


def document_frequencies(df: DataFrame, text: str, stopwords=()) -> DataFrame:
    """``word, df, idf`` with smoothed idf = ln((1 + N) / (1 + df)) + 1."""
    n = df.agg(F.count("*").alias("__n"))
    words = df.select(F.explode(tokens(text, stopwords)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return words.crossJoin(n).select("word", "df", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, id: str, text: str, stopwords=()) -> DataFrame:
    """``id, word, weight``: presence times idf, each text's weights to length 1, as sparse rows.  Frequent words get
    their idf where their rows are, by a broadcast of at most `HOT_WORDS`; the rest is dealt out by word."""
    words = df.select(F.col(id), F.explode(tokens(text, stopwords)).alias("word"))
    idf = document_frequencies(df, text, stopwords)
    total = idf.agg(F.sum("df").alias("__all"))
    known = idf.crossJoin(F.broadcast(total)).withColumn("__hot", F.col("df") * HOT_WORDS > F.col("__all"))
    hot, rest = known.filter("__hot").select("word", "idf"), known.filter("NOT __hot").select("word", "idf")
    w = words.join(F.broadcast(hot), "word", "left")
    w = w.filter("idf IS NOT NULL").unionByName(w.filter("idf IS NULL").drop("idf").join(rest, "word"))
    norm = w.groupBy(id).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("__norm"))
    return w.join(norm, id).select(id, "word", (F.col("idf") / F.col("__norm")).alias("weight"))


def _dense(comments: list[str], stop: set[str]) -> tuple[np.ndarray, np.ndarray] | None:
    import re

    rows = [list(dict.fromkeys(w for w in re.sub("[^a-z0-9' ]", " ", c.lower()).split() if len(w) > 2 and w not in stop)) for c in comments]
    vocab = {w: j for j, w in enumerate(sorted({w for r in rows for w in r}))}
    if not vocab:
        return None
    tf = np.zeros((len(rows), len(vocab)))
    for i, r in enumerate(rows):
        tf[i, [vocab[w] for w in r]] = 1
    m = tf * (np.log((1 + len(rows)) / (1 + tf.sum(axis=0))) + 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return tf, m / np.where(norm == 0, 1, norm)


@on_default
def sample_comments_diverse(df: DataFrame | None, *columns, n: int = SAMPLE_SIZE, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, exclude=None, lambda_: float = LAMBDA, method: str = "mmr", score: str = "entropy", stopwords=None, max_candidates: int = MAX_CANDIDATES, seed: int | None = None) -> DataFrame:
    """``source, comment, length, info``: informative comments unlike each other.  Spark removes repeats and
    draws the shortlist of at most ``max_candidates`` that this operator compares; the comparison, quadratic in
    the shortlist, is the driver's."""
    method, score = S.match_arg(method, ("mmr", "entropy")), S.match_arg(score, ("entropy", "tfidf"))
    d = prep_comments(df, *columns, min_chars=min_chars, max_chars=max_chars, exclude=exclude)
    d = d.groupBy("comment").agg(F.min("source").alias("source"), F.first("length").alias("length"))
    draw = F.rand() if seed is None else F.xxhash64(F.lit(seed), "comment")
    rows = d.orderBy(draw, "comment").limit(max_candidates).collect()
    spark = d.sparkSession
    schema = "source string, comment string, length int, info double"
    if len(rows) <= n:
        return spark.createDataFrame([(r["source"], r["comment"], r["length"], None) for r in rows], schema)
    rng = np.random.default_rng(seed)
    stop = set() if stopwords is False else set(STOPWORDS if stopwords is None else [w.lower() for w in stopwords])
    dense = _dense([r["comment"] for r in rows], stop)
    if dense is None:
        return spark.createDataFrame([(r["source"], r["comment"], r["length"], None) for r in rows[:n]], schema)
    tf, m = dense
    size = tf.sum(axis=1)
    info = np.where(size > 0, np.log2(np.maximum(size, 1)), 0.0) if score == "entropy" else m.sum(axis=1)
    if method == "entropy":
        p = info - info.min() + 1e-6
        chosen = rng.choice(len(rows), n, replace=False, p=p / p.sum()).tolist()
    else:
        spread = info.max() - info.min()
        value = np.full(len(rows), 0.5) if spread == 0 else (info - info.min()) / spread
        alike, left, chosen = np.zeros(len(rows)), np.ones(len(rows), bool), []
        for _ in range(n):
            s = np.where(left, lambda_ * value - (1 - lambda_) * alike, -np.inf)
            p = np.exp(s - s.max())
            k = int(rng.choice(len(rows), p=p / p.sum()))
            chosen.append(k)
            left[k] = False
            alike = np.maximum(alike, m @ m[k])
    return spark.createDataFrame([(rows[k]["source"], rows[k]["comment"], rows[k]["length"], float(info[k])) for k in chosen], schema)
