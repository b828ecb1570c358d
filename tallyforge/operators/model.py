"""Net Promoter scores, comparisons, driver importance and importance/performance models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators.select import check_column, select_columns, starts_with
from tallyforge.operators.tabulate import dtypes, grouping
from tallyforge.operators.weights import WEIGHT, with_weights
from tallyforge.plans.state import current, on_default

METHODS = ("rwa", "forest", "correlation")
FOREST_TREES = 500
FOREST_LEAF = 5


@on_default
def calc_nps(df: DataFrame | None, value: str, by=None, weights=None) -> DataFrame:
    """``by, n, nps, pct_*, n_*`` of promoters, passives and detractors; shares follow the weights, counts don't."""
    df = current().resolve(df)
    check_column(value, df)
    by = grouping(df, by)
    scheme = current().resolve_weights(weights)
    d = with_weights(df, scheme).select(*by, WEIGHT, S.nps_group(value, dtype=dtypes(df)[value]).alias("__g")).filter("__g IS NOT NULL")
    share = lambda g: S.r_round(F.try_divide(F.sum(F.when(F.col("__g") == g, F.col(WEIGHT)).otherwise(0.0)), F.sum(WEIGHT)) * 100, 0)
    count = lambda g: F.count_if(F.col("__g") == g)
    out = d.groupBy(*by).agg(
        F.count("*").alias("n"), S.r_round(F.try_divide(F.sum(F.col("__g") * F.col(WEIGHT)), F.sum(WEIGHT)) * 100, 0).alias("nps"),
        share(1).alias("pct_promoters"), share(0).alias("pct_passives"), share(-1).alias("pct_detractors"),
        count(1).alias("n_promoters"), count(0).alias("n_passives"), count(-1).alias("n_detractors"),
    )
    return out.orderBy(*[F.col(f"`{b}`").asc_nulls_last() for b in by]) if by else out


def nps_distribution(df: DataFrame, value: str) -> DataFrame:
    """``score, group, n, pct`` for 0 to 10."""
    n = df.select(S.ensure_numeric(value, dtypes(df)[value]).alias("score")).filter("score BETWEEN 0 AND 10 AND score = floor(score)").groupBy("score").agg(F.count("*").alias("n"))
    scores = df.sparkSession.range(11).select(F.col("id").cast("double").alias("score"))
    t = scores.join(n, "score", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = n.agg(F.sum("n").alias("__total"))
    return t.crossJoin(total).select(F.col("score").cast("int").alias("score"), S.nps_group("score", labels=True, dtype=T.DoubleType()).alias("group"), "n", S.r_round(F.try_divide(F.col("n"), F.col("__total")) * 100, 0).alias("pct")).orderBy("score")


def compare_values(now: DataFrame, before: DataFrame, by: str = "feature", value: str = "performance") -> DataFrame:
    """``by, previous, current, difference``: all keys of the earlier table, missing ones matching each other."""
    check_column(by, now), check_column(by, before)
    a = before.select(F.col(f"`{by}`").alias(by), F.col(f"`{value}`").cast("double").alias("previous"))
    b = now.select(F.col(f"`{by}`").alias("__key"), F.col(f"`{value}`").cast("double").alias("current"))
    out = a.join(b, F.col(f"`{by}`").eqNullSafe(F.col("__key")), "left").drop("__key")
    return out.withColumn("difference", F.col("current") - F.col("previous"))


def _recoded(df: DataFrame, columns: list[str], levels) -> DataFrame:
    kinds = dtypes(df)
    worded = [c for c in columns if not isinstance(kinds[c], T.NumericType)]
    return df.withColumns({c: S.recode_likert(c, levels) for c in worded}) if worded else df


#: Up to so many columns each product is an expression of its own; beyond, tasks multiply whole batches.
MANY_COLUMNS = 24


def _products(d: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sums of the products of each two columns' deviations: one small matrix a task, added up cell by cell."""
    p = len(mean)

    def run(batches):
        total = np.zeros((p, p))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    cells = d.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(p * p)
    for r in cells:
        out[r["i"]] = r["x"]
    return out.reshape(p, p)


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariances) over rows complete in ``columns``: two aggregations, the second around the means
    of the first."""
    kinds = dtypes(df)
    d = df.select(*[S.ensure_numeric(c, kinds[c]).alias(f"v{i}") for i, c in enumerate(columns)]).dropna()
    p = len(columns)
    r = d.agg(F.count("*").alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(p)]).first()
    if r["n"] < 2:
        raise ValueError("Fewer than two complete rows.")
    mean = np.array([r[f"m{i}"] for i in range(p)])
    if p > MANY_COLUMNS:
        return r["n"], mean, _products(d, mean) / (r["n"] - 1)
    dev = [F.col(f"v{i}") - F.lit(float(mean[i])) for i in range(p)]
    s = d.agg(*[F.sum(dev[i] * dev[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    cov = np.array([[s[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / (r["n"] - 1)
    return r["n"], mean, cov


def _correlations(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov / np.outer(sd, sd)


def relative_weights(cov: np.ndarray, names: list[str]) -> np.ndarray:
    """Shares of the explained variance by Johnson's method; ``cov`` has the outcome first."""
    flat = [n for n, v in zip(names, np.diag(cov)) if v == 0]
    if flat:
        raise ValueError(f"No variance in: {', '.join(flat)}.")
    r = _correlations(cov)
    inner, outer = r[1:, 1:], r[1:, 0]
    if abs(np.linalg.det(inner)) < 100 * np.finfo(float).eps:
        raise ValueError("The predictors' correlation matrix is singular or nearly so; remove highly correlated predictors.")
    values, vectors = np.linalg.eigh(inner)
    root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
    beta = np.linalg.solve(root, outer)
    return (root**2) @ (beta**2) / (beta**2).sum() * 100


def rescaled(values) -> np.ndarray:
    v = np.maximum(np.nan_to_num(np.asarray(values, float)), 0)
    if v.sum() == 0:
        raise ValueError("No predictor carries any importance.")
    return v / v.sum() * 100


def forest_weights(df: DataFrame, outcome: str, predictors: list[str], trees: int = FOREST_TREES, seed: int = 7) -> np.ndarray:
    """Rise in held-out squared error when a predictor is shuffled, for a distributed random forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    kinds = dtypes(df)
    d = df.select(S.ensure_numeric(outcome, kinds[outcome]).alias("y"), *[S.ensure_numeric(p, kinds[p]).alias(f"x{i}") for i, p in enumerate(predictors)]).dropna()
    d = d.withColumn("__side", F.pmod(F.xxhash64(F.lit(seed), *d.columns), F.lit(3)))
    p = len(predictors)
    put = lambda t: VectorAssembler(inputCols=[f"x{i}" for i in range(p)], outputCol="x").transform(t)
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, minInstancesPerNode=FOREST_LEAF, featureSubsetStrategy=str(max(1, p // 3)), seed=seed).fit(put(d.filter("__side > 0")))
    held = d.filter("__side = 0")
    error = lambda t: model.transform(put(t)).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    base, rises = error(held), []
    buckets = max(1, held.count() // 1000)
    for i in range(p):
        # a shuffle by buckets of about a thousand random rows: each row takes its predecessor's value
        bucket = F.pmod(F.xxhash64(F.lit(i), *held.columns), F.lit(buckets))
        keyed = held.withColumn("__b", bucket).withColumn("__o", F.xxhash64(F.lit(-i - 1), *held.columns))
        w = Window.partitionBy("__b").orderBy("__o")
        last = F.last(f"x{i}").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        moved = keyed.withColumn(f"x{i}", F.coalesce(F.lag(f"x{i}").over(w), last)).drop("__b", "__o")
        rises.append(error(moved) - base)
    return np.array(rises)


def importance_table(df: DataFrame, outcome: str, predictors: list[str], method: str) -> list[tuple[str, float]]:
    if method == "forest":
        values = rescaled(forest_weights(df, outcome, predictors))
    else:
        _, _, cov = moments(df, [outcome, *predictors])
        values = relative_weights(cov, [outcome, *predictors]) if method == "rwa" else rescaled(np.abs(_correlations(cov)[0, 1:]))
    order = sorted(range(len(predictors)), key=lambda i: -values[i])  # stable
    return [(predictors[i], float(values[i])) for i in order]


@on_default
def calc_importance(df: DataFrame | None, outcome: str, predictors, method: str = "rwa", recode: bool = True, likert_levels=S.LIKERT_LEVELS) -> DataFrame:
    """``feature, importance`` in descending order; importances add up to 100."""
    df = current().resolve(df)
    method = S.match_arg(method, METHODS)
    check_column(outcome, df)
    names = select_columns(df, predictors)
    if not names:
        raise ValueError("No predictor columns selected.")
    d = _recoded(df, names, likert_levels) if recode else df
    rows = importance_table(d, outcome, names, method)
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


@on_default
def ipm_model(df: DataFrame | None, outcome: str, rating_prefix: str, method: str = "rwa", recode: bool = True, likert_levels=S.LIKERT_LEVELS) -> DataFrame:
    """``feature, importance, performance, perf_class``: importance against the mean of all ratings given."""
    df = current().resolve(df)
    method = S.match_arg(method, METHODS)
    check_column(outcome, df)
    names = select_columns(df, starts_with(rating_prefix))
    if not names:
        raise ValueError(f"No columns start with prefix '{rating_prefix}'.")
    d = _recoded(df, names, likert_levels) if recode else df
    kinds = dtypes(d)
    means = d.agg(*[F.avg(S.ensure_numeric(c, kinds[c])).alias(f"m{i}") for i, c in enumerate(names)]).first()
    by_name = {c: means[f"m{i}"] for i, c in enumerate(names)}
    rows = []
    for name, importance in importance_table(d, outcome, names, method):
        m = by_name[name]
        band = None if m is None or not 1 <= math.floor(m) <= 5 else str(math.floor(m))
        rows.append((S.clean_name(name.replace(rating_prefix, "", 1)), importance, m, band))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, performance double, perf_class string")
