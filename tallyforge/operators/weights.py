"""Post-stratification and raking, and statistics under weights.

Raking needs no rows: it runs on the cells of the weighting variables (their number of categories bounds
them), which one aggregation counts.  The cell weights are joined back to the rows.
"""

from __future__ import annotations

import json
import math
import weakref

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

#: Cells that raking takes: one row each comes to the driver.
MAX_CELLS = 100_000
#: Tables whose cells are remembered, for as long as the tables live.
_REMEMBERED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
MAX_SWEEPS = 50
TOLERANCE = 1e-6
WEIGHT = "__weight"


def parse_scheme(*specs, **named) -> dict[str, dict[str, float]]:
    """``{variable: {category: share}}`` from mappings, (variable, targets) pairs, or keywords; shares of a
    variable are divided by their sum."""
    out: dict[str, dict] = {}
    for s in specs:
        if isinstance(s, tuple) and len(s) == 2:
            out[s[0]] = s[1]
        elif isinstance(s, dict) and set(s) == {"variable", "targets"}:
            out[s["variable"]] = s["targets"]
        elif isinstance(s, dict):
            out |= s
        elif isinstance(s, (list, tuple)):
            out |= parse_scheme(*s)
        else:
            raise ValueError("Weights are given as {variable: {category: share}}.")
    out |= named
    if not out:
        raise ValueError("No weighting variable is given.")
    return {v: _shares(v, t) for v, t in out.items()}


def _shares(variable: str, targets: dict) -> dict[str, float]:
    values = {str(k): float(x) for k, x in targets.items()}
    if any(math.isnan(x) or x < 0 for x in values.values()):
        raise ValueError(f"Targets of '{variable}' must be numbers of at least 0.")
    total = sum(values.values())
    if total == 0:
        raise ValueError(f"Targets of '{variable}' add up to 0.")
    return {k: x / total for k, x in values.items()}


def cell_weights(df: DataFrame, scheme: dict, max_sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(cells, counts, weights): the categories of each cell, how many rows it has, and their weight.  They are
    remembered for each table and scheme."""
    gone = [v for v in scheme if v not in df.columns]
    if gone:
        raise ValueError(f"Weighting variable '{gone[0]}' is not a column.")
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [S.na_blank(v, dtype=types[v]).alias(f"c{i}") for i, v in enumerate(scheme)]
    known = _REMEMBERED.setdefault(df, {})
    key = json.dumps([scheme, max_sweeps, tolerance])
    if key in known:
        return known[key]
    rows = df.select(*texts).groupBy(*[f"c{i}" for i in range(len(scheme))]).agg(F.count("*").alias("n")).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"The weighting variables make more than {MAX_CELLS} cells.")
    rows.sort(key=lambda r: [(x is None, x or "") for x in r[:-1]])
    cells, n = [tuple(r[:-1]) for r in rows], np.array([r["n"] for r in rows], float)
    w = np.ones(len(cells))
    for _ in range(max_sweeps):
        worst = 0.0
        for i, targets in enumerate(scheme.values()):
            at = np.array([c[i] is not None for c in cells], bool)
            base = float((w * n)[at].sum())
            for category, share in targets.items():
                own = np.array([c[i] == category for c in cells], bool)
                now = float((w * n)[own].sum())
                if now > 0:
                    ratio = share * base / now
                    w[own] *= ratio
                    worst = max(worst, abs(math.log(ratio))) if ratio > 0 else math.inf
        if worst < tolerance:
            break
    mean = float((w * n).sum() / n.sum()) if n.sum() else 1.0
    known[key] = cells, n, w / mean if mean else w
    return known[key]


def clear_weights_cache() -> None:
    _REMEMBERED.clear()


def weight_vector(df: DataFrame, scheme: dict, into: str = "weight") -> DataFrame:
    """``df`` with a weight for each row, 1 on average."""
    cells, _, w = cell_weights(df, scheme)
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [f"__cell{i}" for i in range(len(scheme))]
    table = df.sparkSession.createDataFrame([(*c, float(x)) for c, x in zip(cells, w)] or [(*[None] * len(names), 1.0)], ", ".join([*(f"{x} string" for x in names), f"`{into}` double"]))
    keyed = df.withColumns({f"__own{i}": S.na_blank(v, dtype=types[v]) for i, v in enumerate(scheme)})
    on = [F.col(f"__own{i}").eqNullSafe(F.col(x)) for i, x in enumerate(names)]
    return keyed.join(table, on, "left").drop(*names, *[f"__own{i}" for i in range(len(scheme))])


def weight_diagnostics(df: DataFrame, scheme: dict) -> dict[str, float]:
    """Design effect after Kish and the effective number of rows."""
    _, n, w = cell_weights(df, scheme)
    total = n.sum()
    mean, square = (w * n).sum() / total, (w * w * n).sum() / total
    deff = float(square / mean**2)
    return {"deff": deff, "n_eff": float(total / deff)}


def with_weights(df: DataFrame, scheme: dict | None) -> DataFrame:
    """``df`` with the column `WEIGHT`: 1 without a scheme."""
    return df.withColumn(WEIGHT, F.lit(1.0)) if scheme is None else weight_vector(df, scheme, WEIGHT)


def weighted_mean(x, w):
    """Aggregate over rows whose value is not missing."""
    x, w = S.col(x), S.col(w)
    return F.try_divide(F.sum(F.when(x.isNotNull(), x * w)), F.sum(F.when(x.isNotNull(), w)))


def weighted_quantiles(df: DataFrame, value: str, weight: str, by: list[str], probs: dict[str, float]) -> DataFrame:
    """The lowest value whose share of the weight up to it reaches p, for each p.  Equal values are added up
    first, so a window holds one row for each distinct value of a group."""
    d = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    whole = Window.partitionBy(*by)
    run = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__share", F.sum("__w").over(run) / F.sum("__w").over(whole))
    return d.groupBy(*by).agg(*[F.min(F.when(F.col("__share") >= p, F.col(value))).alias(k) for k, p in probs.items()])


def weighted_sd(df: DataFrame, value: str, weight: str, by: list[str], out: str = "sd") -> DataFrame:
    """Root of the weighted squares around the weighted mean over (sum of weights - 1); two passes."""
    d = df.filter(F.col(value).isNotNull())
    mean = d.groupBy(*by).agg(weighted_mean(value, weight).alias("__m"))
    keys = {b: f"__mean{i}" for i, b in enumerate(by)}
    mean = mean.select(*[F.col(f"`{b}`").alias(k) for b, k in keys.items()], "__m")
    on = [F.col(f"`{b}`").eqNullSafe(F.col(k)) for b, k in keys.items()]
    j = d.join(mean, on, "inner") if by else d.crossJoin(mean)
    ss = F.sum(F.col(weight) * F.pow(F.col(value) - F.col("__m"), 2))
    return j.groupBy(*by).agg(F.when(F.count("*") > 1, F.sqrt(F.try_divide(ss, F.sum(weight) - 1))).alias(out))
