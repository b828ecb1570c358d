"""How precise survey estimates are."""

from __future__ import annotations

import math
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators.select import select_columns
from tallyforge.operators.tabulate import dtypes
from tallyforge.plans.profile import is_categorical_like, profile
from tallyforge.plans.state import current, on_default

TYPES = ("auto", "mean", "prop")


@on_default
def diagnose(df: DataFrame | None, *columns, type: str = "auto", by=None, z: float = S.Z_95, digits: int = 2) -> DataFrame:
    """``by, variable, type, unit, n, estimate, se, rse, moe, precision``: means of numbers in points, the
    largest answer's share of the rest in percentage points.  One aggregation for all means, one for all shares."""
    df = current().resolve(df)
    type = S.match_arg(type, TYPES)
    names = select_columns(df, *columns)
    if not names:
        raise ValueError("Select at least one column to diagnose.")
    by = select_columns(df, by) if by is not None else []
    kinds = dtypes(df)
    as_mean = [c for c in names if type == "mean" or type == "auto" and isinstance(kinds[c], T.NumericType)]
    parts = []
    if as_mean:
        vals = [F.struct(F.lit(names.index(c)).alias("k"), F.lit(c).alias("variable"), S.ensure_numeric(c, kinds[c]).alias("v")) for c in as_mean]
        x = df.select(*by, F.explode(F.array(*vals)).alias("x")).select(*by, "x.*")
        m = x.groupBy(*by, "k", "variable").agg(F.count("v").alias("n"), F.avg("v").alias("estimate"), S.se_mean("v").alias("se"))
        parts.append(m.withColumn("type", F.lit("mean")).withColumn("unit", F.lit("points")))
    shares = [c for c in names if c not in as_mean]
    if shares:
        vals = [F.struct(F.lit(names.index(c)).alias("k"), F.lit(c).alias("variable"), S.na_blank(c, dtype=kinds[c]).alias("v")) for c in shares]
        x = df.select(*by, F.explode(F.array(*vals)).alias("x")).select(*by, "x.*")
        c = x.groupBy(*by, "k", "variable", "v").agg(F.count("v").alias("n"))  # a missing answer counts 0
        m = c.groupBy(*by, "k", "variable").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
        p = F.try_divide(F.col("top").cast("double"), F.col("n"))
        m = m.withColumn("estimate", 100 * p).withColumn("se", F.when(F.col("n") > 0, 100 * S.se_prop(p, F.col("n").cast("double")))).drop("top")
        parts.append(m.withColumn("type", F.lit("prop")).withColumn("unit", F.lit("ppt")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ratio = S.rse(F.col("estimate"), F.col("se"))
    ratio = F.when(~F.isnan(ratio), ratio)
    out = out.withColumn("rse", ratio).withColumn("moe", S.margin_of_error(F.col("se"), z)).withColumn("precision", S.rse_rating(F.col("rse")))
    for c in ("estimate", "se", "rse", "moe"):
        out = out.withColumn(c, S.r_round(c, digits))
    order = [F.col(f"`{b}`").asc_nulls_last() for b in by]
    return out.orderBy(*order, "k").select(*by, "variable", "type", "unit", "n", "estimate", "se", "rse", "moe", "precision")


@on_default
def precision_summary(df: DataFrame | None, *columns, z: float = S.Z_95) -> dict:
    """The table of ``diagnose`` for all suitable columns, its medians, a verdict, and these in sentences."""
    df = current().resolve(df)
    p = profile(df, select_columns(df, *columns) or None)
    names = [c for c in df.columns if c in p and (p[c]["kind"] == "numeric" or is_categorical_like(p[c]))]
    if not names:
        raise ValueError("No numeric or categorical variables found to assess.")
    table = [r.asDict() for r in diagnose(df, names, z=z).collect()]
    n = df.count()
    have = lambda k, t=None: [r[k] for r in table if r[k] is not None and (t is None or r["type"] == t)]
    overall = median(have("rse")) if have("rse") else math.nan
    rating = next((label for limit, label in S.PRECISION_BANDS if overall < limit), S.WORST_PRECISION)
    level = round(100 * math.erf(z / math.sqrt(2)))
    bullets = [f"Based on {n:,} total responses (per-question base of {min(have('n')):,} to {max(have('n')):,})."]
    if have("moe", "mean"):
        m = have("moe", "mean")
        bullets.append(f"Point ratings carry a sampling margin of about +/-{median(m):.2f} points (up to +/-{max(m):.2f}) at {level}% confidence.")
    if have("moe", "prop"):
        base = median(have("n", "prop"))
        worst = z * math.sqrt(0.25 / base) * 100 if base else math.inf
        bullets.append(f"Percentages carry a sampling margin of about +/-{median(have('moe', 'prop')):.1f} percentage points (worst case +/-{worst:.1f} at a 50/50 split).")
    bullets.append(f"Overall relative standard error of about {overall:.1f}% -- {rating}.")
    return {"n": n, "table": table, "overall_rse": overall, "rating": rating, "bullets": bullets}
