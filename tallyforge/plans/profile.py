"""What columns look like: one aggregation over all of them, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators.select import column_prefix


def profile(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """For each column: filled, distinct, blanks, mean length, and its kind: numeric, constant (fewer than 2
    answers), freetext (half of the answers or more are distinct) or categorical."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = []
    for k, f in enumerate(fields):
        t = S.na_blank(f.name, dtype=f.dataType)
        aggs += [F.count(t).alias(f"f{k}"), F.count_distinct(t).alias(f"d{k}"), F.avg(F.length(t)).alias(f"l{k}")]
    r = df.agg(F.count("*").alias("rows"), *aggs).first()
    out = {}
    for k, f in enumerate(fields):
        filled, distinct = r[f"f{k}"], r[f"d{k}"]
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "constant" if distinct < 2 else "freetext" if distinct >= 0.5 * filled else "categorical"
        out[f.name] = {"kind": kind, "filled": filled, "distinct": distinct, "blank": r["rows"] - filled, "length": r[f"l{k}"] or 0.0}
    return out


def is_categorical_like(p: dict) -> bool:
    return p["kind"] != "numeric" and p["filled"] > 0 and p["length"] <= 30 and 2 <= p["distinct"] <= max(15, 0.25 * p["filled"])


def detect_multiselect(df: DataFrame, columns: list[str] | None = None, known: dict | None = None) -> dict[str, list[str]]:
    """{prefix: columns} of blocks: two or more columns with a common prefix, each with one answer and blanks."""
    names = columns or df.columns
    blocks: dict[str, list[str]] = {}
    for n in names:
        if column_prefix(n):
            blocks.setdefault(column_prefix(n), []).append(n)
    blocks = {p: m for p, m in blocks.items() if len(m) > 1}
    if not blocks:
        return {}
    p = known or profile(df, [c for m in blocks.values() for c in m])
    return {k: m for k, m in blocks.items() if all(p[c]["distinct"] == 1 and p[c]["blank"] > 0 for c in m)}


def banner_selection(df: DataFrame, max_levels: int) -> dict:
    """Groups: categorical or numeric columns of few answers; rows: those and all numbers; blocks apart."""
    p = profile(df)
    multi = detect_multiselect(df, known=p)
    members = {c for m in multi.values() for c in m}
    few = lambda c: p[c]["distinct"] <= max_levels
    singles = [c for c in df.columns if c not in members]
    rows = [c for c in singles if p[c]["kind"] == "numeric" or p[c]["kind"] == "categorical" and few(c)]
    cols = [c for c in singles if p[c]["kind"] in ("categorical", "numeric") and few(c) and p[c]["distinct"] > 1]
    return {"rows": rows, "cols": cols, "multi": multi, "skipped": [c for c in singles if c not in rows]}
