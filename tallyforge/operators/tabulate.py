"""Percentage tables and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators.select import check_column, select_columns
from tallyforge.operators.weights import WEIGHT, weighted_mean, weighted_quantiles, weighted_sd, with_weights
from tallyforge.plans.state import current, levels_of, on_default

SORTS = ("none", "asc", "desc")


def dtypes(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def english(c: Column | str) -> Column:
    """The order of an English dictionary."""
    return F.collate(S.col(c).cast("string"), "UNICODE").asc_nulls_last()


def level_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """Position among ``levels`` from 1; missing if not one of them."""
    at = F.array_position(F.array(*[F.lit(x) for x in levels]), S.col(c).cast("string"))
    return F.when(at > 0, at)


def grouping(df: DataFrame, by) -> list[str]:
    """``by``, else the option's columns that the table has."""
    if by is None:
        by = current().option("default_by")
        return [b for b in ([by] if isinstance(by, str) else by or []) if b in df.columns]
    return select_columns(df, by)


def answered(df: DataFrame, column: str, drop, na_rm: bool) -> DataFrame:
    """Rows that count: dropped answers gone, then (with ``na_rm``) missing ones, the rest as text."""
    kinds = dtypes(df)
    drop = current().option("drop_answers") if drop is None else drop
    if drop:
        df = df.filter(~S.dropped(column, drop, kinds[column]))
    if na_rm:
        df = df.withColumn(column, S.na_blank(column, na_answers=current().option("na_answers"), dtype=kinds[column])).filter(F.col(f"`{column}`").isNotNull())
    return df


def _shares(counts: DataFrame, within: list[str], digits: int, weighted: bool) -> DataFrame:
    w = Window.partitionBy(*within)
    counts = counts.withColumn("pct", S.r_round(F.col("n") / F.sum("n").over(w) * 100, digits))
    if weighted:
        counts = counts.withColumn("wpct", S.r_round(F.try_divide(F.col("__w"), F.sum("__w").over(w)) * 100, digits))
    return counts.drop("__w")


@on_default
def calc_percentage(df: DataFrame | None, column: str, by=None, sort: str = "none", levels: Sequence[str] | None = None, digits: int = 0, wide: bool = False, na_rm: bool = True, drop=None, weights=None) -> DataFrame:
    """``by, column, n, pct`` (and ``wpct``): how often each answer occurs within each group.

    Order: explicit ``levels`` (an answer that isn't one loses its label), else ``sort`` over the whole table,
    else a registered order, else the one that the column carries, else the answers' own.  ``wide`` has one column for each answer.
    """
    df = current().resolve(df)
    check_column(column, df)
    carried = levels_of(df, column)
    sort = S.match_arg(sort, SORTS)
    scheme = current().resolve_weights(weights)
    by = grouping(df, by)
    # raw answers are counted first, so that only distinct ones are cleaned
    raw = with_weights(df, scheme).groupBy(*by, column).agg(F.count("*").alias("__n"), F.sum(WEIGHT).alias("__raw"))
    counts = answered(raw, column, drop, na_rm).groupBy(*by, column).agg(F.sum("__n").alias("n"), *([F.sum("__raw").alias("__w")] if scheme else []))
    out = _shares(counts, by, digits, scheme is not None).select(*by, column, "n", "pct", *(["wpct"] if scheme else []))
    prior = [F.col(f"`{c}`").asc_nulls_last() for c in [*by, column]]
    if levels is None and sort == "none":
        known = current().order_for(column) or carried
        if known:
            rank = F.coalesce(level_rank(column, known), F.lit(len(known) + 1))
            out = out.orderBy(*prior[:-1], rank, prior[-1])
        else:
            out = out.orderBy(*prior)
    elif levels is not None:
        rank = level_rank(column, levels)
        out = out.withColumn("__rank", rank).orderBy(*[english(b) for b in by], F.col("__rank").asc_nulls_last(), prior[-1])
        out = out.withColumn(column, F.when(F.col("__rank").isNotNull(), F.col(f"`{column}`").cast("string"))).drop("__rank")
    else:
        out = out.orderBy(F.col("pct").desc_nulls_last() if sort == "desc" else F.col("pct").asc_nulls_last(), *prior)
    return pivot_wider(out, by, column, "wpct" if scheme else "pct") if wide else out


#: Columns that a wide table may have: their names come to the driver.
MOST_WIDE = 5000


def few_rows(df: DataFrame, what: str, most: int = MOST_WIDE) -> list:
    """All rows of a table that has to be small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most}; ask for the long form.")
    return rows


def pivot_wider(df: DataFrame, ids: list[str], names_from: str, values_from: str) -> DataFrame:
    """One column for each name in order of appearance, `MOST_WIDE` at most; a missing name is ``NA``."""
    text = F.coalesce(F.col(f"`{names_from}`").cast("string"), F.lit("NA"))
    at = df.select(text.alias("name"), F.monotonically_increasing_id().alias("at")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at")
    names = [r["name"] for r in few_rows(at, f"Answers of '{names_from}'")]
    d = df.withColumn(names_from, F.coalesce(F.col(f"`{names_from}`").cast("string"), F.lit("NA")))
    out = d.groupBy(*ids).pivot(names_from, names).agg(F.last(values_from))
    return out.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in ids]) if ids else out


@on_default
def calc_percentage_batch(df: DataFrame | None, *columns, by=None, sort: str = "none", digits: int = 0, na_rm: bool = True, drop=None, weights=None, clean_names: bool = False, prefix: str | None = None) -> DataFrame:
    """``variable, by, answer, n, pct`` for many columns at once: one scan and one aggregation, whatever their
    number.  A ``prefix`` is taken off the names, and cleans them as ``clean_names`` does."""
    df = current().resolve(df)
    names = select_columns(df, *columns)
    if not names:
        raise ValueError("Select at least one column.")
    scheme = current().resolve_weights(weights)
    by = grouping(df, by)
    kinds = dtypes(df)
    drop = current().option("drop_answers") if drop is None else drop
    cells = [F.struct(F.lit(k).alias("k"), S.as_text(c, kinds[c]).alias("answer")) for k, c in enumerate(names)]
    long = with_weights(df, scheme).select(*by, WEIGHT, F.explode(F.array(*cells)).alias("x")).select(*by, WEIGHT, "x.*")
    raw = long.groupBy("k", *by, "answer").agg(F.count("*").alias("n"), F.sum(WEIGHT).alias("__w"))
    if drop:
        raw = raw.filter(~S.dropped("answer", drop))
    if na_rm:
        raw = raw.withColumn("answer", S.na_blank("answer", na_answers=current().option("na_answers"))).filter("answer IS NOT NULL")
    labels = F.array(*[F.lit(S.clean_name(c, prefix) if clean_names or prefix is not None else c) for c in names])
    counts = raw.groupBy("k", *by, "answer").agg(F.sum("n").alias("n"), F.sum("__w").alias("__w")).withColumn("variable", F.get(labels, F.col("k")))
    out = _shares(counts, ["k", *by], digits, scheme is not None)
    prior = [F.col(c).asc_nulls_last() for c in [*by, "answer"]]
    first = [] if sort == "none" else [F.col("pct").desc_nulls_last() if sort == "desc" else F.col("pct").asc_nulls_last()]
    return out.orderBy("k", *first, *prior).select("variable", *by, "answer", "n", "pct", *(["wpct"] if scheme else []))


def block_columns(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


#: Between the answers of one cell, in the order in which they are looked for (fixed values).
DELIMITERS = (";", "|", ",")


def detect_delimiter(df: DataFrame, column: str) -> str | None:
    """The first of the known delimiters that any answer holds; one aggregation."""
    r = df.agg(*[F.bool_or(F.col(f"`{column}`").cast("string").contains(d)).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]).first()
    return next((d for i, d in enumerate(DELIMITERS) if r[i]), None)


def packed_answers(column: str, delimiter: str | None) -> Column:
    """The answers of a packed cell, without blanks and repeats; without a delimiter a cell is one answer."""
    cell = S.col(column).cast("string")
    parts = F.split(cell, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1) if delimiter else F.array(cell)
    return F.coalesce(F.array_distinct(F.filter(F.transform(parts, S.squish), lambda x: x != "")), F.array().cast("array<string>"))


def option_arrays(df: DataFrame, prefix: str, clean_names: bool = True, split: str | None = "auto") -> Column:
    """Each row's chosen options: of a block of columns with the prefix, or of one packed column."""
    names = block_columns(df, prefix)
    if not names:
        raise ValueError(f"No columns start with prefix '{prefix}'.")
    if len(names) == 1 and split is not None:
        delimiter = detect_delimiter(df, names[0]) if split == "auto" else split
        if delimiter:
            return packed_answers(names[0], delimiter)
    kinds = dtypes(df)
    at = lambda c: c.lower().find(prefix.lower())
    label = lambda c: S.clean_name(c[: at(c)] + c[at(c) + len(prefix) :]) if clean_names else c[: at(c)] + c[at(c) + len(prefix) :]
    cells = [F.when(S.na_blank(c, dtype=kinds[c]).isNotNull(), F.lit(label(c))) for c in names]
    return F.array_distinct(F.array_compact(F.array(*cells)))


@on_default
def calc_percentage_multi(df: DataFrame | None, prefix: str, id: str | None = None, by=None, sort: str = "none", digits: int = 0, drop=None, clean_names: bool = True, split: str | None = "auto") -> DataFrame:
    """``by, option, n, pct`` of a check-all question: distinct respondents of each option, as a share of the
    respondents with at least one surviving option.  Without ``id`` a row is a respondent and nothing needs a
    distinct count; all missing ids are one respondent."""
    df = current().resolve(df)
    by = grouping(df, by)
    drop = current().option("drop_answers") if drop is None else drop
    options = option_arrays(df, prefix, clean_names, split)
    if drop:
        options = F.filter(options, lambda x: ~S.dropped(x, drop))
    who = [] if id is None else [F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("\0")).alias("__id")]
    d = df.select(*by, *who, options.alias("__options")).filter(F.size("__options") > 0)
    if id is None:
        base = d.groupBy(*by).agg(F.count("*").alias("__base"))
        n = d.select(*by, F.explode("__options").alias("option")).groupBy(*by, "option").agg(F.count("*").alias("n"))
    else:
        # one row for each respondent and option, then plain counts
        base = d.select(*by, "__id").distinct().groupBy(*by).agg(F.count("*").alias("__base"))
        n = d.select(*by, "__id", F.explode("__options").alias("option")).distinct().groupBy(*by, "option").agg(F.count("*").alias("n"))
    b = base.select(*[F.col(x).alias(f"__b{i}") for i, x in enumerate(by)], "__base")
    on = [n[x].eqNullSafe(b[f"__b{i}"]) for i, x in enumerate(by)]
    out = (n.join(b, on) if by else n.crossJoin(b)).withColumn("pct", S.r_round(F.col("n") / F.col("__base") * 100, digits)).select(*by, "option", "n", "pct")
    prior = [F.col(c).asc_nulls_last() for c in [*by, "option"]]
    return out.orderBy(*prior) if sort == "none" else out.orderBy(F.col("pct").desc() if sort == "desc" else F.col("pct").asc(), *prior)


@on_default
def split_multi(df: DataFrame | None, column: str, split: str = "auto", prefix: str | None = None) -> DataFrame:
    """One text column for each answer of a packed column (the answer, or ''), most chosen first."""
    df = current().resolve(df)
    check_column(column, df)
    delimiter = detect_delimiter(df, column) if split == "auto" else split
    answers = packed_answers(column, delimiter)
    counts = df.select(F.explode(answers).alias("a")).groupBy("a").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), english("a"))
    names = [r["a"] for r in few_rows(counts, f"Answers in '{column}'")]
    if not names:
        raise ValueError(f"'{column}' holds no answers.")
    head = f"{column}_" if prefix is None else prefix
    return df.withColumns({f"{head}{a}": F.when(F.array_contains(answers, a), F.lit(a)).otherwise("") for a in names})


@on_default
def calc_summary(df: DataFrame | None, column: str, by=None, na_rm: bool = True, weights=None) -> DataFrame:
    """``by, n, mean, median, sd``; missing values never count under weights, and without ``na_rm`` one
    missing value makes a group's statistics missing."""
    df = current().resolve(df)
    check_column(column, df)
    by = select_columns(df, by) if by is not None else []
    scheme = current().resolve_weights(weights)
    d = with_weights(df, scheme).select(*by, WEIGHT, S.ensure_numeric(column, dtypes(df)[column]).alias("__v"))
    order = [F.col(f"`{c}`").asc_nulls_last() for c in by]
    if scheme is None:
        whole = F.lit(True) if na_rm else F.count("*") == F.count("__v")
        stats = {"mean": F.avg("__v"), "median": F.median("__v"), "sd": F.stddev_samp("__v")}
        out = d.groupBy(*by).agg(F.count("__v").alias("n"), *[F.when(whole, e).alias(k) for k, e in stats.items()])
        return out.orderBy(*order) if by else out
    base = d.groupBy(*by).agg(F.count("__v").alias("n"), weighted_mean("__v", WEIGHT).alias("mean"))
    for extra in (weighted_quantiles(d, "__v", WEIGHT, by, {"median": 0.5}), weighted_sd(d, "__v", WEIGHT, by)):
        names = {b: f"__k{i}" for i, b in enumerate(by)}
        extra = extra.select(*[F.col(b).alias(k) for b, k in names.items()], *[c for c in extra.columns if c not in by])
        base = base.join(extra, [F.col(b).eqNullSafe(F.col(k)) for b, k in names.items()], "left").drop(*names.values()) if by else base.crossJoin(extra)
    out = base.select(*by, "n", "mean", "median", "sd")
    return out.orderBy(*order) if by else out
