"""Cross-tabulations and the banner: every question by Overall and by each item of each group.

The banner is one pass.  A row's groups and its questions become two small arrays on the row itself; exploding
both and grouping once gives every cell of every table, with map-side sums down to the answer grid.  Wide surveys
go through in chunks of questions, so that a row is never multiplied more than `MAX_EXPLODED` times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators.select import check_column, select_columns
from tallyforge.operators.tabulate import answered, dtypes, english, few_rows, level_rank, option_arrays, pivot_wider
from tallyforge.operators.weights import WEIGHT, weighted_mean, weighted_quantiles, weighted_sd, with_weights
from tallyforge.plans.profile import banner_selection, detect_multiselect
from tallyforge.plans.progress import Progress, confirm_selection
from tallyforge.plans.state import current, on_default

CELLS = ("count", "row_pct", "col_pct", "total_pct", "value")
STATS = ("mean", "median", "sd", "p25", "p75")
MAX_EXPLODED = 2000
OVERALL = "Overall"
MAX_LEVELS = 20


@on_default
def crosstab(df: DataFrame | None, x: str, y: str, cell: str = "count", value: str | None = None, fn: Callable[[Column], Column] | None = None, wide: bool = True, digits: int | None = None, na_rm: bool = True, drop=None, weights=None) -> DataFrame:
    """``x, y, value`` or one column for each y.

    ``cell``: count, row_pct (within x), col_pct (within y), total_pct, or value: an aggregate ``fn`` (a
    function from Column to an aggregate Column; mean by default) of ``value``.
    """
    df = current().resolve(df)
    cell = S.match_arg(cell, CELLS)
    for c in (x, y):
        check_column(c, df)
    if not wide and "value" in (x, y):
        raise ValueError("A question named 'value' needs wide = True.")
    scheme = current().resolve_weights(weights)
    digits = (2 if cell == "value" else 0) if digits is None else digits
    kinds, na = dtypes(df), current().option("na_answers")
    drop = current().option("drop_answers") if drop is None else drop
    cols = {"__x": x, "__y": y}
    d = with_weights(df, scheme)
    text = {k: (S.na_blank(c, na_answers=na, dtype=kinds[c]) if na_rm else S.as_text(c, kinds[c])) for k, c in cols.items()}
    v = S.ensure_numeric(value, kinds[value]) if cell == "value" else F.lit(None).cast("double")
    d = d.select(text["__x"].alias("__x"), text["__y"].alias("__y"), v.alias("__v"), F.col(WEIGHT).alias("__w"))
    if na_rm:
        d = d.filter("__x IS NOT NULL AND __y IS NOT NULL")
    if drop:
        d = d.filter(~S.dropped("__x", drop) & ~S.dropped("__y", drop))
    if cell == "value":
        if scheme is not None:
            stat = weighted_mean("__v", "__w")
        else:
            stat = (fn or F.avg)(F.col("__v"))
            if not na_rm:
                stat = F.when(F.count("*") == F.count("__v"), stat)
        out = d.groupBy("__x", "__y").agg(stat.alias("value"))
        out = out.withColumn("value", S.r_round("value", digits))
    else:
        n = F.sum("__w") if scheme is not None else F.count("*").cast("double")
        out = d.groupBy("__x", "__y").agg(n.alias("__n"))
        within = {"row_pct": ["__x"], "col_pct": ["__y"], "total_pct": []}.get(cell)
        total = None if within is None else F.sum("__n").over(Window.partitionBy(*within))
        out = out.withColumn("value", S.r_round("__n", 0) if total is None else S.r_round(F.col("__n") / total * 100, digits)).drop("__n")
    orders = {k: current().order_for(c) for k, c in cols.items()}
    keys = []
    for k in cols:
        if orders[k]:
            keys.append(F.coalesce(level_rank(k, orders[k]), F.lit(len(orders[k]) + 1)))
        keys.append(F.col(f"`{k}`").asc_nulls_last())
    out = out.orderBy(*keys).select(F.col("__x").alias(x), F.col("__y").alias(y if y != x else f"{y}.1"), "value")
    if not wide:
        return out
    heads = out.select(out.columns[1]).distinct().orderBy(*([F.coalesce(level_rank(out.columns[1], orders["__y"]), F.lit(len(orders["__y"]) + 1))] if orders["__y"] else []), F.col(f"`{out.columns[1]}`").asc_nulls_last())
    names = [r[0] for r in few_rows(heads, f"Answers of '{y}'")]
    names = ["NA" if n is None else n for n in names]
    p = out.withColumn("__head", F.coalesce(F.col(f"`{out.columns[1]}`"), F.lit("NA"))).groupBy(x).pivot("__head", names).agg(F.first("value"))
    rank = [F.coalesce(level_rank(x, orders["__x"]), F.lit(len(orders["__x"]) + 1))] if orders["__x"] else []
    return p.orderBy(*rank, F.col(f"`{x}`").asc_nulls_last())


#: Up to so many columns, rows are first counted by their whole tuple, which few answers make small.
TUPLE_COLUMNS = 4


def _group_array(df: DataFrame, groups: Sequence[str]) -> Column:
    """Overall and each group's raw answer of a row."""
    kinds = dtypes(df)
    cells = [F.struct(F.lit(-1).alias("g"), F.lit(OVERALL).alias("group_item"))]
    cells += [F.struct(F.lit(k).alias("g"), S.as_text(c, kinds[c]).alias("group_item")) for k, c in enumerate(groups)]
    return F.array(*cells)


def _cleaned(df: DataFrame, column: str, drop, keep: Column) -> DataFrame:
    """Answers in ``column`` cleaned and dropped, but for rows of ``keep``; missing ones go."""
    if drop:
        df = df.filter(keep | ~S.dropped(column, drop))
    t = S.na_blank(column, na_answers=current().option("na_answers"))
    return df.withColumn(column, F.when(keep, F.col(column)).otherwise(t)).filter(F.col(column).isNotNull())


def _filled(cells: DataFrame) -> DataFrame:
    """The full grid of each question, absent cells 0.  A question's finished cells meet in one row: they are
    its answers by the group items, however many rows they were counted from."""
    per = cells.groupBy("q").agg(F.collect_list(F.struct("item", "g", "group_item", "value")).alias("cells"))
    items = F.array_distinct(F.transform(F.filter("cells", lambda c: c["g"] == -1), lambda c: c["item"]))
    columns = F.array_distinct(F.transform("cells", lambda c: F.struct(c["g"].alias("g"), c["group_item"].alias("group_item"))))
    known = F.map_from_entries(F.transform("cells", lambda c: F.struct(F.struct(c["item"].alias("item"), c["g"].alias("g"), c["group_item"].alias("group_item")).alias("k"), c["value"].alias("v"))))
    grid = per.select("q", known.alias("known"), items.alias("items"), columns.alias("columns")).withColumn("item", F.explode("items")).withColumn("c", F.explode("columns"))
    at = F.struct("item", F.col("c.g").alias("g"), F.col("c.group_item").alias("group_item"))
    return grid.select("q", "item", "c.g", "c.group_item", F.coalesce(F.try_element_at("known", at), F.lit(0.0)).alias("value"))


@on_default
def banner(df: DataFrame | None, rows=None, cols=None, cell: str = "auto", stats: Sequence[str] | None = None, total: bool = True, digits: int | None = None, na_rm: bool = True, drop=None, weights=None, max_levels: int = MAX_LEVELS, long: bool = True, checkpoint: str | None = None) -> DataFrame:
    """``variable, item, group, group_item, value`` for every question; absent cells of a categorical
    question are 0, and a question is never crossed with itself.

    ``checkpoint``: a folder that all executors share, where finished blocks of the table are kept; a run over the
    same rows with the same settings takes them from there.

    ``cell``: auto (numbers as statistics, the rest as column percentages), pct, count, mean, or diff (column
    percentage or statistic less Overall's, which keeps its own).  ``rows`` and ``cols`` None: chosen by profile.
    """
    df = current().resolve(df)
    cell = S.match_arg(cell, ("auto", "pct", "count", "mean", "diff"))
    stats = [S.match_arg(s, STATS) for s in (STATS if stats is None else [stats] if isinstance(stats, str) else stats)]
    scheme = current().resolve_weights(weights)
    chosen = banner_selection(df, max_levels) if rows is None or cols is None else None
    if rows is None:
        singles, multi = chosen["rows"], chosen["multi"]
    else:
        raw = select_columns(df, rows)
        multi = detect_multiselect(df, raw)
        singles = [c for c in raw if not any(c in m for m in multi.values())]
    groups = chosen["cols"] if cols is None else select_columns(df, cols)
    if not singles and not multi:
        raise ValueError("No question to tabulate.")
    if chosen and not confirm_selection([*singles, *multi], "Questions of the banner"):
        raise ValueError("The automatic selection was declined.")
    numeric = [c for c in singles if cell in ("auto", "diff", "mean") and isinstance(dtypes(df)[c], T.NumericType)]
    if cell == "mean":
        singles = numeric
    categorical = [c for c in singles if c not in numeric]
    drop = current().option("drop_answers") if drop is None else drop
    kinds, na = dtypes(df), current().option("na_answers")
    d = with_weights(df, scheme)
    at = {c: k for k, c in enumerate(df.columns)}
    garray = _group_array(df, groups)
    name_of = lambda g: F.when(g == -1, OVERALL).otherwise(F.get(F.array(*[F.lit(c) for c in groups]) if groups else F.array().cast("array<string>"), F.when(g >= 0, g)))
    pct_digits, stat_digits = (0, 2) if digits is None else (digits, digits)
    parts = []
    if checkpoint:
        from tallyforge.sources.files import Checkpoint, fingerprint

        orders = {c: current().order_for(c) for c in [*singles, *groups]}
        run = Checkpoint(df.sparkSession, checkpoint, fingerprint(df, {"rows": singles, "multi": multi, "cols": groups, "cell": cell, "stats": stats, "digits": digits, "na": [na_rm, na, drop], "weights": scheme, "orders": orders}))
        lines = Progress(-(-len(categorical) // max(1, MAX_EXPLODED // (len(groups) + 1))) + bool(numeric) + len(multi), "Blocks of the banner")

    def add(name: str, part: DataFrame) -> None:
        if checkpoint:
            part = run.load(name) if run.has(name) else run.save(name, part)
            lines.item(name)
        parts.append(part)

    chunk = max(1, MAX_EXPLODED // (len(groups) + 1))
    for lo in range(0, len(categorical), chunk):
        asked = categorical[lo : lo + chunk]
        own = list(dict.fromkeys([*asked, *groups]))
        t = d.groupBy(*own).agg(F.sum(WEIGHT).alias(WEIGHT)) if len(own) <= TUPLE_COLUMNS else d
        qarray = F.array(*[F.struct(F.lit(at[c]).alias("q"), S.as_text(c, kinds[c]).alias("item")) for c in asked])
        x = t.select(WEIGHT, garray.alias("gs"), qarray.alias("qs")).select(WEIGHT, F.explode("qs").alias("x"), "gs").select(WEIGHT, "x.*", F.explode("gs").alias("y")).select(WEIGHT, "q", "item", "y.*")
        same = [(at[c], k) for k, c in enumerate(groups) if c in asked]
        for q, k in same:
            x = x.filter(~((F.col("q") == q) & (F.col("g") == k)))
        raw = x.groupBy("q", "item", "g", "group_item").agg(F.sum(WEIGHT).alias("n"))
        raw = _cleaned(_cleaned(raw, "item", drop, F.lit(False)), "group_item", drop, F.col("g") == -1)
        n = raw.groupBy("q", "item", "g", "group_item").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy("q", "g", "group_item")
        v = S.r_round("n", 0) if cell == "count" else S.r_round(F.col("n") / F.sum("n").over(whole) * 100, pct_digits)
        full = _filled(n.withColumn("value", v))
        names = F.create_map(*[F.lit(y) for c in asked for y in (at[c], c)])
        add(f"answers {lo}", full.withColumn("variable", F.element_at(names, F.col("q"))).withColumn("group", name_of(F.col("g"))).withColumn("i", F.lit(0)))

    if numeric:
        vals = [F.struct(F.lit(at[c]).alias("q"), F.lit(c).alias("variable"), S.ensure_numeric(c, kinds[c]).alias("v")) for c in numeric]
        x = d.select(WEIGHT, garray.alias("gs"), F.array(*vals).alias("qs")).select(WEIGHT, F.explode("qs").alias("x"), "gs").select(WEIGHT, "x.*", F.explode("gs").alias("y")).select(WEIGHT, "q", "variable", "v", "y.*").withColumn("group", name_of(F.col("g"))).filter("variable <> group")
        x = _cleaned(x, "group_item", drop, F.col("g") == -1)
        keys = ["q", "variable", "g", "group", "group_item"]
        if scheme is None:
            p = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            s = x.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), p.alias("__p"))
            s = s.select(*keys, "mean", F.get("__p", F.lit(1)).alias("median"), "sd", F.get("__p", F.lit(0)).alias("p25"), F.get("__p", F.lit(2)).alias("p75"))
        else:
            s = x.groupBy(*keys).agg(weighted_mean("v", WEIGHT).alias("mean"))
            s = s.join(weighted_quantiles(x, "v", WEIGHT, keys, {"p25": 0.25, "median": 0.5, "p75": 0.75}), keys, "left").join(weighted_sd(x, "v", WEIGHT, keys).toDF(*keys, "sd"), keys, "left")
        rows_ = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(name).alias("item"), S.r_round(name, stat_digits).alias("value")) for k, name in enumerate(stats)])
        add("numbers", s.select(*keys, F.explode(rows_).alias("z")).select(*keys, "z.*"))

    for prefix, members in multi.items():
        options = option_arrays(df, prefix, True, None)
        if drop:
            options = F.filter(options, lambda o: ~S.dropped(o, drop))
        x = d.select(garray.alias("gs"), options.alias("os")).filter(F.size("os") > 0).select("os", F.explode("gs").alias("y")).select("os", "y.*").withColumn("group", name_of(F.col("g")))
        x = _cleaned(x, "group_item", drop, F.col("g") == -1)
        base = x.groupBy("g", "group", "group_item").agg(F.count("*").alias("base"))
        n = x.select("g", "group", "group_item", F.explode("os").alias("item")).groupBy("g", "group", "group_item", "item").agg(F.count("*").alias("n"))
        grid = n.select("item").distinct().join(base.withColumn("__one", F.lit(1)), F.lit(True))
        m = grid.join(n, ["g", "group", "group_item", "item"], "left")
        v = F.coalesce(S.r_round("n", 0) if cell == "count" else S.r_round(F.col("n") / F.col("base") * 100, pct_digits), F.lit(0.0))
        q = min(at[c] for c in members)
        add(f"options {prefix}", m.select(F.lit(q).alias("q"), F.lit(prefix.rstrip("_")).alias("variable"), "item", "g", "group", "group_item", v.alias("value"), F.lit(0).alias("i")))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if cell == "diff":
        overall = F.max(F.when(F.col("g") == -1, F.col("value"))).over(Window.partitionBy("q", "variable", "item"))
        out = out.withColumn("value", F.when(F.col("g") == -1, F.col("value")).otherwise(F.col("value") - overall))
    if not total:
        out = out.filter("g >= 0")
    rank = F.col("i") * 0
    for c in {*categorical, *groups}:
        known = current().order_for(c)
        if known:
            rank = F.when(F.col("variable") == c, F.coalesce(level_rank("item", known), F.lit(len(known) + 1))).otherwise(rank)
    out = out.orderBy("q", "i", rank, "item", "g", "group_item")
    if long:
        return out.select("variable", "item", "group", "group_item", "value")
    return banner_wide(out)


def banner_wide(cells: DataFrame) -> DataFrame:
    """One row for each (variable, item), one column for each group item, Overall first.  Which columns belong
    to which group is in each field's metadata (``group``)."""
    heads = few_rows(cells.select("g", "group", "group_item").distinct().orderBy("g", "group_item"), "Groups of the banner")
    names = S.make_unique([h["group_item"] for h in heads], sep=" ")
    key = F.concat_ws("\0", F.col("g").cast("string"), "group_item")
    p = cells.withColumn("__h", key).groupBy("q", "variable", "i", "item").pivot("__h", [f"{h['g']}\0{h['group_item']}" for h in heads]).agg(F.first("value"))
    cols = [F.col(f"`{h['g']}\0{h['group_item']}`").alias(n, metadata={"group": h["group"]}) for h, n in zip(heads, names)]
    return p.orderBy("q", "i", "item").select("variable", "item", *cols)
