"""One query for each operator over the driver's tables, with the same in SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import facts
from tallyforge.functions import scalars as S
from tallyforge.operators import comments, crosstab, lookups, model, precision, select, tabulate, weights
from tallyforge.plans import charts, profile, state
from tallyforge.session import shared_folder
from tallyforge.sources import files
from tallyforge.streaming import windows

#: Target shares of the weighted queries.
STATUS = {"l_linestatus": {"F": 0.6, "O": 0.4}}
TWO = {"l_linestatus": {"F": 0.6, "O": 0.4}, "l_returnflag": {"A": 0.3, "N": 0.5, "R": 0.2}}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, columns: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(f"`{c}`", digits) for c, t in df.dtypes if t == "double" and (not columns or c in columns)})


# Percentages --------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0) AS pct FROM events GROUP BY 1")
def pct_event_type(spark, sf):
    return tabulate.calc_percentage(table(spark, sf, "events"), "event_type")


@query("SELECT user_id % 5 AS bucket, event_type, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id % 5) * 100, 0) AS pct FROM events GROUP BY 1, 2")
def pct_by_user_bucket(spark, sf):
    return tabulate.calc_percentage(table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 5), "event_type", by="bucket")


@query("SELECT o_orderpriority, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0) AS pct FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def pct_priority_drop(spark, sf):
    return tabulate.calc_percentage(table(spark, sf, "orders"), "o_orderpriority", drop=" 5-low ", sort="desc")


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN o_orderpriority END AS o_orderpriority, n, pct FROM (SELECT o_orderpriority, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0) AS pct FROM orders GROUP BY 1)")
def pct_priority_levels(spark, sf):
    return tabulate.calc_percentage(table(spark, sf, "orders"), "o_orderpriority", levels=["3-MEDIUM", "1-URGENT"])


@query("SELECT o_orderpriority, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1) AS pct FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '1-URGENT') GROUP BY 1")
def pct_carried_levels(spark, sf):
    return tabulate.calc_percentage(state.with_levels(table(spark, sf, "orders"), "o_orderpriority", ["3-MEDIUM", "1-URGENT"]), "o_orderpriority", digits=1)


_PCT_SEGMENT = "SELECT c_nationkey, c_mktsegment, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY c_nationkey) * 100, 0) AS pct FROM customer GROUP BY 1, 2"


@query(f"SELECT c_nationkey, {', '.join(f'''max(CASE WHEN c_mktsegment = '{s}' THEN pct END) AS \"{s}\"''' for s in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM ({_PCT_SEGMENT}) GROUP BY 1")
def pct_wide_segment(spark, sf):
    return tabulate.calc_percentage(table(spark, sf, "customer"), "c_mktsegment", by="c_nationkey", wide=True)


_BATCH = "SELECT '{0}' AS variable, {0} AS answer, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0) AS pct FROM lineitem GROUP BY 2"


@query(f"{_BATCH.format('l_returnflag')} UNION ALL {_BATCH.format('l_linestatus')}")
def batch_lineitem_flags(spark, sf):
    return tabulate.calc_percentage_batch(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


_OPTIONS = "WITH o AS (SELECT DISTINCT l_orderkey, l_returnflag AS option FROM lineitem) SELECT option, count(*) AS n, round_even(count(*)::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem) * 100, 0) AS pct FROM o GROUP BY 1"


def _block(spark, sf):
    chosen = lambda f: F.max(F.when(F.col("l_returnflag") == f, f)).alias(f"flag_{f}")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[chosen(f) for f in "ANR"])


def _packed(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "; ").alias("flags"))


@query(_OPTIONS)
def multi_block_flags(spark, sf):
    return tabulate.calc_percentage_multi(_block(spark, sf), "flag_", id="l_orderkey")


@query(_OPTIONS)
def multi_block_rows(spark, sf):
    return tabulate.calc_percentage_multi(_block(spark, sf), "flag_")


@query(_OPTIONS)
def multi_packed_flags(spark, sf):
    return tabulate.calc_percentage_multi(_packed(spark, sf), "flags", id="l_orderkey")


@query(_OPTIONS)
def multi_pipe(spark, sf):
    return tabulate.calc_percentage_multi(_packed(spark, sf).withColumn("flags", F.replace("flags", F.lit("; "), F.lit(" |"))), "flags", id="l_orderkey")


@query(_OPTIONS)
def multi_comma(spark, sf):
    mixed = F.when(F.col("l_orderkey") % 2 == 0, F.replace("flags", F.lit("; "), F.lit(","))).otherwise(F.replace("flags", F.lit("; "), F.lit(", ")))
    return tabulate.calc_percentage_multi(_packed(spark, sf).withColumn("flags", mixed), "flags")


@query("SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN 'A' ELSE '' END) AS flags_A, max(CASE WHEN l_returnflag = 'N' THEN 'N' ELSE '' END) AS flags_N, max(CASE WHEN l_returnflag = 'R' THEN 'R' ELSE '' END) AS flags_R FROM lineitem GROUP BY 1")
def split_multi_flags(spark, sf):
    return tabulate.split_multi(_packed(spark, sf), "flags").drop("flags")


# Summaries ----------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1")
def summary_quantity_by_flag(spark, sf):
    return rounded(tabulate.calc_summary(table(spark, sf, "lineitem"), "l_quantity", by="l_returnflag"))


_NPS = "SELECT {by} AS p_type, count(*) AS n, round_even(sum(g)::DOUBLE / count(*) * 100, 0) AS nps, {shares} FROM (SELECT p_type, CASE WHEN s <= 6 THEN -1 WHEN s <= 8 THEN 0 ELSE 1 END AS g FROM (SELECT p_type, p_size % 11 AS s FROM part)) GROUP BY 1"
_SHARES = ", ".join(f"round_even(count(*) FILTER (g = {g})::DOUBLE / count(*) * 100, 0) AS pct_{n}, count(*) FILTER (g = {g}) AS n_{n}" for n, g in (("promoters", 1), ("passives", 0), ("detractors", -1)))


@query(_NPS.format(by="p_type", shares=_SHARES))
def nps_by_type(spark, sf):
    return model.calc_nps(table(spark, sf, "part").withColumn("score", F.col("p_size") % 11), "score", by="p_type")


@query("SELECT s.score, CASE WHEN score <= 6 THEN 'Detractor' WHEN score <= 8 THEN 'Passive' ELSE 'Promoter' END AS \"group\", coalesce(n, 0) AS n, round_even(coalesce(n, 0)::DOUBLE / (SELECT count(*) FROM part) * 100, 0) AS pct FROM (SELECT unnest(range(11))::INTEGER AS score) s LEFT JOIN (SELECT p_size % 11 AS score, count(*) AS n FROM part GROUP BY 1) USING (score)")
def nps_scores(spark, sf):
    return model.nps_distribution(table(spark, sf, "part").withColumn("score", F.col("p_size") % 11), "score")


# Scalars ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' WHEN p_size <= 50 THEN 'large' END AS band FROM part")
def bins_part_size(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", S.bin_numeric("p_size", [0, 10, 30, 50], ["small", "medium", "large"]).alias("band"))


@query("SELECT p_partkey, CASE WHEN p_size < 18 THEN '17 or younger' WHEN p_size < 22 THEN '18 to 21' WHEN p_size < 26 THEN '22 to 25' WHEN p_size < 30 THEN '26 to 29' WHEN p_size < 35 THEN '30 to 34' ELSE '35+' END AS age, CASE WHEN 2026 - p_size >= 2013 THEN 'Gen Alpha' WHEN 2026 - p_size >= 1997 THEN 'Gen Z' WHEN 2026 - p_size >= 1981 THEN 'Millennial' WHEN 2026 - p_size >= 1965 THEN 'Gen X' END AS cohort FROM part")
def age_and_generation(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.recode_age("p_size").alias("age"), S.recode_generation("p_size", year=2026).alias("cohort"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%NOT SPECIFIED' THEN 2 WHEN o_orderpriority LIKE '%LOW' THEN 1 WHEN o_orderpriority LIKE '%MEDIUM' THEN 3 WHEN o_orderpriority LIKE '%HIGH' THEN 4 WHEN o_orderpriority LIKE '%URGENT' THEN 5 END AS code FROM orders")
def likert_priority(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.recode_likert("o_orderpriority", ["low", "not specified", "medium", "high", "urgent"]).alias("code"))


@query("SELECT c_custkey, CASE WHEN lower(c_mktsegment) <> 'building' THEN c_mktsegment END AS segment, regexp_extract(c_name, '[0-9]+')::DOUBLE AS number, round_even(c_acctbal, 0) AS balance FROM customer")
def scalar_recodes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.drop_items("c_mktsegment", ["Building"]).alias("segment"), S.ensure_numeric("c_name").alias("number"), S.r_round("c_acctbal", 0).alias("balance"))


@query("SELECT o_orderkey, printf('%.15g', o_totalprice / 7) AS a, printf('%.15g', o_totalprice * 1e-9) AS b, printf('%.15g', o_totalprice * 1e14) AS c, printf('%.15g', 0.1::DOUBLE + 0.2::DOUBLE + (o_orderkey % 3)) AS d FROM orders")
def text_of_doubles(spark, sf):
    price, double = F.col("o_totalprice"), T.DoubleType()
    values = {"a": price / 7, "b": price * 1e-9, "c": price * 1e14, "d": F.lit(0.1) + F.lit(0.2) + F.col("o_orderkey") % 3}
    return table(spark, sf, "orders").select("o_orderkey", *[S.as_text(v, double).alias(k) for k, v in values.items()])


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'high' WHEN s_acctbal >= 0 THEN 'mid' ELSE 'low' END AS band FROM supplier")
def band_labels(spark, sf):
    rows = charts.bands([-1000, 0, 5000, 10000], ["low", "mid", "high"], ["red", "amber", "green"])
    return table(spark, sf, "supplier").select("s_suppkey", charts.band_of("s_acctbal", rows).alias("band"))


@query("SELECT r_regionkey, c_name, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def selectors(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(*select.select_columns(d, select.starts_with("r_regionk"), [select.contains("c_name"), select.any_of(["gone", "c_nationkey"])]))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_name, c_mktsegment FROM customer")
def selectors_by_kind(spark, sf):
    d = table(spark, sf, "customer")
    numbers = select.where(select.is_numeric)
    return d.select(*select.select_columns(d, [select.all_of(["c_custkey"]), numbers], select.ends_with("_NAME"), [select.starts_with("c_mkt"), select.contains("mktseg")]))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def selectors_by_name(spark, sf):
    d = table(spark, sf, "customer")
    return select.select_suffix(select.select_prefix(d, "c_").select(*select.select_columns(d, select.everything())), ["key", "bal"])


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN trim(s_name) END AS answer, CASE WHEN s_nationkey % 11 <= 6 THEN 'Detractor' WHEN s_nationkey % 11 <= 8 THEN 'Passive' ELSE 'Promoter' END AS grp, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal <= 5000 THEN 'some' ELSE 'much' END AS band, replace(replace(s_name, '#', ' / '), '0', ' ') IS NOT NULL AS labelled FROM supplier")
def scalar_answers(spark, sf):
    d = table(spark, sf, "supplier")
    cell = F.when(F.col("s_nationkey") % 5 == 0, F.when(F.col("s_nationkey") % 2 == 0, " Prefer not to answer ").otherwise("  ")).otherwise(F.concat(F.lit("  "), "s_name", F.lit("\t")))
    return d.select(
        "s_suppkey",
        S.na_blank(cell).alias("answer"),
        S.nps_group(F.col("s_nationkey") % 11, labels=True, dtype=T.LongType()).alias("grp"),
        F.when(F.col("s_acctbal") < 0, "debt").otherwise(S.cut("s_acctbal", [0, 5000, 1e9], ["some", "much"], include_lowest=True)).alias("band"),
        S.clean_label("s_name").isNotNull().alias("labelled"),
    )


@query("""WITH g AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) / sqrt(count(*)) AS se, avg((c_acctbal > 0)::INT) AS p FROM customer GROUP BY 1)
SELECT c_nationkey, round(se, 6) AS se, round(sqrt(p * (1 - p) / n), 9) AS se_p, round(100 * sqrt(p * (1 - p) / n), 7) AS se_pct, round(se / m * 100, 6) AS rse, round(1.96 * se, 6) AS moe,
CASE WHEN se / m * 100 < 5 THEN 'high precision' WHEN se / m * 100 < 10 THEN 'precise' WHEN se / m * 100 < 15 THEN 'satisfactory' WHEN se / m * 100 < 25 THEN 'use with caution' ELSE 'likely reliability issues' END AS rating FROM g""")
def precision_formulas(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"), S.se_mean("c_acctbal").alias("se"), F.avg((F.col("c_acctbal") > 0).cast("int")).alias("p"))
    n, p, se = F.col("n"), F.col("p"), F.col("se")
    r = S.rse(F.col("m"), se)
    return g.select("c_nationkey", F.round(se, 6).alias("se"), F.round(S.se_prop(p, n), 9).alias("se_p"), F.round(S.se_prop(p, n, percent=True), 7).alias("se_pct"), F.round(r, 6).alias("rse"), F.round(S.margin_of_error(se), 6).alias("moe"), S.rse_rating(r).alias("rating"))


# Cross-tabulations --------------------------------------------------------------------------------------


def _xtab(cell):
    def run(spark, sf):
        return crosstab.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", cell=cell, wide=False)

    run.__name__ = f"xtab_{cell}"
    return run


_XTAB = "SELECT l_returnflag, l_linestatus, {0} AS value FROM lineitem GROUP BY 1, 2"
for _cell, _sql in {
    "count": "count(*)::DOUBLE",
    "row_pct": "round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag) * 100, 0)",
    "col_pct": "round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_linestatus) * 100, 0)",
    "total_pct": "round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0)",
}.items():
    query(_XTAB.format(_sql))(_xtab(_cell))


@query(_XTAB.format("round_even(avg(l_quantity), 4)"))
def xtab_value(spark, sf):
    return crosstab.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", cell="value", value="l_quantity", digits=4, wide=False)


@query(_XTAB.format("max(l_extendedprice)"))
def xtab_fn(spark, sf):
    return crosstab.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", cell="value", value="l_extendedprice", fn=F.max, digits=6, wide=False)


@query("SELECT l_returnflag, l_linestatus, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def xtab_drop(spark, sf):
    return crosstab.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", cell="total_pct", digits=2, wide=False, drop=["n"])


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::DOUBLE AS F, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS O FROM lineitem GROUP BY 1")
def xtab_wide(spark, sf):
    return crosstab.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


_LONG = "SELECT l_linestatus, l_returnflag, l_quantity, q FROM (SELECT *, CASE WHEN l_quantity < 20 THEN 'few' ELSE 'many' END AS q FROM lineitem)"
_CELLS = "SELECT '{v}' AS variable, {v} AS item, '{g}' AS \"group\", {e} AS group_item, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {e}) * 100, 0) AS value FROM ({t}) GROUP BY {v}, {e}"


def _cells(v, g):
    e = "'Overall'" if g == "Overall" else g
    return _CELLS.format(v=v, g=g, e=e, t=_LONG)


def _flags(spark, sf):
    return table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_quantity") < 20, "few").otherwise("many"))


_BANNER = " UNION ALL ".join([_cells("q", "Overall"), _cells("q", "l_linestatus"), _cells("q", "l_returnflag"), _cells("l_linestatus", "Overall"), _cells("l_linestatus", "l_returnflag")])


@query(_BANNER)
def banner_flags(spark, sf):
    return crosstab.banner(_flags(spark, sf), rows=["q", "l_linestatus"], cols=["l_linestatus", "l_returnflag"], cell="pct")


@query(f"SELECT variable, item, \"group\", group_item, CASE WHEN \"group\" = 'Overall' THEN value ELSE value - max(CASE WHEN \"group\" = 'Overall' THEN value END) OVER (PARTITION BY variable, item) END AS value FROM ({_BANNER})")
def banner_diff(spark, sf):
    return crosstab.banner(_flags(spark, sf), rows=["q", "l_linestatus"], cols=["l_linestatus", "l_returnflag"], cell="diff")


_BLOCK = "WITH b AS (SELECT l_orderkey, l_orderkey % 2 = 0 AS even, list_distinct(list(l_returnflag)) AS flags FROM lineitem GROUP BY l_orderkey), g AS (SELECT *, 'Overall' AS \"group\", 'Overall' AS group_item FROM b UNION ALL SELECT *, 'half', CASE WHEN even THEN 'even' ELSE 'odd' END FROM b)"


@query(_BLOCK + ", n AS (SELECT \"group\", group_item, unnest(flags) AS item FROM g), t AS (SELECT group_item, count(*) AS base FROM g GROUP BY 1) SELECT 'flag' AS variable, item, \"group\", group_item, round_even(count(*)::DOUBLE / max(base) * 100, 0) AS value FROM n JOIN t USING (group_item) GROUP BY 2, 3, 4")
def banner_block(spark, sf):
    d = _block(spark, sf).withColumn("half", F.when(F.col("l_orderkey") % 2 == 0, "even").otherwise("odd")).drop("l_orderkey")
    return crosstab.banner(d, rows=["flag_A", "flag_N", "flag_R"], cols=["half"], cell="pct")


@query("SELECT 'q' AS variable, q AS item, \"group\", group_item, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY group_item) * 100, 0) AS value FROM (SELECT CASE WHEN l_quantity < 20 THEN 'few' WHEN l_quantity < 40 THEN 'some' ELSE 'many' END AS q, unnest(['Overall', 'l_linestatus']) AS \"group\", unnest(['Overall', l_linestatus]) AS group_item FROM lineitem) WHERE q <> 'some' GROUP BY 2, 3, 4")
def banner_drop(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_quantity") < 20, "few").when(F.col("l_quantity") < 40, "some").otherwise("many"))
    return crosstab.banner(d, rows=["q"], cols=["l_linestatus"], cell="pct", drop=" SOME")


@query(_BANNER.replace("round_even(count(*)::DOUBLE / sum(count(*))", "(count(*)::DOUBLE + 0 * sum(count(*))").replace(" * 100, 0) AS value", ") AS value"))
def banner_counts(spark, sf):
    return crosstab.banner(_flags(spark, sf), rows=["q", "l_linestatus"], cols=["l_linestatus", "l_returnflag"], cell="count")


_STATS = "SELECT {g} AS \"group\", {e} AS group_item, round_even(avg(l_quantity), 3) AS mean, round_even(median(l_quantity), 3) AS median, round_even(stddev_samp(l_quantity), 3) AS sd, round_even(quantile_cont(l_quantity, 0.25), 3) AS p25, round_even(quantile_cont(l_quantity, 0.75), 3) AS p75 FROM lineitem GROUP BY 2"


@query("SELECT 'l_quantity' AS variable, item, \"group\", group_item, value FROM (" + _STATS.format(g="'Overall'", e="'Overall'") + " UNION ALL " + _STATS.format(g="'l_returnflag'", e="l_returnflag") + ") UNPIVOT (value FOR item IN (mean, median, sd, p25, p75))")
def banner_stats(spark, sf):
    return crosstab.banner(table(spark, sf, "lineitem"), rows=["l_quantity"], cols=["l_returnflag"], digits=3)


@query(f"SELECT variable, item, max(CASE WHEN \"group\" = 'Overall' THEN value END) AS \"Overall\", max(CASE WHEN group_item = 'A' THEN value END) AS A, max(CASE WHEN group_item = 'N' THEN value END) AS N, max(CASE WHEN group_item = 'R' THEN value END) AS R FROM ({_cells('q', 'Overall')} UNION ALL {_cells('q', 'l_returnflag')}) GROUP BY 1, 2")
def banner_wide(spark, sf):
    return crosstab.banner(_flags(spark, sf), rows=["q"], cols=["l_returnflag"], cell="pct", long=False)


# Weights ------------------------------------------------------------------------------------------------

_W = "WITH s AS (SELECT l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), w AS (SELECT l.*, (CASE l_linestatus WHEN 'F' THEN 0.6 ELSE 0.4 END) * (SELECT sum(n) FROM s) / s.n AS w FROM lineitem l JOIN s USING (l_linestatus)) "


@query(_W + "SELECT l_returnflag, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0) AS pct, round_even(sum(w) / sum(sum(w)) OVER () * 100, 0) AS wpct FROM w GROUP BY 1")
def weighted_pct_flag(spark, sf):
    return tabulate.calc_percentage(table(spark, sf, "lineitem"), "l_returnflag", weights=STATUS)


@query(_W + ", m AS (SELECT l_returnflag, count(*) AS n, sum(w * l_quantity) / sum(w) AS mean FROM w GROUP BY 1), c AS (SELECT l_returnflag, l_quantity, sum(sum(w)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(sum(w)) OVER (PARTITION BY l_returnflag) AS share FROM w GROUP BY 1, 2), d AS (SELECT l_returnflag, min(l_quantity) FILTER (share >= 0.5) AS median FROM c GROUP BY 1), v AS (SELECT l_returnflag, sqrt(sum(w * (l_quantity - mean) ** 2) / (sum(w) - 1)) AS sd FROM w JOIN m USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd FROM m JOIN d USING (l_returnflag) JOIN v USING (l_returnflag)")
def weighted_summary(spark, sf):
    return rounded(tabulate.calc_summary(table(spark, sf, "lineitem"), "l_quantity", by="l_returnflag", weights=STATUS))


@query(_W + f"SELECT l_returnflag, count(*) AS n, round_even(sum(g * w) / sum(w) * 100, 0) AS nps, {', '.join(f'round_even(coalesce(sum(w) FILTER (g = {g}), 0) / sum(w) * 100, 0) AS pct_{n}, count(*) FILTER (g = {g}) AS n_{n}' for n, g in (('promoters', 1), ('passives', 0), ('detractors', -1)))} FROM (SELECT *, CASE WHEN l_partkey % 11 <= 6 THEN -1 WHEN l_partkey % 11 <= 8 THEN 0 ELSE 1 END AS g FROM w) GROUP BY 1")
def weighted_nps(spark, sf):
    return model.calc_nps(table(spark, sf, "lineitem").withColumn("score", F.col("l_partkey") % 11), "score", by="l_returnflag", weights=STATUS)


@query("SELECT * FROM (VALUES ('l_linestatus', 'F', 60.0::DOUBLE), ('l_linestatus', 'O', 40.0::DOUBLE), ('l_returnflag', 'A', 30.0::DOUBLE), ('l_returnflag', 'N', 50.0::DOUBLE), ('l_returnflag', 'R', 20.0::DOUBLE)) AS t(variable, answer, wpct)")
def raked_margins(spark, sf):
    out = tabulate.calc_percentage_batch(table(spark, sf, "lineitem"), "l_linestatus", "l_returnflag", weights=TWO, digits=2)
    return out.select("variable", "answer", "wpct")


_CELLS_OF = "SELECT l_linestatus, count(*) AS n, round((CASE l_linestatus WHEN 'F' THEN 0.6 ELSE 0.4 END) * (SELECT count(*) FROM lineitem) / count(*), 9) AS weight FROM lineitem GROUP BY 1"


@query(_CELLS_OF)
def weight_column(spark, sf):
    d = weights.weight_vector(table(spark, sf, "lineitem"), STATUS)
    return d.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


@query(f"SELECT round(sum(n * weight * weight) * sum(n) / sum(n * weight) ** 2, 6) AS deff, round(sum(n * weight) ** 2 / sum(n * weight * weight), 3) AS n_eff FROM ({_CELLS_OF})")
def weight_effect(spark, sf):
    found = weights.weight_diagnostics(table(spark, sf, "lineitem"), weights.parse_scheme(("l_linestatus", {"F": 6, "O": 4})))
    return spark.createDataFrame([(round(found["deff"], 6), round(found["n_eff"], 3))], "deff double, n_eff double")


_WBANNER = "SELECT 'l_returnflag' AS variable, l_returnflag AS item, '{g}' AS \"group\", {e} AS group_item, round_even(sum(w) / sum(sum(w)) OVER (PARTITION BY {e}) * 100, 0) AS value FROM w GROUP BY l_returnflag, {e}"


@query(_W + _WBANNER.format(g="Overall", e="'Overall'") + " UNION ALL " + _WBANNER.format(g="l_linestatus", e="l_linestatus"))
def banner_weighted(spark, sf):
    d = table(spark, sf, "lineitem").filter("l_returnflag IS NOT NULL")
    return _present(spark, sf, crosstab.banner(d, rows=["l_returnflag"], cols=["l_linestatus"], cell="pct", weights=STATUS))


def _present(spark, sf, cells):
    """Only cells that have rows: SQL makes no others."""
    seen = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    seen = seen.select("l_returnflag", F.explode(F.array("l_linestatus", F.lit("Overall"))).alias("g")).distinct()
    return cells.join(seen, (F.col("item") == F.col("l_returnflag")) & (F.col("group_item") == F.col("g"))).select(*cells.columns)


@query(_W + ", m AS (SELECT l_returnflag, sum(w * l_quantity) / sum(w) AS m FROM w GROUP BY 1) SELECT l_returnflag, l_linestatus, round_even(sum(w * l_quantity) / sum(w), 4) AS value FROM w GROUP BY 1, 2")
def xtab_weighted_value(spark, sf):
    return crosstab.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", cell="value", value="l_quantity", digits=4, wide=False, weights=STATUS)


# Precision ----------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT 'l_quantity' AS variable, 'mean' AS type, 'points' AS unit, count(*) AS n, avg(l_quantity) AS e, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem),
p AS (SELECT 'l_returnflag' AS variable, 'prop' AS type, 'ppt' AS unit, sum(c)::BIGINT AS n, 100 * (max(c)::DOUBLE / sum(c)) AS e, 100 * sqrt((max(c)::DOUBLE / sum(c)) * (1 - max(c)::DOUBLE / sum(c)) / sum(c)::DOUBLE) AS se FROM (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY 1)),
u AS (SELECT * FROM m UNION ALL SELECT * FROM p)
SELECT variable, type, unit, n, round_even(e, 4) AS estimate, round_even(se, 4) AS se, round_even(se / e * 100, 4) AS rse, round_even(1.96 * se, 4) AS moe, CASE WHEN se / e * 100 < 5 THEN 'high precision' ELSE 'other' END AS precision FROM u""")
def diagnose_lineitem(spark, sf):
    return precision.diagnose(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", digits=4)


@query()
def precision_bullets(spark, sf):
    found = precision.precision_summary(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return spark.createDataFrame([(i, b) for i, b in enumerate(found["bullets"])], "line int, text string")


@query("""SELECT 'c_mktsegment' AS variable, 'categorical' AS kind, count(DISTINCT c_mktsegment) AS n_distinct FROM customer UNION ALL SELECT 'c_name', 'freetext', count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_acctbal', 'numeric', count(DISTINCT c_acctbal) FROM customer""")
def column_kinds(spark, sf):
    found = profile.profile(table(spark, sf, "customer"), ["c_mktsegment", "c_name", "c_acctbal"])
    return spark.createDataFrame([(c, p["kind"], p["distinct"]) for c, p in found.items()], "variable string, kind string, n_distinct long")


# Models -------------------------------------------------------------------------------------------------

_PREDICTORS = ["l_quantity", "l_discount", "l_tax"]


@query("WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_discount, l_extendedprice)) AS b, abs(corr(l_tax, l_extendedprice)) AS c FROM lineitem) SELECT 'l_quantity' AS feature, round(a / (a + b + c) * 100, 6) AS importance FROM r UNION ALL SELECT 'l_discount', round(b / (a + b + c) * 100, 6) FROM r UNION ALL SELECT 'l_tax', round(c / (a + b + c) * 100, 6) FROM r")
def corr_importance(spark, sf):
    return rounded(model.calc_importance(table(spark, sf, "lineitem"), "l_extendedprice", _PREDICTORS, method="correlation"))


@query("""WITH r AS (SELECT corr(l_quantity, l_discount) AS r, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b FROM lineitem),
s AS (SELECT *, (sqrt(1 + r) + sqrt(1 - r)) / 2 AS u, (sqrt(1 + r) - sqrt(1 - r)) / 2 AS v FROM r),
t AS (SELECT *, (u * a - v * b) / (u * u - v * v) AS x, (u * b - v * a) / (u * u - v * v) AS y FROM s),
e AS (SELECT u * u * x * x + v * v * y * y AS p, v * v * x * x + u * u * y * y AS q FROM t)
SELECT 'l_quantity' AS feature, round(p / (p + q) * 100, 6) AS importance FROM e UNION ALL SELECT 'l_discount', round(q / (p + q) * 100, 6) FROM e""")
def rwa_importance(spark, sf):
    return rounded(model.calc_importance(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


@query()
def forest_importance(spark, sf):
    d = table(spark, sf, "orders").select((F.col("o_orderkey") % 7).alias("a"), (F.col("o_custkey") % 5).alias("b"))
    values = model.rescaled(model.forest_weights(d.withColumn("y", F.col("a") * 2 + F.col("b")), "y", ["a", "b"], trees=10) + 1e-9)
    return spark.createDataFrame([("a", float(values[0])), ("b", float(values[1]))], "feature string, importance double")


@query()
def ipm_ratings(spark, sf):
    d = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") % 5 + 1).alias("ratings_size"), (F.col("l_discount") * 40 + 1).alias("ratings_price"), (F.col("l_tax") * 50 + 1).alias("ratings_tax"))
    return rounded(model.ipm_model(d, "l_extendedprice", "ratings_"))


_YEAR = "(SELECT o_orderpriority AS feature, round_even(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 0) AS performance FROM orders WHERE year(o_orderdate) = {0} GROUP BY 1)"


@query(f"SELECT p.feature, p.performance AS previous, c.performance AS current, c.performance - p.performance AS difference FROM {_YEAR.format(1997)} p LEFT JOIN {_YEAR.format(1998)} c USING (feature)")
def compare_years_priority(spark, sf):
    def of(year):
        d = table(spark, sf, "orders").filter(F.year("o_orderdate") == year).withColumnRenamed("o_orderpriority", "feature")
        return tabulate.calc_percentage(d, "feature").withColumnRenamed("pct", "performance")

    return model.compare_values(of(1998), of(1997))


# Lookups ------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'RMB' WHEN 1 THEN ' eur' ELSE 'XXX' END AS code, round(CASE c_nationkey % 3 WHEN 0 THEN c_acctbal / 7.2 * 0.79 WHEN 1 THEN c_acctbal / 0.92 * 0.79 END, 6) AS c_acctbal_gbp FROM customer")
def currency_by_nation(spark, sf):
    code = F.when(F.col("c_nationkey") % 3 == 0, "RMB").when(F.col("c_nationkey") % 3 == 1, " eur").otherwise("XXX")
    out = lookups.add_currency(table(spark, sf, "customer").withColumn("code", code), "c_acctbal", "code", to="GBP")
    return rounded(out.select("c_custkey", "code", "c_acctbal_gbp"))


_VALUES = ", ".join("({})".format(", ".join("'" + r[k].replace("'", "''") + "'" for k in ("country", "region", "subregion"))) for r in lookups.read_rows("countries.csv"))


@query(f"SELECT n_nationkey, country, t.region, t.subregion FROM nation, (VALUES {_VALUES}) AS t(country, region, subregion)")
def region_all_countries(spark, sf):
    names = F.array(*[F.lit(r["country"]) for r in lookups.read_rows("countries.csv")])
    d = table(spark, sf, "nation").select("n_nationkey", F.explode(names).alias("country"))
    typed = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("  The "), F.upper("country"))).otherwise(F.concat(F.lower("country"), F.lit(" .")))
    return lookups.add_region(d.withColumn("typed", typed), "typed", subregion=True).select("n_nationkey", "country", "region", "subregion")


@query("""SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'Europe' WHEN 1 THEN 'North America' WHEN 2 THEN 'Asia' WHEN 3 THEN NULL WHEN 4 THEN 'Europe' WHEN 5 THEN 'South America' WHEN 6 THEN NULL ELSE 'Europe' END AS region,
CASE n_nationkey % 8 WHEN 0 THEN 'Western Europe' WHEN 1 THEN 'North America' WHEN 2 THEN 'South East Asia' WHEN 3 THEN NULL WHEN 4 THEN 'Western Europe' WHEN 5 THEN 'South America' WHEN 6 THEN NULL ELSE 'Northern Europe' END AS subregion FROM nation""")
def region_lookup(spark, sf):
    names = F.array(*[F.lit(x) for x in ("  GERMANY", "U.S.A.", "Viet Nam", "nowhere", "the UK", "Brasil", "no", "NO")])
    d = table(spark, sf, "nation").select("n_nationkey", F.get(names, F.col("n_nationkey") % 8).alias("country"))
    return lookups.add_region(d, "country", subregion=True).drop("country")


# Text ---------------------------------------------------------------------------------------------------


@query(r"SELECT source, count(*) AS n, sum(least(length(t), 300))::BIGINT AS chars FROM (SELECT source, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM documents) WHERE length(t) > 10 AND t <> 'Prefer not to answer' AND NOT regexp_matches(lower(t), 'xyzzy|lorem') GROUP BY 1")
def comments_prep(spark, sf):
    d = comments.prep_comments(table(spark, sf, "documents").withColumnRenamed("source", "origin"), "text", exclude=["xyzzy", "Lorem"], by="origin")
    return d.groupBy(F.col("origin").alias("source")).agg(F.count("*").alias("n"), F.sum("length").alias("chars"))


_TOKENS = "SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9'' ]', ' ', 'g'), ' +'), lambda w: length(w) > 2))) AS word FROM documents WHERE text IS NOT NULL"


@query(f"SELECT word, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1, 6) AS idf FROM ({_TOKENS}) GROUP BY 1")
def tokens_idf(spark, sf):
    return rounded(comments.document_frequencies(table(spark, sf, "documents"), "text"))


@query(f"SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) > 0 THEN log2(n) ELSE 0 END, 6) AS bits FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_TOKENS}) GROUP BY 1) USING (doc_id)")
def comment_entropy(spark, sf):
    return rounded(table(spark, sf, "documents").select("doc_id", comments.entropy_bits(comments.tokens("text", ())).alias("bits")))


@query(f"WITH t AS ({_TOKENS}), f AS (SELECT word, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1 AS idf FROM t GROUP BY 1), n AS (SELECT doc_id, sqrt(sum(idf * idf)) AS norm FROM t JOIN f USING (word) GROUP BY 1) SELECT doc_id, word, round(idf / norm, 9) AS weight FROM t JOIN f USING (word) JOIN n USING (doc_id)")
def tfidf_weights(spark, sf):
    return rounded(comments.tfidf(table(spark, sf, "documents"), "doc_id", "text"), 9)


@query(r"""SELECT origin, comment FROM (SELECT source AS origin, comment, row_number() OVER (PARTITION BY source ORDER BY md5('1:text:' || comment), comment) AS k
FROM (SELECT source, CASE WHEN length(t) > 300 THEN t[:297] || '...' ELSE t END AS comment FROM (SELECT source, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM documents) WHERE length(t) > 0 AND t <> 'Prefer not to answer')) WHERE k <= 3""")
def comments_sampled(spark, sf):
    d = comments.sample_comments(table(spark, sf, "documents").withColumnRenamed("source", "origin"), "text", n=3, min_chars=0, by="origin", by_column=False, seed=1)
    return d.select("origin", "comment")


@query()
def comments_diverse(spark, sf):
    return comments.sample_comments_diverse(table(spark, sf, "documents"), "text", n=5, seed=1)


# Sources ------------------------------------------------------------------------------------------------


@query("SELECT c_name AS name, c_acctbal AS acctbal, NULL::DOUBLE AS suppkey FROM customer UNION ALL SELECT s_name, s_acctbal, s_suppkey::DOUBLE FROM supplier")
def csv_folder(spark, sf):
    """Two kinds of CSV files in one folder, read back below one another."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    a = table(spark, sf, "customer").select(F.concat(F.lit(" "), "c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("suppkey"))
    for d in (a, b):
        d.write.mode("append").option("header", True).csv(folder)
    back = files.read_folder(spark, folder)
    return back.select("name", S.ensure_numeric("acctbal").alias("acctbal"), S.ensure_numeric("suppkey").alias("suppkey"))


@query("SELECT n_nationkey, string_split(n_name, '_')[1] AS kind, string_split(n_name, '_')[2] AS number, NULL::VARCHAR AS more FROM nation")
def parse_names(spark, sf):
    d = table(spark, sf, "nation").withColumn("file", F.concat("n_name", F.lit(".csv")))
    return files.parse_filename(d, into=["kind", "number", "more"], remove=True).select("n_nationkey", "kind", "number", "more")


# Time ---------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def window_event_counts(spark, sf):
    return windows.windowed_counts(table(spark, sf, "events"), "event_type")


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1, 2")
def window_event_values(spark, sf):
    return rounded(windows.windowed_summary(table(spark, sf, "events"), "value"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "user_id")


# Helpers ------------------------------------------------------------------------------------------------

for _name, (_f, _wanted) in facts.QUERIES.items():
    QUERIES[_name], SQL[_name] = _f, facts.sql(_wanted)
