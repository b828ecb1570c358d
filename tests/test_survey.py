"""Semantics of the survey operators on small hand-computed tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import comments, crosstab, lookups, model, precision, select, tabulate, weights
from tallyforge.plans import brand, charts, profile, state


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture()
def survey(spark):
    data = [
        (1, "Yes", "A", 10, "Good", "x", None), (2, " yes", "A", 9, "Very good", None, "y"), (3, "No", "B", 3, "4 - Ok", "x", "y"), (4, None, "B", 7, "Bad", None, None),
        (5, "Prefer not to answer", None, 8, "very bad", "x", None), (6, "No", "A", None, "", None, "y"), (7, "Maybe", "B", 0, "nonsense", "x", "y"),
    ]
    return spark.createDataFrame(data, "id int, q string, g string, nps int, rating string, opt_x string, opt_y string")


# Scalars


def scalar_round(x, d):
    if x == 0 or not math.isfinite(x) or math.floor(math.log10(abs(x))) + 1 + d > 15:
        return x
    if d == 0:
        return float(round(x))
    p = 10.0**d
    low, high = math.floor(abs(x) * p), math.ceil(abs(x) * p)
    a, b = abs(x) - low / p, high / p - abs(x)
    return math.copysign(low / p if a < b or a == b and low % 2 == 0 else high / p, x)


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_rounding(spark, digits):
    rng = random.Random(digits)
    v = [k / 8 for k in range(-80, 80)] + [0.15, 0.25, 0.35, 2.675, 1e16, -1e16, 0.0, 1e14 + 0.5] + [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 8) for _ in range(20_000)]
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for x, y in df.select("x", S.r_round("x", digits)).collect():
        assert y == scalar_round(x, digits), x


def test_text_forms(spark):
    df = spark.createDataFrame([(25.0, True), (0.5, False), (math.inf, None), (math.nan, None), (None, None)], "x double, b boolean")
    kinds = tabulate.dtypes(df)
    assert rows(df.select(S.as_text("x", kinds["x"]), S.as_text("b", kinds["b"]))) == [("25", "TRUE"), ("0.5", "FALSE"), ("Inf", None), (None, None), (None, None)]


def test_missing_and_dropped(survey):
    assert rows(survey.select(S.na_blank("q"))) == [("Yes",), ("yes",), ("No",), (None,), (None,), ("No",), ("Maybe",)]
    assert rows(survey.select(S.drop_items("q", "YES"))) == [(None,), (None,), ("No",), (None,), ("Prefer not to answer",), ("No",), ("Maybe",)]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("34 years",), ("about -2.5",), (".5",), ("none",), (None,)], "t string")
    assert rows(df.select(S.ensure_numeric("t"))) == [(34.0,), (-2.5,), (0.5,), (None,), (None,)]


def test_recodes(spark, survey):
    assert rows(survey.select(S.recode_likert("rating"))) == [(4,), (5,), (3,), (2,), (1,), (None,), (None,)]
    df = spark.createDataFrame([(17,), (18,), (34,), (35,), (120,), (-1,)], "a int")
    assert [r[0] for r in rows(df.select(S.recode_age("a")))] == ["17 or younger", "18 to 21", "30 to 34", "35+", "35+", None]
    years = spark.createDataFrame([(1927,), (1928,), (1996,), (1997,), (2030,)], "y int")
    assert [r[0] for r in rows(years.select(S.recode_generation("y", "year")))] == [None, "Silent", "Millennial", "Gen Z", "Gen Alpha"]
    ages = spark.createDataFrame([(6.0,), (6.5,), (7.0,), (8.5,), (9.0,), (11.0,)], "n double")
    assert [r[0] for r in rows(ages.select(S.nps_group("n")))] == [-1, None, 0, None, 1, None]
    syn = spark.createDataFrame([("Dissatisfied",), ("satisfied!",)], "s string")
    assert rows(syn.select(S.recode_likert("s", synonyms={"Bad": "Dissatisfied", "Good": "Satisfied"}))) == [(2,), (4,)]
    with pytest.raises(ValueError, match="not one of"):
        S.recode_likert("s", synonyms={"Nope": "x"})


def test_labels_and_helpers(spark):
    assert S.clean_name("opt_A...B.c", "opt_") == "A / B c"
    assert spark.range(1).select(S.clean_label(F.lit("opt_A...B.c"), "opt_")).first()[0] == "A / B c"
    assert S.nice_max([10, 50], 25) == 75 and math.isnan(S.nice_max([])) and S.nice_max(math.inf) == math.inf
    assert S.make_unique(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    assert S.match_arg("cou", ["count", "row"]) == "count"
    with pytest.raises(ValueError):
        S.match_arg("x", ["count", "row"])
    assert S.wrap_text("aa bb ccc", 5) == "aa bb\nccc"
    assert S.label_pct(1)(2.25) == "2.2%" and S.label_pct()(None) == "NA%"


def test_precision_formulas(spark):
    r = spark.range(1).select(S.se_prop(0.5, 100), S.se_prop(50.0, 100, percent=True), S.se_prop(0.5, 0), S.rse(F.lit(0.0), F.lit(1.0)), S.rse_rating(F.lit(12.0)), S.rse_rating(F.lit(25.0)), S.margin_of_error(F.lit(2.0))).first()
    assert tuple(r) == (0.05, 5.0, math.inf, math.inf, "satisfactory", "likely reliability issues", 3.92)


# Selectors


def test_selectors(survey):
    pick = lambda *s: select.select_columns(survey, *s)
    assert pick(select.starts_with("OPT_")) == ["opt_x", "opt_y"]
    assert pick("q", [select.ends_with("_x"), "q"], select.any_of(["gone", "g"])) == ["q", "opt_x", "g"]
    assert pick(select.where(select.is_numeric)) == ["id", "nps"]
    assert select.select_prefix(survey, "opt_", keep="id").columns == ["id", "opt_x", "opt_y"]
    assert select.select_suffix(survey, "_y").columns == ["opt_y"]
    with pytest.raises(ValueError, match="Did you mean 'rating'"):
        select.check_column("ratng", survey)
    with pytest.raises(ValueError, match="don't exist"):
        pick(select.all_of(["nope"]))


# Percentages


def test_percentages(survey):
    assert rows(tabulate.calc_percentage(survey, "q")) == [("Maybe", 1, 20.0), ("No", 2, 40.0), ("Yes", 1, 20.0), ("yes", 1, 20.0)]
    assert rows(tabulate.calc_percentage(survey, "q", drop=["YES", "maybe"])) == [("No", 2, 100.0)]
    assert rows(tabulate.calc_percentage(survey, "q", levels=["No", "Yes"])) == [("No", 2, 40.0), ("Yes", 1, 20.0), (None, 1, 20.0), (None, 1, 20.0)]
    assert rows(tabulate.calc_percentage(survey, "q", sort="desc"))[0] == ("No", 2, 40.0)
    assert rows(tabulate.calc_percentage(survey, "g", by="q"))[-1] == (None, "B", 1, 100.0)  # groups keep their missing one, last
    kept = rows(tabulate.calc_percentage(survey, "nps", na_rm=False))
    assert kept[-1] == (None, 1, 14.0) and kept[0] == (0, 1, 14.0)  # numbers sort as numbers, missing last


def test_wide_and_orders(survey):
    state.current().register_order("answers", ["Yes", "No", "Maybe"], vars="q")
    assert [r[0] for r in rows(tabulate.calc_percentage(survey, "q"))] == ["Yes", "No", "Maybe", "yes"]
    wide = tabulate.calc_percentage(survey, "q", by="g", wide=True)
    assert set(wide.columns) == {"g", "Yes", "No", "Maybe", "yes"}
    assert [r["g"] for r in wide.collect()] == ["A", "B"] and wide.collect()[0]["Maybe"] is None


def test_batch_is_the_sum_of_its_parts(survey):
    batch = rows(tabulate.calc_percentage_batch(survey, "q", "g", "nps"))
    parts = [(v, *r) for v in ("q", "g", "nps") for r in rows(tabulate.calc_percentage(survey, v))]
    assert batch == [(v, str(a), n, p) for v, a, n, p in parts]


def test_multi(spark, survey):
    assert rows(tabulate.calc_percentage_multi(survey, "opt_")) == [("x", 4, 67.0), ("y", 4, 67.0)]
    packed = spark.createDataFrame([(1, "a; b"), (1, "b"), (2, " b ;; c c "), (3, ""), (None, "a"), (None, "a")], "id int, p string")
    assert rows(tabulate.calc_percentage_multi(packed, "p", id="id")) == [("a", 2, 67.0), ("b", 2, 67.0), ("c c", 1, 33.0)]
    split = tabulate.split_multi(packed, "p")
    assert split.columns == ["id", "p", "p_a", "p_b", "p_c c"] and split.filter("id = 2").first()["p_b"] == "b"


def test_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0)], "g string, v double")
    assert rows(tabulate.calc_summary(df, "v", by="g")) == [("a", 2, 1.5, 1.5, pytest.approx(math.sqrt(0.5))), ("b", 1, 5.0, 5.0, None)]
    assert rows(tabulate.calc_summary(df, "v", by="g", na_rm=False))[0] == ("a", 2, None, None, None)
    assert rows(tabulate.calc_summary(df.limit(0), "v")) == [(0, None, None, None)]


# Weights


def test_raking_hits_its_targets(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), "mf"[int(a)], "xyz"[int(b)] if b < 3 else None) for i, (a, b) in enumerate(zip(rng.integers(0, 2, 600), rng.integers(0, 4, 600)))]
    df = spark.createDataFrame(data, "id int, s string, r string")
    scheme = weights.parse_scheme(s={"m": 3, "f": 1}, r={"x": 0.5, "y": 0.3, "z": 0.2})
    out = weights.weight_vector(df, scheme)
    w = out.agg(F.avg("weight"), F.min("weight")).first()
    assert w[0] == pytest.approx(1) and w[1] > 0
    got = {r[0]: r[2] for r in rows(tabulate.calc_percentage(df, "r", weights=scheme, digits=3).select("r", "n", "wpct"))}
    assert got == pytest.approx({"x": 50, "y": 30, "z": 20}, abs=2e-3)
    d = weights.weight_diagnostics(df, scheme)
    assert d["n_eff"] < 600 and d["deff"] > 1


def test_weighted_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (None, 9.0)], "v double, w double")
    q = weights.weighted_quantiles(df, "v", "w", [], {"m": 0.5, "p75": 0.75}).first()
    assert tuple(q) == (2.0, 3.0)  # the lowest value whose share reaches p
    assert weights.weighted_sd(df, "v", "w", []).first()[0] == pytest.approx(math.sqrt((1.25**2 + 0.25**2 + 2 * 0.75**2) / 3))


def test_scheme_errors_and_session(survey):
    with pytest.raises(ValueError, match="add up to 0"):
        weights.parse_scheme({"g": {"A": 0}})
    s = state.current()
    s.use_dataset(survey)
    with pytest.raises(ValueError, match="not a column"):
        s.set_weights({"nope": {"A": 1}})
    assert not s.has_weights()
    assert s.set_weights({"g": {"A": 1, "B": 1}})["n_eff"] > 0
    assert "wpct" in tabulate.calc_percentage(None, "q").columns
    assert "wpct" not in tabulate.calc_percentage(None, "q", weights=False).columns


# Cross-tabulations


def test_crosstab(survey):
    long = {(a, b): v for a, b, v in rows(crosstab.crosstab(survey, "q", "g", wide=False))}
    assert long == {("Maybe", "B"): 1, ("No", "A"): 1, ("No", "B"): 1, ("Yes", "A"): 1, ("yes", "A"): 1}
    wide = crosstab.crosstab(survey, "q", "g", cell="col_pct")
    assert wide.columns == ["q", "A", "B"] and rows(wide)[0] == ("Maybe", None, 50.0)
    assert rows(crosstab.crosstab(survey, "q", "g", cell="value", value="nps", fn=F.max))[-1] == ("yes", 9.0, None)


def test_banner_equals_its_crosstabs(survey):
    b = crosstab.banner(survey, rows=["q", "nps", select.starts_with("opt_")], cols=["g"])
    cells = {tuple(r)[:4]: r["value"] for r in b.collect()}
    for a, g, v in rows(crosstab.crosstab(survey, "q", "g", cell="col_pct", wide=False)):
        assert cells["q", a, "g", g] == v
    assert cells["q", "Maybe", "g", "A"] == 0  # absent cells are 0
    assert cells["q", "No", "Overall", "Overall"] == 40
    assert cells["nps", "mean", "g", "B"] == pytest.approx(3.33)
    assert cells["opt", "x", "Overall", "Overall"] == 67 and cells["opt", "y", "g", "A"] == 67
    for g in ("A", "B"):
        assert sum(v for k, v in cells.items() if k[0] == "q" and k[3] == g) == pytest.approx(100, abs=2)
    d = {tuple(r)[:4]: r["value"] for r in crosstab.banner(survey, rows=["q"], cols=["g"], cell="diff").collect()}
    assert d["q", "No", "g", "B"] == 10 and d["q", "No", "Overall", "Overall"] == 40
    self_crossed = crosstab.banner(survey, rows=["q", "g"], cols=["g"]).filter("variable = group")
    assert self_crossed.count() == 0
    wide = crosstab.banner(survey, rows=["q"], cols=["g"], long=False)
    assert wide.columns == ["variable", "item", "Overall", "A", "B"] and wide.schema["A"].metadata == {"group": "g"}


def test_auto_selection(survey):
    p = profile.profile(survey)
    assert p["id"]["kind"] == "numeric" and p["opt_x"]["kind"] == "constant"
    assert profile.detect_multiselect(survey) == {"opt_": ["opt_x", "opt_y"]}
    assert crosstab.banner(survey).count() > 0


# Models


def test_nps(survey, spark):
    r = model.calc_nps(survey, "nps").first()
    assert tuple(r) == (6, 0.0, 33.0, 33.0, 33.0, 2, 2, 2)
    assert tuple(model.calc_nps(survey.limit(0), "nps").first()) == (0, None, None, None, None, 0, 0, 0)
    dist = rows(model.nps_distribution(survey, "nps"))
    assert len(dist) == 11 and dist[10] == (10, "Promoter", 1, 17.0)


def test_compare(spark):
    old = spark.createDataFrame([("a", 1.0), (None, 2.0), ("gone", 3.0)], "feature string, performance double")
    new = spark.createDataFrame([("a", 1.5), (None, 1.0), ("new", 9.0)], "feature string, performance double")
    assert sorted(rows(model.compare_values(new, old)), key=str) == sorted([("a", 1.0, 1.5, 0.5), (None, 2.0, 1.0, -1.0), ("gone", 3.0, None, None)], key=str)


def test_importance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = 2 * x[:, 0] + x[:, 1] + rng.normal(size=400) * 0.2
    df = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, r_a double, r_b double, r_c double")
    for method in ("rwa", "correlation"):
        got = rows(model.calc_importance(df, "y", select.starts_with("r_"), method=method))
        assert [f for f, _ in got][:2] == ["r_a", "r_b"] and sum(v for _, v in got) == pytest.approx(100) and min(v for _, v in got) >= 0
    values = model.forest_weights(df, "y", ["r_a", "r_b", "r_c"], trees=20)
    assert values.argmax() == 0 and values[0] > values[2]
    with pytest.raises(ValueError, match="No variance"):
        model.calc_importance(df.withColumn("r_a", F.lit(1.0)), "y", ["r_a", "r_b"])
    with pytest.raises(ValueError, match="singular"):
        model.calc_importance(df.withColumn("r_b", F.col("r_a") * 2), "y", ["r_a", "r_b"])
    ipm = model.ipm_model(df.withColumn("r_a", F.col("r_a") + 3), "y", "r_").collect()
    assert {r["feature"] for r in ipm} == {"a", "b", "c"} and {r["feature"]: r["perf_class"] for r in ipm}["a"] in ("2", "3")


# Precision, lookups, text


def test_diagnose(survey):
    got = {r["variable"]: r for r in precision.diagnose(survey, "nps", "q").collect()}
    assert got["nps"]["n"] == 6 and got["nps"]["estimate"] == 6.17 and got["nps"]["unit"] == "points"
    assert got["q"]["estimate"] == 40.0 and got["q"]["se"] == pytest.approx(21.91) and got["q"]["precision"] == "likely reliability issues"
    assert len(precision.precision_summary(survey)["bullets"]) == 4


def test_lookups(spark):
    df = spark.createDataFrame([("  the UNITED states ",), ("Côte d'Ivoire",), ("no",), ("NO",), ("atlantis",), (None,)], "c string")
    got = {r["c"]: r["region"] for r in lookups.add_region(df, "c").collect()}
    assert list(map(got.get, [r["c"] for r in df.collect()])) == ["North America", "Africa", None, "Europe", None, None]
    named = spark.createDataFrame([("Brasil",), ("EGYPT",), ("Japan",), ("USA",), ("U.S.",), ("Holland",), ("Puerto Rico",), ("North Korea",), ("KOR",)], "c string")
    where = {r["c"]: (r["where"], r["subregion"]) for r in lookups.add_region(named, "c", region_to="where", subregion=True).collect()}
    assert where == {
        "Brasil": ("South America", "South America"), "EGYPT": ("Middle East", "Middle East"), "Japan": ("Asia", "East Asia"), "USA": ("North America", "North America"),
        "U.S.": ("North America", "North America"), "Holland": ("Europe", "Western Europe"), "Puerto Rico": ("North America", "Caribbean"), "North Korea": ("Asia", "East Asia"),
        "KOR": ("Asia", "East Asia"),
    }
    assert rows(lookups.recode_subregion(named.limit(1), "c")) == [("Brasil", "South America")]
    own = spark.createDataFrame([("Atlantis", "Sea", "Deep Sea")], "country string, region string, subregion string")
    assert {r["c"]: r["region"] for r in lookups.add_region(df, "c", table=own, aliases={}).collect()}["atlantis"] == "Sea"
    money = spark.createDataFrame([(92.0, "EUR"), (7.2, " rmb "), (1.0, "???")], "a double, cur string")
    assert [r["a_usd"] for r in lookups.add_currency(money, "a", "cur").collect()] == [pytest.approx(100), pytest.approx(1), None]
    assert lookups.add_currency(money, "a", "EUR", to="EUR").first()["a_eur"] == pytest.approx(92)
    assert len(lookups.list_currencies()) == 39


def test_comments(spark):
    df = spark.createDataFrame([(i, f"comment number {i} about topic{i % 4} and more", "short") for i in range(30)], "id int, a string, b string")
    prep = comments.prep_comments(df, "a", "b", max_chars=20, exclude="NUMBER 7")
    assert prep.count() == 29 and prep.first()["comment"].endswith("...") and prep.first()["length"] == 20
    assert comments.sample_comments(df, "a", n=4, seed=3).count() == 4
    assert rows(comments.sample_comments(df, "a", n=4, seed=3)) == rows(comments.sample_comments(df, "a", n=4, seed=3))
    for kw in ({}, {"method": "entropy"}, {"score": "tfidf"}):
        got = comments.sample_comments_diverse(df, "a", n=6, seed=2, **kw).collect()
        assert len({r["comment"] for r in got}) == 6
    w = comments.tfidf(df, "id", "a").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in w.collect())


# Charts and state


def test_bands_and_specs(spark, survey):
    assert [b["label"] for b in charts.bands_rating_3(3.5)] == ["OK", "GOOD"]
    assert charts.rescale_bands(charts.bands_nps_score(), (0, 1))[0]["to"] == 0.5
    df = spark.createDataFrame([(0.5,), (3.0,), (9.0,), (None,)], "v double")
    assert [r[0] for r in rows(df.select(charts.band_of("v", charts.bands_rating_3())))] == ["BAD", "OK", "GOOD", None]
    spec = charts.bars(tabulate.calc_percentage(survey, "q"))
    assert spec["encoding"]["y"]["scale"]["domain"] == [0, 50]
    assert charts.gauge(4.2)["label"] == "GOOD" and charts.gauge(50)["label"] == "GREAT"
    assert charts.ramp(["#000000", "#ffffff"], 3) == ["#000000", "#808080", "#FFFFFF"] and len(charts.pal_brand(9)) == 9
    assert charts.nps_chart(survey, "nps")["callouts"]["Promoter"] == 34.0


def test_palettes_axes_and_gauges():
    assert charts.rating_colours(["5 - x", "1 - y"]) == {"5 - x": "#86A33B", "1 - y": "#EC2000"}
    assert charts.rating_colours(["low", "mid", "high"]) == {"low": "#FF3300", "mid": "#FFCB3E", "high": "#86A33B"}
    assert [b["from"] for b in charts.bands_nps()] == [-0.5, 6.5, 8.5] and charts.pal_brand(2) == ["#8FE2FF", "#43CEFF"]
    assert charts.pct_axis([10, 60])["scale"]["domain"] == [0, 75] and "scale" not in charts.pct_axis()
    g = charts.gauges({"a": 4.0, "b": 50})["rows"]
    assert [(r["text"], r["at"]) for r in g] == [("4.00 / 5", 0.75), ("+50", 0.75)] and g[1]["bands"][0]["to"] == 0.5
    assert charts.theme("y")["axisY"]["grid"] and not charts.theme("y")["axisX"]["grid"]


def test_rating_grid(spark):
    df = spark.createDataFrame([("Good", "Bad"), ("Good", "Odd"), ("Bad", "Bad")], "z_a string, z_b string")
    spec = charts.rating_grid(df, "z_", levels=["Bad", "Good"])
    assert spec["unranked"] == ["Odd"] and spec["clashes"] == {}
    assert {r["answer"] for r in spec["data"]["values"]} == {"1 - Bad", "2 - Good", "NA - Odd"}
    assert spec["encoding"]["y"]["sort"] == ["a", "b"]
    with pytest.raises(ValueError, match="No columns"):
        charts.rating_grid(df, "y_")


def test_brand(tmp_path):
    import zipfile

    ns = "http://schemas.openxmlformats.org/drawingml/2006/main"
    xml = f'<a:theme xmlns:a="{ns}"><a:clrScheme><a:dk1><a:sysClr lastClr="0a0a0a"/></a:dk1><a:accent1><a:srgbClr val="0b5394"/></a:accent1></a:clrScheme><a:fontScheme><a:minorFont><a:latin typeface="Georgia"/></a:minorFont></a:fontScheme></a:theme>'
    with zipfile.ZipFile(tmp_path / "t.pptx", "w") as z:
        z.writestr("ppt/theme/theme1.xml", xml)
    info = brand.use_brand(str(tmp_path / "t.pptx"))
    assert info["brand_colors"] == ["#0B5394"] and charts.pal_brand() == ["#0B5394"] and charts.theme()["font"] == "Georgia"
    brand.clear_brand()
    assert brand.brand_info()["brand_colors"] is None and charts.theme()["font"] == "sans-serif"
    with pytest.raises(ValueError, match="template"):
        brand.use_brand("x.pdf")


def test_options_and_profiles(tmp_path):
    s = state.current()
    assert s.options(current_year=2030) == {"current_year": None} and s.option("current_year") == 2030
    with pytest.warns(UserWarning, match="Unknown option"):
        s.options(nope=1)
    s.register_order_presets()
    assert s.order_for("ratings_food") == ["Very bad", "Bad", "Ok", "Good", "Very good"] and s.order_for("demo_edu")[0] == "Primary or less"
    path = s.save_profile(str(tmp_path / "p.yml"))
    fresh = state.SurveySession()
    assert fresh.load_profile(path) == [path] and fresh.option("current_year") == 2030 and len(fresh.list_orders()) == 5
    with pytest.raises(ValueError, match="No default dataset"):
        fresh.get_dataset()


def test_delimiters(spark):
    cells = lambda *values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    for values, found in ((("a, b; c", "d"), ";"), (("a, b", "c"), ","), (("a|b", "c"), "|"), (("a", "b", ""), None)):
        assert tabulate.detect_delimiter(cells(*values), "x") == found
    got = lambda *values: {r["option"]: r["n"] for r in tabulate.calc_percentage_multi(cells(*values), "x").collect()}
    assert got("a,b, c", "b ,  c  d", None, " , ") == {"a": 1, "b": 2, "c": 1, "c d": 1}
    assert got("a|b", "b | c|", "|") == {"a": 1, "b": 2, "c": 1}
    wide = tabulate.split_multi(cells("a/b", "b"), "x", split="/", prefix="pick_")
    assert wide.columns == ["i", "x", "pick_b", "pick_a"]
    assert [r["x_a"] for r in tabulate.split_multi(cells("a", "b", "a"), "x").collect()] == ["a", "", "a"]


def test_text_of_doubles(spark):
    from pyspark.sql import types as T

    values = [0.1 + 0.2, 1e-5, 1e16, 123456.5, 1 / 3, -2 / 3, 1e15, 1.5e300, 40887.61714285715, 0.00012345, 100.0, 1e22, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(S.as_text("d", T.DoubleType())).collect()]
    want = [format(v, ".15g") if v not in (100.0, 1e15) else format(v, ".15g") for v in values[:-3]]
    assert got == [*want, "Inf", None, None]


def test_calls_without_a_table(spark, survey):
    state.current().use_dataset(survey)
    assert rows(tabulate.calc_percentage("q")) == rows(tabulate.calc_percentage(survey, "q"))
    assert rows(crosstab.crosstab("q", "nps", cell="count", wide=False)) == rows(crosstab.crosstab(survey, "q", "nps", wide=False))
    assert rows(model.calc_nps("nps")) == rows(model.calc_nps(None, "nps"))


def test_orders_that_columns_carry(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "size string")
    state.current().register_order("sizes", ["c", "a"], vars="size")
    ordered = state.current().apply_order(df, "size")
    assert state.levels_of(ordered, "size") == ["c", "a"] and state.levels_of(df, "size") is None
    assert [r["size"] for r in ordered.collect()] == [None, "a", "c", "a", None]
    state.current().remove_order("sizes")
    assert [r["size"] for r in tabulate.calc_percentage(ordered, "size").collect()] == ["c", "a"]
    assert state.factor_order(ordered, "size", ["a", "x", "c"]) == ["c", "a", "x"] and state.factor_order(df, "size", ["a"]) is None
    assert state.current().apply_order(df, "size") is df
    with pytest.raises(ValueError):
        state.current().apply_order(df, "size", "none")


def test_weights_are_counted_once(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "q string")
    first = weights.cell_weights(df, {"q": {"a": 0.5, "b": 0.5}})
    assert weights.cell_weights(df, {"q": {"a": 0.5, "b": 0.5}}) is first
    assert weights.cell_weights(df, {"q": {"a": 0.6, "b": 0.4}}) is not first
    weights.clear_weights_cache()
    assert weights.cell_weights(df, {"q": {"a": 0.5, "b": 0.5}}) is not first
    monkeypatch.setattr(weights, "MAX_CELLS", 1)
    with pytest.raises(ValueError, match="more than 1 cells"):
        weights.cell_weights(df, {"q": {"a": 0.7, "b": 0.3}})


def test_progress_and_confirmation(tmp_path):
    from tallyforge.plans.progress import Progress, confirm_selection

    lines = []
    state.current().options(progress=True, confirm=True)
    p = Progress(2, "Tables", lines.append)
    p.item("a")
    p.item("b")
    p.done()
    assert lines[0] == "Tables: 2" and lines[1].startswith("[1/2] a (about 0s left)") and lines[2] == "[2/2] b" and lines[3].startswith("done")
    assert confirm_selection(["x"], "Columns", lambda q: "") and not confirm_selection(["x"], "Columns", lambda q: "n")
    state.current().options(progress="false", confirm="false")
    assert confirm_selection(["x"], "Columns", lambda q: 1 / 0) and not Progress(1, out=lines.append).on
    path = state.current().edit_profile(str(tmp_path / "p.yml"))
    assert "pct_axis_unit" in open(path).read() and state.current().edit_profile(path) == path
    assert len(state.DEFAULTS) == 28


def test_small_helpers(spark):
    assert S.break_lines("one two three extraordinary x", 9) == ["one two", "three", "extraordinary", "x"]
    assert S.break_lines("aa bb cc dd", 7, indent=2) == ["aa bb", "  cc", "  dd"] and S.break_lines("", 5) == [""]
    df = spark.createDataFrame([("b",), ("A",), ("a",), (None,)], "q string")
    assert state.factor_levels(df, "q") == ["a", "A", "b"] and state.factor_levels(state.with_levels(df, "q", ["b", "a"]), "q") == ["b", "a"]
    source = state.with_levels(df, "q", ["b", "a"])
    assert state.levels_of(state.carry_levels(source.groupBy("q").count(), source, ["q"]), "q") == ["b", "a"]
    tiles = charts.quote_tiles([3, 1, 6, 2, 1], 10, 5)
    areas = [(r - l) * (b - t) for l, t, r, b in tiles]
    assert areas == pytest.approx([50 * x / 13 for x in (6, 3, 2, 1, 1)]) and all(0 <= l < r <= 10 + 1e-9 and 0 <= t < b <= 5 + 1e-9 for l, t, r, b in tiles)
    assert all(min(a[2], b[2]) <= max(a[0], b[0]) + 1e-9 or min(a[3], b[3]) <= max(a[1], b[1]) + 1e-9 for i, a in enumerate(tiles) for b in tiles[:i])


def test_many_predictors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * 10 + 1000
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(5))).repartition(3)
    for many in (24, 2):
        monkeypatch.setattr(model, "MANY_COLUMNS", many)
        n, mean, cov = model.moments(df, df.columns)
        assert n == 60 and mean == pytest.approx(x.mean(axis=0)) and cov == pytest.approx(np.cov(x.T))
