"""What the small helpers on the driver answer, one row each, against the values that they have to give."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyforge.functions import scalars as S
from tallyforge.operators import lookups, model, select, tabulate, weights
from tallyforge.plans import brand, charts, profile, state
from tallyforge.sources import files


def _text(v) -> str:
    if isinstance(v, float):
        return f"{v:.6f}"
    return ", ".join(map(_text, v)) if isinstance(v, (list, tuple)) else str(v)


def rows(spark: SparkSession, found: dict):
    return spark.createDataFrame([(k, _text(v)) for k, v in found.items()], "fact string, value string")


def sql(wanted: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in wanted.items()) + ") AS t(fact, value)"


def _error(f) -> str:
    try:
        f()
    except ValueError as e:
        return str(e)
    return "no error"


TEXT = {
    "clean label": "Q one / two",
    "clean label without prefix": "size",
    "unique names": "a, a.1, b, a.2",
    "abbreviated argument": "correlation",
    "unknown argument": "'x' should be one of rwa, correlation.",
    "wrapped": "one two|three|extraordinary",
    "next tick": "75.000000",
    "next tick of a multiple": "75.000000",
    "next tick with room": "120.000000",
    "percent labels": "12%, 12.5 pts, NA%",
    "edits": "0, 1, 2",
    "hint": "Column 'ages' not found. Did you mean 'age'?",
    "no hint": "Column 'xyz' not found.",
    "prefix of a column": "q1_, q1_, ",
    "number in a text": "-3.500000, None",
    "currency codes": "39, USD, ILS",
    "generation years": "1928.000000, 1945.000000, 2013.000000, inf",
}


def text(spark: SparkSession, sf_dir: str):
    df = spark.createDataFrame([(1, 2)], "age int, size int")
    cohorts = S.generation_scheme("pew")
    return rows(
        spark,
        {
            "clean label": S.clean_name(" Q.one...two "),
            "clean label without prefix": S.clean_name("shop_size", "shop_"),
            "unique names": S.make_unique(["a", "a", "b", "a"]),
            "abbreviated argument": S.match_arg("corr", ("rwa", "correlation")),
            "unknown argument": _error(lambda: S.match_arg("x", ("rwa", "correlation"))),
            "wrapped": S.wrap_text("one two three extraordinary", 8).replace("\n", "|"),
            "next tick": float(S.nice_max([10, 62, None])),
            "next tick of a multiple": float(S.nice_max(50.0)),
            "next tick with room": float(S.nice_max(99, 10, 20)),
            "percent labels": [S.label_pct()(12.3), S.label_pct(1, " pts")(12.49), S.label_pct()(None)],
            "edits": [select.edits_within("age", "my age now"), select.edits_within("agf", "my age"), select.edits_within("xyz", "z")],
            "hint": _error(lambda: select.check_column("ages", df)),
            "no hint": _error(lambda: select.check_column("xyz", df)),
            "prefix of a column": [select.column_prefix("q1_a"), select.column_prefix("q1_"), select.column_prefix("age")],
            "number in a text": [S.number_in("about -3.5 or 4"), S.number_in("none")],
            "currency codes": [len(lookups.list_currencies()), lookups.list_currencies()[0], lookups.list_currencies()[-1]],
            "generation years": [cohorts[0][1], cohorts[0][2], cohorts[-1][1], cohorts[-1][2]],
        },
    )


STATE = {
    "no dataset": "No default dataset is set.",
    "columns of the dataset": "n_nationkey, n_name, n_regionkey",
    "gone again": "False",
    "no weights": "No weights are set.",
    "shares": "0.250000, 0.750000",
    "shares as pairs": "0.500000, 0.500000",
    "bad shares": "Targets of 'q' add up to 0.",
    "weights given": "True, False, True",
    "presets": "education_isced, frequency, likelihood, likert_agree, likert_bad_good",
    "order by name": "Never, Rarely, Sometimes, Often, Always",
    "order by variable": "Primary or less",
    "order by prefix": "Very bad",
    "order of another": "None",
    "order removed": "4",
    "option": "25, 10, 25",
    "options": "28, survey-outputs",
    "profile": "50, S",
}


def session(spark: SparkSession, sf_dir: str):
    import os
    import tempfile

    s = state.SurveySession()  # a session of its own: the caller's stays as it is
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = {"no dataset": _error(s.get_dataset)}
    s.use_dataset(nation)
    out["columns of the dataset"] = s.dataset_vars()[:3]
    s.clear_dataset()
    out["gone again"] = s.has_dataset()
    out["no weights"] = _error(s.get_weights)
    s.set_weights({"q": {"a": 1, "b": 3}})
    out["shares"] = list(s.get_weights()["q"].values())
    out["shares as pairs"] = list(weights.parse_scheme(("q", {"a": 2, "b": 2}))["q"].values())
    out["bad shares"] = _error(lambda: weights.parse_scheme(q={"a": 0}))
    out["weights given"] = [s.resolve_weights(None) is not None, s.resolve_weights(False) is not None, s.resolve_weights(True) is not None]
    s.clear_weights()
    s.register_order_presets()
    out["presets"] = [o["name"] for o in s.list_orders()]
    out["order by name"] = s.get_order("frequency")
    out["order by variable"] = s.order_for("education")[0]
    out["order by prefix"] = s.order_for("ratings_price")[0]
    out["order of another"] = s.order_for("age")
    s.remove_order("frequency")
    out["order removed"] = len(s.list_orders())
    before = s.options(pct_axis_unit=10)["pct_axis_unit"]
    now = s.option("pct_axis_unit")
    s.reset_options()
    out["option"] = [before, now, s.option("pct_axis_unit")]
    out["options"] = [len(s.options()), s.option("output_dir")]
    s.options(pct_axis_max=50)
    s.register_order("sizes", ["S", "M"])
    path = os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), "p.yml")  # the driver's own file
    s.save_profile(path)
    other = state.SurveySession()
    other.load_profile(path)
    out["profile"] = [other.option("pct_axis_max"), other.get_order("sizes")[0]]
    return rows(spark, out)


CHARTS = {
    "bands of three": "BAD 1.000000 3.000000, OK 3.000000 4.000000, GOOD 4.000000 5.000000",
    "bands of nps clipped": "PASSIVE 7.000000 8.500000, PROMOTER 8.500000 10.000000",
    "bands of scores": "NEEDS WORK, GOOD, GREAT, EXCELLENT",
    "bands of five": "5, 0.500000, 5.500000",
    "rescaled": "0.000000, 50.000000, 75.000000, 100.000000",
    "ramp": "#000000, #808080, #FFFFFF",
    "brand of one colour": "#123456, #123456",
    "scales": "5, 3",
    "axis": "0, 75.000000",
    "theme": "True",
    "office theme": "#AA0000, Arial",
}


def graphics(spark: SparkSession, sf_dir: str):
    xml = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme name="x"><a:accent1><a:srgbClr val="AA0000"/></a:accent1></a:clrScheme><a:fontScheme name="x"><a:majorFont><a:latin typeface="Arial"/></a:majorFont><a:minorFont><a:latin typeface="Arial"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
    theme = brand.office_theme(xml)
    label = lambda b: f"{b['label']} {b['from']:.6f} {b['to']:.6f}"
    five = charts.bands_rating_5()
    moved = charts.rescale_bands(charts.bands_rating_3(), (0, 100))
    axis = charts.pct_axis([10, 62])
    return rows(
        spark,
        {
            "bands of three": [label(b) for b in charts.bands_rating_3()],
            "bands of nps clipped": [label(b) for b in charts.bands_nps(lower=7, upper=10)],
            "bands of scores": [b["label"] for b in charts.bands_nps_score()],
            "bands of five": [len(five), five[0]["from"], five[-1]["to"]],
            "rescaled": [moved[0]["from"], *(b["to"] for b in moved)],
            "ramp": charts.ramp(["#000000", "#FFFFFF"], 3),
            "brand of one colour": charts.ramp(["#123456"], 2),
            "scales": [len(charts.scale_rating()["domain"]), len(charts.scale_nps()["domain"])],
            "axis": [axis["scale"]["domain"][0], float(axis["scale"]["domain"][1])],
            "theme": isinstance(charts.theme("xy"), dict),
            "office theme": [_first_colour(theme), _first_font(theme)],
        },
    )


def _first_colour(theme: dict) -> str:
    return next(c for v in theme.values() for c in (v if isinstance(v, (list, tuple)) else [v]) if isinstance(c, str) and c.startswith("#"))


def _first_font(theme: dict) -> str:
    return next(c for v in theme.values() for c in (v if isinstance(v, (list, tuple)) else [v]) if isinstance(c, str) and not c.startswith("#"))


TABLES = {
    "question row": "True, False, False",
    "sheet names": "a_b, a_b_, " + "x" * 28,
    "delimiters": ";, |, ,, None",
    "check-all block": "flag_",
    "banner groups": "o_orderpriority, o_orderstatus",
    "banner blocks": "flag_",
    "kinds": "categorical, numeric, freetext, constant",
    "categorical-like": "True, False",
    "weights rescaled": "25.000000, 75.000000",
    "sidecar": "integer, 2024",
    "folder of a bare name": "True",
}


def tables(spark: SparkSession, sf_dir: str):
    import os
    import tempfile

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    packed = lambda *values: spark.createDataFrame([(v,) for v in values], "x string")
    block = spark.createDataFrame([("A", None, 1), (None, "N", 2), ("A", "N", 3)], "flag_A string, flag_N string, n int")
    kinds = profile.profile(spark.createDataFrame([("a", 1, f"t{i}", "k") if i % 2 else ("b", 2, f"t{i}", "k") for i in range(8)], "c string, n int, f string, k string"))
    chosen = profile.banner_selection(orders, 20)
    with tempfile.TemporaryDirectory(prefix="tallyforge-") as own:  # the driver's own files
        side = os.path.join(own, "t.meta.csv")
        with open(side, "w", encoding="utf-8") as f:
            f.write('kind,name,value\ncolumn,n,integer\nattr,year,"2024"\n')
        said = files.column_types(side)
    return rows(
        spark,
        {
            "question row": [files.looks_like_question_row(x) for x in (["How would you rate it?", "Which of these did you buy?", "Any other thing to add?"], ["How would you rate it?", "Which of these did you buy?", "3"], ["a", "b", "c"])],
            "sheet names": files.sheet_names(["a/b", "a:b", "x" * 40]),
            "delimiters": [tabulate.detect_delimiter(packed(*v), "x") for v in (("a, b; c",), ("a|b, c",), ("a,b",), ("a", ""))],
            "check-all block": list(profile.detect_multiselect(block)),
            "banner groups": [c for c in chosen["cols"] if c.startswith("o_order")],
            "banner blocks": list(profile.banner_selection(block, 20)["multi"]),
            "kinds": [kinds[c]["kind"] for c in "cnfk"],
            "categorical-like": [profile.is_categorical_like(kinds["c"]), profile.is_categorical_like(kinds["n"])],
            "weights rescaled": [float(x) for x in model.rescaled([1, 3])],
            "sidecar": [said["columns"]["n"], said["attrs"]["year"]],
            "folder of a bare name": files.output_path(os.path.join(tempfile.gettempdir(), "x.csv")).endswith("x.csv"),
        },
    )


QUERIES = {"facts_text": (text, TEXT), "facts_session": (session, STATE), "facts_graphics": (graphics, CHARTS), "facts_tables": (tables, TABLES)}
