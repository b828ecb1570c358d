"""Bands, palettes and chart specs: plain dicts that any Vega-Lite renderer draws.  Input tables are finished
and small; they are collected here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.plans.state import current, on_default

# Fixed colours: ratings by rank, net promoter groups, the blue ramp that stands in for a brand, neutral.
RATING = {"1": "#FF3300", "2": "#FF3300", "3": "#FFCB3E", "4": "#A7C23D", "5": "#86A33B"}
RATING_DISTINCT = {"1": "#EC2000", "2": "#FF3300", "3": "#FFCB3E", "4": "#A7C23D", "5": "#86A33B"}
NPS = {"-1": "#FF3300", "0": "#FFCB3E", "1": "#86A33B"}
BLUES = ("#8FE2FF", "#43CEFF", "#00B0F0", "#0070C0")
NEUTRAL = "#D9D9D9"
RED, AMBER, LIME, GREEN = (RATING[k] for k in ("1", "3", "4", "5"))


def bands(edges: list[float], labels: list[str], colours: list[str], lower: float | None = None, upper: float | None = None) -> list[dict]:
    return clip_bands([{"label": n, "from": float(a), "to": float(b), "colour": c} for n, a, b, c in zip(labels, edges, edges[1:], colours)], lower, upper)


def clip_bands(rows: list[dict], lower: float | None = None, upper: float | None = None) -> list[dict]:
    """Cut at the limits; bands outside go."""
    out = []
    for r in rows:
        a = r["from"] if lower is None else max(r["from"], lower)
        b = r["to"] if upper is None else min(r["to"], upper)
        if a < b:
            out.append(r | {"from": float(a), "to": float(b)})
    return out


def bands_rating_3(lower=None, upper=None):
    return bands([1, 3, 4, 5], ["BAD", "OK", "GOOD"], [RED, AMBER, GREEN], lower, upper)


def bands_rating_5(lower=None, upper=None):
    return bands([0.5, 1.5, 2.5, 3.5, 4.5, 5.5], ["1\nVery bad", "2", "3\nOk", "4", "5\nVery good"], list(RATING_DISTINCT.values()), lower, upper)


def bands_nps(lower=None, upper=None):
    """Around the answers 0 to 10, half a point on each side."""
    return bands([-0.5, 6.5, 8.5, 10.5], ["DETRACTOR", "PASSIVE", "PROMOTER"], list(NPS.values()), lower, upper)


def bands_nps_score(lower=None, upper=None):
    return bands([-100, 0, 30, 70, 100], ["NEEDS WORK", "GOOD", "GREAT", "EXCELLENT"], [RED, AMBER, LIME, GREEN], lower, upper)


def rescale_bands(rows: list[dict], to: tuple[float, float], from_: tuple[float, float] | None = None) -> list[dict]:
    """Edges mapped linearly to another scale."""
    a, b = from_ or (min(r["from"] for r in rows), max(r["to"] for r in rows))
    f = lambda x: to[0] + (x - a) / (b - a) * (to[1] - to[0])
    return [r | {"from": f(r["from"]), "to": f(r["to"])} for r in rows]


def band_of(value: Column | str, rows: list[dict], what: str = "label") -> Column:
    """The last band that begins at or below the value; values outside take the first or last."""
    v = S.col(value)
    out = F.when(v.isNull(), F.lit(None))
    for r in reversed(rows[1:]):
        out = out.when(v >= r["from"], r[what])
    return out.otherwise(rows[0][what])


def ramp(colours: list[str], n: int) -> list[str]:
    """``n`` colours between the given ones."""
    rgb = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in colours]
    out = []
    for k in range(n):
        t = 0 if n == 1 else k * (len(rgb) - 1) / (n - 1)
        i = min(int(t), len(rgb) - 2) if len(rgb) > 1 else 0
        j = min(i + 1, len(rgb) - 1)
        out.append("#" + "".join(f"{int(a + (b - a) * (t - i) + 0.5):02X}" for a, b in zip(rgb[i], rgb[j])))
    return out


def pal_brand(n: int | None = None) -> list[str]:
    """The brand's accents, or its one colour, or blues; more than there are come from between them."""
    own = current().option("brand_colors") or current().option("brand_color_primary") or BLUES
    own = [own] if isinstance(own, str) else list(own)
    return own if n is None else own[:n] if n <= len(own) else ramp(own, n)


def rating_colours(levels: list[str]) -> dict[str, str]:
    """A colour from red to green for each level: by its first digit from 1 to 5 if all have one, else by rank."""
    levels = list(dict.fromkeys(str(v) for v in levels if v is not None))
    digit = {v: next((c for c in v if c in "123456789"), None) for v in levels}
    if levels and all(d in RATING_DISTINCT for d in digit.values()):
        return {v: RATING_DISTINCT[d] for v, d in digit.items()}
    ranked = sorted(levels, key=lambda v: digit[v] or "~")
    colour = dict(zip(ranked, ramp([RED, AMBER, GREEN], len(levels))))
    return {v: colour[v] for v in levels}


def scale_rating(distinct: bool = False) -> dict:
    """For a colour channel: ranks 1 to 5."""
    p = RATING_DISTINCT if distinct else RATING
    return {"domain": list(p), "range": list(p.values())}


def scale_nps() -> dict:
    return {"domain": list(NPS), "range": list(NPS.values())}


def scale_brand(levels: list[str]) -> dict:
    return {"domain": list(levels), "range": pal_brand(len(levels))}


def pct_axis(values=None, unit: float = 25, pad: float = 0, top: float | None = None, labels=True) -> dict:
    """A percentage axis: up to ``top``, else above the largest value, else left to the renderer."""
    if not (labels in (True, False) or callable(labels)):
        raise ValueError("`labels` must be True, False or a function.")
    limit = top if top is not None else None if values is None else S.nice_max(values, unit, pad)
    axis = {"labels": False} if labels is False else {"format": S.label_pct() if labels is True else labels}
    return {"type": "quantitative", "axis": axis} | ({} if limit is None else {"scale": {"domain": [0, limit]}})


def theme(grid: str = "", base_size: float = 11, family: str | None = None, transparent: bool = False) -> dict:
    """A chart's ``config``: no ticks, no legend, grid lines along the axes named in ``grid`` (x, y or xy)."""
    o = current().option
    family = family or (o("brand_font_minor") if o("brand_fonts_enabled") else None) or "sans-serif"
    axis = lambda a: {"ticks": False, "grid": a in grid, "labelFontSize": base_size * 1.25, "titleFontStyle": "italic"}
    back = None if transparent else "white"
    return {"font": family, "background": back, "legend": {"disable": True}, "title": {"fontWeight": "bold", "fontSize": base_size * 1.5}, "axisX": axis("x"), "axisY": axis("y")}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _label(df: DataFrame, label: str | None, value: str) -> str:
    return label or next(c for c in df.columns if c not in ("n", value))


def bars(df: DataFrame, label: str | None = None, value: str = "pct", orientation: str = "auto", title: str | None = None) -> dict:
    """Columns for a few short labels, bars otherwise; the axis ends above the largest value."""
    rows, label = _rows(df), _label(df, label, value)
    o = current().option
    if orientation == "auto":
        long = any(len(str(r[label])) > o("bar_cols_max_label") for r in rows)
        orientation = "bars" if len(rows) > o("bar_cols_max_items") or long else "columns"
    top = o("pct_axis_max") or S.nice_max([r[value] for r in rows], o("pct_axis_unit"))
    wrap = o("bar_wrap_cols" if orientation == "columns" else "bar_wrap_bars")
    data = [r | {label: S.wrap_text(str(r[label]), wrap), "text": S.label_pct()(r[value])} for r in rows]
    name = {"field": label, "type": "nominal", "sort": None, "title": None}
    size = {"field": value, "type": "quantitative", "scale": {"domain": [0, top]}}
    return {"mark": {"type": "bar", "width": {"band": min(0.9, o("bar_width") * len(rows) / o("bar_ref_items"))}}, "data": {"values": data}, "encoding": {"x": name, "y": size} if orientation == "columns" else {"x": size, "y": name}, "title": title}


def stacked_rating(df: DataFrame, feature: str, level: str, value: str = "pct", label_min: float = 1) -> dict:
    """100 % bars by feature, best average first; a level's leading digit is its rank."""
    rows = _rows(df)
    rank = lambda r: S.number_in(str(r[level])) or 0.0
    mean: dict = {}
    for r in rows:
        mean[r[feature]] = mean.get(r[feature], 0.0) + rank(r) * (r[value] or 0) / 100
    order = sorted(mean, key=lambda f: -mean[f])
    data = [r | {"text": f"{r[value]:.0f}%" if (r[value] or 0) >= label_min else "", "average": mean[r[feature]]} for r in rows]
    return {"mark": "bar", "data": {"values": data}, "encoding": {"y": {"field": feature, "sort": order}, "x": {"field": value, "stack": "normalize"}, "color": {"field": level}}}


@on_default
def rating_grid(df: DataFrame | None, prefix: str, levels=None, digits: int = 2, label_min: float = 1) -> dict:
    """A block of rating questions stacked by question, answers numbered by their place on the scale (``levels``,
    else the block's registered order, else five points).  ``unranked``: answers that are not on the scale;
    ``clashes``: ranks that two answers share."""
    from tallyforge.operators.select import all_of
    from tallyforge.operators.tabulate import calc_percentage_batch

    df = current().resolve(df)
    columns = [c for c in df.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"No columns start with '{prefix}'.")
    levels = levels or current().order_for(columns[0]) or S.LIKERT_LEVELS
    shares = calc_percentage_batch(df, all_of(columns), digits=digits, prefix=prefix)
    rank = S.recode_likert("answer", levels=levels)
    ranked = shares.withColumn("rank", rank).withColumn("answer_text", F.col("answer"))
    ranked = ranked.withColumn("answer", F.concat(F.coalesce(rank.cast("string"), F.lit("NA")), F.lit(" - "), F.col("answer")))
    spec = stacked_rating(ranked, "variable", "answer", label_min=label_min)
    texts: dict = {}
    for r in spec["data"]["values"]:
        texts.setdefault(r["rank"], set()).add(r["answer_text"])
    clashes = {k: sorted(v) for k, v in texts.items() if k is not None and len(v) > 1}
    return spec | {"unranked": sorted(texts.get(None, ())), "clashes": clashes, "colours": rating_colours([r["answer"] for r in spec["data"]["values"]])}


def gauges(scores: dict[str, float], scales=None, title: str | None = None) -> dict:
    """Scores one below the other, each with its bands and marker mapped to 0..1 of its own scale."""
    scales = [scales] * len(scores) if scales is None or isinstance(scales, str) else list(scales)
    if len(scales) != len(scores):
        raise ValueError("Give one scale, or one for each score.")
    rows = []
    for (name, score), scale in zip(scores.items(), scales):
        g = gauge(score, scale or "auto")
        lo, hi = g["bands"][0]["from"], g["bands"][-1]["to"]
        text = f"{score:.2f} / 5" if hi == 5 else f"{round(score):+d}"
        rows.append({"name": name, "score": score, "text": text, "label": g["label"], "at": min(1.0, max(0.0, (score - lo) / (hi - lo))), "bands": rescale_bands(g["bands"], (0, 1))})
    return {"mark": "gauges", "rows": rows, "title": title}


def gauge(score: float, scale: str = "auto", title: str | None = None) -> dict:
    """One score on its banded scale; a score from 1 to 5 is taken for a rating."""
    if scale == "auto":
        scale = "rating" if 1 <= score <= 5 else "nps"
    rows = bands_rating_3() if scale == "rating" else bands_nps_score()
    label = next((r["label"] for r in reversed(rows) if score >= r["from"]), rows[0]["label"])
    return {"mark": "gauge", "score": score, "bands": rows, "label": label, "title": title}


def nps_chart(df: DataFrame, value: str) -> dict:
    from tallyforge.operators.model import nps_distribution

    rows = _rows(nps_distribution(df, value))
    sums = {g: sum(r["pct"] or 0 for r in rows if r["group"] == g) for g in ("Detractor", "Passive", "Promoter")}
    return {"mark": "bar", "data": {"values": rows}, "encoding": {"x": {"field": "score"}, "y": {"field": "pct"}, "color": {"field": "group"}}, "callouts": sums}


def ipm_chart(df: DataFrame) -> dict:
    rows = _rows(df)
    return {"mark": "point", "data": {"values": rows}, "encoding": {"x": {"field": "performance"}, "y": {"field": "importance"}}, "bands": bands_rating_3(), "off_scale": [r["feature"] for r in rows if not 1 <= (r["performance"] or 0) <= 5]}


def diff_chart(df: DataFrame, label: str = "feature", difference: str = "difference", digits: int = 2) -> dict:
    """Diverging bars, largest gain first, with signed labels and symmetric limits."""
    rows = sorted((r for r in _rows(df) if r[difference] is not None), key=lambda r: -r[difference])
    top = 1.25 * max((abs(r[difference]) for r in rows), default=1)
    data = [r | {"text": f"{r[difference]:+.{digits}f}" if round(r[difference], digits) > 0 else f"{r[difference]:.{digits}f}", "colour": GREEN if r[difference] > 0 else AMBER} for r in rows]
    return {"mark": "bar", "data": {"values": data}, "encoding": {"y": {"field": label, "sort": None}, "x": {"field": difference, "scale": {"domain": [-top, top]}}}}


def quote_tiles(sizes: list[float], width: float = 10.0, height: float = 5.6) -> list[tuple[float, float, float, float]]:
    """A rectangle (left, top, right, bottom) for each size, areas in proportion, largest first: rows are filled along
    the shorter side for as long as that makes the worst tile squarer."""
    total = float(sum(sizes))
    areas = [s * width * height / total for s in sorted(sizes, reverse=True) if s > 0]
    x, y, w, h, out, k = 0.0, 0.0, width, height, [], 0
    while k < len(areas):
        side, row = min(w, h), [areas[k]]
        worst = lambda r: max(max(side**2 * a / sum(r) ** 2, sum(r) ** 2 / (side**2 * a)) for a in r)  # noqa: B023, E731
        while k + len(row) < len(areas) and worst([*row, areas[k + len(row)]]) <= worst(row):
            row.append(areas[k + len(row)])
        deep, at = sum(row) / side, 0.0
        for a in row:
            out.append((x, y + at, x + deep, y + at + a / deep) if w >= h else (x + at, y, x + at + a / deep, y + deep))
            at += a / deep
        x, y, w, h = (x + deep, y, w - deep, h) if w >= h else (x, y + deep, w, h - deep)
        k += len(row)
    return out


def quotes_tree(df: DataFrame, label: str = "comment", area: str = "length") -> dict:
    return {"mark": "treemap", "data": {"values": _rows(df)}, "encoding": {"size": {"field": area}, "text": {"field": label}}}


def annotate_bands(spec: dict, rows: list[dict], axis: str = "x") -> dict:
    return spec | {"bands": rows, "band_axis": S.match_arg(axis, ("x", "y"))}


def mark_value(spec: dict, value: float, axis: str = "x", label: str | None = None) -> dict:
    return spec | {"marks": [*spec.get("marks", []), {"value": value, "axis": axis, "label": label}]}
