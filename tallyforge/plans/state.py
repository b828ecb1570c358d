"""Session state: default table, weights, answer orders and options.  Nothing happens at import."""

from __future__ import annotations

import functools
import os
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

#: Options and their defaults (fixed values).
DEFAULTS = {
    "pct_axis_unit": 25, "pct_axis_max": None, "bar_cols_max_items": 6, "bar_cols_max_label": 12, "bar_wrap_cols": 12,
    "bar_wrap_bars": 28, "bar_label_size": 3.5, "bar_size_step": 0.15, "bar_size_min": 2.4, "bar_width": 0.66, "bar_ref_items": 6, "age_breaks": list(S.AGE_BREAKS), "age_labels": list(S.AGE_LABELS),
    "na_answers": list(S.NA_ANSWERS), "drop_answers": None, "generation_scheme": "pew", "current_year": None, "default_by": None,
    "progress": "auto", "confirm": "auto", "output_dir": "survey-outputs",
    "brand_colors": None, "brand_color_primary": None, "brand_font_major": None, "brand_font_minor": None, "brand_fonts_enabled": True,
    "brand_template_pptx": None, "brand_template_docx": None,
}

#: Answer orders that `register_order_presets` adds (fixed values): name -> (levels, variables, prefixes).
PRESETS = {
    "likert_bad_good": (["Very bad", "Bad", "Ok", "Good", "Very good"], [], ["ratings_"]),
    "likert_agree": (["Strongly disagree", "Disagree", "Neither agree nor disagree", "Agree", "Strongly agree"], [], []),
    "frequency": (["Never", "Rarely", "Sometimes", "Often", "Always"], [], []),
    "likelihood": (["Very unlikely", "Unlikely", "Not sure", "Likely", "Very likely"], ["satis_return"], []),
    "education_isced": (
        ["Primary or less", "Lower secondary", "Upper secondary", "Short-cycle tertiary", "Bachelor or equivalent", "Master or equivalent", "Doctoral or equivalent"],
        ["demo_edu", "education"],
        ["edu_"],
    ),
}


class SurveySession:
    """What a caller sets once and operators look up.  Pass one to operators, or use ``current()``."""

    def __init__(self):
        self._data: DataFrame | None = None
        self._weights: dict | None = None
        self._orders: dict[str, dict] = {}
        self._options: dict = {}

    # default table
    def use_dataset(self, df: DataFrame) -> DataFrame:
        if not isinstance(df, DataFrame):
            raise ValueError("The default dataset must be a DataFrame.")
        self._data = df
        return df

    def get_dataset(self) -> DataFrame:
        if self._data is None:
            raise ValueError("No default dataset is set.")
        return self._data

    def has_dataset(self) -> bool:
        return self._data is not None

    def clear_dataset(self) -> None:
        self._data = None

    def dataset_vars(self) -> list[str]:
        return self.get_dataset().columns

    def resolve(self, df: DataFrame | None) -> DataFrame:
        return self.get_dataset() if df is None else df

    # weights
    def set_weights(self, *specs, **named) -> dict:
        from tallyforge.operators.weights import parse_scheme, weight_diagnostics

        before, self._weights = self._weights, parse_scheme(*specs, **named)
        if self._data is None:
            return {}
        try:
            return weight_diagnostics(self._data, self._weights)
        except Exception:
            self._weights = before
            raise

    def get_weights(self) -> dict:
        if self._weights is None:
            raise ValueError("No weights are set.")
        return self._weights

    def has_weights(self) -> bool:
        return self._weights is not None

    def clear_weights(self) -> None:
        self._weights = None

    def resolve_weights(self, weights) -> dict | None:
        """None: the session's if any; False: none; True: the session's, which must be; else a scheme."""
        from tallyforge.operators.weights import parse_scheme

        if weights is None:
            return self._weights
        if weights is False:
            return None
        return self.get_weights() if weights is True else parse_scheme(weights)

    # orders
    def register_order(self, name: str, levels, vars=None, prefixes=None, overwrite: bool = True) -> None:
        if name in self._orders and not overwrite:
            raise ValueError(f"Order '{name}' exists.")
        many = lambda x: [] if x is None else [x] if isinstance(x, str) else list(x)
        self._orders[name] = {"levels": [str(v) for v in levels], "vars": many(vars), "prefixes": many(prefixes)}

    def register_order_presets(self) -> list[str]:
        for name, (levels, variables, prefixes) in PRESETS.items():
            self.register_order(name, levels, variables, prefixes)
        return list(PRESETS)

    def list_orders(self) -> list[dict]:
        return [{"name": n, "n_levels": len(o["levels"]), "vars": o["vars"], "prefixes": o["prefixes"]} for n, o in sorted(self._orders.items(), key=lambda x: x[0].casefold())]

    def get_order(self, name: str) -> list[str]:
        if name not in self._orders:
            raise ValueError(f"No order named '{name}'.")
        return self._orders[name]["levels"]

    def remove_order(self, name: str) -> None:
        self._orders.pop(name, None)

    def order_for(self, var: str) -> list[str] | None:
        """Exact variable first, over names in order; then the first prefix that fits."""
        names = sorted(self._orders, key=str.casefold)
        for n in names:
            if var in self._orders[n]["vars"]:
                return self._orders[n]["levels"]
        for n in names:
            if any(var.startswith(p) for p in self._orders[n]["prefixes"]):
                return self._orders[n]["levels"]
        return None

    def apply_order(self, df: DataFrame, column: str, name: str | None = None) -> DataFrame:
        """``df`` whose ``column`` carries an order (the named one, or the one for the column) and is text: an answer
        that isn't one of its levels is missing.  Without an order the table stays as it is."""
        levels = self.get_order(name) if name is not None else self.order_for(column)
        return df if levels is None else with_levels(df, column, levels)

    # options
    def options(self, **new) -> dict:
        """All options; or set some (None deletes) and return what they were."""
        if not new:
            return DEFAULTS | self._options
        before = {k: self.option(k) for k in new if k in DEFAULTS}
        for k, v in new.items():
            if k not in DEFAULTS:
                warnings.warn(f"Unknown option '{k}'.", stacklevel=2)
            elif v is None:
                self._options.pop(k, None)
            else:
                self._options[k] = v
        return before

    def reset_options(self) -> None:
        self._options.clear()

    def option(self, name: str):
        return self._options.get(name, DEFAULTS[name])

    # profiles
    def save_profile(self, path: str, include_options: bool = True, include_orders: bool = True) -> str:
        import yaml

        body = ({"options": dict(self._options)} if include_options else {}) | ({"orders": self._orders} if include_orders else {})
        Path(path).write_text(yaml.safe_dump(body, sort_keys=False), encoding="utf-8")
        return path

    def load_profile(self, *paths: str) -> list[str]:
        """Options and orders of YAML files; later ones win; files that can't be read are passed over."""
        import yaml

        used = []
        for p in paths or profile_paths():
            try:
                body = yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}
            except (OSError, yaml.YAMLError):
                continue
            if opts := body.get("options", {k: v for k, v in body.items() if k in DEFAULTS}):
                self.options(**opts)
            for name, o in (body.get("orders") or {}).items():
                self.register_order(name, o["levels"], o.get("vars"), o.get("prefixes"))
            used.append(str(p))
        return used

    def edit_profile(self, path: str | None = None) -> str:
        """The path of a profile to edit, made from the template where there is none."""
        path = path or profile_paths()[-1]
        return path if os.path.exists(path) else self.write_profile_template(path)

    def write_profile_template(self, path: str, overwrite: bool = False) -> str:
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"'{path}' exists.")
        Path(path).write_text("# Persistent defaults: uncomment what you change.\noptions:\n" + "".join(f"  # {k}: {v}\n" for k, v in DEFAULTS.items()) + "orders: {}\n", encoding="utf-8")
        return path


def with_levels(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """``df`` whose ``column`` is text with these answers in this order, others missing; the order travels with the
    column as metadata."""
    dtype = next(f.dataType for f in df.schema.fields if f.name == column)
    text = S.as_text(column, dtype)
    levels = [str(x) for x in levels]
    named = F.when(text.isin(levels), text).alias(column, metadata={"levels": levels})
    return df.select(*[named if c == column else F.col(f"`{c}`") for c in df.columns])


def levels_of(df: DataFrame, column: str) -> list[str] | None:
    """The order that a column carries."""
    return next(f.metadata.get("levels") for f in df.schema.fields if f.name == column)


def factor_order(df: DataFrame, column: str, answers: list[str]) -> list[str] | None:
    """The answers in the order that the column carries, those it doesn't list at the end; None without an order."""
    levels = levels_of(df, column)
    return None if levels is None else [x for x in levels if x in answers] + [x for x in answers if x not in levels]


def carry_levels(out: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """``out`` whose ``columns`` carry the orders that they have in ``source``."""
    kept = {c: levels_of(source, c) for c in columns}
    return out.select(*[F.col(f"`{c}`").alias(c, metadata={"levels": kept[c]}) if kept.get(c) else F.col(f"`{c}`") for c in out.columns])


def factor_levels(df: DataFrame, column: str) -> list[str]:
    """The order that a column carries, else its answers in the order of an English dictionary: a finished column's."""
    dtype = next(f.dataType for f in df.schema.fields if f.name == column)
    known = levels_of(df, column)
    text = S.as_text(column, dtype)
    return known or [r[0] for r in df.select(text.alias("t")).filter("t IS NOT NULL").distinct().orderBy(F.collate("t", "UNICODE"), "t").collect()]


def on_default(f: Callable) -> Callable:
    """Operators called without a table take the session's: their other arguments move up."""

    @functools.wraps(f)
    def call(*args, **options):
        given = "df" in options or args and (args[0] is None or isinstance(args[0], DataFrame))
        return f(*args, **options) if given else f(None, *args, **options)

    return call


def profile_paths() -> list[str]:
    config = os.environ.get("XDG_CONFIG_HOME", os.path.join(os.path.expanduser("~"), ".config"))
    return [os.path.join(config, "tallyforge", "profile.yml"), os.path.join(os.path.expanduser("~"), ".tallyforge.yml"), os.path.join(os.getcwd(), "tallyforge.yml")]


_CURRENT = SurveySession()


def current() -> SurveySession:
    return _CURRENT
