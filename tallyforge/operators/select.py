"""Column selectors and the checks of column names, all on the driver over the schema."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Selector = Callable[[DataFrame], list[str]]


def _many(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _by(match, ignore_case: bool, test) -> Selector:
    low = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    return lambda df: [c for c in df.columns if any(test(low(c), low(m)) for m in _many(match))]


def starts_with(match, ignore_case: bool = True) -> Selector:
    return _by(match, ignore_case, str.startswith)


def ends_with(match, ignore_case: bool = True) -> Selector:
    return _by(match, ignore_case, str.endswith)


def contains(match, ignore_case: bool = True) -> Selector:
    return _by(match, ignore_case, lambda c, m: m in c)


def everything() -> Selector:
    return lambda df: list(df.columns)


def all_of(names) -> Selector:
    def pick(df: DataFrame) -> list[str]:
        gone = [n for n in _many(names) if n not in df.columns]
        if gone:
            raise ValueError(f"Can't select columns that don't exist: {', '.join(gone)}.")
        return _many(names)

    return pick


def any_of(names) -> Selector:
    return lambda df: [n for n in _many(names) if n in df.columns]


def where(test: Callable[[T.StructField], bool]) -> Selector:
    """Columns whose field passes ``test``."""
    return lambda df: [f.name for f in df.schema.fields if test(f)]


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def select_columns(df: DataFrame, *selections) -> list[str]:
    """Names and selectors, nested as they come, in order and each column once."""
    out: list[str] = []
    for s in selections:
        if s is None:
            continue
        if callable(s):
            found = s(df)
        elif isinstance(s, str):
            found = [check_column(s, df)]
        else:
            found = select_columns(df, *s)
        out += [c for c in found if c not in out]
    return out


def select_prefix(df: DataFrame, prefix, keep=None) -> DataFrame:
    return df.select(*[f"`{c}`" for c in select_columns(df, keep or [], starts_with(prefix))])


def select_suffix(df: DataFrame, suffix, keep=None) -> DataFrame:
    return df.select(*[f"`{c}`" for c in select_columns(df, keep or [], ends_with(suffix))])


def edits_within(pattern: str, text: str) -> int:
    """The fewest edits that turn ``pattern`` into some part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def check_column(name: str, df: DataFrame) -> str:
    if name in df.columns:
        return name
    far = math.ceil(0.3 * len(name))
    near = sorted((edits_within(name.lower(), c.lower()), k, c) for k, c in enumerate(df.columns))
    hint = f" Did you mean '{near[0][2]}'?" if near and near[0][0] <= far else ""
    raise ValueError(f"Column '{name}' not found.{hint}")


def column_prefix(name: str) -> str:
    """Up to and including the last underscore."""
    return name if name.endswith("_") else name[: name.rfind("_") + 1]
