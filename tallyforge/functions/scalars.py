"""Column builders for survey answers: text forms, missing values, rounding, recodes, precision formulas.

Every function takes and returns a Column (or a column name) and stays inside Catalyst.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default answers and cut-offs (fixed values).
NA_ANSWERS = ("Prefer not to answer",)
AGE_BREAKS = (0, 18, 22, 26, 30, 35, math.inf)
AGE_LABELS = ("17 or younger", "18 to 21", "22 to 25", "26 to 29", "30 to 34", "35+")
LIKERT_LEVELS = ("Very bad", "Bad", "Ok", "Good", "Very good")
GENERATIONS = (("Silent", 1928), ("Baby Boomer", 1946), ("Gen X", 1965), ("Millennial", 1981), ("Gen Z", 1997), ("Gen Alpha", 2013))
PRECISION_BANDS = ((5, "high precision"), (10, "precise"), (15, "satisfactory"), (25, "use with caution"))
WORST_PRECISION = "likely reliability issues"
Z_95 = 1.96
NUMBER_PATTERN = r"-?[0-9]*\.?[0-9]+"


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def squish(c: Column | str) -> Column:
    """``strip``, and inner runs of white space as one space."""
    return strip(F.regexp_replace(col(c), r"\s+", " "))


def known(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """The value, NaN counting as missing."""
    c = col(c)
    return F.when(~F.isnan(c), c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _side(x: Column, longer: Column, k: Column) -> Column:
    """-1, 0 or 1: a positive double against the decimal of its first 16 digits over 10^``k``, 0 <= k <= 22, by an
    exact product (Dekker)."""
    ten = F.element_at(F.array(*[F.lit(float(10**i)) for i in range(23)]), (k + 1).cast("int"))
    top = lambda a: a * F.lit(134217729.0) - (a * F.lit(134217729.0) - a)
    parts = bound(F.struct(x.alias("x"), ten.alias("t"), F.substring(longer, 1, 16).try_cast("long").alias("n")), lambda v: F.struct(v["x"].alias("x"), v["t"].alias("t"), v["n"].alias("n"), top(v["x"]).alias("xh"), top(v["t"]).alias("th"), (v["x"] * v["t"]).alias("p")))

    def compare(v: Column) -> Column:
        xl, tl, whole = v["x"] - v["xh"], v["t"] - v["th"], F.floor(v["p"])
        error = ((v["xh"] * v["th"] - v["p"]) + v["xh"] * tl + xl * v["th"]) + xl * tl
        return F.signum((whole - v["n"]).cast("double") + (v["p"] - whole) + error)

    return bound(parts, compare)


def significant(d: Column) -> Column:
    """A number's text of up to 15 significant digits: plain from 0.0001 to below 10^15, else with an exponent of
    two digits or more.  The digits are those of the exact binary value, rounded half to even; numbers outside
    1e-7..1e16 whose shortest text has 16 digits, the last a five, are rounded by that text."""
    digits = lambda e: F.replace(F.substring_index(e, "e", 1), F.lit("."), F.lit(""))
    power = lambda e: F.substring_index(e, "e", -1).try_cast("int")

    def rounded(v: Column) -> Column:
        k = 15 - power(v["long"])
        tie = digits(v["long"]).endswith("50") & k.between(0, 22)
        side = F.when(tie, _side(v["x"], digits(v["long"]), k))
        even = F.substring(digits(v["long"]), 15, 1).try_cast("int") % 2 == 0
        down = bound(side, lambda s: F.coalesce((s < 0) | (s == 0) & even, F.lit(False)))
        cut = lambda w: F.struct(F.regexp_replace(F.when(w, F.substring(digits(v["long"]), 1, 15)).otherwise(digits(v["short"])), "(?<=.)0+$", "").alias("kept"), F.when(w, power(v["long"])).otherwise(power(v["short"])).alias("power"))
        return bound(down, cut)

    def spelled(v: Column) -> Column:
        kept, at, n = v["kept"], v["power"], F.length(v["kept"])
        size = F.abs(at).cast("string")
        above = F.when(n > at + 1, F.concat(kept.substr(F.lit(1), at + 1), F.lit("."), kept.substr(at + 2, n))).otherwise(F.rpad(kept, F.greatest(at + 1, n), F.lit("0")))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -at - 1), kept)
        head = F.when(n > 1, F.concat(F.substring(kept, 1, 1), F.lit("."), kept.substr(F.lit(2), n))).otherwise(kept)
        science = F.concat(head, F.when(at < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
        return F.when((at < -4) | (at >= 15), science).when(at >= 0, above).otherwise(below)

    texts = F.struct(F.abs(d).alias("x"), F.format_string("%.14e", F.abs(d)).alias("short"), F.format_string("%.16e", F.abs(d)).alias("long"))
    return F.concat(F.when(d < 0, "-").otherwise(""), bound(bound(texts, rounded), spelled))


def as_text(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Text as a respondent would read it: whole numbers without a point, others with up to 15 significant digits,
    TRUE and FALSE, Inf."""
    c = col(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "TRUE").when(~c, "FALSE")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(F.isnan(d), F.lit(None)).when(d == math.inf, "Inf").when(d == -math.inf, "-Inf").when(whole, d.cast("bigint").cast("string")).otherwise(significant(d))
    return c.cast("string")


def na_blank(c: Column | str, also: Sequence[str] | str | None = None, trim: bool = True, na_answers: Sequence[str] = NA_ANSWERS, dtype: T.DataType | None = None) -> Column:
    """Blank answers and the configured non-answers as missing; the result is text."""
    gone = ["", *na_answers, *([also] if isinstance(also, str) else also or [])]
    t = as_text(c, dtype)
    t = strip(t) if trim else t
    return F.when(~t.isin(gone), t)


def dropped(c: Column | str, items: Sequence[str] | str, dtype: T.DataType | None = None) -> Column:
    """Whether the answer is one of ``items``, ignoring case and outer white space; never missing."""
    wanted = [str(i).strip().lower() for i in ([items] if isinstance(items, str) else items)]
    return F.coalesce(F.lower(strip(as_text(c, dtype))).isin(wanted), F.lit(False))


def drop_items(c: Column | str, items: Sequence[str] | str) -> Column:
    """Missing where the answer is one of ``items``; other answers as they are."""
    return F.when(~dropped(c, items), col(c))


def ensure_numeric(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Numbers as they are; of text, the first number in it."""
    if isinstance(dtype, T.NumericType):
        return known(col(c).cast("double"), T.DoubleType())
    return F.regexp_substr(col(c).cast("string"), F.lit(NUMBER_PATTERN)).cast("double")


def r_round(c: Column | str, digits: int = 0) -> Column:
    """The nearer of the two candidates in double arithmetic, ties to the even one; numbers with more than
    15 significant digits, infinities and 0 as they are."""
    c = col(c).cast("double")
    digits = math.floor(digits + 0.5)
    if digits <= 0:
        p = 10.0**-digits
        return F.when(F.abs(c) < 1e15, F.bround(c / p, 0) * p).otherwise(c) if digits else F.when(F.abs(c) < 1e15, F.bround(c, 0)).otherwise(c)
    p = F.lit(10.0**digits)
    x = F.abs(c)
    low = F.floor(x * p).cast("double")
    lo, hi = low / p, F.ceil(x * p).cast("double") / p
    below, above = x - lo, hi - x
    near = F.when(below < above, lo).when(above < below, hi).when(low % 2 == 0, lo).otherwise(hi)
    too_long = F.floor(F.log10(x)) + 1 + digits > 15
    return F.when(x == 0, c).when(F.isnan(c) | (x == math.inf) | (x >= 1e15), c).when(too_long, c).otherwise(F.signum(c) * near)


def clean_label(c: Column | str, prefix: str | None = None) -> Column:
    """A readable label from a column name; ``clean_name`` is the same for one name."""
    c = col(c)
    if prefix:
        c = F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)
    c = F.replace(F.replace(c, F.lit("..."), F.lit(" / ")), F.lit("."), F.lit(" "))
    return squish(c)


def clean_name(name: str, prefix: str | None = None) -> str:
    if prefix and name.startswith(prefix):
        name = name[len(prefix) :]
    return " ".join(name.replace("...", " / ").replace(".", " ").split())


def cut(c: Column | str, breaks: Sequence[float], labels: Sequence[str], right: bool = True, include_lowest: bool = False) -> Column:
    """The label of the interval that holds the value; the outer edge is closed by ``include_lowest``."""
    if len(labels) != len(breaks) - 1:
        raise ValueError(f"{len(breaks)} breaks make {len(breaks) - 1} bands, but there are {len(labels)} labels.")
    c, out = col(c).cast("double"), None
    for k, label in enumerate(labels):
        lo, hi = float(breaks[k]), float(breaks[k + 1])
        if right:
            inside = (c > lo) & (c <= hi)
            inside = inside | (c == lo) if include_lowest and k == 0 else inside
        else:
            inside = (c >= lo) & (c < hi)
            inside = inside | (c == hi) if include_lowest and k == len(labels) - 1 else inside
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bin_numeric(c: Column | str, breaks: Sequence[float], labels: Sequence[str], right: bool = False, dtype: T.DataType | None = None) -> Column:
    return cut(ensure_numeric(c, dtype), breaks, labels, right, include_lowest=True)


def recode_age(c: Column | str, breaks: Sequence[float] = AGE_BREAKS, labels: Sequence[str] = AGE_LABELS, dtype: T.DataType | None = None) -> Column:
    return bin_numeric(c, breaks, labels, dtype=dtype)


def generation_scheme(scheme: str = "pew") -> list[tuple[str, float, float]]:
    """(label, first birth year, last birth year) of each cohort."""
    if scheme != "pew":
        raise ValueError(f"Unknown scheme '{scheme}'.")
    ends = [start - 1.0 for _, start in GENERATIONS[1:]] + [math.inf]
    return [(label, float(start), end) for (label, start), end in zip(GENERATIONS, ends)]


def recode_generation(c: Column | str, input: str = "age", year: int | None = None, scheme: Sequence[tuple] | None = None, dtype: T.DataType | None = None) -> Column:
    """Cohort of an age (as of ``year``, this year if None) or of a birth year."""
    if input not in ("age", "year"):
        raise ValueError("`input` must be 'age' or 'year'.")
    cohorts = sorted(scheme or generation_scheme(), key=lambda r: r[1])
    n = ensure_numeric(c, dtype)
    born = n if input == "year" else (F.year(F.current_date()) if year is None else F.lit(float(year))) - n
    return cut(born, [*(r[1] for r in cohorts), math.inf], [r[0] for r in cohorts], right=False, include_lowest=True)


def recode_likert(c: Column | str, levels: Sequence[str] = LIKERT_LEVELS, synonyms: dict | None = None) -> Column:
    """1..k: exact level first, then the longest level that the answer contains, then synonyms likewise."""
    lower = F.lower(col(c).cast("string"))
    low = [x.lower() for x in levels]
    out = reduce(lambda w, i: w.when(strip(lower) == low[i], i + 1), range(1, len(low)), F.when(strip(lower) == low[0], 1))

    def contained(out: Column, needles: list[tuple[str, int]]) -> Column:
        for needle, target in sorted(needles, key=lambda x: -len(x[0])):  # stable: ties keep their order
            out = out.when(lower.contains(needle), target)
        return out

    out = contained(out, [(x, i + 1) for i, x in enumerate(low)])
    if synonyms:
        more = []
        for name, spellings in synonyms.items():
            if name.lower() not in low:
                raise ValueError(f"Synonym target '{name}' is not one of `levels`.")
            more += [(s.lower(), low.index(name.lower()) + 1) for s in ([spellings] if isinstance(spellings, str) else spellings)]
        out = contained(out, more)
    return out.cast("int")


def nps_group(c: Column | str, labels: bool = False, dtype: T.DataType | None = None) -> Column:
    """-1, 0, 1 (or names) for 0-6, 7-8 and 9-10; values between the bands or outside are missing."""
    n = ensure_numeric(c, dtype)
    names = ("Detractor", "Passive", "Promoter") if labels else (-1, 0, 1)
    return F.when(n.between(0, 6), names[0]).when(n.between(7, 8), names[1]).when(n.between(9, 10), names[2])


# Precision ----------------------------------------------------------------------------------------------


def se_mean(c: Column | str) -> Column:
    """Aggregate: sd over the root of n; missing for fewer than two values."""
    c = col(c)
    return F.when(F.count(c) > 1, F.stddev_samp(c) / F.sqrt(F.count(c)))


def se_prop(p: Column | float, n: Column | float, percent: bool = False) -> Column:
    """Standard error of a share; a share above 1 is read as a percentage; infinite without answers."""
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n
    p = F.when(p > 1, p / 100).otherwise(p)
    out = F.when(n <= 0, F.lit(math.inf)).otherwise(F.sqrt(p * (1 - p) / F.when(n > 0, n)))
    return out * 100 if percent else out


def rse(estimate: Column, se: Column) -> Column:
    """Relative standard error in percent, with IEEE division."""
    return F.when(estimate != 0, se / F.when(estimate != 0, estimate) * 100).when(se > 0, F.lit(math.inf)).when(se < 0, F.lit(-math.inf)).otherwise(F.when(se.isNotNull() & estimate.isNotNull(), F.lit(math.nan)))


def margin_of_error(se: Column, z: float = Z_95) -> Column:
    return se * F.lit(float(z))


def rse_rating(value: Column) -> Column:
    out = None
    for limit, label in PRECISION_BANDS:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out.when(value.isNotNull() & ~F.isnan(value), WORST_PRECISION)


# Small helpers on the driver ---------------------------------------------------------------------------


def nice_max(x: Sequence[float] | float, unit: float = 25, pad: float = 0) -> float:
    """The next multiple of ``unit`` above the largest value, and ``pad`` more."""
    if unit <= 0:
        raise ValueError("`unit` must be above 0.")
    values = [float(v) for v in (x if isinstance(x, (list, tuple)) else [x]) if v is not None and not math.isnan(float(v))]
    if not values:
        return math.nan
    top = max(values)
    return top if math.isinf(top) else (math.floor(top / unit) + 1) * unit + pad


def label_pct(digits: int = 0, suffix: str = "%"):
    """A formatter of numbers."""
    return lambda v: f"NA{suffix}" if v is None or math.isnan(v) else f"{v:.{digits}f}{suffix}"


def wrap_text(text: str, width: int) -> str:
    """Greedy lines of at most ``width`` characters; a longer word has a line of its own."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return "\n".join(lines)


def break_lines(text: str, width: int, indent: int = 0) -> list[str]:
    """Greedy lines shorter than ``width``, all but the first indented; a longer word has a line of its own."""
    lines: list[str] = [""]
    for word in str(text).split():
        room = width - 1 - (indent if len(lines) > 1 else 0)
        if not lines[-1]:
            lines[-1] = word
        elif len(lines[-1]) + 1 + len(word) <= room:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return [lines[0], *(" " * indent + x for x in lines[1:])]


def make_unique(names: Sequence[str], sep: str = ".") -> list[str]:
    """Repeats get a counter: a, a.1, a.2."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if k == 0 else f"{n}{sep}{k}")
    return out


def match_arg(value: str, choices: Sequence[str]) -> str:
    """The choice that ``value`` names in full or abbreviates without doubt."""
    if value in choices:
        return value
    hits = [c for c in choices if c.startswith(value)]
    if len(hits) != 1:
        raise ValueError(f"'{value}' should be one of {', '.join(choices)}.")
    return hits[0]


def number_in(text: str) -> float | None:
    m = re.search(NUMBER_PATTERN, text)
    return float(m[0]) if m else None
