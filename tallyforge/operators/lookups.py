"""Countries to regions, and amounts between currencies.

Lookup tables are joined; they are small, and Spark broadcasts them after it has seen their size.
"""

from __future__ import annotations

import csv
import functools
import re
import unicodedata
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators.select import check_column
from tallyforge.operators.tabulate import dtypes
from tallyforge.plans.state import current, on_default

#: Units of each currency per US dollar (fixed values).
RATES = {
    "USD": 1, "EUR": 0.92, "GBP": 0.79, "JPY": 150, "CNY": 7.2, "CHF": 0.88, "CAD": 1.36, "AUD": 1.52, "NZD": 1.65, "SEK": 10.5,
    "NOK": 10.7, "DKK": 6.9, "PLN": 4, "CZK": 23.5, "HUF": 370, "RON": 4.6, "BGN": 1.8, "TRY": 35, "RUB": 95, "UAH": 41,
    "BRL": 5, "MXN": 17.5, "ARS": 1000, "CLP": 960, "COP": 4300, "INR": 83, "IDR": 15800, "KRW": 1350, "SGD": 1.34, "HKD": 7.8,
    "TWD": 32, "THB": 34, "MYR": 4.5, "PHP": 58, "VND": 25000, "ZAR": 18.5, "AED": 3.67, "SAR": 3.75, "ILS": 3.6,
}
#: Other names of codes (fixed values).
CURRENCY_ALIASES = {"RMB": "CNY", "YUAN": "CNY", "RENMINBI": "CNY", "DOLLAR": "USD", "EURO": "EUR", "STERLING": "GBP", "QUID": "GBP", "YEN": "JPY", "NIS": "ILS"}

#: Fixed values, as plain files: ``countries.csv`` (country, region, subregion; the states and the territories that
#: surveys meet) and ``country_spellings.csv`` (what respondents type, and the country that they mean).
DATA = Path(__file__).resolve().parent.parent / "data"
#: Codes that are words too: read only when typed in capitals.
AMBIGUOUS = ("no", "it", "at", "be", "in", "my", "id")


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the plain letter of each by Unicode's decomposition; letters
    with a stroke have none and are spelled out."""
    stroked = {"ø": "o", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŧ": "t", "ð": "d"}
    pairs = {ch: unicodedata.normalize("NFKD", ch)[0] for ch in map(chr, range(0xE0, 0x180)) if ch == ch.lower()}
    pairs = {a: b for a, b in pairs.items() if b.isascii() and b.isalpha()} | stroked
    return "".join(pairs), "".join(pairs.values())


def normalise_country(c: Column | str) -> Column:
    """Lower case, no accents or punctuation, single spaces, no leading 'the'."""
    c = F.lower(F.regexp_replace(S.col(c).cast("string"), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    for letter, spelling in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        c = F.replace(c, F.lit(letter), F.lit(spelling))
    c = F.translate(c, *_plain_letters())
    c = F.regexp_replace(c, r"\p{M}", "")
    c = F.regexp_replace(F.regexp_replace(c, "[.,'`]", ""), "[^a-z ]", " ")
    c = F.trim(F.regexp_replace(c, " +", " "))
    return F.regexp_replace(c, "^the ", "")


def read_rows(name: str) -> list[dict[str, str]]:
    with open(DATA / name, encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


@functools.cache
def country_spellings() -> dict[str, str]:
    """What respondents type, in the form of `normalise_country`, and the country that they mean."""
    return {r["spelling"]: r["country"] for r in read_rows("country_spellings.csv")}


def plain_key(name: str) -> str:
    """`normalise_country` of one name of the tables."""
    name = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    name = " ".join(re.sub("[^a-z ]", " ", re.sub("[.,'`]", "", name)).split())
    return name.removeprefix("the ")


def canonical_country(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """The key to look a country up by: what ``aliases`` say that a spelling means, else the name itself."""
    aliases = country_spellings() if aliases is None else aliases
    key = normalise_country(c)
    if not aliases:
        return key
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, plain_key(v))])
    hit = F.try_element_at(table, key)
    raw = S.col(c).cast("string")
    return F.coalesce(F.when(~(key.isin(*AMBIGUOUS) & (raw != F.upper(raw))), hit), key)


def country_table(spark: SparkSession) -> DataFrame:
    """``country, region, subregion``; any table of these columns can be given to the operators instead."""
    rows = [(r["country"], r["region"], r["subregion"]) for r in read_rows("countries.csv")]
    return spark.createDataFrame(rows, "country string, region string, subregion string")


@on_default
def add_region(df: DataFrame | None, country: str, region_to: str = "region", subregion: bool = False, table: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the region (and subregion) of each country; unknown ones are missing."""
    df = current().resolve(df)
    check_column(country, df)
    table = country_table(df.sparkSession) if table is None else table
    keyed = table.groupBy(normalise_country("country").alias("__country")).agg(F.min_by("region", "country").alias("__region"), F.min_by("subregion", "country").alias("__sub"))
    out = df.withColumn("__key", canonical_country(country, aliases)).join(keyed, F.col("__key") == F.col("__country"), "left")
    out = out.withColumn(region_to, F.col("__region"))
    out = out.withColumn("subregion", F.col("__sub")) if subregion else out
    return out.drop("__key", "__country", "__region", "__sub")


@on_default
def recode_region(df: DataFrame | None, country: str, which: str = "region", **options) -> DataFrame:
    which = S.match_arg(which, ("region", "subregion"))
    table = options.pop("table", None)
    df = current().resolve(df)
    table = country_table(df.sparkSession) if table is None else table
    return add_region(df, country, f"{country}_{which}", table=table.withColumn("region", F.col(which)), **options)


@on_default
def recode_subregion(df: DataFrame | None, country: str, **options) -> DataFrame:
    return recode_region(df, country, "subregion", **options)


def currency_code(c: Column) -> Column:
    code = F.upper(S.strip(c))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCY_ALIASES.items() for x in kv]), code), code)


def rate_table(rates) -> dict[str, float]:
    if rates is None:
        return {k: float(v) for k, v in RATES.items()}
    if isinstance(rates, DataFrame):
        value = "per_usd" if "per_usd" in rates.columns else "rate"
        rates = {r[0]: r[1] for r in rates.select("currency", value).collect()}  # one row for each currency
    return {str(k).upper(): float(v) for k, v in dict(rates).items()}


def convert_currency(amount: Column | str, from_: Column | str, to: str = "USD", rates=None) -> Column:
    """``amount`` in ``from_`` (a column of codes) as ``to``; unknown codes give missing."""
    table = rate_table(rates)
    per = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    to = CURRENCY_ALIASES.get(to.strip().upper(), to.strip().upper())
    target = F.lit(table.get(to)).cast("double")
    return S.col(amount).cast("double") / F.try_element_at(per, currency_code(S.col(from_))) * target


@on_default
def add_currency(df: DataFrame | None, amount: str, from_: str, to: str = "USD", into: str | None = None, rates=None) -> DataFrame:
    """``df`` with the amount in ``to``; ``from_`` is a column of codes, or one code for all rows."""
    df = current().resolve(df)
    check_column(amount, df)
    code = F.col(f"`{from_}`") if from_ in df.columns else F.lit(from_)
    n = S.ensure_numeric(amount, dtypes(df)[amount])
    return df.withColumn(into or f"{amount}_{to.lower()}", convert_currency(n, code, to, rates))


def list_currencies(rates=None) -> list[str]:
    return list(rate_table(rates))
