"""Folders of survey exports in, tables out."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import scalars as S
from tallyforge.operators.select import check_column
from tallyforge.plans.state import current, on_default

SHEET_CHARS = 28


def _names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files of a folder whose names fit, through Spark's file system, so that any store it reads will do."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise ValueError(f"Folder '{path}' does not exist.")
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isFile())
    found = [n for n in names if re.search(pattern, n)]
    if not found:
        raise ValueError(f"No file in '{path}' fits '{pattern}'.")
    return found


def looks_like_question_row(cells: list[str | None]) -> bool:
    """Question wordings rather than answers: three or more, none a number, half of them long phrases."""
    filled = [c for c in cells if c]
    if len(cells) < 3 or len(filled) < 3 or any(re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", c) for c in filled):
        return False
    return sum(len(c) > 20 and " " in c for c in filled) >= len(filled) / 2


def _read_csv(spark: SparkSession, paths: list[str], infer: bool, encoding: str) -> DataFrame:
    return spark.read.csv(paths, header=True, inferSchema=infer, encoding=encoding, multiLine=True, escape='"', nullValue="NA", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _first_rows(spark: SparkSession, path: str, encoding: str, n: int = 2) -> list[list[str | None]]:
    """The first rows of a CSV file: a few lines that the driver reads, whatever the file's size."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at), encoding))
    try:
        text, rows = "", []
        while len(rows) < n and (line := lines.readLine()) is not None:
            text += line + "\n"
            if text.count('"') % 2 == 0 and text.strip():
                rows = list(csv.reader(text.removeprefix("\ufeff").splitlines(True)))
        return [[None if c in ("", "NA") else c for c in r] for r in rows if r]
    finally:
        lines.close()


def read_folder(spark: SparkSession, path: str, pattern: str = r"\.csv$", id: str = "file", all_character: bool = True, question_row: bool | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All matching files by name, one below the other by column name, with the file's name in ``id``.

    Files with the same header are one read, so the plan grows with the number of headers, not of files.  Cells are
    text: empty and ``NA`` are missing, then white space goes.  ``question_row``: True drops the first row of each file,
    False keeps it, None keeps it and records in the ``id`` column's metadata (``question_rows``) which files seem to
    have one.
    """
    by_header: dict[tuple, list[str]] = {}
    suspects = []
    for name in _names(spark, path, pattern):
        rows = _first_rows(spark, f"{path}/{name}", encoding)
        by_header.setdefault(tuple(rows[0]) if rows else (), []).append(name)
        if question_row is None and len(rows) > 1 and looks_like_question_row(rows[1]):
            suspects.append(name)
    parts = []
    for header, same in by_header.items():
        if not header:
            continue
        d = _read_csv(spark, [f"{path}/{n}" for n in same], not all_character, encoding)
        d = d.select(*[f"`{c}`" for c in d.columns], F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("__name"))
        if question_row:
            d = d.withColumn("__row", F.monotonically_increasing_id())
            first = d.groupBy(F.col("__name").alias("__of")).agg(F.min("__row").alias("__first"))
            d = d.join(F.broadcast(first), (F.col("__name") == F.col("__of")) & (F.col("__row") == F.col("__first")), "left_anti").drop("__row")
        texts = [f.name for f in d.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "__name"]
        d = d.withColumns({c: F.when(F.col(f"`{c}`") != "", S.strip(c)) for c in texts})
        parts.append(d.withColumn(id, F.col("__name")).drop("__name"))
    if not parts:
        raise ValueError(f"The files in '{path}' are empty.")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(f"`{c}`").alias(c, metadata={"question_rows": suspects}) if c == id else F.col(f"`{c}`") for c in [id, *(c for c in out.columns if c != id)]])


@on_default
def parse_filename(df: DataFrame | None, col: str = "file", into: list[str] | None = None, sep: str = "_", drop_ext: bool = True, remove: bool = False) -> DataFrame:
    """The parts of a name between ``sep`` as columns ``into``; what a name lacks is missing, what it has more is cut."""
    df = current().resolve(df)
    check_column(col, df)
    if not into:
        raise ValueError("Name at least one column in `into`.")
    name = F.col(f"`{col}`")
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "") if drop_ext else name, re.escape(sep), -1)
    out = df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(into)})
    return out.drop(col) if remove else out


def read_typed_csv(spark: SparkSession, path: str, types: dict[str, str], missing: str = "<NA>") -> DataFrame:
    """A CSV file with a sidecar of column kinds (integer, numeric, logical, character); unlisted ones are text."""
    kinds = {"integer": T.LongType(), "numeric": T.DoubleType(), "logical": T.BooleanType()}
    header = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, kinds.get(types.get(c, "character"), T.StringType())) for c in header])
    return spark.read.csv(path, header=True, schema=schema, nullValue=missing, multiLine=True, escape='"')


def column_types(path: str) -> dict[str, dict[str, str]]:
    """What a sidecar file (``kind, name, value``) says: ``columns`` with their types, and other ``attrs``."""
    out: dict[str, dict[str, str]] = {"columns": {}, "attrs": {}}
    with open(path, encoding="utf-8", newline="") as f:
        for r in csv.DictReader(f):
            out["columns" if r["kind"] == "column" else "attrs"][r["name"]] = r["value"]
    return out


def read_dataset(spark: SparkSession, path: str, missing: str = "<NA>") -> DataFrame:
    """A CSV file typed by the sidecar beside it (``name.meta.csv`` for ``name.csv``), if there is one."""
    side = f"{os.path.splitext(path)[0]}.meta.csv"
    return read_typed_csv(spark, path, column_types(side)["columns"] if os.path.exists(side) else {}, missing)


def load_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A table that comes with the package: ``country_region`` or ``cur``."""
    from tallyforge.operators import lookups

    if name == "country_region":
        return lookups.country_table(spark)
    if name == "cur":
        return spark.createDataFrame([(k, float(v)) for k, v in lookups.RATES.items()], "currency string, per_usd double")
    raise ValueError(f"Unknown dataset '{name}'. Bundled: country_region, cur.")


def csv_cell(c, dtype) -> F.Column:
    """A cell's text in a CSV file: whole numbers without a point."""
    return S.as_text(c, dtype)


def output_path(path: str) -> str:
    """Bare names go to the option's folder; paths with a folder are kept; folders are made."""
    full = path if os.path.dirname(path) else os.path.join(current().option("output_dir"), path)
    os.makedirs(os.path.dirname(os.path.abspath(full)), exist_ok=True)
    return full


def _rows(df: DataFrame, na: str) -> list[list[str]]:
    texts = df.select(*[F.coalesce(csv_cell(f.name, f.dataType), F.lit(na)).alias(f.name) for f in df.schema.fields])
    return [list(df.columns), *(list(r) for r in texts.toLocalIterator())]


def save_data(data: DataFrame | dict[str, DataFrame], path: str, na: str = "") -> str:
    """A finished table as .csv, .tsv or .xlsx (a dict: one sheet each) on the driver; any other ending, as
    a folder that the executors write: .parquet, .json, .orc."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".xlsx":
        return export_xlsx(path=path, **(data if isinstance(data, dict) else {"data": data}))
    if isinstance(data, dict):
        raise ValueError("Several tables need an .xlsx file.")
    if ext in (".csv", ".tsv"):
        full = output_path(path)
        with open(full, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, delimiter="\t" if ext == ".tsv" else ",")
            for row in _rows(data, na):
                w.writerow(row)
        return full
    if ext in (".parquet", ".json", ".orc"):
        data.write.mode("overwrite").format(ext[1:]).save(path)
        return path
    raise ValueError(f"Can't write '{ext}' files.")


def sheet_names(names: list[str]) -> list[str]:
    """Without the characters that a sheet's name can't have, cut, and each once."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[\\/?*:\[\]]", "_", n)[:SHEET_CHARS]
        name = base
        while name in out:
            name += "_"
        out.append(name)
    return out


def _sheet(rows: list[list], kinds: list[bool]) -> str:
    def cell(v, number: bool) -> str:
        if v is None:
            return "<c/>"
        if number:
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join("<row>" + "".join(cell(v, k and i > 0) for v, k in zip(r, kinds)) + "</row>" for i, r in enumerate(rows))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def export_xlsx(*tables: DataFrame, path: str = "tables.xlsx", **named: DataFrame) -> str:
    """A workbook with one sheet for each finished table, by the standard library alone."""
    frames = [(t.columns[0] if t.columns else f"Sheet{i}", t) for i, t in enumerate(tables, 1)] + list(named.items())
    names = sheet_names([n for n, _ in frames])
    full = output_path(path)
    main = "http://schemas.openxmlformats.org/"
    with zipfile.ZipFile(full, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{main}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{main}package/2006/relationships"><Relationship Id="r1" Type="{main}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}spreadsheetml/2006/main" xmlns:r="{main}officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Type="{main}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{main}package/2006/relationships">{rels}</Relationships>')
        for i, (_, t) in enumerate(frames, 1):
            kinds = [isinstance(f.dataType, T.NumericType) for f in t.schema.fields]
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet([list(t.columns), *(list(r) for r in t.toLocalIterator())], kinds))
    return full


@on_default
def export_summary_xlsx(df: DataFrame | None, *columns, path: str = "summary.xlsx", by=None, sort: str = "none", digits: int = 0, weights=None) -> str:
    """A workbook of one sheet a question: statistics of numbers, percentages of answers and of blocks."""
    from tallyforge.operators.select import select_columns
    from tallyforge.operators.tabulate import calc_percentage, calc_percentage_multi, calc_summary
    from tallyforge.plans.profile import detect_multiselect, profile

    df = current().resolve(df)
    names = select_columns(df, *columns) if columns else None
    p = profile(df, names)
    multi = detect_multiselect(df, names, known=p if names is None else None)
    members = {c for m in multi.values() for c in m}
    sheets: dict[str, DataFrame] = {}
    for c in names or df.columns:
        if c in members:
            prefix = next(k for k, m in multi.items() if c in m)
            sheets.setdefault(prefix.rstrip("_"), calc_percentage_multi(df, prefix, by=by, sort=sort, digits=digits))
        elif p[c]["kind"] == "numeric":
            sheets[c] = calc_summary(df, c, by=by, weights=weights)
        elif names is not None or p[c]["kind"] == "categorical":
            sheets[c] = calc_percentage(df, c, by=by, sort=sort, digits=digits, weights=weights)
    return export_xlsx(path=path, **sheets)


def fingerprint(df: DataFrame, settings: dict) -> str:
    """Of a table's rows in any order, its columns and the settings of a run."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([r["n"], str(r["s"]), df.columns, settings], sort_keys=True, default=str).encode()).hexdigest()


class Checkpoint:
    """Finished blocks of a long run: Parquet tables under the run's fingerprint, in a folder that all executors
    share, each with a mark that Spark's writer sets when it is whole.  Blocks of another key are not seen."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), hashlib.sha256(key.encode()).hexdigest()[:24]

    def _path(self, name: str = ""):
        block = hashlib.sha256(name.encode()).hexdigest()[:24] if name else ""
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(x for x in (self.folder, self.key, block) if x))

    def _store(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name), "_SUCCESS")
        return self._store(done).exists(done)

    def save(self, name: str, block: DataFrame) -> DataFrame:
        block.write.mode("overwrite").parquet(str(self._path(name)))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self._path(name)))

    def clear(self) -> int:
        """Deletes the run's blocks; how many there were."""
        path = self._path()
        store = self._store(path)
        n = len(store.listStatus(path)) if store.exists(path) else 0
        store.delete(path, True)
        return n
