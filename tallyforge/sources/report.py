"""Reports of finished tables and chart specs: a deck of slides as one HTML, Markdown, Quarto or Office file."""

from __future__ import annotations

import html
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallyforge.functions import scalars as S
from tallyforge.operators.model import calc_nps
from tallyforge.operators.tabulate import calc_percentage
from tallyforge.plans import charts
from tallyforge.plans.state import current
from tallyforge.sources.files import output_path, save_data
from tallyforge.sources.office import write_docx, write_pptx

FORMATS = {".html": "html", ".md": "markdown", ".qmd": "quarto", ".pptx": "pptx", ".docx": "docx"}
#: Formats that a Quarto skeleton can ask for.
TEMPLATES = ("docx", "html", "pdf", "pptx")
#: Rows that a table on a slide may have: a slide shows finished tables, not data.
MOST_ROWS = 500


@dataclass
class Report:
    """Slides in order: kind (title, section, content), title and pieces."""

    title: str | None = None
    slides: list[dict] = field(default_factory=list)
    template: str | None = None  # of a .pptx; else the brand's, else a plain one

    def _add(self, kind: str, title: str | None, **more) -> Report:
        self.slides.append({"kind": kind, "title": title, "pieces": []} | more)
        return self

    def title_slide(self, title: str, subtitle: str | None = None) -> Report:
        return self._add("title", title, subtitle=subtitle)

    def section(self, title: str) -> Report:
        return self._add("section", title)

    def add_slide(self, title: str | None = None) -> Report:
        return self._add("content", title)

    def _piece(self, kind: str, body) -> Report:
        if not self.slides:
            self.add_slide()
        self.slides[-1]["pieces"].append((kind, body))
        return self

    def add_text(self, text: str | list[str]) -> Report:
        return self._piece("text", [text] if isinstance(text, str) else list(text))

    def add_plot(self, spec: dict) -> Report:
        return self._piece("plot", spec)

    def add_table(self, df: DataFrame) -> Report:
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"A slide's table has {MOST_ROWS} rows at most; save larger ones with `save_data`.")
        return self._piece("table", (list(df.columns), [["" if v is None else str(v) for v in r] for r in rows]))

    def slide(self, title: str | None = None, content=None) -> Report:
        """A slide with a table, a chart spec, text, or a list of these."""
        self.add_slide(title)
        for x in content if isinstance(content, list) and not all(isinstance(c, str) for c in content) else [content]:
            if isinstance(x, DataFrame):
                self.add_table(x)
            elif isinstance(x, dict):
                self.add_plot(x)
            elif x is not None:
                self.add_text(x)
        return self

    def save(self, path: str) -> str:
        kind = FORMATS.get(os.path.splitext(path)[1].lower())
        if kind is None:
            raise ValueError(f"Reports end in {', '.join(FORMATS)}.")
        full = output_path(path)
        if kind == "pptx":
            write_pptx(full, self.slides, _spec_text, self.template or current().option("brand_template_pptx"))
            return full
        if kind == "docx":
            write_docx(full, self.slides, _spec_text)
            return full
        with open(full, "w", encoding="utf-8") as f:
            f.write(_as_html(self) if kind == "html" else _as_markdown(self, kind == "quarto"))
        return full


def _spec_text(spec: dict) -> str:
    return json.dumps(spec, indent=1, default=str, ensure_ascii=False)


def _as_html(report: Report) -> str:
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(report.title or '')}</title></head><body>"]
    for s in report.slides:
        level = "h1" if s["kind"] == "title" else "h2"
        out.append(f"<section class='{s['kind']}'>" + (f"<{level}>{html.escape(s['title'])}</{level}>" if s["title"] else ""))
        if s.get("subtitle"):
            out.append(f"<p>{html.escape(s['subtitle'])}</p>")
        for kind, body in s["pieces"]:
            if kind == "text":
                out.append("<ul>" + "".join(f"<li>{html.escape(t)}</li>" for t in body) + "</ul>")
            elif kind == "plot":
                out.append("<script type='application/json' class='chart'>" + _spec_text(body).replace("</", "<\\/") + "</script>")
            else:
                row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
                out.append("<table>" + row(body[0], "th") + "".join(row(r, "td") for r in body[1]) + "</table>")
        out.append("</section>")
    return "\n".join([*out, "</body></html>", ""])


def _as_markdown(report: Report, quarto: bool) -> str:
    cell = lambda c: c.replace("|", "\\|").replace("\n", " ")
    out = ["---", f"title: {json.dumps(report.title or 'Report', ensure_ascii=False)}", "format: revealjs", "---", ""] if quarto else []
    for s in report.slides:
        out += [("# " if s["kind"] != "content" else "## ") + (s["title"] or ""), ""]
        out += [s["subtitle"], ""] if s.get("subtitle") else []
        for kind, body in s["pieces"]:
            if kind == "text":
                out += [f"- {t}" for t in body]
            elif kind == "plot":
                out += ["```json", _spec_text(body), "```"]
            else:
                out += ["| " + " | ".join(map(cell, r)) + " |" for r in (body[0], ["---"] * len(body[0]), *body[1])]
            out.append("")
    return "\n".join(out)


def list_report_templates() -> list[str]:
    return list(TEMPLATES)


def scaffold_report(format: str = "pptx", path: str | None = None, title: str = "Survey Report", author: str | None = None, reference_doc: str | None = None, overwrite: bool = False) -> str:
    """A Quarto skeleton: a summary, a section for each question of a CSV file given as a parameter, and the precision
    of its figures."""
    format = S.match_arg(format, TEMPLATES)
    full = output_path(path or f"survey-report-{format}.qmd")
    if os.path.exists(full) and not overwrite:
        raise ValueError(f"'{full}' exists.")
    reference_doc = reference_doc or (current().option(f"brand_template_{format}") if format in ("pptx", "docx") else None)
    body = [f"    reference-doc: {os.path.abspath(reference_doc)}"] if reference_doc else ["    toc: true"]
    cell = lambda *lines: ["```{python}", *lines, "```", ""]
    text = [
        "---", f"title: {json.dumps(title, ensure_ascii=False)}", f"author: {json.dumps(author or 'Your name', ensure_ascii=False)}", "format:", f"  {format}:", *body, "execute:", "  echo: false", "---", "",
        *cell("#| tags: [parameters]", 'data = "survey.csv"'),
        *cell("from tallyforge.session import local_session", "from tallyforge.operators import precision, tabulate", "from tallyforge.plans import profile", "spark = local_session()", "df = spark.read.csv(data, header=True, inferSchema=True)"),
        "## Summary", "", "What the reader should remember.", "", "## Answers", "",
        *cell('for c, p in profile.profile(df).items():', '    if p["kind"] == "categorical":', "        display(tabulate.calc_percentage(df, c).toPandas())"),
        "## Precision", "", *cell("precision.diagnose(df).toPandas()"),
    ]
    with open(full, "w", encoding="utf-8") as f:
        f.write("\n".join(text))
    return full


def example_report(spark: SparkSession, path: str) -> str:
    """A worked example, over answers made up by rule: a title, a table, a chart and a note, in any format."""
    df = spark.range(300).selectExpr("CASE id % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS again", "CAST(id * id % 11 AS int) AS score", "CASE id % 2 WHEN 0 THEN 'new' ELSE 'known' END AS customer")
    shares = calc_percentage(df, "again", by="customer")
    items = {"Results": None, "Would you come again?": [shares, charts.bars(calc_percentage(df, "again"))], "Recommendation": calc_nps(df, "score", by="customer"), "Notes": ["Answers are made up by rule.", "Shares are of each customer group."]}
    return report_deck(items, path, title="An example")


def report_deck(items: dict, path: str, title: str | None = None, template: str | None = None) -> str:
    """One slide for each item, a ``None`` item being a section; written at once."""
    report = Report(title, template=template)
    if title:
        report.title_slide(title)
    for name, content in items.items():
        report.section(name) if content is None else report.slide(name, content)
    return report.save(path)


def save_plot(spec: dict, path: str) -> str:
    """A chart spec as .json."""
    if os.path.splitext(path)[1].lower() != ".json":
        raise ValueError("Chart specs are saved as .json.")
    full = output_path(path)
    with open(full, "w", encoding="utf-8") as f:
        f.write(_spec_text(spec))
    return full


def save_output(x, path: str, **options) -> str:
    """A chart spec, a table or several, each by its own sink."""
    if isinstance(x, DataFrame) or isinstance(x, dict) and x and all(isinstance(v, DataFrame) for v in x.values()):
        return save_data(x, path, **options)
    if isinstance(x, dict) and "mark" in x:
        return save_plot(x, path)
    raise ValueError("Only chart specs and tables can be saved.")
