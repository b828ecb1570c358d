import zipfile

import pytest

from tallyforge.operators.tabulate import calc_percentage
from tallyforge.sources import files


def test_folder(spark, tmp_path):
    (tmp_path / "b_2024_x.csv").write_text('q1,q2,q3\nNA, NA ,"say ""hi""\nthere"\n1,,z\n')
    (tmp_path / "a_2023.csv").write_text("q1,q4,q5\nHow would you rate it overall?,Which of these did you buy?,Any other thing to add?\n5,x,y\n")
    (tmp_path / "skip.txt").write_text("x")
    df = files.read_folder(spark, str(tmp_path))
    got = [r.asDict() for r in df.collect()]
    assert [r["file"] for r in got] == ["a_2023.csv"] * 2 + ["b_2024_x.csv"] * 2
    assert got[2]["q1"] is None and got[2]["q3"] == 'say "hi"\nthere' and got[3]["q2"] is None and got[3]["q4"] is None
    assert df.schema["file"].metadata["question_rows"] == ["a_2023.csv"]
    assert files.read_folder(spark, str(tmp_path), question_row=True).count() == 2
    parsed = files.parse_filename(df, into=["name", "year", "tag"]).select("name", "year", "tag").distinct().collect()
    assert sorted(map(tuple, parsed), key=str) == [("a", "2023", None), ("b", "2024", "x")]
    with pytest.raises(ValueError, match="does not exist"):
        files.read_folder(spark, str(tmp_path / "gone"))
    with pytest.raises(ValueError, match="fits"):
        files.read_folder(spark, str(tmp_path), pattern="xlsx$")


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("country,n,x,b\nNA,1,0.5,true\n<NA>,2,<NA>,false\n")
    df = files.read_typed_csv(spark, str(tmp_path / "t.csv"), {"n": "integer", "x": "numeric", "b": "logical"})
    assert [tuple(r) for r in df.collect()] == [("NA", 1, 0.5, True), (None, 2, None, False)]


def test_sinks(spark, tmp_path):
    t = calc_percentage(spark.createDataFrame([("a",), ("b",), ("a",)], "q string"), "q")
    path = files.save_data(t, str(tmp_path / "t.csv"))
    assert open(path).read().split() == ["q,n,pct", "a,2,67", "b,1,33"]
    assert files.save_data(t, str(tmp_path / "t.tsv")).endswith("tsv")
    book = files.export_xlsx(t, path=str(tmp_path / "t.xlsx"), other=t)
    with zipfile.ZipFile(book) as z:
        assert "<v>67.0</v>" in z.read("xl/worksheets/sheet1.xml").decode() and 'name="other"' in z.read("xl/workbook.xml").decode()
    assert files.sheet_names(["a/b", "a:b", "x" * 40]) == ["a_b", "a_b_", "x" * 28]
    files.save_data(t, str(tmp_path / "t.parquet"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError, match="Can't write"):
        files.save_data(t, str(tmp_path / "t.doc"))


def test_summary_workbook(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x", None), ("b", 2, None, "y"), ("a", 3, "x", "y"), ("a", 3, None, None)] * 3, "q string, n int, o_x string, o_y string")
    with zipfile.ZipFile(files.export_summary_xlsx(df, path=str(tmp_path / "s.xlsx"))) as z:
        assert [n for n in ("q", "n", "o") if f'name="{n}"' in z.read("xl/workbook.xml").decode()] == ["q", "n", "o"]


def test_checkpoint(spark, tmp_path):
    df = spark.range(5)
    key = files.fingerprint(df, {"a": 1})
    assert key == files.fingerprint(df.repartition(3), {"a": 1}) != files.fingerprint(df, {"a": 2})
    c = files.Checkpoint(spark, str(tmp_path / "run"), key)
    assert not c.has("block") and c.save("block", df).count() == 5
    again = files.Checkpoint(spark, str(tmp_path / "run"), key)
    assert again.has("block") and not again.has("other") and again.load("block").count() == 5
    assert not files.Checkpoint(spark, str(tmp_path / "run"), "other").has("block")
    (tmp_path / "run" / again.key).joinpath(*[]).iterdir().__next__().joinpath("_SUCCESS").unlink()
    assert not again.has("block") and again.clear() == 1 and again.clear() == 0


def test_banner_takes_finished_blocks(spark, tmp_path):
    from tallyforge.operators import crosstab

    df = spark.createDataFrame([("a", 1, "x", None), ("b", 2, None, "y"), ("a", 3, "x", "y")] * 4, "q string, n int, o_x string, o_y string")
    plain = lambda d: sorted(map(str, d.collect()))
    want = plain(crosstab.banner(df, ["q", "n", "o_x", "o_y"], ["q"]))
    run = str(tmp_path / "run")
    assert plain(crosstab.banner(df, ["q", "n", "o_x", "o_y"], ["q"], checkpoint=run)) == want
    blocks = [p for p in (tmp_path / "run").rglob("_SUCCESS")]
    times = {p: p.stat().st_mtime_ns for p in blocks}
    assert len(blocks) == 3 and plain(crosstab.banner(df, ["q", "n", "o_x", "o_y"], ["q"], checkpoint=run)) == want
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("_SUCCESS")} == times
    assert plain(crosstab.banner(df, ["q", "n", "o_x", "o_y"], ["q"], digits=1, checkpoint=run)) != want


def test_datasets(spark, tmp_path):
    (tmp_path / "t.csv").write_text("country,n,x,b\nNA,1,0.5,true\n<NA>,2,<NA>,false\n")
    (tmp_path / "t.meta.csv").write_text('kind,name,value\ncolumn,n,integer\ncolumn,x,numeric\ncolumn,b,logical\nattr,year,"2024"\n')
    assert [tuple(r) for r in files.read_dataset(spark, str(tmp_path / "t.csv")).collect()] == [("NA", 1, 0.5, True), (None, 2, None, False)]
    assert files.column_types(str(tmp_path / "t.meta.csv"))["attrs"] == {"year": "2024"}
    assert files.load_dataset(spark, "cur").count() == 39 and files.load_dataset(spark, "country_region").count() > 195
    with pytest.raises(ValueError, match="Unknown dataset"):
        files.load_dataset(spark, "x")


def test_folder_of_many_files_is_one_read_a_header(spark, tmp_path):
    for i in range(12):
        head = "q1,q2" if i % 2 else "q1,other name"
        (tmp_path / f"f {i:02d}+.csv").write_text(f"{head}\nquestion,wording\n{i},{i * 2}\n")
    df = files.read_folder(spark, str(tmp_path), question_row=True)
    got = {r["file"]: (r["q1"], r["q2"], r["other name"]) for r in df.collect()}
    assert got == {f"f {i:02d}+.csv": (str(i), str(i * 2) if i % 2 else None, None if i % 2 else str(i * 2)) for i in range(12)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2 * 2  # the rows, and the first of each


def test_reports(spark, tmp_path):
    import json

    from tallyforge.plans import charts
    from tallyforge.sources import report

    t = calc_percentage(spark.createDataFrame([("a|<b>",), ("b",)], "q string"), "q")
    spec = charts.bars(t)
    page = open(report.report_deck({"Part": None, "Shares": [t, spec], "Notes": ["one", "two"]}, str(tmp_path / "d.html"), title="Deck")).read()
    assert "<h1>Deck</h1>" in page and "<td>a|&lt;b&gt;</td>" in page and "<li>two</li>" in page and "application/json" in page
    text = open(report.Report("T").slide("S", t).save(str(tmp_path / "d.qmd"))).read()
    assert text.startswith('---\ntitle: "T"') and "| a\\|<b> | 1 |" in text
    assert json.load(open(report.save_output(spec, str(tmp_path / "c.json"))))["mark"]["type"] == "bar"
    assert report.save_output(t, str(tmp_path / "t.csv")).endswith("csv")
    with pytest.raises(ValueError, match="Reports end"):
        report.Report().save(str(tmp_path / "d.key"))
    with pytest.raises(ValueError, match="Only chart"):
        report.save_output(3, "x.csv")
    with pytest.raises(ValueError, match="500 rows"):
        report.Report().add_table(spark.range(501))


def test_office_files(spark, tmp_path):
    from xml.etree import ElementTree

    from tallyforge.sources import office, report

    def parts(path):
        with zipfile.ZipFile(path) as z:
            out = {n: z.read(n).decode() for n in z.namelist()}
        for name, text in out.items():
            ElementTree.fromstring(text)  # every part is well formed
        listed = set(__import__("re").findall(r'PartName="/([^"]+)"', out["[Content_Types].xml"]))
        assert listed <= set(out) and all(n in listed or n.endswith(".rels") or n == "[Content_Types].xml" for n in out)
        for name, text in out.items():  # every relation leads somewhere
            if name.endswith(".rels"):
                base = name.replace("_rels/", "").rsplit("/", 1)[0] if "/" in name.replace("_rels/", "") else ""
                for target in __import__("re").findall(r'Target="([^"]+)"', text):
                    import posixpath

                    assert posixpath.normpath(posixpath.join(base, target)) in out, (name, target)
        return out

    deck = report.example_report(spark, str(tmp_path / "d.pptx"))
    got = parts(deck)
    assert sum(n.startswith("ppt/slides/slide") for n in got) == 5 and "An example" in got["ppt/slides/slide1.xml"] and "<a:tbl>" in got["ppt/slides/slide3.xml"]
    assert "slideLayout1.xml" in got["ppt/slides/_rels/slide1.xml.rels"] and "slideLayout3.xml" in got["ppt/slides/_rels/slide2.xml.rels"]
    again = parts(report.report_deck({"A & <b>": ["x"]}, str(tmp_path / "e.pptx"), template=deck))  # a deck as a template
    assert sum(n.startswith("ppt/slides/slide") for n in again) == 1 and "A &amp; &lt;b&gt;" in again["ppt/slides/slide1.xml"]
    text = parts(report.example_report(spark, str(tmp_path / "d.docx")))["word/document.xml"]
    assert text.count("<w:tbl>") == 2 and "made up by rule" in text
    layouts = office.report_layouts()
    assert [x["layout"] for x in layouts] == ["Title Slide", "Title and Content", "Section Header", "Two Content"]
    assert [office.select_layout(layouts, p)["layout"] for p in office.PURPOSES] == ["Title Slide", "Section Header", "Title and Content", "Two Content"]
    assert office.select_layout(layouts[:3], "two_content") is None
    with pytest.raises(ValueError):
        office.select_layout(layouts, "x")


def test_report_templates(tmp_path):
    from tallyforge.sources import report

    for kind in report.list_report_templates():
        path = report.scaffold_report(kind, str(tmp_path / f"{kind}.qmd"), title="T: x", author="Me")
        assert f"  {kind}:" in open(path).read() and 'title: "T: x"' in open(path).read()
        with pytest.raises(ValueError, match="exists"):
            report.scaffold_report(kind, path)
        assert report.scaffold_report(kind, path, overwrite=True, reference_doc="ref.x")
        assert "reference-doc" in open(path).read()
