"""Reports as Office files: slides (.pptx) and documents (.docx), written part by part.

A deck takes masters, layouts and theme from a template, or from a small one made here; a slide's layout is the one
whose placeholders suit it, whatever it is called.  Charts appear as their spec's text.
"""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

INCH = 914_400
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_P = f'{_A} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MIME = "application/vnd.openxmlformats-officedocument"
PURPOSES = ("title", "section", "content", "two_content")


def _rels(targets: list[tuple[str, str, str]]) -> str:
    return f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_REL}/{kind}" Target="{to}"/>' for i, kind, to in targets) + "</Relationships>"


def _box(x: float, y: float, w: float, h: float) -> str:
    return f'<a:xfrm><a:off x="{int(x * INCH)}" y="{int(y * INCH)}"/><a:ext cx="{int(w * INCH)}" cy="{int(h * INCH)}"/></a:xfrm>'


def _holder(i: int, kind: str, box: tuple | None, body: str = "<a:p/>", idx: str | None = None) -> str:
    """A placeholder; its text."""
    place = f"<p:spPr>{_box(*box) if box else ''}</p:spPr>"
    mark = (f' type="{kind}"' if kind else "") + (f' idx="{idx}"' if idx is not None else "")
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="{kind or "body"} {i}"/><p:cNvSpPr/><p:nvPr><p:ph{mark}/></p:nvPr></p:nvSpPr>{place}<p:txBody><a:bodyPr/><a:lstStyle/>{body}</p:txBody></p:sp>'


def _tree(shapes: str) -> str:
    return f'<p:cSld{{name}}><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shapes}</p:spTree></p:cSld>'


def _template() -> dict[str, bytes]:
    """A 16:9 template of one master and four layouts."""
    title, body = (0.6, 0.4, 12.1, 1.0), (0.6, 1.6, 12.1, 5.3)
    layouts = {
        "Title Slide": _holder(2, "ctrTitle", (1, 2.2, 11.3, 1.5)) + _holder(3, "subTitle", (1, 3.9, 11.3, 1.2), idx="1"),
        "Title and Content": _holder(2, "title", title) + _holder(3, "", body, idx="1"),
        "Section Header": _holder(2, "title", (1, 2.8, 11.3, 1.5)),
        "Two Content": _holder(2, "title", title) + _holder(3, "", (0.6, 1.6, 5.9, 5.3), idx="1") + _holder(4, "", (6.8, 1.6, 5.9, 5.3), idx="2"),
    }
    n = len(layouts)
    parts = {
        "ppt/theme/theme1.xml": f'{_HEAD}<a:theme {_A} name="Plain"><a:themeElements><a:clrScheme name="Plain">'
        + "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in {"dk1": "000000", "lt1": "FFFFFF", "dk2": "333333", "lt2": "EEEEEE", "accent1": "2F6DB5", "accent2": "5B9BD5", "accent3": "8AB6E0", "accent4": "B5D0EC", "accent5": "6C757D", "accent6": "ADB5BD", "hlink": "2F6DB5", "folHlink": "6C757D"}.items())
        + '</a:clrScheme><a:fontScheme name="Plain"><a:majorFont><a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/></a:majorFont><a:minorFont><a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/></a:minorFont></a:fontScheme><a:fmtScheme name="Plain"><a:fillStyleLst>'
        + '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3
        + "</a:fillStyleLst><a:lnStyleLst>"
        + '<a:ln w="6350"><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>' * 3
        + "</a:lnStyleLst><a:effectStyleLst>"
        + "<a:effectStyle><a:effectLst/></a:effectStyle>" * 3
        + "</a:effectStyleLst><a:bgFillStyleLst>"
        + '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3
        + "</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>",
        "ppt/slideMasters/slideMaster1.xml": f"{_HEAD}<p:sldMaster {_P}>"
        + _tree(_holder(2, "title", title) + _holder(3, "body", body, idx="1")).format(name="")
        + '<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/><p:sldLayoutIdLst>'
        + "".join(f'<p:sldLayoutId id="{2147483649 + k}" r:id="rId{k + 1}"/>' for k in range(n))
        + "</p:sldLayoutIdLst></p:sldMaster>",
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": _rels([*((f"rId{k + 1}", "slideLayout", f"../slideLayouts/slideLayout{k + 1}.xml") for k in range(n)), (f"rId{n + 1}", "theme", "../theme/theme1.xml")]),
        "ppt/presentation.xml": f'{_HEAD}<p:presentation {_P}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldSz cx="{int(13.333 * INCH)}" cy="{int(7.5 * INCH)}"/><p:notesSz cx="{int(7.5 * INCH)}" cy="{int(10 * INCH)}"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), ("rId2", "theme", "theme/theme1.xml")]),
        "_rels/.rels": _rels([("rId1", "officeDocument", "ppt/presentation.xml")]),
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + f'<Override PartName="/ppt/presentation.xml" ContentType="{_MIME}.presentationml.presentation.main+xml"/><Override PartName="/ppt/slideMasters/slideMaster1.xml" ContentType="{_MIME}.presentationml.slideMaster+xml"/><Override PartName="/ppt/theme/theme1.xml" ContentType="{_MIME}.theme+xml"/>'
        + "".join(f'<Override PartName="/ppt/slideLayouts/slideLayout{k + 1}.xml" ContentType="{_MIME}.presentationml.slideLayout+xml"/>' for k in range(n))
        + "</Types>",
    }
    for k, (name, shapes) in enumerate(layouts.items(), 1):
        parts[f"ppt/slideLayouts/slideLayout{k}.xml"] = f"{_HEAD}<p:sldLayout {_P}>" + _tree(shapes).format(name=f' name="{name}"') + "</p:sldLayout>"
        parts[f"ppt/slideLayouts/_rels/slideLayout{k}.xml.rels"] = _rels([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")])
    return {k: v.encode() for k, v in parts.items()}


def read_template(path: str | None) -> dict[str, bytes]:
    if path is None:
        return _template()
    with zipfile.ZipFile(path) as z:
        return {n: z.read(n) for n in z.namelist()}


def report_layouts(template: str | None = None) -> list[dict]:
    """The layouts of a template: their part, name, and placeholders (type, idx)."""
    out = []
    for part, body in sorted(read_template(template).items(), key=lambda x: [int(n) for n in re.findall(r"\d+", x[0])]):
        if re.fullmatch(r"ppt/slideLayouts/slideLayout\d+\.xml", part):
            text = body.decode("utf-8")
            name = re.search(r'<p:cSld[^>]*\bname="([^"]*)"', text)
            marks = [dict(re.findall(r'(\w+)="([^"]*)"', m)) for m in re.findall(r"<p:ph\b([^>]*)/?>", text)]
            holders = [(m.get("type", "body"), m.get("idx", "0")) for m in marks]
            out.append({"part": part, "layout": name[1] if name else "", "has_title": any(t in ("title", "ctrTitle") for t, _ in holders), "n_body": sum(t in ("body", "obj") for t, _ in holders), "placeholders": holders})
    return out


def select_layout(layouts: list[dict], purpose: str = "content") -> dict | None:
    """The layout whose placeholders suit a purpose best; None if none has two bodies for ``two_content``."""
    if purpose not in PURPOSES:
        raise ValueError(f"'{purpose}' should be one of {', '.join(PURPOSES)}.")

    def fits(x: dict) -> tuple:
        kinds = [t for t, _ in x["placeholders"]]
        return {
            "title": ("ctrTitle" in kinds, "subTitle" in kinds, -x["n_body"]),
            "section": (x["has_title"], "ctrTitle" not in kinds, -x["n_body"]),
            "content": (x["has_title"], x["n_body"] == 1, "ctrTitle" not in kinds),
            "two_content": (x["n_body"] == 2, x["has_title"], True),
        }[purpose]

    best = max(layouts, key=fits, default=None)  # the first of equals
    return None if best is None or purpose == "two_content" and best["n_body"] < 2 else best


def _paragraphs(lines: list[str]) -> str:
    return "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines) or "<a:p/>"


def _slide_table(i: int, head: list[str], rows: list[list[str]], y: float) -> str:
    w = int(12.1 * INCH / max(1, len(head)))
    cell = lambda c, bold: f'<a:tc><a:txBody><a:bodyPr/><a:lstStyle/><a:p><a:r><a:rPr sz="1200" b="{int(bold)}"/><a:t>{escape(c)}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>'
    line = lambda cells, bold: f'<a:tr h="{int(0.3 * INCH)}">' + "".join(cell(c, bold) for c in cells) + "</a:tr>"
    grid = "".join(f'<a:gridCol w="{w}"/>' for _ in head)
    place = _box(0.6, y, 12.1, 0.3 * (len(rows) + 1)).replace("a:xfrm", "p:xfrm")
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{i}" name="Table {i}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{place}<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{grid}</a:tblGrid>{line(head, True)}{"".join(line(r, False) for r in rows)}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def write_pptx(path: str, slides: list[dict], spec_text, template: str | None = None) -> None:
    """``slides``: kind, title, subtitle and pieces, as a `Report` holds them."""
    parts = {k: v for k, v in read_template(template).items() if not re.match(r"ppt/(slides|notesSlides)/", k)}
    layouts = report_layouts(template)
    types = re.sub(r'<Override PartName="/ppt/(?:slides|notesSlides)/[^>]*>', "", parts["[Content_Types].xml"].decode())
    deck = re.sub(r"<p:sldIdLst>.*?</p:sldIdLst>", "", parts["ppt/presentation.xml"].decode(), flags=re.S)
    rels = re.sub(rf'<Relationship\b[^>]*Type="{_REL}/slide"[^>]*>', "", parts["ppt/_rels/presentation.xml.rels"].decode())
    listed = []
    for k, s in enumerate(slides, 1):
        layout = select_layout(layouts, s["kind"] if s["kind"] in ("title", "section") else "content")
        holder = lambda kinds: next(((t, n) for t, n in layout["placeholders"] if t in kinds), None)  # noqa: B023, E731
        shapes, i, y = "", 2, 1.6
        if s["title"] and (at := holder(("title", "ctrTitle"))):
            shapes += _holder(i, at[0], None, _paragraphs([s["title"]]))
            i += 1
        text = [t for kind, body in s["pieces"] for t in (body if kind == "text" else spec_text(body).splitlines() if kind == "plot" else [])]
        text = [s["subtitle"], *text] if s.get("subtitle") else text
        if text and (at := holder(("subTitle", "body", "obj"))):
            shapes += _holder(i, "" if at[0] == "body" else at[0], None, _paragraphs(text), idx=at[1])
            i += 1
        for kind, body in s["pieces"]:
            if kind == "table":
                shapes += _slide_table(i, body[0], body[1], y)
                i, y = i + 1, y + 0.3 * (len(body[1]) + 2)
        parts[f"ppt/slides/slide{k}.xml"] = (f"{_HEAD}<p:sld {_P}>" + _tree(shapes).replace("{name}", "", 1) + "</p:sld>").encode()
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = _rels([("rId1", "slideLayout", f"../slideLayouts/{layout['part'].rsplit('/', 1)[1]}")]).encode()
        types = types.replace("</Types>", f'<Override PartName="/ppt/slides/slide{k}.xml" ContentType="{_MIME}.presentationml.slide+xml"/></Types>')
        rels = rels.replace("</Relationships>", f'<Relationship Id="rIdSlide{k}" Type="{_REL}/slide" Target="slides/slide{k}.xml"/></Relationships>')
        listed.append(f'<p:sldId id="{255 + k}" r:id="rIdSlide{k}"/>')
    deck = deck.replace("</p:sldMasterIdLst>", f"</p:sldMasterIdLst><p:sldIdLst>{''.join(listed)}</p:sldIdLst>", 1)
    parts |= {"[Content_Types].xml": types.encode(), "ppt/presentation.xml": deck.encode(), "ppt/_rels/presentation.xml.rels": rels.encode()}
    _zip(path, parts)


def write_docx(path: str, slides: list[dict], spec_text) -> None:
    """Headings, paragraphs and tables, one after another."""
    run = lambda t, more="": f'<w:p>{more}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    style = lambda s: f'<w:pPr><w:pStyle w:val="{s}"/></w:pPr>'
    out = []
    for s in slides:
        if s["title"]:
            out.append(run(s["title"], style({"title": "Title", "section": "Heading1"}.get(s["kind"], "Heading2"))))
        if s.get("subtitle"):
            out.append(run(s["subtitle"]))
        for kind, body in s["pieces"]:
            if kind == "text":
                out += [run(t) for t in body]
            elif kind == "plot":
                out += [run(t) for t in spec_text(body).splitlines()]
            else:
                row = lambda cells: "<w:tr>" + "".join(f"<w:tc><w:tcPr/>{run(c)}</w:tc>" for c in cells) + "</w:tr>"
                out.append('<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid>' + "<w:gridCol/>" * len(body[0]) + "</w:tblGrid>" + row(body[0]) + "".join(map(row, body[1])) + "</w:tbl><w:p/>")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    named = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/><w:rPr><w:b/><w:sz w:val="{z}"/></w:rPr></w:style>' for i, n, z in (("Title", "Title", 52), ("Heading1", "heading 1", 36), ("Heading2", "heading 2", 28)))
    parts = {
        "word/document.xml": f"{_HEAD}<w:document {w}><w:body>{''.join(out)}<w:sectPr/></w:body></w:document>",
        "word/styles.xml": f"{_HEAD}<w:styles {w}>{named}</w:styles>",
        "word/_rels/document.xml.rels": _rels([("rId1", "styles", "styles.xml")]),
        "_rels/.rels": _rels([("rId1", "officeDocument", "word/document.xml")]),
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_MIME}.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{_MIME}.wordprocessingml.styles+xml"/></Types>',
    }
    _zip(path, {k: v.encode() for k, v in parts.items()})


def _zip(path: str, parts: dict[str, bytes]) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts, key=lambda n: n != "[Content_Types].xml"):
            z.writestr(name, parts[name])
