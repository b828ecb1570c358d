"""An organisation's colours and fonts, from an Office file's theme or by hand, kept as session options."""

from __future__ import annotations

import os
import re
import zipfile
from xml.etree import ElementTree

from tallyforge.plans.state import current

_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SETTINGS = ("brand_colors", "brand_color_primary", "brand_font_major", "brand_font_minor")


def office_theme(xml: bytes | str) -> dict:
    """``accents``, ``dark``, ``light``, ``font_major`` and ``font_minor`` of a theme part."""
    root = ElementTree.fromstring(xml)

    def colour(slot: str) -> str | None:
        for node in root.iter(f"{_DRAWING}{slot}"):
            for tag, attr in (("srgbClr", "val"), ("sysClr", "lastClr")):
                found = node.find(f"{_DRAWING}{tag}")
                if found is not None and found.get(attr):
                    return "#" + found.get(attr).upper()
        return None

    def font(slot: str) -> str | None:
        node = root.find(f".//{_DRAWING}{slot}/{_DRAWING}latin")
        face = "" if node is None else node.get("typeface") or ""
        return face if face and not face.startswith("+") else None

    accents = [c for i in range(1, 7) if (c := colour(f"accent{i}"))]
    return {"accents": accents, "dark": colour("dk1") or "#000000", "light": colour("lt1") or "#FFFFFF", "font_major": font("majorFont"), "font_minor": font("minorFont")}


def use_brand(template: str | None = None, colors: list[str] | str | None = None, fonts: list[str] | str | None = None) -> dict:
    """Colours and fonts for charts; ``colors`` and ``fonts`` (body, or heading and body) beat the template's."""
    if template is None and colors is None and fonts is None:
        raise ValueError("Name a template, colours or fonts.")
    theme, new = {}, {}
    if template is not None:
        ext = os.path.splitext(template)[1].lower().lstrip(".")
        if ext not in ("pptx", "docx"):
            raise ValueError("The template must be a .pptx or .docx file.")
        with zipfile.ZipFile(template) as z:
            parts = sorted(n for n in z.namelist() if re.search(r"theme/theme[0-9]*\.xml$", n))
            if not parts:
                raise ValueError("The template has no theme.")
            theme = office_theme(z.read(parts[0]))
        new[f"brand_template_{ext}"] = os.path.abspath(template)
    accents = [colors] if isinstance(colors, str) else list(colors or theme.get("accents", []))
    faces = [fonts] if isinstance(fonts, str) else list(fonts or [])
    major = faces[0] if faces else theme.get("font_major")
    minor = faces[-1] if faces else theme.get("font_minor")
    new |= dict(zip(SETTINGS, (accents or None, accents[0] if accents else None, major, minor)))
    current().options(**{k: v for k, v in new.items() if v is not None})
    return brand_info()


def brand_info() -> dict:
    return {k: current().option(k) for k in (*SETTINGS, "brand_template_pptx", "brand_template_docx")}


def clear_brand() -> None:
    current().options(**dict.fromkeys((*SETTINGS, "brand_template_pptx", "brand_template_docx")))
