"""Documents made from Markdown, and changes to existing ones that leave the rest as it is."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.operators.blocks import parse_blocks

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HP = "http://www.hancom.co.kr/hwpml/2011/paragraph"
_HS = "http://www.hancom.co.kr/hwpml/2011/section"


def _zip(parts: dict[str, str], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            # A fixed date, so that equal input gives equal bytes.
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()


def _plain(text: str) -> str:
    return re.sub(r"(\*\*|__|~~|`)(.+?)\1", r"\2", text)


def markdown_docx(text: str) -> bytes:
    """A Word document: headings by outline level, paragraphs, lists by indent, tables."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(_plain(t))}</w:t></w:r>'
    body = []
    for b in parse_blocks(text):
        if b["kind"] == "heading":
            body.append(f'<w:p><w:pPr><w:outlineLvl w:val="{b["level"] - 1}"/></w:pPr>{run(b["text"])}</w:p>')
        elif b["kind"] == "list":
            for n, item in enumerate(b["items"], 1):
                mark = f"{n}. " if b["ordered"] else "• "
                body.append(f'<w:p><w:pPr><w:ind w:left="{400 * (item["depth"] + 1)}"/></w:pPr>{run(mark + item["text"])}</w:p>')
        elif b["kind"] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in b["cells"])
            body.append(f"<w:tbl><w:tblPr/>{rows}</w:tbl>")
        else:
            body.append(f"<w:p>{run(b['text'] or '')}</w:p>")
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    return _zip(
        {
            "[Content_Types].xml": f'{_TYPES}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>',
            "_rels/.rels": f'{_TYPES}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f'{_TYPES}<w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>',
        }
    )


def markdown_hwpx(text: str) -> bytes:
    """An HWPX package with one section: paragraphs, and tables with the address of each cell."""
    para = lambda t: f'<hp:p><hp:run charPrIDRef="0"><hp:t>{escape(_plain(t))}</hp:t></hp:run></hp:p>'
    body = []
    for b in parse_blocks(text):
        if b["kind"] == "list":
            body += [para("  " * i["depth"] + (f"{n}. " if b["ordered"] else "- ") + i["text"]) for n, i in enumerate(b["items"], 1)]
        elif b["kind"] == "table":
            rows = "".join(
                "<hp:tr>" + "".join(f'<hp:tc><hp:subList>{para(c)}</hp:subList><hp:cellAddr colAddr="{x}" rowAddr="{y}"/><hp:cellSpan colSpan="1" rowSpan="1"/></hp:tc>' for x, c in enumerate(r)) + "</hp:tr>"
                for y, r in enumerate(b["cells"])
            )
            body.append(f'<hp:p><hp:run charPrIDRef="0"><hp:tbl rowCnt="{len(b["cells"])}" colCnt="{len(b["cells"][0])}">{rows}</hp:tbl></hp:run></hp:p>')
        else:
            body.append(para(b["text"] or ""))
    section = f'{_TYPES}<hs:sec xmlns:hs="{_HS}" xmlns:hp="{_HP}">{"".join(body)}</hs:sec>'
    package = f'{_TYPES}<opf:package xmlns:opf="http://www.idpf.org/2007/opf/"><opf:manifest><opf:item id="section0" href="Contents/section0.xml" media-type="application/xml"/></opf:manifest><opf:spine><opf:itemref idref="section0"/></opf:spine></opf:package>'
    return _zip({"mimetype": "application/hwp+zip", "Contents/content.hpf": package, "Contents/section0.xml": section}, stored=("mimetype",))


def hwpx_issues(data: bytes) -> list[str]:
    """What is wrong with the structure of an HWPX package; nothing for a sound one."""
    from xml.etree import ElementTree as ET

    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return ["not an archive"]
    names, out = z.namelist(), []
    if names[:1] != ["mimetype"] or z.getinfo("mimetype").compress_type != zipfile.ZIP_STORED:
        out.append("mimetype isn't first and stored")
    if "Contents/section0.xml" not in names:
        out.append("no section")
    for name in (n for n in names if n.endswith((".xml", ".hpf"))):
        try:
            ET.fromstring(z.read(name))
        except ET.ParseError as e:
            out.append(f"{name}: {e}")
    return out


def rewrite(data: bytes, change: Callable[[str, bytes], bytes]) -> bytes:
    """An archive with its members passed through change; order, dates and kinds of storage stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w") as target:
        for info in source.infolist():
            target.writestr(info, change(info.filename, source.read(info.filename)), compress_type=info.compress_type)
    return out.getvalue()


_SECTION = re.compile(r"(?i)section\d+\.xml$")
_TEXT = re.compile(r"(<(?:\w+:)?t(?:\s[^>]*)?>)([^<]*)(</(?:\w+:)?t>)")


def replace_hwpx(data: bytes, replacements: list[tuple[str, str]]) -> tuple[bytes, int]:
    """The package with strings replaced in its text runs, and how many were."""
    count = 0

    def inside(m: re.Match) -> str:
        nonlocal count
        text = m[2]
        for old, new in replacements:
            count += text.count(escape(old))
            text = text.replace(escape(old), escape(new))
        return m[1] + text + m[3]

    made = rewrite(data, lambda name, body: _TEXT.sub(inside, body.decode("utf-8")).encode() if _SECTION.search(name) else body)
    return made, count


_CELL = re.compile(r"<(\w+:)?tc\b.*?</\1tc>", re.S)


def fill_hwpx(data: bytes, values: dict[str, str]) -> tuple[bytes, list[str]]:
    """The package with the cell to the right of each label cell filled, and the labels that weren't found. Labels are
    compared without white space and colons; a cell with text of its own is replaced."""
    plain = lambda t: re.sub(r"[\s:：]+", "", t)
    wanted, found = {plain(k): (k, v) for k, v in values.items()}, set()

    def section(name: str, body: bytes) -> bytes:
        if not _SECTION.search(name):
            return body
        text, out, at, pending = body.decode("utf-8"), [], 0, None
        for cell in _CELL.finditer(text):
            own = "".join(m[2] for m in _TEXT.finditer(cell[0]))
            new = cell[0]
            if pending is not None and _TEXT.search(new):
                state = {"first": True}

                def put(m: re.Match, value: str = pending, state: dict = state) -> str:
                    shown = escape(value) if state.pop("first", False) else ""
                    return m[1] + shown + m[3]

                new = _TEXT.sub(put, new)
            pending = None
            if plain(own) in wanted and new == cell[0]:
                key, pending = wanted[plain(own)]
                found.add(key)
            out += [text[at : cell.start()], new]
            at = cell.end()
        return "".join([*out, text[at:]]).encode()

    made = rewrite(data, section)
    return made, [k for k in values if k not in found]


def generated(markdown: Column, kind: str = "docx") -> Column:
    """Documents of kind docx or hwpx as a binary Column; null for null."""
    make = {"docx": markdown_docx, "hwpx": markdown_hwpx}[kind]

    @F.pandas_udf("binary")
    def run(texts):
        import pandas as pd

        return pd.Series([None if t is None else make(t) for t in texts], dtype=object)

    return run(markdown)
