"""Format detection, and readers of document formats as plain functions from bytes.

A reader takes the bytes of one file and gives Markdown; the registry maps extensions to readers, and
files.convert applies them in Arrow batches. Sizes are bounded, so that a hostile archive can't
fill a worker's memory.
"""

from __future__ import annotations

import csv
import html as html_lib
import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree as ET

from docweave.operators.blocks import render_table

#: Most bytes of one archive member, of one XML member, and of one file.
MEMBER_BYTES, XML_BYTES, FILE_BYTES = 64 << 20, 32 << 20, 512 << 20
#: Cells of a table's grid, which addresses alone can make large; a table beyond it fails the file.
TABLE_CELLS = 10_000_000
MAGIC = ((b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"{\\rtf", "rtf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), (b"HWP Document File", "hwp3"))
EXTENSIONS = {
    "txt": "txt", "text": "txt", "log": "txt", "md": "md", "csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "xhtml": "html", "xlsx": "xlsx",
    "pptx": "pptx", "docx": "docx", "epub": "epub", "hwpx": "hwpx", "rtf": "rtf", "hwp": "hwp", "doc": "doc", "xls": "xls", "pdf": "pdf", "hml": "hwpml",
}


class TooLarge(ValueError):
    pass


def inflate(data: bytes, most: int = MEMBER_BYTES) -> bytes:
    """Raw deflate data, refused beyond most bytes."""
    machine = zlib.decompressobj(-15)
    out = machine.decompress(data, most + 1)
    if len(out) > most:
        raise TooLarge(f"more than {most} bytes")
    return out


def member(archive: zipfile.ZipFile, name: str, most: int = XML_BYTES) -> bytes:
    with archive.open(name) as stream:
        data = stream.read(most + 1)
    if len(data) > most:
        raise TooLarge(f"{name}: more than {most} bytes")
    return data


def zip_kind(data: bytes) -> str:
    """What an archive holds, by its first thirty names."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = archive.namelist()[:30]
        # Both books and word processor files name their type first.
        if names[:1] == ["mimetype"] and b"hwp" in member(archive, "mimetype", 1000):
            return "hwpx"
    except zipfile.BadZipFile:
        return "unknown"
    for name in names:
        for prefix, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx"), ("Contents/", "hwpx"), ("META-INF/", "hwpx" if "mimetype" not in names else "epub")):
            if name.startswith(prefix):
                return kind
        if name == "mimetype" or name.endswith(".opf"):
            return "epub"
    return "zip"


def ole_kind(data: bytes) -> str:
    wide = lambda s: s.encode("utf-16-le")
    head = data[: 1 << 20]
    return "xls" if wide("Workbook") in head or wide("Book") in head else "doc" if wide("WordDocument") in head else "hwp"


def detect(data: bytes, path: str, precedence: str = "magic") -> str:
    """The format of a file. precedence "magic" trusts its first bytes over its extension, "extension" the other way."""
    by_name = EXTENSIONS.get(path.rpartition(".")[2].lower())
    found = next((kind for head, kind in MAGIC if data.startswith(head)), None)
    found = zip_kind(data) if found == "zip" else ole_kind(data) if found == "ole" else found
    return (found or by_name if precedence == "magic" else by_name or found) or "unknown"


def decode(data: bytes) -> str:
    """Text by its byte order mark, else as UTF-8 if that is strict, else as Windows' Korean code page."""
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp949", "replace")


def read_text(data: bytes) -> str:
    return decode(data)


def csv_rows(data: bytes) -> list[list[str]]:
    """Rows of any width; tabs separate if the first line has more of them than commas. Blank rows at the end go."""
    text = decode(data)
    first = text.split("\n", 1)[0]
    rows = list(csv.reader(io.StringIO(text), delimiter="\t" if first.count("\t") > first.count(",") else ","))
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    return rows


def grid_markdown(rows: list[list[str]]) -> str:
    """A pipe table without the empty columns at the right."""
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
    return render_table([[*r[:width], *[""] * (width - len(r))] for r in rows]) if width else ""


def read_csv(data: bytes) -> str:
    return grid_markdown(csv_rows(data))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node if _local(c.tag) == name]


def _attribute(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _texts(node: ET.Element, name: str = "t") -> str:
    return "".join(n.text or "" for n in node.iter() if _local(n.tag) == name)


def number_text(value: str) -> str:
    """A number as sheets show it: without .0 where it is whole."""
    try:
        f = float(value)
    except ValueError:
        return value
    return str(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f)


def serial_date(serial: float) -> str:
    """A spreadsheet's day number as ISO date or time; day 60 never was."""
    import datetime

    day = datetime.datetime(1899, 12, 31) + datetime.timedelta(days=serial - (serial >= 60))
    return day.date().isoformat() if serial == int(serial) else day.replace(microsecond=0).isoformat()


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of the sheets in order; cells as text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = [_texts(si) for si in ET.fromstring(member(z, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(member(z, "xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in (n for n in ET.fromstring(member(z, "xl/workbook.xml")).iter() if _local(n.tag) == "sheet"):
        target = (rels.get(_attribute(sheet, "id")) or "").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        if path not in names:
            continue
        rows: list[list[str]] = []
        for row in (n for n in ET.fromstring(member(z, path)).iter() if _local(n.tag) == "row"):
            cells: list[str] = []
            for c in _children(row, "c"):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                raw = next((v.text or "" for v in _children(c, "v")), "")
                kind = c.get("t")
                value = shared[int(raw)] if kind == "s" and raw else _texts(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else number_text(raw) if raw and kind in (None, "n") else raw
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            number = int(row.get("r") or len(rows) + 1)
            rows += [[] for _ in range(number - len(rows))]
            rows[number - 1] = cells
        out.append((sheet.get("name") or "", rows))
    return out


def read_xlsx(data: bytes) -> str:
    parts = [(name, grid_markdown(rows)) for name, rows in xlsx_sheets(data)]
    return "\n\n".join(f"## {name}\n\n{grid}" for name, grid in parts if grid)


def _pptx_paragraphs(shape: ET.Element) -> list[str]:
    return [t for p in shape.iter() if _local(p.tag) == "p" and (t := _texts(p).strip())]


def read_pptx(data: bytes) -> str:
    """Slides in order: title, text, tables, notes; notes are found by relationship, not by number."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for no, path in enumerate(slides, 1):
        title, body = None, []
        for shape in ET.fromstring(member(z, path)).iter():
            tag = _local(shape.tag)
            if tag == "sp":
                texts = _pptx_paragraphs(shape)
                holder = next((p.get("type") for p in shape.iter() if _local(p.tag) == "ph"), None)
                if holder in ("title", "ctrTitle") and title is None:
                    title = " ".join(texts)
                else:
                    body += texts
            elif tag == "tbl":
                rows = [["\n".join(_pptx_paragraphs(c)) for c in _children(r, "tc")] for r in _children(shape, "tr")]
                body += [render_table(rows)] if rows else []
        notes = ""
        rel = path.replace("slides/", "slides/_rels/") + ".rels"
        for r in ET.fromstring(member(z, rel)) if rel in names else []:
            if (r.get("Type") or "").endswith("/notesSlide"):
                target = "ppt/" + (r.get("Target") or "").removeprefix("../")
                notes = " ".join(_pptx_paragraphs(ET.fromstring(member(z, target)))) if target in names else ""
        head = f"## Slide {no}" + (f": {title}" if title else "")
        out.append("\n\n".join([head, *body, *([f"> **Notes:** {notes}"] if notes else [])]))
    return "\n\n---\n\n".join(out)


def _docx_run(run: ET.Element) -> str:
    text = "".join({"t": n.text or "", "tab": "\t", "br": "\n"}.get(_local(n.tag), "") for n in run.iter())
    properties = {_local(p.tag): _attribute(p, "val") for r in _children(run, "rPr") for p in r}
    on = lambda name: name in properties and properties[name] not in ("0", "false", "none")
    if text.strip():
        for name, mark in (("strike", "~~"), ("i", "*"), ("b", "**")):
            text = f"{mark}{text}{mark}" if on(name) else text
    return text


def _docx_paragraph(p: ET.Element, links: dict[str, str], levels: dict[str, int]) -> str:
    out = []
    for node in p:
        if _local(node.tag) == "r":
            out.append(_docx_run(node))
            out += [f"[^{_attribute(n, 'id')}]" for n in node.iter() if _local(n.tag) == "footnoteReference"]
        elif _local(node.tag) == "hyperlink":
            text = "".join(_docx_run(r) for r in _children(node, "r"))
            target = links.get(_attribute(node, "id") or "")
            out.append(f"[{text}]({target})" if target else text)
    text = "".join(out).strip().replace("****", "")
    properties = {_local(n.tag): n for pr in _children(p, "pPr") for n in pr}
    level = None
    if "outlineLvl" in properties:
        level = int(_attribute(properties["outlineLvl"], "val") or 9) + 1
    elif "pStyle" in properties:
        level = levels.get(_attribute(properties["pStyle"], "val") or "")
    if text and level and level <= 6:
        return "#" * level + " " + text.replace("**", "")
    if text and "numPr" in properties:
        depth = next((int(_attribute(n, "val") or 0) for n in properties["numPr"] if _local(n.tag) == "ilvl"), 0)
        return "  " * depth + "- " + text
    return text


def read_docx(data: bytes) -> str:
    """Headings by outline level or style, paragraphs, lists, tables (cells that continue a merge are blank), links,
    footnotes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    links, levels = {}, {}
    if "word/_rels/document.xml.rels" in names:
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(member(z, "word/_rels/document.xml.rels")) if (r.get("Type") or "").endswith("/hyperlink")}
    if "word/styles.xml" in names:
        for style in (s for s in ET.fromstring(member(z, "word/styles.xml")) if _local(s.tag) == "style"):
            name = next((_attribute(n, "val") or "" for n in _children(style, "name")), "")
            outline = next((int(_attribute(n, "val") or 9) + 1 for n in style.iter() if _local(n.tag) == "outlineLvl"), None)
            m = re.fullmatch(r"(?i)(?:heading|제목|개요)\s*(\d)", name)
            if outline or m:
                levels[_attribute(style, "styleId") or ""] = outline or int(m[1])
    out, body = [], next((n for n in ET.fromstring(member(z, "word/document.xml")) if _local(n.tag) == "body"), None)
    for node in body if body is not None else []:
        if _local(node.tag) == "p":
            out.append(_docx_paragraph(node, links, levels))
        elif _local(node.tag) == "tbl":
            rows = []
            for tr in _children(node, "tr"):
                cells = []
                for tc in _children(tr, "tc"):
                    merge = next((m for m in tc.iter() if _local(m.tag) == "vMerge"), None)
                    text = " ".join(filter(None, (_docx_paragraph(p, links, {}) for p in _children(tc, "p"))))
                    cells.append("" if merge is not None and _attribute(merge, "val") != "restart" else text)
                    cells += [""] * (next((int(_attribute(g, "val") or 1) for g in tc.iter() if _local(g.tag) == "gridSpan"), 1) - 1)
                rows.append(cells)
            width = max(map(len, rows), default=0)
            out.append(render_table([r + [""] * (width - len(r)) for r in rows]) if width else "")
    if "word/footnotes.xml" in names:
        for note in ET.fromstring(member(z, "word/footnotes.xml")):
            text = _texts(note).strip()
            if text and _attribute(note, "type") is None:
                out.append(f"[^{_attribute(note, 'id')}]: {text}")
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(x for x in out if x))


def package_media(data: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the media embedded in an office package, in order of their names."""
    z = zipfile.ZipFile(io.BytesIO(data))
    inside = sorted(n for n in z.namelist() if re.search(r"(?:^|/)(?:media|BinData)/[^/]+$", n))
    return [(n.rsplit("/", 1)[-1], member(z, n, MEMBER_BYTES)) for n in inside]


def package_properties(data: bytes) -> dict[str, str]:
    """The properties of an office package (title, creator, pages and so on) that aren't blank."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names, out = set(z.namelist()), {}
    for part in ("docProps/core.xml", "docProps/app.xml"):
        if part in names:
            out |= {_local(n.tag): n.text.strip() for n in ET.fromstring(member(z, part)) if not len(n) and n.text and n.text.strip()}
    return out


def _cached(node: ET.Element) -> list[str | None]:
    """The points of a chart's cache at their indexes, or its only value."""
    points = [n for n in node.iter() if _local(n.tag) == "pt"]
    text = lambda n: next((v.text or "" for v in n.iter() if _local(v.tag) == "v"), None)
    if not points:
        return [] if text(node) is None else [text(node)]
    count = next((int(n.get("val") or 0) for n in node.iter() if _local(n.tag) == "ptCount"), 0)
    at = {int(p.get("idx") or 0): text(p) for p in points}
    return [at.get(i) for i in range(min(max(count, max(at) + 1), 1_000_000))]


def chart(data: bytes) -> dict | None:
    """kind, title, categories and series (name, values) of a chart part; None without any series."""
    found = {_local(n.tag): n for n in ET.fromstring(data).iter() if _local(n.tag) in ("chart", "plotArea")}
    if len(found) < 2:
        return None
    plot = found["plotArea"]
    kind = next((_local(n.tag)[:-5] for n in plot if _local(n.tag).endswith("Chart")), None)
    title = next((n for n in found["chart"] if _local(n.tag) == "title"), None)
    categories: list[str] = []
    series = []
    for ser in (n for n in plot.iter() if _local(n.tag) == "ser"):
        part = {_local(n.tag): n for n in ser}
        own = _cached(part["cat"]) if "cat" in part else []
        categories = [c or "" for c in own] if len(own) > len(categories) else categories
        name = next((v for v in (_cached(part["tx"]) if "tx" in part else []) if v), f"계열 {len(series) + 1}")
        values = part.get("val", part.get("yVal"))
        series.append((name, _cached(values) if values is not None else []))
    return {"kind": kind, "title": _texts(title).strip() or None if title is not None else None, "categories": categories, "series": series} if kind and series else None


def chart_markdown(found: dict) -> str:
    """A caption and a table with a row per category; without a name a category is its number."""
    cell = lambda v: (v or "").replace("|", "\\|").replace("\n", " ")
    rows = max([len(found["categories"]), *[len(v) for _, v in found["series"]]])
    title = f"{found['title']} ({found['kind']})" if found["title"] else found["kind"]
    out = [f"**차트: {title}**", "", "| 항목 | " + " | ".join(cell(n) for n, _ in found["series"]) + " |", "|" + " --- |" * (1 + len(found["series"]))]
    for r in range(rows):
        name = found["categories"][r] if r < len(found["categories"]) and found["categories"][r] else str(r + 1)
        out.append("| " + " | ".join([cell(name), *[cell(v[r]) if r < len(v) else "" for _, v in found["series"]]]) + " |")
    return "\n".join(out)


def read_hwpml(data: bytes) -> str:
    """Paragraphs and tables of a word processor's XML, in order; tables with merged cells as HTML."""
    from docweave.operators.blocks import html_table, merged

    def paragraph(p: ET.Element, out: list[str]) -> None:
        said = []
        for part in p.iter():
            if _local(part.tag) == "CHAR" and id(part) not in inside:
                said.append("".join(part.itertext()))
        if "".join(said).strip():
            out.append("".join(said).strip())

    def cell_text(cell: ET.Element) -> str:
        return "\n".join(filter(None, ("".join("".join(c.itertext()) for c in p.iter() if _local(c.tag) == "CHAR").strip() for p in cell.iter() if _local(p.tag) == "P")))

    root, out = ET.fromstring(data), []
    tables = [n for n in root.iter() if _local(n.tag) == "TABLE"]
    inside = {id(n) for t in tables for n in t.iter()}
    for p in (n for n in root.iter() if _local(n.tag) == "P" and id(n) not in inside):
        paragraph(p, out)
        for t in (n for n in p.iter() if _local(n.tag) == "TABLE"):
            number = lambda c, name: int(c.get(name) or 1)
            rows = [[{"text": cell_text(c), "rowspan": number(c, "RowSpan"), "colspan": number(c, "ColSpan")} for c in r if _local(c.tag) == "CELL"] for r in t if _local(r.tag) == "ROW"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                out.append(html_table(rows) if merged(rows) else render_table([[c["text"] for c in r] + [""] * (width - len(r)) for r in rows]))
    return "\n\n".join(out)


_NOISE = re.compile(r"(?is)<(script|style|nav|header|footer|noscript|svg|head)\b.*?</\1\s*>|<!--.*?-->")
_TAG_RULES = [
    (re.compile(r"(?is)<pre[^>]*>(.*?)</pre>"), lambda m: "\n\n```\n" + re.sub("<[^>]+>", "", m[1]).strip("\n") + "\n```\n\n"),
    (re.compile(r"(?is)<table[^>]*>(.*?)</table>"), lambda m: "\n\n" + _html_table(m[1]) + "\n\n"),
    (re.compile(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"), lambda m: f"\n\n{'#' * int(m[1])} {_inline(m[2]).strip()}\n\n"),
    (re.compile(r"(?is)<blockquote[^>]*>(.*?)</blockquote>"), lambda m: "\n\n> " + _inline(m[1]).strip().replace("\n", "\n> ") + "\n\n"),
    (re.compile(r"(?is)<ol\b[^>]*>(.*?)</ol>"), lambda m: "\n\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(_items(m[1]), 1)) + "\n\n"),
    (re.compile(r"(?is)<ul\b[^>]*>(.*?)</ul>"), lambda m: "\n\n" + "\n".join(f"- {x}" for x in _items(m[1])) + "\n\n"),
]


def _items(inner: str) -> list[str]:
    return [x for i in re.findall(r"(?is)<li\b[^>]*>(.*?)(?=</li>|<li\b|\Z)", inner) if (x := " ".join(_inline(i).split()))]


def _html_table(inner: str) -> str:
    rows = [[" ".join(_inline(c).split()) for c in re.findall(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", inner)]
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    return render_table([r + [""] * (width - len(r)) for r in rows]) if rows else ""


def _link(m: re.Match) -> str:
    text, href = _inline(m[2]).strip(), html_lib.unescape(m[1])
    return text if re.match(r"(?i)\s*(javascript|vbscript|data):", href) else f"[{text}]({href})"


def _image(m: re.Match) -> str:
    get = lambda name: next(iter(re.findall(rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)", m[0])), "")
    src = get("src")
    return f"![{get('alt')}]({src.split(',', 1)[0] + ',...' if src.startswith('data:') and len(src) > 64 else src})"


def _inline(text: str) -> str:
    text = re.sub(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", _link, text)
    text = re.sub(r"(?is)<img\b[^>]*>", _image, text)
    for tags, mark in (("b|strong", "**"), ("i|em", "*"), ("code", "`")):
        text = re.sub(rf"(?is)<({tags})(?:\s[^>]*)?>(.*?)</\1>", lambda m, mark=mark: mark + m[2].strip() + mark if m[2].strip() else "", text)
    return re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>", "\n", text))


def html_markdown(html: str) -> str:
    """Markdown of an HTML page: scripts, styles and page furniture dropped, then blocks, then inline tags, then entities."""
    text = _NOISE.sub("", html)
    for pattern, rule in _TAG_RULES:
        text = pattern.sub(rule, text)
    text = re.sub(r"(?i)</p>|</div>", "\n\n", text)
    text = re.sub(r"(?i)<hr\s*/?>", "\n\n---\n\n", text)
    text = html_lib.unescape(_inline(text)).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def read_html(data: bytes) -> str:
    return html_markdown(decode(data))


def epub_chapters(data: bytes) -> list[tuple[str, str]]:
    """(path, Markdown) of the chapters in reading order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    root = next(n.get("full-path") for n in ET.fromstring(member(z, "META-INF/container.xml")).iter() if _local(n.tag) == "rootfile")
    opf = ET.fromstring(member(z, root))
    base = root.rpartition("/")[0]
    hrefs = {n.get("id"): n.get("href") for n in opf.iter() if _local(n.tag) == "item"}
    order = [hrefs.get(n.get("idref")) for n in opf.iter() if _local(n.tag) == "itemref"]
    paths = [f"{base}/{h}".lstrip("/") for h in order if h]
    return [(p, html_markdown(decode(member(z, p)))) for p in paths if p in names]


def read_epub(data: bytes) -> str:
    return "\n\n---\n\n".join(t for _, t in epub_chapters(data) if t)


def read_hwpx(data: bytes) -> str:
    """Sections until one is missing: paragraphs, and tables by their cells' addresses and spans."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names, out, no = set(z.namelist()), [], 0
    while f"Contents/section{no}.xml" in names:
        for node in ET.fromstring(member(z, f"Contents/section{no}.xml")):
            if _local(node.tag) == "p":
                out += _hwpx_paragraph(node)
        no += 1
    return "\n\n".join(out)


def _hwpx_paragraph(p: ET.Element) -> list[str]:
    text, tables = "", []
    for run in _children(p, "run"):
        for node in run:
            if _local(node.tag) == "t":
                text += "".join(node.itertext())
            elif _local(node.tag) == "tbl":
                tables.append(_hwpx_table(node))
    return [x for x in (text.strip(), *tables) if x]


def _hwpx_table(table: ET.Element) -> str:
    cells = {}
    for row_no, row in enumerate(_children(table, "tr")):
        for col_no, cell in enumerate(_children(row, "tc")):
            address = next(iter(_children(cell, "cellAddr")), None)
            at = (int(address.get("rowAddr")), int(address.get("colAddr"))) if address is not None else (row_no, col_no)
            cells[at] = " ".join(t for s in _children(cell, "subList") for p in _children(s, "p") for t in _hwpx_paragraph(p))
    if not cells:
        return ""
    height, width = (max(k[i] for k in cells) + 1 for i in (0, 1))
    if height * width > TABLE_CELLS:
        raise TooLarge(f"table of {height} x {width}: more than {TABLE_CELLS} cells")
    return render_table([[cells.get((r, c), "") for c in range(width)] for r in range(height)])


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
_RTF_SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable"}


def read_rtf(data: bytes) -> str:
    """Text of an RTF file: tables of fonts and the like skipped, byte escapes in the file's code page."""
    source = data.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", source)
    codec = {"949": "cp949", "932": "cp932", "936": "gbk"}.get(page[1], f"cp{page[1]}") if page else "cp949"
    out, raw, stack, skip, ahead = [], bytearray(), [], False, 0
    uc = 1

    def flush() -> None:
        if raw:
            out.append(raw.decode(codec, "replace"))
            raw.clear()

    for m in _RTF.finditer(source):
        word, number, byte, symbol, brace, char = m.groups()
        if byte:
            if ahead:
                ahead -= 1
            elif not skip:
                raw.append(int(byte, 16))
            continue
        flush()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol:
            skip = skip or symbol == "*"
            out.append(symbol if symbol in "\\{}" and not skip else " " if symbol == "~" and not skip else "")
        elif word:
            if word in _RTF_SKIPPED:
                skip = True
            elif word == "uc":
                uc = int(number or 1)
            elif skip:
                continue
            elif word in ("par", "line", "row"):
                out.append("\n")
            elif word in ("tab", "cell"):
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                ahead = uc
        elif char and ahead:
            ahead -= 1
        elif char and not skip:
            out.append(char)
    flush()
    return "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())


#: Extension or format -> reader. Others are added with register().
READERS: dict[str, Callable[[bytes], str]] = {
    "txt": read_text, "md": read_text, "csv": read_csv, "html": read_html, "xlsx": read_xlsx, "pptx": read_pptx, "docx": read_docx, "epub": read_epub, "hwpx": read_hwpx, "rtf": read_rtf, "hwpml": read_hwpml,
}


def register(kind: str, reader: Callable[[bytes], str], replace: bool = False) -> None:
    """Adds a reader; the first one registered for a format holds unless replace is set."""
    if replace:
        READERS[kind] = reader
    else:
        READERS.setdefault(kind, reader)


def to_markdown(data: bytes, path: str, precedence: str = "magic") -> tuple[str, str]:
    """(format, Markdown) of a file; raises where there is no reader or the file is damaged."""
    from docweave.sources import binary  # noqa: F401  # registers its readers, on every worker

    if len(data) > FILE_BYTES:
        raise TooLarge(f"more than {FILE_BYTES} bytes")
    kind = detect(data, path, precedence)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return kind, READERS[kind](data)
