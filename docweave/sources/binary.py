"""Readers of binary formats without a library: compound files, HWP 5 text, plain PDF text."""

from __future__ import annotations

import re
import struct
import zlib

from docweave.sources import formats
from docweave.sources.formats import MEMBER_BYTES, TooLarge, inflate

_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE


class CompoundFile:
    """Streams of an OLE compound file by path. Damaged chains end where they break, so that what can be
    read is read."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
            raise ValueError("no compound file")
        self.data = data
        self.sector, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, self.cutoff, first_mini, _, first_difat, difats = struct.unpack_from("<I4xIIIII", data, 48)
        difat = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(difats, 1 << 16)):
            block = self._sector(first_difat)
            if len(block) < self.sector:
                break
            *more, first_difat = struct.unpack(f"<{self.sector // 4}I", block)
            difat += more
        self.fat = [x for s in difat if s < _END for x in self._numbers(self._sector(s))]
        self.minifat = self._numbers(self._chain(first_mini))
        self.streams: dict[str, tuple[int, int]] = {}
        self._directory(self._chain(first_dir))

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.sector : (n + 2) * self.sector]

    @staticmethod
    def _numbers(block: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(block) // 4}I", block[: len(block) // 4 * 4]))

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < len(self.fat) and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start]
        return b"".join(out)

    def _directory(self, block: bytes) -> None:
        entries = []
        for at in range(0, len(block) - 127, 128):
            length, kind = struct.unpack_from("<HB", block, at + 64)
            left, right, child = struct.unpack_from("<III", block, at + 68)
            start, size = struct.unpack_from("<II", block, at + 116)
            entries.append((block[at : at + max(length - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, start, size))
        if not entries:
            raise ValueError("no directory")
        self.ministream = self._chain(entries[0][5])
        todo, seen = [(entries[0][4], "")], set()
        while todo:
            n, path = todo.pop()
            if n >= len(entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, start, size = entries[n]
            todo += [(left, path), (right, path)]
            if kind == 1:
                todo.append((child, f"{path}{name}/"))
            elif kind == 2:
                self.streams[path + name] = (start, size)

    def read(self, path: str) -> bytes:
        start, size = self.streams[path]
        if size > MEMBER_BYTES:
            raise TooLarge(path)
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < len(self.minifat) and start not in seen:
            seen.add(start)
            out.append(self.ministream[start * self.mini : (start + 1) * self.mini])
            start = self.minifat[start]
        return b"".join(out)[:size]


def hwp_records(data: bytes) -> list[tuple[int, int, bytes]]:
    """(tag, level, body) of a record stream; a record that claims more than is left ends it."""
    out, at = [], 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        tag, level, size = head & 0x3FF, head >> 10 & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            if at + 4 > len(data):
                break
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        if at + size > len(data):
            break
        out.append((tag, level, data[at : at + size]))
        at += size
    return out


_PARA_TEXT = 67
_SINGLE = {0, 10, 13, *range(24, 32)}


def hwp_paragraph(body: bytes) -> str:
    """Text of a paragraph record: control characters other than the single ones take eight units."""
    units, out, i = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2]), [], 0
    while i < len(units):
        u = units[i]
        if u >= 32:
            out.append(u)
        elif u in (10, 9):
            out.append(u)
        elif u in (30, 31):
            out.append(32)
        i += 1 if u >= 32 or u in _SINGLE else 8
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace").strip()


# Tags of control headers, list headers (of a table's cells among others) and tables.
_CONTROL, _LIST, _TABLE = 71, 72, 77
_HEADINGS = ((re.compile("부칙"), 1), (re.compile(r"제\s*\d+\s*[편장]", re.A), 2), (re.compile(r"제\s*\d+\s*[절조]", re.A), 3), (re.compile(r"제\s*\d+\s*목", re.A), 4))


def heading_of(text: str) -> int:
    """The level of a paragraph that is a heading by its words; 0 for others, and for long ones."""
    first = text.split("\n", 1)[0]
    if len(text.encode()) > 240 or len(first.encode()) > 80:
        return 0
    return next((level for pattern, level in _HEADINGS if pattern.match(first)), 0)


def hwp_blocks(records: list[tuple[int, int, bytes]]) -> list[dict]:
    """Blocks (kind, level, text, or rows of cells with rowspan and colspan) of a record stream, in order. A table holds
    what lies deeper than its control; tables within its cells are part of the cell's text."""
    out: list[dict] = []
    at = 0
    while at < len(records):
        tag, level, body = records[at]
        at += 1
        if tag == _PARA_TEXT:
            if text := hwp_paragraph(body):
                out.append({"kind": "heading" if heading_of(text) else "paragraph", "level": heading_of(text), "text": text})
        elif tag == _CONTROL and body[:4] == b" lbt":
            end = at
            while end < len(records) and records[end][1] > level:
                end += 1
            rows = _hwp_table(records[at:end], level + 1)
            if rows:
                out.append({"kind": "table", "level": 0, "rows": rows})
            at = end
    return out


def _hwp_table(records: list[tuple[int, int, bytes]], depth: int) -> list[list[dict]]:
    cells: list[dict] = []
    for tag, level, body in records:
        if tag == _LIST and level == depth and len(body) >= 16:
            col, row, wide, high = struct.unpack_from("<4H", body, 8)
            cells.append({"row": row, "col": col, "rowspan": max(high, 1), "colspan": max(wide, 1), "text": ""})
        elif tag == _PARA_TEXT and cells and (text := hwp_paragraph(body)):
            cells[-1]["text"] += ("\n" if cells[-1]["text"] else "") + text
    rows: dict[int, list[dict]] = {}
    for c in sorted(cells, key=lambda c: (c["row"], c["col"])):
        rows.setdefault(c["row"], []).append(c)
    return [rows[r] for r in sorted(rows)]


def _hwp_sections(data: bytes) -> list[bytes]:
    container = CompoundFile(data)
    flags = struct.unpack_from("<I", container.read("FileHeader"), 36)[0]
    if flags & 2:
        raise ValueError("encrypted")
    out = []
    while (path := f"BodyText/Section{len(out)}") in container.streams:
        raw = container.read(path)
        out.append(inflate(raw) if flags & 1 else raw)
    return out


def read_hwp(data: bytes) -> str:
    """Paragraphs, headings and tables (as HTML where cells are merged) of an HWP 5 file, sections in order. Encrypted files
    are refused."""
    from docweave.operators.blocks import html_table, merged, render_table

    out = []
    for section in _hwp_sections(data):
        for b in hwp_blocks(hwp_records(section)):
            if b["kind"] == "table":
                width = max(map(len, b["rows"]))
                plain = not merged(b["rows"])
                out.append(render_table([[c["text"] for c in r] + [""] * (width - len(r)) for r in b["rows"]]) if plain else html_table(b["rows"]))
            else:
                out.append("#" * b["level"] + " " + b["text"] if b["level"] else b["text"])
    return "\n\n".join(out)


def hwp_images(data: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of the binary data of an HWP 5 file, inflated where it is deflated."""
    container, out = CompoundFile(data), []
    for path in sorted(container.streams):
        if path.startswith("BinData/"):
            raw = container.read(path)
            try:
                raw = inflate(raw)
            except (zlib.error, ValueError):
                pass
            out.append((path.rpartition("/")[2], raw))
    return out


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
_SHOW = re.compile(rb"/(\w+)\s+[\d.]+\s+Tf|(\[(?:[^\[\]\\]|\\.)*\])\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(\bT\*|\bT[dD]\b|\bTm\b|\bET\b)", re.S)


def unescape_pdf(raw: bytes) -> bytes:
    """The bytes of a literal string without its brackets."""
    names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}

    def one(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else names.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def cmap(stream: bytes) -> dict[int, str]:
    """Code -> text of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, last, start = int(a, 16), int(b, 16), text(c)
            out |= {n: start[:-1] + chr(ord(start[-1]) + n - first) for n in range(first, min(last, first + 65535) + 1)}
    return out


_TOKEN = re.compile(rb"(?P<string>\((?:\\.|[^\\()])*\))|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open>\[)|(?P<close>\])|(?P<name>/[^\s/\[\]()<>]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<op>[A-Za-z'\"][A-Za-z0-9*]*)|(?P<skip><<|>>|%[^\n]*)", re.S)
Matrix = tuple[float, float, float, float, float, float]


def _times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


class _Reader:
    """The objects of a PDF with their streams inflated, and the ToUnicode maps of its fonts by name."""

    def __init__(self, data: bytes):
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            self.objects[int(m[1])] = m[2]
            if s := _STREAM.search(m[2]):
                body = s[1]
                if b"FlateDecode" in m[2][: s.start()]:
                    try:
                        body = zlib.decompressobj().decompress(body, MEMBER_BYTES)
                    except zlib.error:
                        continue
                self.streams[int(m[1])] = body
        self.maps: dict[bytes, dict[int, str]] = {}
        self.bold: set[bytes] = set()
        for body in self.objects.values():
            for name, ref in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", body):
                font = self.objects.get(int(ref), b"")
                to = re.search(rb"/ToUnicode\s+(\d+)\s+0\s+R", font)
                if to and int(to[1]) in self.streams:
                    self.maps[name] = cmap(self.streams[int(to[1])])
                if re.search(rb"/BaseFont\s*/\S*Bold", font):
                    self.bold.add(name)

    def shown(self, raw: bytes, font: bytes) -> str:
        digits = re.sub(rb"\s", b"", raw[1:-1])
        value = bytes.fromhex(digits.decode()) if raw[:1] == b"<" and len(digits) % 2 == 0 else unescape_pdf(raw[1:-1])
        table = self.maps.get(font)
        if table is None:
            return value.decode("cp1252", "replace")
        wide = max(table, default=0) > 255 or raw[:1] == b"<" and len(value) % 2 == 0 and not any(b in table for b in value[:1])
        codes = struct.unpack(f">{len(value) // 2}H", value[: len(value) // 2 * 2]) if wide else value
        return "".join(table.get(c, "\ufffd") for c in codes)

    def contents(self) -> list[bytes]:
        """Content streams of pages in the order of the page objects; without such, all streams that show text."""
        out = []
        for body in self.objects.values():
            if re.search(rb"/Type\s*/Page\b", body) and (m := re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+0\s+R)", body)):
                refs = [int(n) for n in re.findall(rb"(\d+)\s+0\s+R", m[1])] if m[1] is not None else [int(m[2])]
                out.append(b"\n".join(self.streams[n] for n in refs if n in self.streams))
        return out or [b for b in self.streams.values() if b"BT" in b and (b"Tj" in b or b"TJ" in b)]


def pdf_layout(data: bytes) -> list[dict]:
    """Pages of a PDF: {"runs": [x, y, width, size, text, bold], "lines": [x1, y1, x2, y2]} in page units, y upward.
    Widths are estimates (half a size a letter, a whole one for wide ones), as font programs aren't read."""
    reader, pages = _Reader(data), []
    for body in reader.contents():
        runs, lines = [], []
        ctm: Matrix = (1, 0, 0, 1, 0, 0)
        saved: list[Matrix] = []
        tm = tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        font, size, leading, args, array, inside = b"", 1.0, 0.0, [], [], False
        path: list[tuple[float, float, float, float]] = []
        here = (0.0, 0.0)

        def at(x: float, y: float) -> tuple[float, float]:
            a, b, c, d, e, f = ctm
            return a * x + c * y + e, b * x + d * y + f

        def show(raw: list) -> None:
            nonlocal tm
            text, moved = "", 0.0
            for part in raw:
                if isinstance(part, bytes):
                    said = reader.shown(part, font)
                    text += said
                    moved += sum(1.0 if ord(c) > 0x1100 else 0.5 for c in said) * size
                else:
                    if part < -200 and text and not text.endswith(" "):
                        text += " "
                    moved -= part / 1000 * size
            m = _times(tm, ctm)
            if text.strip():
                runs.append({"x": m[4], "y": m[5], "width": moved * abs(m[0] or m[1] or 1), "size": size * abs(m[3] or m[0] or 1), "text": text, "bold": font in reader.bold})
            tm = _times((1, 0, 0, 1, moved, 0), tm)

        for token in _TOKEN.finditer(body):
            kind, raw = token.lastgroup, token[0]
            if kind in ("string", "hex"):
                (array if inside else args).append(raw)
            elif kind == "number":
                (array if inside else args).append(float(raw))
            elif kind == "open":
                array, inside = [], True
            elif kind == "close":
                args.append(array)
                inside = False
            elif kind == "name":
                args.append(raw)
            elif kind == "op":
                n = [a for a in args if isinstance(a, float)]
                if raw == b"q":
                    saved.append(ctm)
                elif raw == b"Q" and saved:
                    ctm = saved.pop()
                elif raw == b"cm" and len(n) == 6:
                    ctm = _times(tuple(n), ctm)
                elif raw == b"BT":
                    tm = tlm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                elif raw == b"Tf" and n:
                    font, size = next((a[1:] for a in args if isinstance(a, bytes)), font), n[-1]
                elif raw == b"TL" and n:
                    leading = n[0]
                elif raw == b"Tm" and len(n) == 6:
                    tm = tlm = tuple(n)
                elif raw in (b"Td", b"TD") and len(n) == 2:
                    leading = -n[1] if raw == b"TD" else leading
                    tm = tlm = _times((1, 0, 0, 1, n[0], n[1]), tlm)
                elif raw == b"T*":
                    tm = tlm = _times((1, 0, 0, 1, 0, -leading), tlm)
                elif raw in (b"Tj", b"'", b'"') and args:
                    if raw != b"Tj":
                        tm = tlm = _times((1, 0, 0, 1, 0, -leading), tlm)
                    show([a for a in args[-1:] if isinstance(a, bytes)])
                elif raw == b"TJ" and args and isinstance(args[-1], list):
                    show(args[-1])
                elif raw == b"m" and len(n) == 2:
                    here = at(*n)
                elif raw == b"l" and len(n) == 2:
                    there = at(*n)
                    path.append((*here, *there))
                    here = there
                elif raw == b"re" and len(n) == 4:
                    x, y, w, h = n
                    corners = [at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)]
                    # A rectangle as thin as a line is one.
                    if abs(w) <= 2 or abs(h) <= 2:
                        path.append((*corners[0], *corners[2]))
                    else:
                        path += [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
                elif raw in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                    lines += [{"x1": a, "y1": b, "x2": c, "y2": d} for a, b, c, d in path if abs(a - c) <= 1 or abs(b - d) <= 1]
                    path = []
                elif raw == b"n":
                    path = []
                args = []
        pages.append({"runs": runs, "lines": lines})
    return pages


def pdf_pages(data: bytes) -> list[str]:
    """Text of the content streams of a PDF in their order, a page each. Fonts are told apart by name, text by the
    ToUnicode map of its font or as Latin. Object streams and encryption aren't read."""
    reader, pages = _Reader(data), []
    for body in reader.contents():
        out, font = [], b""
        for m in _SHOW.finditer(body):
            if m[1]:
                font = m[1]
            elif m[2]:
                out.append("".join(reader.shown(s, font) for s in _STRING.findall(m[2])))
            elif m[3]:
                out.append(reader.shown(m[3], font))
            elif out and out[-1] != "\n":
                out.append("\n")
        pages.append("".join(out).strip())
    return pages


def pdf_markdown(data: bytes) -> str:
    """A PDF by its layout: headings, lists, paragraphs by column, and tables. Pages whose
    text all stands at one height, as it does without positions, keep it as it is shown."""
    from docweave.operators import layout as Y

    out = []
    for page, plain in zip(pdf_layout(data), pdf_pages(data), strict=True):
        placed = len({round(r["y"]) for r in page["runs"]}) > 1
        found = Y.elements([Y.Run(**r) for r in page["runs"]], [tuple(r.values()) for r in page["lines"]]) if placed else []
        out.append(Y.page_markdown(found) if found else plain)
    return "\n\n".join(p for p in out if p)


def read_pdf(data: bytes) -> str:
    if re.search(rb"/Encrypt\b", data[-4096:]):
        raise ValueError("encrypted")
    return "\n\n".join(p for p in pdf_pages(data) if p)


def read_pdf_layout(data: bytes) -> str:
    """As read_pdf, with headings, columns and tables; formats.register("pdf", read_pdf_layout, replace=True) makes conversions use it."""
    if re.search(rb"/Encrypt\b", data[-4096:]):
        raise ValueError("encrypted")
    return pdf_markdown(data)


formats.register("hwp", read_hwp)
formats.register("pdf", read_pdf)
