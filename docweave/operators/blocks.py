"""Markdown as ordered blocks, blocks as Markdown, and structure-aware chunks of them.

A document's blocks depend on their order, so parsing is a fold over one text in one row; the
result is exploded only afterwards, and no document is ever shuffled to be parsed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

_ITEM = StructType([StructField("text", StringType()), StructField("depth", IntegerType())])
BLOCK = StructType(
    [
        StructField("kind", StringType()),
        StructField("level", IntegerType()),
        StructField("text", StringType()),
        StructField("ordered", BooleanType()),
        StructField("items", ArrayType(_ITEM)),
        StructField("cells", ArrayType(ArrayType(StringType()))),
    ]
)
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})$")
_ITEM_LINE = re.compile(r"^([ \t]*)(?:([-*+])|(\d{1,9})[.)])\s+(.*)$")
_SEPARATOR = re.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?$")
_MARKER = re.compile(r"^(?:([□○●■◦▪ㅇ])|(\d{1,3})[.)]|([가-하])[.)]|([①-⑳])|\((\d{1,3})\)|\(([가-하])\))")
MAX_DEPTH = 8


def _block(kind: str, **values) -> dict:
    return {"kind": kind, "level": None, "text": None, "ordered": None, "items": None, "cells": None} | values


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def parse_blocks(text: str) -> list[dict]:
    """Blocks of a Markdown text: heading, separator, table (piped, or with a matching rule below its
    first row), list (a level for every two columns of indent, a tab counting two), and paragraphs,
    whose lines are joined by a space. Fences have no meaning of their own here."""
    out, paragraph = [], []
    lines = text.replace("\r\n", "\n").split("\n")

    def close() -> None:
        if paragraph:
            out.append(_block("paragraph", text=" ".join(paragraph)))
            paragraph.clear()

    i = 0
    while i < len(lines):
        line = lines[i].strip()
        below = lines[i + 1].strip() if i + 1 < len(lines) else ""
        item = _ITEM_LINE.match(lines[i])
        if not line:
            close()
        elif m := _HEADING.match(line):
            close()
            out.append(_block("heading", level=len(m[1]), text=m[2]))
        elif _RULE.match(line):
            close()
            out.append(_block("separator"))
        elif "|" in line and (line.startswith("|") or _SEPARATOR.match(below) and "|" in below and len(_cells(below)) == len(_cells(line))):
            close()
            rows = []
            while i < len(lines) and "|" in lines[i]:
                if not _SEPARATOR.match(lines[i].strip()):
                    rows.append(_cells(lines[i]))
                i += 1
            width = max(map(len, rows), default=0)
            if rows:
                out.append(_block("table", cells=[r + [""] * (width - len(r)) for r in rows]))
            continue
        elif item:
            close()
            items, ordered = [], item[3] is not None
            while i < len(lines) and (m := _ITEM_LINE.match(lines[i])) and (m[3] is not None) == ordered:
                depth = len(m[1].replace("\t", "  ")) // 2
                items.append({"text": m[4].strip(), "depth": min(depth, MAX_DEPTH)})
                i += 1
            out.append(_block("list", ordered=ordered, items=items))
            continue
        else:
            paragraph.append(line)
        i += 1
    close()
    return out


def _render_items(items: list[dict], ordered: bool) -> str:
    counters, out = [0] * (MAX_DEPTH + 2), []
    for item in items:
        depth = item["depth"]
        counters[depth] += 1
        counters[depth + 1 :] = [0] * (len(counters) - depth - 1)
        out.append("  " * depth + (f"{counters[depth]}. " if ordered else "- ") + item["text"])
    return "\n".join(out)


def render_table(cells: list[list[str]]) -> str:
    row = lambda cs: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cs) + " |"
    return "\n".join([row(cells[0]), "|" + " --- |" * len(cells[0]), *map(row, cells[1:])])


def merged(rows: list[list[dict]]) -> bool:
    """Whether any cell (text, rowspan, colspan) spans more than its place."""
    return any((c.get("rowspan") or 1) > 1 or (c.get("colspan") or 1) > 1 for row in rows for c in row)


def has_merged_cells(rows: Column) -> Column:
    """merged for an array of arrays of structs with rowspan and colspan; null counts as one."""
    wide = lambda c: (F.coalesce(c["rowspan"], F.lit(1)) > 1) | (F.coalesce(c["colspan"], F.lit(1)) > 1)
    return F.exists(rows, lambda row: F.exists(row, wide))


def html_table(rows: list[list[dict]]) -> str:
    """A table with merged cells as HTML: the first row are heads, places that a span covers aren't repeated."""
    covered: set[tuple[int, int]] = set()
    out = ["<table>"]
    for i, row in enumerate(rows):
        tag, col, cells = "td" if i else "th", 0, []
        for c in row:
            while (i, col) in covered:
                col += 1
            high, wide = max(c.get("rowspan") or 1, 1), max(c.get("colspan") or 1, 1)
            covered |= {(i + a, col + b) for a in range(high) for b in range(wide)}
            spans = (f' rowspan="{high}"' if high > 1 else "") + (f' colspan="{wide}"' if wide > 1 else "")
            cells.append(f"<{tag}{spans}>{html.escape(c.get('text') or '', quote=False).replace(chr(10), '<br>')}</{tag}>")
            col += wide
        out.append(f"<tr>{''.join(cells)}</tr>")
    return "\n".join([*out, "</table>"])


def render_blocks(blocks: list[dict]) -> str:
    """Markdown of blocks, a blank line between any two. Ordinals start anew below a shallower item."""
    out = []
    for b in blocks:
        if b["kind"] == "heading":
            out.append("#" * min(max(b["level"], 1), 6) + " " + b["text"])
        elif b["kind"] == "table":
            out.append(render_table(b["cells"]))
        elif b["kind"] == "list":
            out.append(_render_items(b["items"], b["ordered"]))
        else:
            out.append("---" if b["kind"] == "separator" else b["text"])
    return "\n\n".join(out)


@F.pandas_udf(ArrayType(BLOCK))
def markdown_blocks(texts: pd.Series) -> pd.Series:
    """Blocks of Markdown; null for null, no blocks for empty text."""
    return pd.Series([None if t is None else parse_blocks(t) for t in texts], dtype=object)


def _plain_block(b) -> dict:
    cells, items = b["cells"], b["items"]
    return dict(b) | {"cells": None if cells is None else [list(r) for r in cells], "items": None if items is None else list(items)}


@F.pandas_udf(StringType())
def blocks_markdown(blocks: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else render_blocks([_plain_block(x) for x in b]) for b in blocks], dtype=object)


def split_by_chars(text: str, most: int, overlap: int) -> list[str]:
    """Windows of most characters, each beginning overlap characters before the end of the one before."""
    step = max(most - overlap, 1)
    last = max(len(text) - most, 0)
    return [text[a : a + most] for a in range(0, last + step, step) if a < last + step and (a == 0 or a - step + most < len(text))]


def char_windows(text: Column, most: int, overlap: int) -> Column:
    """The same as an array Column; a text that fits is one window."""
    step = max(most - overlap, 1)
    windows = F.ceil(F.greatest(F.length(text) - most, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), windows), lambda i: F.substring(text, i * step + 1, F.lit(most)))


def _list_label(text: str) -> int | None:
    m = _MARKER.match(text.strip())
    return None if m is None else m.lastindex


def chunk_blocks(blocks: list[dict], most: int | None = None, overlap: int = 0, by: str = "section") -> list[dict]:
    """Chunks with breadcrumb: headings and tables by themselves, lists by groups of siblings, and the
    text between them, merged where the breadcrumb stays the same (by="section") or block by block.
    Texts beyond most characters are cut into overlapping windows, tables by rows with their first row
    repeated. Empty blocks give no chunk."""
    out, headings, held = [], [], []

    def add(kind: str, crumbs: list[str], text: str, first: int, last: int) -> None:
        parts = split_by_chars(text, most, overlap) if most and len(text) > most and kind == "text" else [text]
        for part in parts:
            out.append({"id": f"c{len(out) + 1:04d}", "kind": kind, "breadcrumb": list(crumbs), "text": part, "block_start": first, "block_end": last, "char_count": len(part)})

    def release() -> None:
        if held:
            crumbs = [h for _, h in headings]
            add("text", crumbs, render_blocks([blocks[i] for i in held]), held[0], held[-1])
            held.clear()

    for n, b in enumerate(blocks):
        kind = b["kind"]
        if kind == "heading":
            release()
            while headings and headings[-1][0] >= b["level"]:
                headings.pop()
            headings.append((b["level"], b["text"]))
            add("heading", [h for _, h in headings], render_blocks([b]), n, n)
        elif kind == "table":
            release()
            crumbs, head, rows = [h for _, h in headings], b["cells"][0], b["cells"][1:]
            group: list[list[str]] = []
            for row in rows if most and len(render_table(b["cells"])) > most else []:
                if group and len(render_table([head, *group, row])) > most:
                    add("table", crumbs, render_table([head, *group]), n, n)
                    group = []
                group.append(row)
            add("table", crumbs, render_table([head, *(group or rows)]), n, n)
        elif kind == "list":
            release()
            crumbs, stack, group, level = [h for _, h in headings], [], [], None
            for item in [*b["items"], None]:
                if item is None or level is not None and item["depth"] != level:
                    add("text", crumbs + [s for _, s in stack if s], _render_items(group, b["ordered"]), n, n)
                    if item is not None:
                        if item["depth"] > level:
                            stack.append((level, group[-1]["text"]))
                        while stack and stack[-1][0] >= item["depth"]:
                            stack.pop()
                    group = []
                if item is not None:
                    group.append(item)
                    level = item["depth"]
        elif kind == "paragraph" and b["text"].strip():
            held.append(n)
            if by == "block":
                release()
        elif kind == "separator":
            held.append(n)
    release()
    return out


_CHUNK = "chunk_id string, kind string, breadcrumb array<string>, text string, block_start int, block_end int, char_count int"


def chunks(df: DataFrame, key: str, text: str, most: int | None = None, overlap: int = 0, by: str = "section") -> DataFrame:
    """(key, chunk_no, chunk_id, kind, breadcrumb, text, block_start, block_end, char_count) of Markdown texts, in
    order. Null and empty texts give no chunk."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, *c.values()) for k, t in zip(batch[key], batch["_text"], strict=True) for n, c in enumerate(chunk_blocks(parse_blocks(t), most, overlap, by))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk_id", "kind", "breadcrumb", "text", "block_start", "block_end", "char_count"])

    usable = df.select(key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    return usable.mapInPandas(run, f"`{key}` {kind}, chunk_no int, {_CHUNK}")
