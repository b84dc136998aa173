"""Page layout: columns, blocks, tables and Markdown from positioned text and ruling lines.

A page is one row with an array of runs (x, y, width, size, text, bold; y grows upward) and an array of lines
(x1, y1, x2, y2), so whatever is done about a page is done within its row, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators.blocks import html_table, merged, render_table

# Rows this near are one; bins of the column histogram; least filled share of a table found by
# clusters; how near lines meet; distance of ruling lines that are shading; a heading's size by the median.
ROW, BIN, DENSITY, TOUCH, SHADE, HEADING = 5.0, 10.0, 0.4, 3.0, 3.0, 1.2


@dataclass
class Run:
    x: float
    y: float
    width: float
    size: float
    text: str
    bold: bool = False

    @property
    def right(self) -> float:
        return self.x + self.width


@dataclass
class Cell:
    row: int
    col: int
    rowspan: int = 1
    colspan: int = 1
    text: str = ""


@dataclass
class Table:
    left: float
    bottom: float
    right: float
    top: float
    cells: list[Cell] = field(default_factory=list)

    @property
    def area(self) -> float:
        return (self.right - self.left) * (self.top - self.bottom)

    def holds(self, x: float, y: float) -> bool:
        return self.left - TOUCH <= x <= self.right + TOUCH and self.bottom - TOUCH <= y <= self.top + TOUCH

    def overlaps(self, other: Table) -> bool:
        return self.left < other.right and other.left < self.right and self.bottom < other.top and other.bottom < self.top

    def markdown(self) -> str:
        """A pipe table, or HTML where cells are merged."""
        if not self.cells:
            return ""
        rows = max(c.row for c in self.cells) + 1
        grid = [[c for c in sorted(self.cells, key=lambda c: c.col) if c.row == r] for r in range(rows)]
        listed = [[{"text": c.text, "rowspan": c.rowspan, "colspan": c.colspan} for c in row] for row in grid]
        return html_table(listed) if merged(listed) else render_table([[c["text"] for c in row] for row in listed])


def clusters(values: Sequence[float], tolerance: float) -> list[float]:
    """Centres of values in order: each joins the cluster before it if it lies within tolerance of its mean."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][0] / out[-1][1] <= tolerance:
            out[-1][0] += v
            out[-1][1] += 1
        else:
            out.append([v, 1])
    return [total / n for total, n in out]


def _nearest(centres: Sequence[float], v: float) -> int:
    return min(range(len(centres)), key=lambda i: (abs(centres[i] - v), i))


def rows_of(runs: Sequence[Run]) -> list[list[Run]]:
    """Runs in rows from the top, each from the left."""
    out: list[list[Run]] = []
    for r in sorted(runs, key=lambda r: (-r.y, r.x)):
        if out and out[-1][0].y - r.y <= ROW:
            out[-1].append(r)
        else:
            out.append([r])
    return [sorted(row, key=lambda r: r.x) for row in out]


def column_split(runs: Sequence[Run]) -> float | None:
    """Where a page of two columns divides: between the two bins at which most rows begin, if both have a fifth of
    the runs, lie apart by more than a quarter of the width and at most a tenth of the runs cross the middle."""
    if len(runs) < 8:
        return None
    bins = Counter(int(r.x // BIN) for r in runs)
    (a, n), *rest = sorted(bins.items(), key=lambda x: (-x[1], x[0]))
    width = max(r.right for r in runs) - min(r.x for r in runs)
    for b, m in rest:
        if abs(a - b) * BIN > width / 4 and min(n, m) * 5 >= len(runs):
            at = max(a, b) * BIN
            crossing = sum(r.x < at - BIN / 2 and r.right > at + BIN / 2 for r in runs)
            return at if crossing * 10 <= len(runs) else None
    return None


def sides_of(runs: Sequence[Run]) -> list[list[Run]]:
    """The runs of a page's columns, left to right."""
    at = column_split(runs)
    return [list(runs)] if at is None else [[r for r in runs if r.x < at - BIN / 2], [r for r in runs if r.x >= at - BIN / 2]]


def row_text(row: Sequence[Run]) -> str:
    """Texts of a row; a gap wider than a fifth of the size is a space."""
    out, end = "", None
    for r in row:
        if end is not None and r.x - end > 0.2 * r.size and not out.endswith(" "):
            out += " "
        out, end = out + r.text, r.right
    return out.strip()


def blocks_of(runs: Sequence[Run]) -> list[list[list[Run]]]:
    """Blocks of rows: by column, and within it wherever the gap to the row above exceeds one and a half of its
    size, or the size changes by more than a fifth."""
    out = []
    for side in sides_of(runs):
        last = None
        for row in rows_of(side):
            size = max(r.size for r in row)
            if last is None or last[0] - row[0].y > 1.5 * max(size, last[1]) or max(size, last[1]) > 1.2 * min(size, last[1]):
                out.append([])
            out[-1].append(row)
            last = (row[0].y, size)
    return out


def cluster_tables(runs: Sequence[Run]) -> list[Table]:
    """Tables without lines: two rows or more, one after the other, of two cells or more that begin at common
    positions, with at least DENSITY of the grid filled."""
    found, group = [], []

    def close() -> None:
        if len(group) >= 2:
            anchors = clusters([r.x for row in group for r in row], BIN)
            often = Counter(_nearest(anchors, r.x) for row in group for r in row)
            kept = [anchors[i] for i, n in sorted(often.items()) if n >= 2]
            if len(kept) >= 2:
                grid: dict[tuple[int, int], list[Run]] = defaultdict(list)
                for i, row in enumerate(group):
                    for r in row:
                        grid[i, _nearest(kept, r.x)].append(r)
                if len(grid) >= DENSITY * len(group) * len(kept):
                    all_runs = [r for row in group for r in row]
                    box = (min(r.x for r in all_runs), min(r.y for r in all_runs), max(r.right for r in all_runs), max(r.y + r.size for r in all_runs))
                    cells = [Cell(i, j, text=row_text(grid[i, j])) for i in range(len(group)) for j in range(len(kept))]
                    found.append(Table(*box, cells))
        group.clear()

    for row in rows_of(runs):
        parts: list[Run] = []
        for r in row:
            # Runs that touch are one cell.
            if parts and r.x - parts[-1].right <= r.size:
                last = parts[-1]
                parts[-1] = Run(last.x, last.y, r.right - last.x, last.size, f"{last.text} {r.text}" if r.x - last.right > 0.2 * r.size else last.text + r.text, last.bold)
            else:
                parts.append(r)
        far = group and group[-1][0].y - row[0].y > 3 * max(r.size for r in row)
        if len(parts) < 2 or far:
            close()
        if len(parts) >= 2:
            group.append(parts)
    close()
    return found


Line = tuple[float, float, float, float]


def without_shading(lines: Sequence[Line]) -> list[Line]:
    """Lines but for stacks of four and more of equal extent at equal distances of SHADE at most, of which only the
    first and last stay."""
    out = []
    for flat in (True, False):
        alike: dict[tuple[int, int], list[Line]] = defaultdict(list)
        for line in lines:
            if (abs(line[1] - line[3]) <= abs(line[0] - line[2])) == flat:
                ends = (line[0], line[2]) if flat else (line[1], line[3])
                alike[round(min(ends)), round(max(ends))].append(line)
        for group in alike.values():
            at = 1 if flat else 0
            group.sort(key=lambda line: line[at])
            stack = [group[0]]
            for line in [*group[1:], None]:
                steps = [b[at] - a[at] for a, b in zip(stack, stack[1:])]
                goes_on = line is not None and line[at] - stack[-1][at] <= SHADE and (not steps or abs(line[at] - stack[-1][at] - steps[0]) <= 0.5)
                if goes_on:
                    stack.append(line)
                    continue
                out += [stack[0], stack[-1]] if len(stack) >= 4 else stack
                stack = [line]
    return out


def connected(lines: Sequence[Line]) -> list[list[Line]]:
    """Groups of lines that meet, by union-find."""
    parent = list(range(len(lines)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    box = [(min(a, c) - TOUCH, min(b, d) - TOUCH, max(a, c) + TOUCH, max(b, d) + TOUCH) for a, b, c, d in lines]
    order = sorted(range(len(lines)), key=lambda i: box[i][0])
    open_: list[int] = []
    for i in order:
        open_ = [j for j in open_ if box[j][2] >= box[i][0]]
        for j in open_:
            if box[i][1] <= box[j][3] and box[j][1] <= box[i][3]:
                parent[root(i)] = root(j)
        open_.append(i)
    groups: dict[int, list[Line]] = defaultdict(list)
    for i, line in enumerate(lines):
        groups[root(i)].append(line)
    return list(groups.values())


def line_tables(lines: Sequence[Line], runs: Sequence[Run]) -> list[Table]:
    """Tables drawn by lines: each group of lines that meet is a grid; where the border between two of its cells is
    missing they are one, with spans; a run is in the cell that holds its middle."""
    found = []
    for group in connected(without_shading(lines)):
        flat = [(min(a, c), max(a, c), (b + d) / 2) for a, b, c, d in group if abs(b - d) <= TOUCH < abs(a - c)]
        steep = [(min(b, d), max(b, d), (a + c) / 2) for a, b, c, d in group if abs(a - c) <= TOUCH < abs(b - d)]
        ys, xs = clusters([y for *_, y in flat], TOUCH)[::-1], clusters([x for *_, x in steep], TOUCH)
        if len(ys) < 2 or len(xs) < 2:
            continue
        n, m = len(ys) - 1, len(xs) - 1
        drawn = lambda marks, at, lo, hi: any(abs(p - at) <= TOUCH and a <= lo + TOUCH and b >= hi - TOUCH for a, b, p in marks)
        below = [[drawn(flat, ys[i + 1], xs[j], xs[j + 1]) for j in range(m)] for i in range(n)]
        beside = [[drawn(steep, xs[j + 1], ys[i + 1], ys[i]) for j in range(m)] for i in range(n)]
        taken, cells, where = set(), [], {}
        for i in range(n):
            for j in range(m):
                if (i, j) in taken:
                    continue
                wide = 1
                while j + wide < m and not beside[i][j + wide - 1] and (i, j + wide) not in taken:
                    wide += 1
                high = 1
                while i + high < n and not any(below[i + high - 1][k] for k in range(j, j + wide)) and all((i + high, k) not in taken for k in range(j, j + wide)):
                    high += 1
                cell = Cell(i, j, high, wide)
                cells.append(cell)
                for a in range(i, i + high):
                    for b in range(j, j + wide):
                        taken.add((a, b))
                        where[a, b] = cell
        table = Table(xs[0], ys[-1], xs[-1], ys[0], cells)
        inside: dict[int, list[Run]] = defaultdict(list)
        for r in runs:
            x, y = (r.x + r.right) / 2, r.y + r.size / 2
            if table.holds(x, y):
                i = next((k for k in range(n) if ys[k + 1] <= y <= ys[k]), None)
                j = next((k for k in range(m) if xs[k] <= x <= xs[k + 1]), None)
                if i is not None and j is not None:
                    inside[id(where[i, j])].append(r)
        for cell in cells:
            cell.text = "\n".join(map(row_text, rows_of(inside[id(cell)]))) if inside[id(cell)] else ""
        if n * m > 1:
            found.append(table)
    return found


def tables_of(runs: Sequence[Run], lines: Sequence[Line]) -> list[Table]:
    """Tables drawn by lines, and of those told by clusters the ones that overlap none."""
    ruled = line_tables(lines, runs)
    free = [r for r in runs if not any(t.holds(r.x, r.y) for t in ruled)]
    told = [t for side in sides_of(free) for t in cluster_tables(side)]
    return ruled + [t for t in told if not any(t.overlaps(o) for o in ruled)]


def covering(tables: Sequence[Table], x: float, y: float) -> list[int]:
    """Which tables hold a point, the tightest first."""
    return sorted((i for i, t in enumerate(tables) if t.holds(x, y)), key=lambda i: (tables[i].area, i))


def elements(runs: Sequence[Run], lines: Sequence[Line] = ()) -> list[dict]:
    """(kind, level, text, x, y) of a page in reading order: headings by their size against the median, list lines,
    paragraphs, and tables at their place."""
    if not runs:
        return []
    tables = tables_of(runs, lines)
    free = [r for r in runs if not covering(tables, r.x + r.width / 2, r.y + r.size / 2)]
    sizes = sorted(r.size for r in runs)
    median = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
    larger = sorted({round(r.size, 1) for r in free if r.size >= HEADING * median}, reverse=True)
    out = []
    for block in blocks_of(free):
        size = round(max(r.size for row in block for r in row), 1)
        level = min(larger.index(size) + 1, 6) if size in larger else 0
        texts = [t for t in map(row_text, block) if t]
        if not texts:
            continue
        x, y = min(r.x for row in block for r in row), block[0][0].y
        if level:
            out.append({"kind": "heading", "level": level, "text": " ".join(texts), "x": x, "y": y})
            continue
        bold = all(r.bold for row in block for r in row)
        joined = ""
        for t in texts:
            joined += ("\n" if X.LIST_LINE.match(t) else " ") + t if joined else t
        kind = "list" if X.LIST_LINE.match(texts[0]) else "paragraph"
        out.append({"kind": kind, "level": 0, "text": f"**{joined}**" if bold and kind == "paragraph" else joined, "x": x, "y": y})
    at = column_split(free)
    side = lambda e: int(at is not None and e["x"] >= at - BIN / 2)
    for t in tables:
        out.append({"kind": "table", "level": 0, "text": t.markdown(), "x": t.left, "y": t.top})
    return sorted(out, key=lambda e: (side(e), -e["y"], e["x"]))


def page_markdown(found: Sequence[dict]) -> str:
    return "\n\n".join("#" * e["level"] + " " + e["text"] if e["kind"] == "heading" else e["text"] for e in found)


_ELEMENT = "seq int, kind string, level int, text string, x double, y double"


def page_elements(pages: DataFrame, keys: Sequence[str], runs: str = "runs", lines: str | None = None) -> DataFrame:
    """(keys, seq, kind, level, text, x, y) of pages with an array of runs and, if named, one of lines. Null arrays and
    pages without text give no rows."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                own = [Run(**r) for r in (batch["_runs"].iat[i] if batch["_runs"].iat[i] is not None else []) if r["text"]]
                drawn = [tuple(r[k] for k in ("x1", "y1", "x2", "y2")) for r in (batch["_lines"].iat[i] if batch["_lines"].iat[i] is not None else [])]
                out += [(*(batch[k].iat[i] for k in keys), n, e["kind"], e["level"], e["text"], e["x"], e["y"]) for n, e in enumerate(elements(own, drawn))]
            yield pd.DataFrame(out, columns=[*keys, "seq", "kind", "level", "text", "x", "y"])

    drawn = F.col(lines) if lines else F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    return pages.select(*keys, F.col(runs).alias("_runs"), drawn.alias("_lines")).mapInPandas(run, f"{kinds}, {_ELEMENT}")


def begin_bins(boxes: Column, width: float = BIN) -> Column:
    """Of an array of boxes, how many begin in each bin of the page's width: the histogram of column_split."""
    starts = F.transform(boxes, lambda b: F.floor(b["x"] / width).cast("int"))
    return F.transform(F.array_sort(F.array_distinct(starts)), lambda s: F.struct(s.alias("bin"), F.size(F.filter(starts, lambda t: t == s)).cast("long").alias("n")))
