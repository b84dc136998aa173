"""Differences between two versions of a document: by block, by word and by line."""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.blocks import parse_blocks, render_blocks

# The least similarity of a pair, of an unchanged and of a moved one; pairs beyond which blocks
# are paired by position; characters beyond which the distance is estimated.
PAIR, UNCHANGED, MOVED, MOST_PAIRS, MOST_CHARS = 0.4, 0.99, 0.85, 10_000_000, 10_000


# Cells of two word lists beyond which the usual rule takes a greedy match (fixed value).
MOST_CELLS = 25_000_000


def edit_distance(a: str, b: str, most: int | None = MOST_CHARS) -> int:
    """Levenshtein distance; from most characters together, an estimate from shared bigrams (None: never)."""
    if a == b:
        return 0
    if most is not None and len(a) + len(b) > most:
        x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
        total = x.total() + y.total()
        dice = 2 * (x & y).total() / total if total else 0.0
        return round(max(len(a), len(b)) * (1 - dice))
    # Rows as bit vectors (Myers 1999): plus and minus mark where a row grows or falls.
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        zero = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(zero | plus) & full, plus & zero
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(zero | up) & full, up & zero
    return distance


def text_similarity(a: str, b: str) -> float:
    a, b = " ".join(a.split()), " ".join(b.split())
    return 1.0 if a == b else 0.0 if not a or not b else 1 - edit_distance(a, b) / max(len(a), len(b))


def _flat(block: dict) -> str:
    if block["kind"] == "list":
        return "\n".join(i["text"] for i in block["items"])
    if block["kind"] == "table":
        return "\n".join(" ".join(r) for r in block["cells"])
    return block["text"] or ""


def block_similarity(a: dict, b: dict) -> float:
    """0 between kinds. Tables weigh their dimensions three tenths; lists of equal text but other marks or
    depths don't count as unchanged."""
    if a["kind"] != b["kind"]:
        return 0.0
    if a["kind"] == "separator":
        return 1.0
    same = text_similarity(_flat(a), _flat(b))
    if a["kind"] == "table":
        sizes = [(len(t["cells"]), len(t["cells"][0])) for t in (a, b)]
        fit = sum(min(x, y) / max(x, y) for x, y in zip(*sizes, strict=True)) / 2
        return 0.3 * fit + 0.7 * same
    if a["kind"] == "list" and (a["ordered"] != b["ordered"] or [i["depth"] for i in a["items"]] != [i["depth"] for i in b["items"]]):
        return min(same, 0.98)
    return same


def align(a: list[dict], b: list[dict]) -> list[tuple[int | None, int | None, float]]:
    """Pairs in order, a longest common subsequence under similarity; unpaired blocks stand alone."""
    if len(a) * len(b) > MOST_PAIRS:
        return [(i if i < len(a) else None, i if i < len(b) else None, block_similarity(a[i], b[i]) if i < min(len(a), len(b)) else 0.0) for i in range(max(len(a), len(b)))]
    sim: dict[tuple[int, int], float] = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n, m = len(_flat(x)), len(_flat(y))
            if x["kind"] == y["kind"] and (min(n, m) >= 0.4 * max(n, m) or x["kind"] == "table"):
                s = block_similarity(x, y)
                if s >= PAIR:
                    sim[i, j] = s
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if (i, j) in sim else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if (i, j) in sim and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j, sim[i, j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None, 0.0))
            i += 1
        else:
            out.append((None, j, 0.0))
            j += 1
    return out + [(k, None, 0.0) for k in range(i, len(a))] + [(None, k, 0.0) for k in range(j, len(b))]


def diff_blocks(a: list[dict], b: list[dict]) -> list[dict]:
    """Changes in order: unchanged, modified, removed, added, and moved where a removed and an added block
    are alike; each block is moved once, the most similar pairs first."""
    rows = []
    for i, j, s in align(a, b):
        change = "added" if i is None else "removed" if j is None else "unchanged" if s >= UNCHANGED else "modified"
        rows.append({"change": change, "before_no": i, "after_no": j, "similarity": s, "pair": None})
    gone, new = ([r for r in rows if r["change"] == c] for c in ("removed", "added"))
    alike = [(block_similarity(a[g["before_no"]], b[n["after_no"]]), x, y) for x, g in enumerate(gone) for y, n in enumerate(new)]
    pairs = 0
    for s, x, y in sorted((p for p in alike if p[0] >= MOVED), key=lambda p: -p[0]):
        if gone[x]["pair"] is None and new[y]["pair"] is None:
            for r in (gone[x], new[y]):
                r.update(change="moved", similarity=s, pair=pairs)
            pairs += 1
    return rows


_DIFF = "change string, before_no int, after_no int, similarity double, pair int, before string, after string"


def document_diff(versions: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, seq, change, before_no, after_no, similarity, pair, before, after) of rows that hold two versions of
    a Markdown text side by side; the pairing of versions is the caller's join. Null counts as empty."""
    kind = versions.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, x, y in zip(batch[key], batch["_a"], batch["_b"], strict=True):
                a, b = parse_blocks(x or ""), parse_blocks(y or "")
                text = lambda blocks, n: None if n is None else render_blocks([blocks[n]])
                rows += [(k, n, *r.values(), text(a, r["before_no"]), text(b, r["after_no"])) for n, r in enumerate(diff_blocks(a, b))]
            frame = pd.DataFrame(rows, columns=[key, "seq", "change", "before_no", "after_no", "similarity", "pair", "before", "after"])
            yield frame.astype({"before_no": "Int64", "after_no": "Int64", "pair": "Int64"})

    return versions.select(key, F.col(before).alias("_a"), F.col(after).alias("_b")).mapInPandas(run, f"`{key}` {kind}, seq int, {_DIFF}")


def common_subsequence(x: list, y: list, most: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Pairs of places (in x, in y) of a longest common subsequence; of ties, the one that keeps x's later words.

    Ends that agree are set apart first. Beyond most cells of the rest a greedy forward match stands in, unless most
    is None: then the rest is divided (Hirschberg 1975), which is exact at any size in linear memory.
    """
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    if most is not None and len(a) * len(b) > most:
        middle = greedy_subsequence(a, b)
    else:
        numbers: dict = {}
        coded = [np.array([numbers.setdefault(w, len(numbers)) for w in side], np.int64) for side in (a, b)]
        middle = _divided(*coded)
    ends = [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in middle] + ends


def greedy_subsequence(x: list, y: list) -> list[tuple[int, int]]:
    """Each of x in turn at its first place in y behind the one before."""
    where: dict = {}
    for j, w in enumerate(y):
        where.setdefault(w, []).append(j)
    out, last = [], -1
    for i, w in enumerate(x):
        places = where.get(w, ())
        k = bisect.bisect_right(places, last)
        if k < len(places):
            last = places[k]
            out.append((i, last))
    return out


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with every beginning of y. A row never falls, so what it takes from
    its left is a running maximum."""
    row = np.zeros(len(y) + 1, np.int32)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0)))
    return row


def _divided(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    if not len(x) or not len(y):
        return []
    if len(x) * len(y) <= 10_000:
        x, y = x.tolist(), y.tolist()
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, w in enumerate(x):
            row, before = best[i + 1], best[i]
            for j, v in enumerate(y):
                row[j + 1] = before[j] + 1 if w == v else max(before[j + 1], row[j])
        out, i, j = [], len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]
    if len(x) == 1:
        return [(0, int(k)) for k in np.flatnonzero(y == x[0])[:1]]
    half = len(x) // 2
    at = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    return _divided(x[:half], y[:at]) + [(half + i, at + j) for i, j in _divided(x[half:], y[at:])]


def word_diff(a: str, b: str, most: int | None = MOST_CELLS) -> list[tuple[str, str]]:
    """(equal | removed | added, text) runs of words with their white space, by a longest common subsequence."""
    x, y = re.findall(r"\s+|\S+", a), re.findall(r"\s+|\S+", b)
    out: list[tuple[str, list[str]]] = []

    def add(kind: str, words: list[str]) -> None:
        if words and out and out[-1][0] == kind:
            out[-1][1].extend(words)
        elif words:
            out.append((kind, list(words)))

    i = j = 0
    for p, q in [*common_subsequence(x, y, most), (len(x), len(y))]:
        add("removed", x[i:p])
        add("added", y[j:q])
        add("equal", x[p : p + 1])
        i, j = p + 1, q + 1
    return [(kind, "".join(words)) for kind, words in out]


def word_diffs(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, seq, kind, text): the word diff of two columns, null counting as empty."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in word_diff(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)

    return df.select(key, F.posexplode(run(F.col(before), F.col(after))).alias("seq", "d")).select(key, "seq", "d.kind", "d.text")


def _cell(value: str | dict) -> tuple[str, int, int]:
    return (value, 1, 1) if isinstance(value, str) else (value.get("text") or "", value.get("rowspan") or 1, value.get("colspan") or 1)


def cell_diffs(a: list[list], b: list[list]) -> list[tuple[str, int | None, int | None, int | None, int | None, str | None, str | None]]:
    """(change, row before, row after, column before, column after, text before, text after) of two tables: rows are aligned by a
    longest common subsequence of their texts, what is left between two such rows by place; then columns, by what
    they hold in the aligned rows, in the same way. Cells are texts or {text, rowspan, colspan}; equal texts of
    other spans are modified. Cells of rows or columns on one side only are removed or added."""
    x, y = [[_cell(c) for c in r] for r in a], [[_cell(c) for c in r] for r in b]
    texts = lambda rows: [tuple(c[0] for c in r) for r in rows]
    rows = _aligned(texts(x), texts(y))
    both = [(i, j) for i, j in rows if i is not None and j is not None]
    width = lambda t: max(map(len, t), default=0)
    column = lambda t, of, c: tuple(t[r][c][0] if c < len(t[r]) else None for r in of)
    left = [column(x, [i for i, _ in both], c) for c in range(width(x))]
    right = [column(y, [j for _, j in both], c) for c in range(width(y))]
    # Columns that have different heads are told by these, others by all they hold.
    heads = lambda cs: [c[0] for c in cs] if both and len({c[0] for c in cs}) == len(cs) else None
    columns = _aligned(heads(left), heads(right)) if heads(left) and heads(right) else _aligned(left, right)
    out = []
    for i, j in rows:
        for p, q in columns:
            u = x[i][p] if i is not None and p is not None and p < len(x[i]) else None
            v = y[j][q] if j is not None and q is not None and q < len(y[j]) else None
            if u is None and v is None:
                continue
            change = "added" if u is None else "removed" if v is None else "unchanged" if u == v else "modified"
            out.append((change, i if u else None, j if v else None, p if u else None, q if v else None, u and u[0], v and v[0]))
    return out


def _aligned(x: list, y: list) -> list[tuple[int | None, int | None]]:
    """A full outer alignment: common ones by a longest common subsequence, those between by place."""
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for p, q in [*common_subsequence(x, y, None), (len(x), len(y))]:
        same = len(x[i:p]) == len(y[j:q])
        if same:
            out += zip(range(i, p), range(j, q), strict=True)
        else:
            out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)]
        if p < len(x):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def table_diffs(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, table_no, change, before_row, after_row, before_col, after_col, before, after): the tables of two Markdown texts, the first
    with the first and so on, cell by cell. Null counts as empty; a table on one side only is added or removed whole."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "table_no", "change", "before_row", "after_row", "before_col", "after_col", "before", "after"]
        for batch in batches:
            rows = []
            for k, a, b in zip(batch[key], batch["_a"], batch["_b"], strict=True):
                x, y = ([t["cells"] for t in parse_blocks(m or "") if t["kind"] == "table"] for m in (a, b))
                for n in range(max(len(x), len(y))):
                    rows += [(k, n, *c) for c in cell_diffs(x[n] if n < len(x) else [], y[n] if n < len(y) else [])]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in names[3:7]})

    schema = f"`{key}` {kind}, table_no int, change string, before_row int, after_row int, before_col int, after_col int, before string, after string"
    return df.select(key, F.col(before).alias("_a"), F.col(after).alias("_b")).mapInPandas(run, schema)


def line_diff(a: str, b: str) -> list[tuple[str, int | None, int | None, str]]:
    """(equal | delete | insert, line before, line after, text): a longest common subsequence of lines."""
    x, y = re.split(r"\r?\n", a), re.split(r"\r?\n", b)
    out, i, j = [], 0, 0
    for p, q in [*common_subsequence(x, y, None), (len(x), len(y))]:
        out += [("delete", k, None, x[k]) for k in range(i, p)] + [("insert", None, k, y[k]) for k in range(j, q)]
        if p < len(x):
            out.append(("equal", p, q, x[p]))
        i, j = p + 1, q + 1
    return out


def line_diffs(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, seq, kind, before_no, after_no, text): the line diff of two columns, null counting as empty."""

    @F.pandas_udf("array<struct<kind:string,before_no:int,after_no:int,text:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("kind", "before_no", "after_no", "text")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in line_diff(x or "", y or "")] for x, y in zip(a, b, strict=True)], dtype=object)

    return df.select(key, F.posexplode(run(F.col(before), F.col(after))).alias("seq", "d")).select(key, "seq", "d.*")


def unified_diff(a: str, b: str, name_a: str = "before", name_b: str = "after") -> dict:
    """added, removed and unchanged lines, similarity (four decimals) and the unified diff, all by difflib."""
    x, y = a.splitlines(), b.splitlines()
    matcher = difflib.SequenceMatcher(a=x, b=y)
    stats = {"added": 0, "removed": 0, "unchanged": 0}
    for op, i1, i2, j1, j2 in matcher.get_opcodes():
        if op == "equal":
            stats["unchanged"] += i2 - i1
        else:
            stats["removed"] += i2 - i1
            stats["added"] += j2 - j1
    return {**stats, "similarity": round(matcher.ratio(), 4), "diff": "\n".join(difflib.unified_diff(x, y, name_a, name_b, lineterm=""))}


def unified_diffs(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, added, removed, unchanged, similarity, diff) of two columns, null counting as empty."""

    @F.pandas_udf("added int, removed int, unchanged int, similarity double, diff string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unified_diff(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["added", "removed", "unchanged", "similarity", "diff"])

    return df.select(key, run(F.col(before), F.col(after)).alias("d")).select(key, "d.*")


# Signs of changes in a report, their names, and characters shown of a block.
SIGNS = {"added": "+", "removed": "-", "modified": "~", "moved": "→", "unchanged": " "}
REPORT_HEAD, SHOWN = ("추가", "added"), 200


def diff_reports(changes: DataFrame, key: str) -> DataFrame:
    """(key, report) of the block changes (key, seq, change, similarity, before, after): counts by kind, then a line per
    change with its sign, the first characters of the block and, for pairs, the similarity in whole percent."""
    said = F.coalesce("after", "before", F.lit(""))
    sign = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])
    percent = F.when(F.col("change").isin("added", "removed"), "").otherwise(F.format_string(" (%.0f%%)", F.col("similarity") * 100))
    line = F.concat(F.try_element_at(sign, F.col("change")), F.lit(" "), F.substring(F.regexp_replace(said, r"\s*\n\s*", " "), 1, SHOWN), percent)
    count = lambda kind: F.sum((F.col("change") == kind).cast("int")).cast("string")
    head = F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), count(kind)) for name, kind in (REPORT_HEAD, ("삭제", "removed"), ("변경", "modified"), ("이동", "moved"), ("동일", "unchanged"))])
    listed = changes.withColumn("_line", line).groupBy(key).agg(head.alias("_head"), F.array_sort(F.collect_list(F.struct("seq", "_line"))).alias("_lines"))
    return listed.select(key, F.concat(F.lit("## 문서 비교 결과\n"), F.col("_head"), F.lit("\n\n"), F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n")).alias("report"))
