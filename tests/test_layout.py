import random

from docweave.operators import blocks as B
from docweave.operators import layout as Y
from docweave.sources import binary
from pyspark.sql import functions as F


def run(x, y, text, size=10.0, bold=False):
    return Y.Run(x, y, len(text) * size / 2, size, text, bold)


def frame(xs, ys, without=()):
    """The lines of a grid, each between two crossings, but for those without."""
    flat = [(a, y, b, y) for y in ys for a, b in zip(xs, xs[1:])]
    steep = [(x, a, x, b) for x in xs for a, b in zip(ys, ys[1:])]
    return [line for line in flat + steep if line not in without]




def test_clusters():
    assert Y.clusters([1, 2, 3, 50, 51, 3], 5) == [2.25, 50.5] and Y.clusters([], 5) == []


def test_lines_make_a_table_with_spans():
    xs, ys = [0, 100, 200, 300], [300, 200, 100, 0]
    lines = frame(xs, ys, without={(100, 200, 200, 200), (200, 300, 200, 200)})
    runs = [run(110, 250, "wide"), run(10, 150, "a"), run(210, 150, "b")]
    (table,) = Y.line_tables(lines, runs)
    spans = {(c.row, c.col): (c.rowspan, c.colspan, c.text) for c in table.cells}
    assert spans[0, 1] == (1, 2, "wide") and spans[1, 0] == (1, 1, "a") and spans[1, 2] == (1, 1, "b") and len(spans) == 8
    assert table.markdown().startswith("<table>\n<tr><th></th><th colspan=\"2\">wide</th></tr>")


def test_union_find_against_brute_force():
    rng = random.Random(3)
    lines = []
    for _ in range(60):
        x, y, n = rng.randint(0, 400), rng.randint(0, 400), rng.randint(10, 60)
        lines.append((x, y, x + n, y) if rng.random() < 0.5 else (x, y, x, y + n))
    meet = lambda a, b: a[0] - 3 <= b[2] + 3 and b[0] - 3 <= a[2] + 3 and a[1] - 3 <= b[3] + 3 and b[1] - 3 <= a[3] + 3
    groups = [{i} for i in range(len(lines))]
    for i in range(len(lines)):
        for j in range(i):
            if meet(lines[i], lines[j]):
                a, b = (next(g for g in groups if k in g) for k in (i, j))
                if a is not b:
                    groups.remove(b)
                    a |= b
    assert sorted(sorted(g) for g in Y.connected(lines)) == sorted(sorted(lines[i] for i in g) for g in groups)


def test_shading_is_dropped():
    stack = [(0, y, 100, y) for y in (10, 12, 14, 16, 18)]
    assert sorted(Y.without_shading([*stack, (0, 50, 100, 50)])) == [(0, 10, 100, 10), (0, 18, 100, 18), (0, 50, 100, 50)]


def test_clusters_make_a_table_and_lines_win():
    runs = [run(x, y, f"c{x}{y}") for y in (100, 85, 70) for x in (50, 200, 350)] + [run(50, 200, "A paragraph that stands alone here")]
    (table,) = Y.cluster_tables(runs)
    assert [(c.row, c.col) for c in table.cells] == [(r, c) for r in range(3) for c in range(3)]
    drawn = Y.tables_of(runs, frame([40, 190, 340, 500], [115, 98, 83, 60]))
    assert len(drawn) == 1 and Y.covering([Y.Table(0, 0, 100, 100), Y.Table(10, 10, 20, 20)], 15, 15) == [1, 0]


def test_columns_and_headings():
    left = [run(50, 700 - 12 * i, f"left line {i} of text") for i in range(10)]
    right = [run(320, 700 - 12 * i, f"right line {i} of text") for i in range(10)]
    found = Y.elements([run(50, 740, "Title", 20.0), *left, *right])
    assert [e["kind"] for e in found] == ["heading", "paragraph", "paragraph"] and found[1]["text"].startswith("left line 0") and found[2]["text"].endswith("right line 9 of text")
    assert Y.page_markdown(found).startswith("# Title\n\nleft") and Y.elements([]) == []


def test_page_elements_odd_rows(spark):
    df = spark.createDataFrame([(1, [(1.0, 2.0, 3.0, 10.0, "a", False)]), (2, None), (3, [])], "id long, runs array<struct<x:double,y:double,width:double,size:double,text:string,bold:boolean>>")
    rows = Y.page_elements(df, ["id"]).collect()
    assert [(r.id, r.kind, r.text) for r in rows] == [(1, "paragraph", "a")]
    boxes = spark.createDataFrame([([(5.0,), (11.0,), (19.0,)],), (None,)], "b array<struct<x:double>>").select(Y.begin_bins(F.col("b")).alias("n")).collect()
    assert [tuple(x) for x in boxes[0].n] == [(0, 1), (1, 2)] and boxes[1].n is None


def test_merged_cells(spark):
    rows = [[{"text": "a<b", "rowspan": 2, "colspan": 1}, {"text": "c", "rowspan": 1, "colspan": 1}], [{"text": "d", "rowspan": 1, "colspan": 1}]]
    assert B.merged(rows) and B.html_table(rows) == '<table>\n<tr><th rowspan="2">a&lt;b</th><th>c</th></tr>\n<tr><td>d</td></tr>\n</table>'
    df = spark.createDataFrame([([[("x", 1, 2)]],), ([[("x", 1, None)]],), ([],)], "t array<array<struct<text:string,rowspan:int,colspan:int>>>")
    assert [r.m for r in df.select(B.has_merged_cells(F.col("t")).alias("m")).collect()] == [True, False, False]


def pdf(content):
    objects = [b"<< /Type /Page /Contents 2 0 R /Resources << /Font << /F1 3 0 R >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Type /Font /BaseFont /Sans-Bold >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer\n%%EOF"


def test_pdf_positions_and_tables():
    grid = b" ".join(b"%d %d 100 20 re S" % (50 + 100 * c, 500 - 20 * r) for r in range(2) for c in range(2))
    text = b"BT /F1 20 Tf 50 700 Td (Report) Tj /F1 10 Tf 0 -40 Td (plain ) Tj (words) Tj ET " + b" ".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET" % (60 + 100 * c, 505 - 20 * r, b"r%dc%d" % (r, c)) for r in range(2) for c in range(2))
    data = pdf(b"q 1 0 0 1 0 0 cm " + grid + b" " + text + b" Q")
    (page,) = binary.pdf_layout(data)
    assert [r["text"] for r in page["runs"]][:2] == ["Report", "plain "] and page["runs"][0]["size"] == 20 and len(page["lines"]) == 16
    markdown = binary.pdf_markdown(data)
    assert markdown.startswith("# Report\n\n") and "plain words" in markdown and "| r0c0 | r0c1 |\n| --- | --- |\n| r1c0 | r1c1 |" in markdown
