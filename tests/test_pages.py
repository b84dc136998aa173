import io
import json
import struct
import zipfile

from docweave.operators import pages as P
from docweave.sources import binary, formats
from pyspark.sql import functions as F


def test_split_pages(spark):
    df = spark.createDataFrame([("a\fb\f \fc", 9), ("1\n2\n3\n4\n5", 2), ("x", 5), ("", 1), (None, 2)], "t string, n int")
    got = [None if r.p is None else [tuple(x) for x in r.p] for r in df.select(P.split_pages(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == [[(1, "a"), (2, "b"), (4, "c")], [(1, "1\n2"), (2, "3\n4"), (3, "5")], [(1, "x")], [], None]


def test_routing_and_dispatch(spark):
    df = spark.createDataFrame([(1, 2, "scanned", 0.9, "글자", None, "ocr two"), (1, 1, "text_native", 0.8, "word", "own one", None), (1, 3, "mixed", 0.7, None, "own three", None)], "doc long, page int, category string, confidence double, text string, native string, ocr string")
    manifest = json.loads(P.routing_manifests(df, "doc").first().manifest)
    assert manifest["full_pages"] == 1 and [p["needs_full_page_ocr"] for p in manifest["pages"]] == [False, True, False] and manifest["pages"][1]["cjk_hint"]
    assert P.dispatched(df, "doc", first=2).first().text == "<!-- page 2 -->\nocr two\n\n<!-- page 3 -->\nown three"


def test_readings_beside_their_images(spark):
    docs = spark.createDataFrame([(1, "a ![x](assets/i1.png) b\n| ![y](i2.png) |\n![z](i3.png)"), (2, "none")], "doc long, t string")
    readings = spark.createDataFrame([(1, "i1.png", "read\ntwo"), (1, "i2.png", "p|q"), (1, "i3.png", " ")], "doc long, image_id string, reading string")
    got = {r.doc: r.t for r in P.with_readings(docs, readings, "doc", "t").collect()}
    assert got == {1: "a ![x](assets/i1.png) b\n\n> read\n> two\n| ![y](i2.png) <br>p\\|q |\n![z](i3.png)", 2: "none"}


def test_small_rules(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c.alias("r")).first().r
    v = F.col("v")
    assert one(P.plain_alt(v), " [a] b ") == "a b" and one(P.drawn("strike", v), "3D") is False and one(P.drawn("underline", v), "TOP") is True and one(P.drawn("emphasis", v), None) is False
    assert one(P.for_comparison(v), "---\na: 1\n---\nx<!-- c\n -->\n\n\n\ny\n## Images\n\nz") == "x\n\ny"
    files = spark.createDataFrame([("/d/tables/a.pdf",), ("/d/text/b.pdf",)], "path string")
    known = spark.createDataFrame([("/r/a.md",)], "path string")
    assert sorted((r.family, r.reference) for r in P.by_stem(files, known).collect()) == [("tables", "/r/a.md"), ("text", None)]
    found = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "doc long, n int")
    shown = sorted(map(tuple, P.shown_findings(found, "doc", "n", F.concat(F.lit("L"), F.col("n").cast("string")), 3).collect()))
    assert shown == [(1, 1, "L0"), (1, 2, "L1"), (1, 3, "L2"), (1, 4, "2 more"), (2, 1, "L0")]


def test_rendered_references(spark):
    rows = [(1, 0, "text", "see ", None, None, None, None), (1, 1, "reference", "", "pic", "image", "/m/p.png", {"max-width": "300", "float": "left"}), (1, 2, "reference", "", "gone", None, None, {})]
    df = spark.createDataFrame(rows, "doc long, seq int, kind string, value string, name string, resource_type string, src string, attributes map<string,string>")
    assert P.rendered(df, "doc").first().html == 'see <img src="/m/p.png" style="max-width: 300px; float: left"><!-- no resource: gone -->'


def test_law_header(spark):
    text = "# 도서관 규정\n- **규정 ID**: LR-7\n- **분류**: 총무\n(제3차 개정, 개정 2024. 3. 5.)\n제1장 총칙\n# 다른 것"
    got = spark.createDataFrame([(text,), ("제1조 x",), (None,)], "t string").select(P.law_header(F.col("t")).alias("h")).collect()
    assert tuple(got[0].h) == ("도서관 규정", "LR-7", "총무", "2024-03-05", "3") and tuple(got[1].h) == (None,) * 5


def test_charts_and_docx_parts():
    chart = """<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:barDir val="bar"/><c:ser><c:tx><c:v>one</c:v></c:tx>
    <c:cat><c:strCache><c:ptCount val="2"/><c:pt idx="0"><c:v>x|y</c:v></c:pt></c:strCache></c:cat><c:val><c:numCache><c:ptCount val="2"/><c:pt idx="0"><c:v>1</c:v></c:pt><c:pt idx="1"><c:v>2</c:v></c:pt></c:numCache></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>"""
    found = formats.chart(chart.encode())
    assert found["title"] == "Sales" and found["series"] == [("one", ["1", "2"])]
    assert formats.chart_markdown(found).splitlines()[-2:] == ["| x\\|y | 1 |", "| 2 | 2 |"] and formats.chart(b"<x/>") is None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'/>")
        z.writestr("word/media/image1.png", b"\x89PNG\r\n\x1a\n")
        z.writestr("docProps/core.xml", "<cp:coreProperties xmlns:cp='cp' xmlns:dc='dc'><dc:title>T</dc:title><dc:creator>C</dc:creator></cp:coreProperties>")
        z.writestr("docProps/app.xml", "<Properties><Pages>3</Pages></Properties>")
    assert formats.package_media(out.getvalue()) == [("image1.png", b"\x89PNG\r\n\x1a\n")] and formats.package_properties(out.getvalue()) == {"title": "T", "creator": "C", "Pages": "3"}


def test_hwpml():
    xml = """<?xml version="1.0"?><HWPML><BODY><SECTION><P><TEXT><CHAR>제1장 총칙</CHAR></TEXT></P><P><TEXT><TABLE><ROW><CELL><PARALIST><P><TEXT><CHAR>a</CHAR></TEXT></P></PARALIST></CELL>
    <CELL ColSpan="1"><PARALIST><P><TEXT><CHAR>b</CHAR></TEXT></P></PARALIST></CELL></ROW></TABLE></TEXT></P><P><TEXT><CHAR>plain </CHAR><CHAR>text</CHAR></TEXT></P></SECTION></BODY></HWPML>"""
    assert formats.read_hwpml(xml.encode()) == "제1장 총칙\n\n| a | b |\n| --- | --- |\n\nplain text"


def record(tag, level, body):
    return struct.pack("<I", tag | level << 10 | len(body) << 20) + body


def test_hwp_tables_and_headings():
    text = lambda t: t.encode("utf-16-le")
    cell = lambda col, row, wide, high: struct.pack("<IIHHHH", 1, 0, col, row, wide, high)
    stream = b"".join(
        [
            record(66, 0, b"\0" * 4), record(67, 1, text("제1장 총칙")), record(66, 0, b"\0" * 4), record(71, 1, b" lbt"), record(77, 2, struct.pack("<IHH", 0, 2, 2)),
            record(72, 2, cell(0, 0, 2, 1)), record(66, 2, b"\0" * 4), record(67, 3, text("넓은 칸")), record(72, 2, cell(0, 1, 1, 1)), record(67, 3, text("a")), record(72, 2, cell(1, 1, 1, 1)), record(67, 3, text("b")),
            record(66, 0, b"\0" * 4), record(67, 1, text("뒤의 글")),
        ]
    )
    blocks = binary.hwp_blocks(binary.hwp_records(stream))
    assert [(b["kind"], b["level"]) for b in blocks] == [("heading", 2), ("table", 0), ("paragraph", 0)]
    assert [[(c["text"], c["colspan"]) for c in r] for r in blocks[1]["rows"]] == [[("넓은 칸", 2)], [("a", 1), ("b", 1)]]
    assert binary.heading_of("부칙") == 1 and binary.heading_of("제3조 x") == 3 and binary.heading_of("x" * 300) == 0


def test_reports_manifests_and_suffixes(spark):
    from docweave.operators import assets, diff, scores
    from docweave.streaming import watch

    changes = spark.createDataFrame([(1, 0, "modified", 0.756, "a", "b\nc"), (1, 1, "removed", None, "gone", None)], "doc long, seq int, change string, similarity double, before string, after string")
    assert diff.diff_reports(changes, "doc").first().report == "## 문서 비교 결과\n추가: 0 | 삭제: 1 | 변경: 1 | 이동: 0 | 동일: 0\n\n~ b c (76%)\n- gone"
    df = spark.createDataFrame([(1, '{"version":"2.0","assets":[{"asset_id":"i","width":3}],"stats":{"total_assets":1}}'), (2, "x")], "id long, manifest string")
    got = {r.id: (r.version, r.total_assets) for r in assets.parsed_manifests(df).collect()}
    assert got == {1: ("2.0", 1), 2: (None, None)}
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c.alias("r")).first().r
    assert one(assets.barcode_suffix(F.col("v")), " https://a.example/x ") == " <https://a.example/x>" and one(assets.barcode_suffix(F.col("v")), "a [b]\nc") == " (QR: a \\[b\\] c)"
    sizes = spark.createDataFrame([(100, 80), (0, 0), (None, 1)], "a int, b int").select(assets.is_effective(F.col("a"), F.col("b"), 0.2).alias("r")).collect()
    assert [r.r for r in sizes] == [True, False, False]
    words = spark.createDataFrame([("g", "aa"), ("g", "b"), ("g", "ab")], "g string, t string")
    assert sorted((r["rank"], r.t) for r in scores.longest(words, "g", "t", 2).collect()) == [(1, "aa"), (2, "ab")]
    events = spark.createDataFrame([("p", "{}")], "path string, event string")
    sent = watch.post_events(events, "http://192.0.2.1:9/", timeout=0.2) if not watch.is_private_address("192.0.2.1") else None
    assert sent is None or sent.first().error
