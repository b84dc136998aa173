import struct
import zlib

from pyspark.sql import functions as F

from docweave.operators import references
from docweave.plans import steps
from docweave.sources import binary, formats, writers

MD = "# 제목\n\n본문 & 글\n\n- a\n- b\n\n| 성명 | 값 |\n| --- | --- |\n| x | y |"


def compound(streams):
    """A compound file with streams of at least 4096 bytes below one storage or the root."""
    entries, data, fat, at = [("Root Entry", 5, 0xFFFFFFFF, b"")], [], [], 2
    fat += [0xFFFFFFFD, 0xFFFFFFFE]
    packed = []
    for name, kind, child, body in streams:
        start = 0xFFFFFFFE
        if kind == 2:
            start, n = at, (len(body) + 511) // 512
            fat += [*range(at + 1, at + n), 0xFFFFFFFE]
            data.append(body.ljust(n * 512, b"\0"))
            at += n
        packed.append((name, kind, child, start, len(body)))
    rows = [("Root Entry", 5, 0xFFFFFFFF, 1, 0xFFFFFFFE, 0)]
    for i, (name, kind, child, start, size) in enumerate(packed):
        sibling = i + 2 if i + 1 < len(packed) and child != -1 else 0xFFFFFFFF
        rows.append((name, kind, sibling, 0xFFFFFFFF if child in (0, -1) else child, start, size))
    directory = b""
    for name, kind, right, child, start, size in rows:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 0, 0xFFFFFFFF, right, child) + b"\0" * 36 + struct.pack("<III", start, size, 0)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    head = head[:76] + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    fat += [0xFFFFFFFF] * (128 - len(fat))
    return head + struct.pack("<128I", *fat) + directory.ljust(512, b"\0") + b"".join(data)


def test_hwp():
    text = lambda s: struct.pack("<I", 67 | len(s.encode("utf-16-le")) << 20) + s.encode("utf-16-le")
    control = chr(11) + "abcdefg"
    body = text(control + "첫째 글") + text("둘째")
    packed = zlib.compressobj(0, wbits=-15)
    section = packed.compress(body) + packed.flush()
    assert [t for t, *_ in binary.hwp_records(body)] == [67, 67]
    assert binary.hwp_paragraph((control + "첫째 글").encode("utf-16-le")) == "첫째 글"
    header = b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, 1)
    data = compound([("FileHeader", 2, 0, header.ljust(4096, b"\0")), ("BodyText", 1, 3, b""), ("Section0", 2, -1, section.ljust(4096, b"\0"))])
    container = binary.CompoundFile(data)
    assert set(container.streams) == {"FileHeader", "BodyText/Section0"}
    assert formats.detect(data, "a.hwp") == "hwp" and binary.read_hwp(data) == "첫째 글\n\n둘째"


def test_pdf():
    content = zlib.compress(b"BT /F1 12 Tf (Hello \\(x\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ /F2 12 Tf T* <00010002> Tj ET")
    unicode_map = b"beginbfchar <0001> <AC00> endbfchar beginbfrange <0002> <0400> <AC01> endbfrange"
    parts = [b"1 0 obj << /Font << /F2 2 0 R >> >> endobj", b"2 0 obj << /Type /Font /ToUnicode 3 0 R >> endobj"]
    parts.append(b"3 0 obj << >> stream\n" + unicode_map + b"\nendstream endobj")
    parts.append(b"4 0 obj << /Filter /FlateDecode >> stream\n" + content + b"\nendstream endobj")
    assert binary.read_pdf(b"%PDF-1.4\n" + b"\n".join(parts)) == "Hello (x)\nworld\n가각"


def test_generated_documents_read_back(spark):
    assert formats.to_markdown(writers.markdown_docx(MD), "a.docx") == ("docx", MD.replace("- a\n- b", "• a\n\n• b"))
    made = writers.markdown_hwpx(MD)
    assert writers.hwpx_issues(made) == [] and writers.hwpx_issues(b"x") == ["not an archive"]
    assert formats.read_hwpx(made) == MD.replace("# ", "").replace("- a\n- b", "- a\n\n- b")
    assert made == writers.markdown_hwpx(MD)
    patched, n = writers.replace_hwpx(made, [("본문 &", "새 <글>")])
    assert n == 1 and "새 <글> 글" in formats.read_hwpx(patched)
    filled, missing = writers.fill_hwpx(made, {"x :": "홍길동", "none": "z"})
    assert "| x | 홍길동 |" in formats.read_hwpx(filled) and missing == ["none"]
    df = spark.createDataFrame([(MD,), (None,)], "t string").select(writers.generated(F.col("t")).alias("d"))
    assert [r.d is None for r in df.collect()] == [False, True]


def test_references(spark):
    df = spark.createDataFrame([(1, 'a ![[img:big | width=3 alt="x y" lazy width=4]] b', 0), (2, None, 0), (3, "", 0)], "id long, t string, name int")
    rows = references.tokens(df, "id", "t").orderBy("seq").collect()
    assert [(r.kind, r.name, r.preset) for r in rows] == [("text", None, None), ("reference", "img", "big"), ("text", None, None)]
    assert rows[1].attributes == {"width": "4", "alt": "x y", "lazy": "true"}
    made = spark.createDataFrame([("img", "image", "./a.png")], "name string, type string, src string")
    assert [r.src for r in references.resolved(references.tokens(df, "id", "t"), made).filter("src is not null").collect()] == ["./a.png"]
    got = made.select(references.absolute(F.col("src"), "http://h/m/")).first()[0]
    assert got == "http://h/m/a.png"


def test_plans(spark):
    plan = spark.createDataFrame([("p", 0, 1), ("p", 1, 1), ("p", 2, None)], "plan string, step int, parallel_group int")
    assert [(r.turn, r.steps) for r in steps.groups(plan).orderBy("turn").collect()] == [(1, [0, 1]), (2, [2])]
    told = spark.createDataFrame([("p", 1, "B", "b"), ("p", 0, "A", "a"), ("p", 2, "C", " ")], "plan string, step int, title string, body string")
    assert steps.report(told).first().report == "## A\n\na\n\n## B\n\nb"
