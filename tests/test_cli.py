import json

import pytest

from docweave import cli


@pytest.fixture
def doc(tmp_path):
    path = tmp_path / "a.md"
    path.write_text("# Title\n\nmail a.b@example.org now\n\n제1조(목적) 이 규정은 정한다.\n① 하나\n", encoding="utf-8")
    return path


def run(capsys, *argv):
    code = cli.main(list(map(str, argv)))
    return code, capsys.readouterr().out


def test_text_commands(capsys, doc, tmp_path):
    assert run(capsys, "text", doc)[1].startswith("# Title")
    assert json.loads(run(capsys, "inspect", doc)[1])[0]["kind"] == "heading"
    masked = run(capsys, "redact", doc, "--rules", "email")[1]
    assert "a.b@example.org" not in masked and "●" in masked
    assert json.loads(run(capsys, "redact", doc, "--rules", "email", "--report")[1])[0]["rule"] == "email"
    assert json.loads(run(capsys, "legal", doc)[1].splitlines()[0])["article_number"] == "1"
    assert len(run(capsys, "chunks", doc, "--most", 40)[1].splitlines()) >= 2
    other = tmp_path / "b.md"
    other.write_text(doc.read_text(encoding="utf-8").replace("now", "later"), encoding="utf-8")
    assert "+mail a.b@example.org later" in run(capsys, "diff", doc, other, "--mode", "unified")[1]
    assert ["added", "later"] in json.loads(run(capsys, "diff", doc, other, "--mode", "words")[1])
    assert 0 < json.loads(run(capsys, "score", doc, other)[1])["edit_ratio"] < 1


def test_files(capsys, doc, tmp_path):
    made = tmp_path / "a.docx"
    assert cli.main(["generate", str(doc), "--out", str(made)]) == 0 and made.read_bytes()[:2] == b"PK"
    assert "Title" in run(capsys, "text", made)[1] and json.loads(run(capsys, "info", made)[1])["format"] == "docx"
    hwpx = tmp_path / "a.hwpx"
    assert cli.main(["generate", str(doc), "--kind", "hwpx", "--out", str(hwpx)]) == 0
    assert json.loads(run(capsys, "validate", hwpx)[1])["issues"] == []
    assert cli.main(["replace", str(hwpx), "Title=Other", "--out", str(tmp_path / "c.hwpx")]) == 0
    assert "Other" in run(capsys, "text", tmp_path / "c.hwpx")[1]
    assert run(capsys, "text", tmp_path / "missing.md")[0] == 1
