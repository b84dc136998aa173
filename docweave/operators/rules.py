"""Rule-based scans of text: personal data with format-preserving masks, and notation findings.

Rules that need look-around or a checksum run in Python over Arrow batches; the e-mail rule alone is
also given as a Column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules in order of priority, and their patterns.
PII_PATTERNS = {
    "rrn": r"(?<!\d)(\d{6})([-‐‑–—])([1-8]\d{6})(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "card": r"(?<!\d)(\d{4})([- ])(\d{4})\2(\d{4})\2(\d{4})(?!\d)",
    "phone": r"(?<![\d-])(?:(01[016789]|070|02|0[3-6]\d)([-. ]?)(\d{3,4})\2(\d{4})|(1[568]\d{2})([-. ])(\d{4}))(?!\d)",
    "driver": r"(?<![\d-])(\d{2})-(\d{2})-\d{6}-\d{2}(?!-?\d)",
    "account": r"(?<!\d)(?<!\d-)\d{2,6}(?:-\d{2,6}){1,2}-\d{2,8}(?!-?\d)",
    "passport": r"\b([MSRODG])\d{8}(?![0-9A-Za-z])",
}
DEFAULT_RULES = ("rrn", "phone", "email", "card", "account")
_PII = {rule: re.compile(p) for rule, p in PII_PATTERNS.items()}


def luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _valid(rule: str, m: re.Match) -> bool:
    if rule == "rrn":
        return 1 <= int(m[1][2:4]) <= 12 and 1 <= int(m[1][4:6]) <= 31
    digits = re.sub(r"\D", "", m[0])
    return luhn(digits) if rule == "card" else 10 <= len(digits) <= 16 if rule == "account" else True


def _hide(text: str, mark: str, keep: slice) -> str:
    """The digits of text hidden but for those of the dash- or space-separated parts in keep."""
    parts = re.split(r"([-‐‑–—. ])", text)
    kept = set(range(0, len(parts), 2)[keep])
    return "".join(p if i % 2 or i in kept else mark * len(p) for i, p in enumerate(parts))


def _masked(rule: str, m: re.Match, mark: str) -> str:
    text = m[0]
    if rule == "rrn":
        return text[:7] + mark * 7
    if rule == "email":
        local, _, domain = text.partition("@")
        return local[:1] + mark * (len(local) - 1) + "@" + domain
    if rule == "card":
        return _hide(text, mark, slice(0, None, 3))
    if rule == "phone":
        if m[1] is None:
            return _hide(text, mark, slice(0, 1))
        return m[1] + m[2] + mark * len(m[3]) + m[2] + m[4]
    if rule == "driver":
        return _hide(text, mark, slice(0, 2))
    return _hide(text, mark, slice(-1, None)) if rule == "account" else text[0] + mark * 8


def pii_spans(text: str, rules: Sequence[str], mark: str = "●") -> list[tuple[int, int, str, str]]:
    """(start, stop, rule, masked) in order of position; of two that overlap the earlier rule holds."""
    taken, out = bytearray(len(text)), []
    for rule in (r for r in PII_PATTERNS if r in rules):
        for m in _PII[rule].finditer(text):
            if _valid(rule, m) and not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
                out.append((m.start(), m.end(), rule, _masked(rule, m, mark)))
    return sorted(out)


def mask_text(text: str, rules: Sequence[str], mark: str = "●") -> str:
    out, at = [], 0
    for start, stop, _, masked in pii_spans(text, rules, mark):
        out += [text[at:start], masked]
        at = stop
    return "".join([*out, text[at:]])


def _check_mark(mark: str) -> None:
    if len(mark) != 1 or mark.isascii() and mark.isalnum():
        raise ValueError(f"a mask is one character that is no ASCII letter or digit: {mark!r}")


def detect_pii(df: DataFrame, key: str, text: str, rules: Sequence[str] = tuple(PII_PATTERNS)) -> DataFrame:
    """(key, rule, index, length, text), one row per hit. index and length count UTF-8 bytes from 0."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["_text"], strict=True):
                for start, stop, rule, _ in pii_spans(t, rules):
                    rows.append((k, rule, len(t[:start].encode()), len(t[start:stop].encode()), t[start:stop]))
            yield pd.DataFrame(rows, columns=[key, "rule", "index", "length", "text"])

    kind = df.schema[key].dataType.simpleString()
    hinted = df.select(key, F.col(text).alias("_text")).filter(F.col("_text").rlike(r"[0-9]{4}|@"))
    return hinted.mapInPandas(scan, f"`{key}` {kind}, rule string, index int, length int, text string")


def redacted_text(text: Column, rules: Sequence[str] = DEFAULT_RULES, mark: str = "●", markdown: bool = False) -> Column:
    """text with hits masked in their own format. markdown leaves lines with data:image/ alone."""
    _check_mark(mark)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        line = lambda x: x if "data:image/" in x else mask_text(x, rules, mark)
        whole = lambda t: "\n".join(map(line, t.split("\n"))) if markdown else mask_text(t, rules, mark)
        for texts in batches:
            yield pd.Series([None if t is None else whole(t) for t in texts], dtype=object)

    return mask(text)


def masked_emails(text: Column, mark: str = "●") -> Column:
    """The e-mail rule alone, without Python: local parts but for their first character are hidden, each
    character by one mark."""
    _check_mark(mark)
    hide = r"(?<=[A-Za-z0-9._%+-])[A-Za-z0-9._%+-](?=[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
    return F.regexp_replace(text, hide, mark)


E_, W_ = "error", "warning"
# Code, severity, pattern, in the order in which they are reported.
LINT_RULES = (
    ("DATE_NO_SPACE", E_, r"\b\d{4}\.\d{1,2}\.\d{1,2}\.?"),
    ("DATE_ZERO_PAD", E_, r"\b\d{4}\.\s*0\d\.|\b\d{4}\.\s*\d{1,2}\.\s*0\d"),
    ("DATE_2DIGIT_YR", E_, r"(?<!\d)['’]\d{2}\.\s*\d"),
    ("DATE_NO_END_DOT", W_, r"\b\d{4}\.\s\d{1,2}\.\s\d{1,2}(?!\s*[.\d(])"),
    ("TIME_AMPM", E_, r"(오전|오후|아침|밤|낮)\s*\d{1,2}\s*시"),
    ("TIME_24H", W_, r"(?<!\d)24\s*시(?!각)"),
    ("TIME_COLON_SP", E_, r"\b\d{1,2}\s+:\s*\d{2}\b|\b\d{1,2}:\s+\d{2}\b"),
    ("MONEY_CHEONWON", E_, r"\d+\s*천\s*원"),
    ("MONEY_GEUM_SP", W_, r"금\s+\d"),
    ("BUNIM_COLON", E_, r"붙\s*임\s*:"),
    ("KKAJI_DUP", E_, r"[∼~～][^\n]{0,20}?까지"),
    ("FOREIGN_FIRST", W_, r"\b[A-Z]{2,5}\s*\([가-힣]"),
    ("COLON_SPACE", W_, r"\S\s+:(?!//)|\S:(?!//)[^\s\d]"),
)


def lint(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, rule, severity, matched): notation findings outside fenced code. line counts from 1.

    All rules run in the JVM, over the lines that no fence encloses; (?U) gives \\b, \\d and \\s their Unicode
    meaning. A fence is closed by its own kind of mark only.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n", "\n"), "\n")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("out"))
    mark = lambda line: F.regexp_extract(line, r"^\s*(`|~)\1\1", 1)
    step = lambda acc, line: F.struct(
        F.when(mark(line) == "", acc["open"]).when(acc["open"] == "", mark(line)).when(acc["open"] == mark(line), "").otherwise(acc["open"]).alias("open"),
        F.concat(acc["out"], F.array((acc["open"] == "") & (mark(line) == ""))).alias("out"),
    )
    fenced = F.when(F.col(text).rlike(r"(?m)^\s*(?:```|~~~)"), F.aggregate(lines, start, step)["out"]).otherwise(F.transform(lines, lambda _: F.lit(True)))
    rows = df.select(key, F.posexplode(F.arrays_zip(lines.alias("line"), fenced.alias("open"))).alias("no", "x")).filter("x.open")
    found = F.array(
        *[
            F.struct(F.lit(code).alias("rule"), F.lit(severity).alias("severity"), F.regexp_extract_all(F.col("x.line"), F.lit("(?U)" + pattern), F.lit(0)).alias("hits"))
            for code, severity, pattern in LINT_RULES
        ]
    )
    exploded = rows.select(key, (F.col("no") + 1).alias("line"), F.explode(found).alias("f")).filter(F.size("f.hits") > 0)
    return exploded.select(key, "line", "f.rule", "f.severity", F.explode("f.hits").alias("matched")).withColumn("matched", F.trim("matched"))
