"""Legal texts: hierarchy, articles, references, annexes, and dates in words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import sizes
from docweave.operators.history import iso_date

# The marks of the hierarchy, from the top, and of references and annexes.
LEVELS = {"part": r"^제(\d+)편\s*(.*)$", "chapter": r"^제(\d+)장\s*(.*)$", "section": r"^제(\d+)절\s*(.*)$", "subsection": r"^제(\d+)관\s*(.*)$"}
ARTICLE = r"^제(\d+)조(?:의(\d+))?(?:\(([^)]+)\))?"
PARAGRAPH = r"^(?:[①-⑳]|\(\d+\))\s*"
LAW_REFERENCE = r"「([^」]+)」(?:\s*제(\d+)조(?:의(\d+))?(?:제(\d+)항)?(?:제(\d+)호)?)?"
INNER_REFERENCE = r"제(\d+)조(?:의(\d+))?(?:제(\d+)항)?(?:제(\d+)호)?(?:([가-하])목)?"
ANNEXES = {
    "annex": r"^\[?별표\s*(\d+)(?:의\s*(\d+))?\]?\s*(.*?)$",
    "form": r"^\[?별지\s*(?:서식\s*)?(?:제?\s*)?(\d+)(?:호)?(?:의\s*(\d+))?\s*(?:서식)?\]?\s*(.*?)$",
    "attachment": r"^\[?첨부\s*(\d+)()\]?\s*(.*?)$",
}


def _text_lines(text: str) -> list[str]:
    """Lines without blanks at their ends; a last empty one isn't counted."""
    return [x.strip(" ") for x in re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text))]


_LEVELS = {name: re.compile(pattern, re.A) for name, pattern in LEVELS.items()}
_ARTICLE = re.compile(ARTICLE, re.A)


def article_rows(text: str) -> Iterator[dict]:
    """The articles of a text in order, by one pass over its lines that holds the article it is in."""
    titles: dict[str, str | None] = dict.fromkeys(LEVELS)
    names, here, n = list(LEVELS), None, 0
    for no, line in enumerate(_text_lines(text)):
        level = next((name for name in names if _LEVELS[name].match(line)), None)
        if level:
            at = names.index(level)
            titles = {name: line if name == level else titles[name] if names.index(name) < at else None for name in names}
        elif m := _ARTICLE.match(line):
            if here:
                yield here
            n += 1
            here = {"article_no": n, **{f"{name}_title": t for name, t in titles.items()}, "m": m, "lines": [line], "line_start": no + 1, "line_end": no + 1}
        elif here and line:
            here["lines"].append(line)
            here["line_end"] = no + 1
    if here:
        yield here


_ARTICLE_ROW = "article_no long, " + ", ".join(f"{n}_title string" for n in LEVELS) + ", article_number string, article_title string, context_path string, content string, line_start int, line_end int"


def articles(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per article of each law text: (key, article_no, part_title, chapter_title, section_title,
    subsection_title, article_number, article_title, context_path, content, token_count, line_start,
    line_end). A title of the hierarchy holds until the next of its level or above; those that follow an
    article's last line belong to what comes after them. Lines count from 1.

    The fold over its lines stays in a text's own row, so nothing is shuffled. Null and empty texts give no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["_text"], strict=True):
                for a in article_rows(t):
                    no, branch, title = a["m"].groups()
                    number = no + (f"의{branch}" if branch else "")
                    titled = f"제{no}조" + (f"의{branch}" if branch else "") + (f"({title})" if title else "")
                    levels = [a[f"{n}_title"] for n in LEVELS]
                    rows.append((k, a["article_no"], *levels, number, title, " > ".join([*filter(None, levels), titled]), "\n".join(a["lines"]), a["line_start"], a["line_end"]))
            yield pd.DataFrame(rows, columns=[key, *[c.strip().split()[0] for c in _ARTICLE_ROW.split(",")]])

    likely = df.filter(F.col(text).rlike("제\\d+조")).select(key, F.col(text).alias("_text"))
    found = likely.mapInPandas(run, f"`{key}` {kind}, {_ARTICLE_ROW}")
    return found.withColumn("token_count", sizes.estimated_tokens(F.col("content")))


def paragraphs_of(chunks: DataFrame, key: str, content: str, most: int = 512) -> DataFrame:
    """Articles of more than most tokens cut before each paragraph mark: (key, piece_no, content, token_count)."""
    large = chunks.filter(sizes.estimated_tokens(F.col(content)) > most)
    pieces = F.split(F.regexp_replace(F.col(content), r"(?m)^(?=\s*(?:[①-⑳]|\(\d+\)))", "\u0001"), "\u0001")
    named = F.filter(pieces, lambda p: F.trim(p) != "")
    return large.select(key, F.posexplode(named).alias("piece_no", "content")).withColumn("token_count", sizes.estimated_tokens(F.col("content")))


def chunk_id(law: Column, article: Column, content: Column) -> Column:
    """16 hexadecimal digits from name, article and the first hundred characters."""
    return F.substring(F.sha2(F.concat_ws(":", F.coalesce(law, F.lit("")), F.coalesce(article, F.lit("")), F.substring(content, 1, 100)), 256), 1, 16)


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reference_type, target_law, target_article, raw_text): laws named in corner brackets with their
    article, then articles of the same law, but for those within one of the former."""
    found = lambda p, i: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(i))
    outer = F.transform(
        F.arrays_zip(found(LAW_REFERENCE, 1).alias("law"), found(LAW_REFERENCE, 2).alias("no"), found(LAW_REFERENCE, 0).alias("raw")),
        lambda x: F.struct(F.lit("external").alias("kind"), x["law"].alias("law"), F.when(x["no"] != "", F.concat(F.lit("제"), x["no"], F.lit("조"))).alias("article"), x["raw"].alias("raw")),
    )
    inner = F.transform(
        F.arrays_zip(found(INNER_REFERENCE, 1).alias("no"), found(INNER_REFERENCE, 2).alias("branch"), found(INNER_REFERENCE, 0).alias("raw")),
        lambda x: F.struct(
            F.lit("internal").alias("kind"),
            F.lit(None).cast("string").alias("law"),
            F.concat(F.lit("제"), x["no"], F.lit("조"), F.when(x["branch"] != "", F.concat(F.lit("의"), x["branch"])).otherwise("")).alias("article"),
            x["raw"].alias("raw"),
        ),
    )
    alone = F.filter(inner, lambda x: ~F.exists(found(LAW_REFERENCE, 0), lambda y: F.contains(y, x["raw"])))
    rows = df.filter(F.col(text).rlike("제\\d+조|「")).select(key, F.explode(F.concat(outer, alone)).alias("r"))
    return rows.select(key, F.col("r.kind").alias("reference_type"), F.col("r.law").alias("target_law"), F.col("r.article").alias("target_article"), F.col("r.raw").alias("raw_text"))


_ANNEXES = {name: re.compile(pattern, re.A) for name, pattern in ANNEXES.items()}


def annexes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, annex_type, number, sub_number, title, start_line, end_line, content): regions from a heading of an
    annex, form or attachment to the next one or the end. Lines count from 0, end_line is past the last. Every text is
    read in its own row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["_text"], strict=True):
                lines = _text_lines(t)
                found = ((i, next(((n, m) for n, p in _ANNEXES.items() if (m := p.match(line))), None)) for i, line in enumerate(lines))
                heads = [(i, *f) for i, f in found if f]
                for (i, n, m), end in zip(heads, [*[h[0] for h in heads[1:]], len(lines)], strict=True):
                    rows.append((k, n, int(m[1]), int(m[2]) if m[2] else None, m[3] or "", i, end, "\n".join(lines[i:end])))
            frame = pd.DataFrame(rows, columns=[key, "annex_type", "number", "sub_number", "title", "start_line", "end_line", "content"])
            yield frame.astype({"sub_number": "Int32"})

    likely = df.filter(F.col(text).rlike("별표|별지|첨부")).select(key, F.col(text).alias("_text"))
    return likely.mapInPandas(run, f"`{key}` {kind}, annex_type string, number int, sub_number int, title string, start_line int, end_line int, content string")



_UNITS = {"일": "day", "주": "week", "달": "month", "개월": "month", "년": "year"}


def date_expression(text: Column, today: Column) -> Column:
    """The first date expression of a Korean text as struct(date, end_date, format, confidence), dates as
    yyyyMMdd: absolute, then named, offset, weekday, recent, quarter. today is a DATE. Null if there is none.
    An offset with 전 or 이내 goes back from today, one with 후 or 뒤 forward."""
    group = lambda p, i: F.regexp_extract(text, p, i)
    shown = lambda d: F.date_format(d, "yyyyMMdd")
    result = lambda d, end, kind, sure: F.struct(shown(d).alias("date"), shown(end).alias("end_date"), F.lit(kind).alias("format"), F.lit(sure).alias("confidence"))
    none = F.lit(None).cast("date")

    def absolute(pattern: str, kind: str, sure: float) -> Column:
        written = F.concat_ws("-", group(pattern, 1), F.lpad(group(pattern, 2), 2, "0"), F.lpad(group(pattern, 3), 2, "0"))
        d = written.try_cast("date")
        return F.when(text.rlike(pattern) & d.isNotNull(), result(d, none, kind, sure))

    month = F.trunc(today, "month")
    named = F.lit(None).cast("struct<date:string,end_date:string,format:string,confidence:double>")
    for word, d in (
        ("모레", F.date_add(today, 2)),
        ("내일", F.date_add(today, 1)),
        ("오늘", today),
        ("그제", F.date_add(today, -2)),
        ("어제", F.date_add(today, -1)),
        ("올해", F.trunc(today, "year")),
        ("작년", F.add_months(F.trunc(today, "year"), -12)),
        ("다음달", F.add_months(month, 1)),
        ("지난달", F.add_months(month, -1)),
        ("이번달", month),
    ):
        named = F.coalesce(named, F.when(F.contains(text, F.lit(word)), result(d, none, "relative", 0.9)))

    offset = r"(\d{1,4})\s*(일|주|달|개월|년)\s*(전|후|이내|뒤|내)"
    sign = F.when(group(offset, 3).isin("후", "뒤"), 1).otherwise(-1)
    n = group(offset, 1).try_cast("int") * sign
    moved = lambda n, unit: (
        F.when(unit == "일", F.date_add(today, n)).when(unit == "주", F.date_add(today, n * 7)).when(unit.isin("달", "개월"), F.add_months(today, n)).when(unit == "분기", F.add_months(today, n * 3)).when(unit == "년", F.add_months(today, n * 12))
    )
    offsets = F.when(text.rlike(offset), result(moved(n, group(offset, 2)), none, "offset", 0.85))

    weekday = r"(이번|다음|지난|저번|다다음)주\s*(월|화|수|목|금|토|일)요일"
    week = F.when(group(weekday, 1) == "이번", 0).when(group(weekday, 1) == "다음", 1).when(group(weekday, 1) == "다다음", 2).otherwise(-1)
    day = F.instr(F.lit("월화수목금토일"), group(weekday, 2)) - 1
    weekdays = F.when(text.rlike(weekday), result(F.date_add(today, day - F.weekday(today) + week * 7), none, "weekday", 0.9))

    recent = r"최근\s*(\d{1,4})?\s*(일|주|달|개월|년|분기)"
    back = -F.coalesce(group(recent, 1).try_cast("int"), F.lit(1))
    recents = F.when(text.rlike(recent), result(moved(back, group(recent, 2)), today, "range", 0.8))

    quarter = r"(?:(\d{4})년\s*)?(상반기|하반기|([1-4])분기)"
    year = F.coalesce(group(quarter, 1).try_cast("int"), F.year(today))
    first = F.when(group(quarter, 2) == "상반기", 1).when(group(quarter, 2) == "하반기", 7).otherwise(group(quarter, 3).try_cast("int") * 3 - 2)
    start = F.make_date(year, F.coalesce(first, F.lit(1)), F.lit(1))
    length = F.when(group(quarter, 2).isin("상반기", "하반기"), 5).otherwise(2)
    quarters = F.when(text.rlike(quarter), result(start, F.last_day(F.add_months(start, length)), "quarter", 0.85))
    written = F.coalesce(absolute(r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일", "korean", 0.95), absolute(r"(\d{4})\.\s?(\d{1,2})\.\s?(\d{1,2})", "dotted", 0.9))
    return F.coalesce(written, named, offsets, weekdays, recents, quarters)


def embedding_rows(chunks: DataFrame) -> DataFrame:
    """(id, text, metadata) of legal chunks: the context path in brackets above the content."""
    context = F.when(F.coalesce(F.col("context_path"), F.lit("")) != "", F.concat(F.lit("["), F.col("context_path"), F.lit("]\n\n"))).otherwise("")
    metadata = F.to_json(F.struct("law_name", "law_id", "category", "article_number", "chunk_type", "token_count"))
    return chunks.select("chunk_id", "id", F.concat(context, F.coalesce("content", F.lit(""))).alias("text"), metadata.alias("metadata"))


def parse_law(text: str) -> Iterator[tuple[str, str]]:
    """(level, line) of the lines of a law text that belong to the hierarchy."""
    for line in map(str.strip, text.splitlines()):
        for name, pattern in (LEVELS | {"article": ARTICLE, "paragraph": PARAGRAPH}).items():
            if re.match(pattern, line):
                yield name, line
                break


def header_dates(headers: DataFrame) -> DataFrame:
    """(header_id, doc_date, iso) of document headers."""
    return headers.select("header_id", "doc_date", iso_date(F.col("doc_date")).alias("iso"))


def outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, line) of the hierarchy's lines, in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch[key], batch["_t"], strict=True) if t for x in parse_law(t)]
            yield pd.DataFrame(rows, columns=[key, "level", "line"])

    return df.select(key, F.col(text).alias("_t")).mapInPandas(run, f"`{key}` {kind}, level string, line string")
