"""Pages of documents: splitting, routing between text and image reading, and putting results together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of page whose text is read from the image.
FROM_IMAGE = ("scanned", "mixed", "unknown")


def split_pages(text: Column, pages: Column) -> Column:
    """Array of (page, text): at form feeds if there are any, else slices of equally many lines, floor(lines / pages), of
    which the last may be one more. Blank pages are left out and keep their number. Null text gives null."""
    lines = F.split(text, r"\n")
    each = F.greatest(F.floor(F.size(lines) / F.greatest(pages, F.lit(1))), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / each).cast("int"))
    sliced = F.transform(starts, lambda i: F.array_join(F.slice(lines, i * each + 1, each), "\n"))
    found = F.when(F.contains(text, F.lit("\f")), F.split(text, "\f")).otherwise(sliced)
    numbered = F.transform(found, lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))
    return F.filter(numbered, lambda p: F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != "")


def routing_manifests(pages: DataFrame, key: str) -> DataFrame:
    """(key, manifest) of pages (key, page, category, confidence, text): per page whether all of it, or only regions, must
    be read from the image, and whether its script is Chinese, Japanese or Korean."""
    wide = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{IsHangul}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+", ""))
    row = F.struct(
        F.col("page"),
        F.col("category"),
        F.col("confidence"),
        F.col("category").isin("scanned", "unknown").alias("needs_full_page_ocr"),
        (F.col("category") == "mixed").alias("needs_regions"),
        (wide * 10 >= F.length(F.coalesce("text", F.lit("")))).alias("cjk_hint"),
    )
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("pages"))
    return listed.select(key, F.to_json(F.struct("pages", F.size(F.filter("pages", lambda p: p["needs_full_page_ocr"])).alias("full_pages"))).alias("manifest"))


def dispatched(pages: DataFrame, key: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(key, text) of pages (key, page, category, native, ocr): each page by its category from its own text or from its
    image, in order, each under a comment with its number; only pages from first to last."""
    wanted = F.lit(True)
    if first is not None:
        wanted &= F.col("page") >= first
    if last is not None:
        wanted &= F.col("page") <= last
    text = F.when(F.col("category").isin(*FROM_IMAGE), F.coalesce("ocr", "native")).otherwise(F.col("native"))
    said = pages.filter(wanted).select(key, "page", F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n"), F.coalesce(text, F.lit(""))).alias("t"))
    return said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def with_readings(documents: DataFrame, readings: DataFrame, key: str, text: str) -> DataFrame:
    """documents with text in which what was read from an image (key, image_id, reading) stands behind the image's mark,
    ![...](...image_id...): as a quote, or within a table's row in the same line. Images without a reading stay."""
    listed = readings.filter(F.trim(F.coalesce("reading", F.lit(""))) != "").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("image_id", "reading")))).alias("_readings"))
    joined = documents.join(listed, key, "left")
    image = r"!\[[^\]]*\]\((?:[^()\s]*/)?([^()/\s]+)\)"
    lines = F.split(F.col(text), "\n")

    def read(line: Column) -> Column:
        ids = F.regexp_extract_all(line, F.lit(image), F.lit(1))
        told = F.filter(F.transform(ids, lambda i: F.try_element_at(F.col("_readings"), i)), lambda r: r.isNotNull())
        inline = F.concat(F.regexp_replace(line, r"\|\s*$", ""), F.lit("<br>"), F.replace(F.regexp_replace(F.array_join(told, "<br>"), r"\s*\n\s*", "<br>"), F.lit("|"), F.lit(r"\|")), F.lit(" |"))
        block = F.concat(line, F.lit("\n\n> "), F.replace(F.array_join(told, "\n\n"), F.lit("\n"), F.lit("\n> ")))
        return F.when(F.size(told) == 0, line).when(F.ltrim(line).startswith("|"), inline).otherwise(block)

    made = F.when(F.col("_readings").isNull(), F.col(text)).otherwise(F.array_join(F.transform(lines, read), "\n"))
    return joined.withColumn(text, made).drop("_readings")


def plain_alt(caption: Column) -> Column:
    """A caption without square brackets, which would end the mark of its image."""
    return F.trim(F.regexp_replace(caption, r"[\[\]]", ""))


def for_comparison(text: Column) -> Column:
    """Without front matter, comments and the sections that are appended to a conversion."""
    out = F.regexp_replace(text, r"(?s)\A---\n.*?---\n", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for title in ("Font Styles", "Images", "Tables"):
        out = F.regexp_replace(out, rf"(?s)\n## {title}\n.*\z", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def by_stem(fixtures: DataFrame, references: DataFrame) -> DataFrame:
    """fixtures (path) with family, the folder a file is in, and the reference of the same stem, if there is one."""
    stem = lambda path: F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    known = references.select(stem(F.col("path")).alias("stem"), F.col("path").alias("reference"))
    own = fixtures.withColumns({"stem": stem(F.col("path")), "family": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})
    return own.join(known, "stem", "left")


def shown_findings(findings: DataFrame, key: str, order: str, line: Column, limit: int) -> DataFrame:
    """(key, no, line): the first limit findings of each key as lines, and how many more there are."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    counted = findings.select(key, F.row_number().over(w.orderBy(order)).alias("no"), F.count("*").over(w).alias("n"), line.alias("line"))
    more = counted.filter((F.col("no") == limit + 1)).withColumn("line", F.format_string("%d more", (F.col("n") - limit).cast("int")))
    return counted.filter(F.col("no") <= limit).unionByName(more).select(key, "no", "line")


# Marks of Korean word processor files that are really drawn; any other value means none.
STRIKES = "CONT SOLID DOT DASH DASH_DOT DASH_DOT_DOT LONG_DASH DOUBLE DOUBLE_SLIM SLIM_THICK THICK_SLIM SLIM_THICK_SLIM WAVE DOUBLE_WAVE CIRCLE".split()
UNDERLINES = "BOTTOM TOP".split()
EMPHASES = "DOT CIRCLE TICK TILDE MIDDLE_DOT COLON".split()


def drawn(kind: str, value: Column) -> Column:
    """Whether a strike, underline or emphasis of that name is drawn."""
    return F.coalesce(value.isin({"strike": STRIKES, "underline": UNDERLINES, "emphasis": EMPHASES}[kind]), F.lit(False))


STYLES = ("max-width", "object-fit", "margin", "opacity", "float")


def inline_style(attributes: Column) -> Column:
    """The attributes of a map that are styles as CSS, in a fixed order."""
    said = [F.when(F.try_element_at(attributes, F.lit(s)).isNotNull(), F.concat(F.lit(f"{s}: "), F.try_element_at(attributes, F.lit(s)), F.lit("px" if s == "max-width" else ""))) for s in STYLES]
    return F.concat_ws("; ", *said)


def rendered(tokens: DataFrame, key: str) -> DataFrame:
    """(key, html) of tokens (key, seq, kind, value, resource_type, src, name, attributes) with their resources: text as
    it is, references as images, videos, sounds or links; those without resource as a comment."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    style = inline_style(F.col("attributes"))
    styled = F.when(F.coalesce(style, F.lit("")) != "", F.concat(F.lit(' style="'), safe(style), F.lit('"'))).otherwise("")
    tag = lambda open_, close: F.concat(F.lit(open_), safe(F.col("src")), F.lit('"'), styled, F.lit(close))
    made = (
        F.when(F.col("kind") == "text", F.col("value"))
        .when(F.col("src").isNull(), F.concat(F.lit("<!-- no resource: "), F.regexp_replace(F.col("name"), "--", ""), F.lit(" -->")))
        .when(F.col("resource_type") == "image", tag('<img src="', ">"))
        .when(F.col("resource_type") == "video", tag('<video controls src="', "></video>"))
        .when(F.col("resource_type") == "audio", tag('<audio controls src="', "></audio>"))
        .otherwise(F.concat(tag('<a href="', ">"), safe(F.col("name")), F.lit("</a>")))
    )
    listed = tokens.select(key, F.struct("seq", made.alias("h")).alias("t")).groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select(key, F.array_join(F.transform("t", lambda x: x["h"]), "").alias("html"))


_HEADER = {
    "law_name": r"(?m)^\s*# (.+?)\s*$",
    "law_id": r"(?m)^\s*- \*\*규정 ID\*\*:(?:[^\n]*:)?[ \t]*([^\n:]*?)[ \t]*$",
    "category": r"(?m)^\s*- \*\*분류\*\*:(?:[^\n]*:)?[ \t]*([^\n:]*?)[ \t]*$",
}


def law_header(text: Column) -> Column:
    """(law_name, law_id, category, revision_date, revision_number) of what stands above the first part, chapter or article of
    a law text; what isn't there is null, of repeated lines the last holds."""
    body = re.compile(r"(?m)^\s*제\s*\d+\s*(?:편|장|조)").pattern
    head = F.element_at(F.split(text, body, 2), 1)
    last = lambda pattern, i=1: F.nullif(F.try_element_at(F.regexp_extract_all(head, F.lit(pattern), F.lit(i)), F.lit(-1)), F.lit(""))
    date = r"개정\s*:?\s*(\d{4})[.\-년]\s*(\d{1,2})[.\-월]\s*(\d{1,2})"
    day = F.concat_ws("-", last(date, 1), F.lpad(last(date, 2), 2, "0"), F.lpad(last(date, 3), 2, "0"))
    return F.struct(
        *[last(p).alias(n) for n, p in _HEADER.items()],
        F.when(last(date, 1).isNotNull(), day).alias("revision_date"),
        last(r"제?\s*(\d+)\s*차\s*개정").alias("revision_number"),
    )
