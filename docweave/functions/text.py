"""Text normalisers, predicates and markers as plain Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def tidy(text: Column) -> Column:
    """CRLF as LF, no white space at line ends, two blank lines in a row at most, none around the whole."""
    return _chain(text, (r"\r\n?", "\n"), (r"[ \t]+(?=\n|\z)", ""), (r"\n{4,}", "\n\n\n"), (r"\A\s+|\s+\z", ""))


def dense(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comparable(text: Column, limit: int = 200_000) -> Column:
    """Form for metrics: image references reduced to their alt text, blank runs collapsed, capped in length."""
    out = _chain(text, (r"!\[([^\]]*)\]\([^)]*\)", "<IMG:$1>"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
    return F.substring(F.regexp_replace(out, r"\A\s+|\s+\z", ""), 1, limit)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---\n(?s:.*?)\n---\n\s*", "")


def html_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(strip_tags(inner)), F.lit(""))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def html_list_items(html: Column) -> Column:
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return F.filter(F.transform(items, lambda x: F.trim(strip_tags(x))), lambda x: x != "")


def decode_entities(text: Column) -> Column:
    """The named entities of HTML's core; ampersands first, so that &amp;lt; becomes <."""
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def short_data_uri(src: Column) -> Column:
    """data: URIs of more than 64 bytes as their prefix and an ellipsis."""
    return F.when(src.startswith("data:") & (F.octet_length(src) > 64), F.concat(F.substring_index(src, ",", 1), F.lit(",..."))).otherwise(src)


def dangerous_url(href: Column) -> Column:
    return F.lower(F.ltrim(href)).rlike("^(javascript|vbscript|data):")


def pipe_cell(text: Column) -> Column:
    """A cell of a pipe table: bars escaped, line breaks as spaces."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\r\n|\n|\r", " ")


def other_characters(*ranges: tuple[int, int]) -> str:
    """The class of all characters outside of ranges, written as ranges: it is matched several times faster than a negated one."""
    out, at = "", 0
    for low, high in [*sorted(ranges), (0x110000, 0x110000)]:
        if low > at:
            out += rf"\x{{{at:x}}}-\x{{{low - 1:x}}}"
        at = max(at, high + 1)
    return f"[{out}]"


LIST_LINE = re.compile(r"^(?:[-*•–—□○▪◦]\s|\d{1,3}[.)]\s|[가-하][.)]\s|[①-⑳])")


def is_list_line(line: Column) -> Column:
    return F.trim(line).rlike(LIST_LINE.pattern)


def normal_list_line(line: Column) -> Column:
    return _chain(line, (r"^\s*[•–—]\s*", "- "), (r"^\s*(\d{1,3})\)\s*", "$1. "))


def cjk_spacing(text: Column) -> Column:
    """No space after an opening or before a closing bracket or punctuation; only where there is such text."""
    fixed = _chain(text, (r"([(\[{「『《〈]) +", "$1"), (r" +([)\]}」』》〉,.;:!?])", "$1"), (r" {2,}", " "))
    return F.when(text.rlike(r"[぀-ヿ一-鿿가-힣()\[\]{}「」『』]"), fixed).otherwise(text)


def joined_numbering(text: Column) -> Column:
    """A line that holds only .N is glued to the next line with text."""
    return F.regexp_replace(text, r"(?m)^[ \t]*(\.\d+)[ \t]*\n\s*", "$1 ")


def unresolved_images(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\(assets/image\d+\)"))


def garbled_share(text: Column) -> Column:
    """Share of replacement, control and private-use characters; 0 for empty text."""
    odd = F.length(F.regexp_replace(text, "[^\\x{fffd}\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{e000}-\\x{f8ff}]", ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(odd / F.length(text))


def ganada(index: Column) -> Column:
    """0 as 가, 1 as 나 and so on, over and over."""
    return F.element_at(F.array(*[F.lit(c) for c in "가나다라마바사아자차카타파하"]), index % 14 + 1)


def chosung(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"]), index % 14 + 1)


def letters(ordinal: Column) -> Column:
    """1 as a, 26 as z, 27 as aa."""
    start = F.struct(ordinal.cast("int").alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(
        acc["n"] > 0,
        F.struct(((acc["n"] - 1) / 26).cast("int").alias("n"), F.concat(F.chr(97 + (acc["n"] - 1) % 26), acc["s"]).alias("s")),
    ).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step)["s"]


def roman(ordinal: Column) -> Column:
    """1 as I, 4 as IV; empty below 1."""
    marks = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    values = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(m).alias("m")) for v, m in marks])
    start = F.struct(ordinal.cast("int").alias("n"), F.lit("").alias("s"))
    step = lambda acc, x: F.struct((acc["n"] % x["v"]).alias("n"), F.concat(acc["s"], F.repeat(x["m"], (acc["n"] / x["v"]).cast("int"))).alias("s"))
    return F.when(ordinal < 1, "").otherwise(F.aggregate(values, start, step)["s"])


def circled_number(mark: Column) -> Column:
    """① as 1 up to ⑳ as 20; null for anything else."""
    code = F.ascii(mark)
    return F.when(code.between(9312, 9331), code - 9311)


def parenthesised_number(mark: Column) -> Column:
    return F.regexp_extract(mark, r"^\((\d{1,3})\)$", 1).try_cast("int")


def article_name(number: Column, branch: Column, title: Column | None = None) -> Column:
    """제N조, 제N조의M, and with the title in brackets where there is one."""
    name = F.concat(F.lit("제"), number, F.lit("조"), F.coalesce(F.concat(F.lit("의"), branch), F.lit("")))
    return name if title is None else F.concat(name, F.coalesce(F.concat(F.lit("("), title, F.lit(")")), F.lit("")))


def heading_level(paragraph: Column) -> Column:
    """1 for 부칙, 2 for 편 and 장, 3 for 절 and 조, 4 for 목 at the start of a short paragraph; else null."""
    first = F.substring_index(paragraph, "\n", 1)
    short = (F.octet_length(paragraph) <= 240) & (F.octet_length(first) <= 80)
    level = (
        F.when(first.rlike(r"^부칙"), 1)
        .when(first.rlike(r"^제\s*\d+\s*[편장]"), 2)
        .when(first.rlike(r"^제\s*\d+\s*(?:절|조)"), 3)
        .when(first.rlike(r"^제\s*\d+\s*목"), 4)
    )
    return F.when(short, level)


def image_type(content: Column) -> Column:
    """Type of an image by its first bytes; unknown otherwise."""
    starts = lambda *heads: F.hex(F.substring(content, 1, 4)).rlike("^(" + "|".join(heads) + ")")
    return (
        F.when(starts("89504E47"), "png")
        .when(starts("FFD8FF"), "jpeg")
        .when(starts("47494638"), "gif")
        .when(starts("424D"), "bmp")
        .when(starts("D7CDC69A"), "wmf")
        .when(starts("49492A00", "4D4D002A"), "tiff")
        .when(starts("52494646"), "webp")
        .otherwise("unknown")
    )


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty, else 1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def bigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the character bigrams of two texts, each counted once; 0 without any."""
    grams = lambda t: F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, 2)))
    )
    x, y = grams(a), grams(b)
    return F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


#: Counters of a Markdown text: name -> pattern (multi-line).
STRUCTURE = {
    "headings": r"(?m)^#{1,6}\s+\S",
    "h1": r"(?m)^#\s+\S",
    "h2": r"(?m)^##\s+\S",
    "h3": r"(?m)^###\s+\S",
    "bullets": r"(?m)^\s*[-*+]\s+\S",
    "numbered": r"(?m)^\s*\d+\.\s+\S",
    "table_rows": r"(?m)^\|.*\|\s*$",
    "table_rules": r"(?m)^\|(?:\s*:?-{3,}:?\s*\|)+\s*$",
    "images": r"!\[[^\]]*\]\([^)]*\)",
    "links": r"(?:^|[^!])\[[^\]]+\]\([^)]*\)",
    "fences": r"(?m)^\s*(?:```|~~~)",
    "quotes": r"(?m)^>\s?",
    "bold": r"\*\*[^*\n]+\*\*",
    "rules": r"(?m)^(?:-{3,}|\*{3,})\s*$",
    "footnotes": r"\[\^[^\]]+\]",
    "formulas": r"\$[^$\n]+\$",
}


def structure(text: Column) -> dict[str, Column]:
    """Counts of structural marks, and the number of lines."""
    counts = {name: F.regexp_count(text, F.lit(pattern)).cast("long") for name, pattern in STRUCTURE.items()}
    return counts | {"lines": (F.regexp_count(text, F.lit("\n")) + 1).cast("long")}


def without_marks(line: Column) -> Column:
    """A Markdown line without its leading mark and its emphasis."""
    return _chain(line, (r"^\s*(?:#{1,6}|>|[-*+]|\d+\.)\s+", ""), (r"(\*\*|__|~~|`)(.+?)\1", "$2"))


def token_set(text: Column) -> Column:
    """The different words of more than one character of a text without front matter, in lower case."""
    words = F.regexp_extract_all(F.lower(without_front_matter(text)), F.lit(r"(?U)\w{2,}"), F.lit(0))
    return F.array_distinct(words)


def line_set(text: Column) -> Column:
    """The different lines of more than three characters, without marks."""
    lines = F.transform(F.split(without_front_matter(text), r"\r?\n"), lambda x: F.trim(without_marks(x)))
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) > 3))


def mostly_wide(payload: Column) -> Column:
    """Whether three tenths of at least sixteen bytes are beyond ASCII."""
    total = F.octet_length(payload)
    narrow = F.length(F.regexp_replace(F.hex(payload), "([89A-F][0-9A-F])|([0-7][0-9A-F])", "$2")) / 2
    return (total >= 16) & ((total - narrow) >= 0.3 * total)


def style_level(name: Column) -> Column:
    """The level of a heading style: Heading 2, 제목 2, 개요 2 as 2; else null."""
    return F.regexp_extract(name, r"(?i)^(?:heading|제목|개요)\s*([1-9])$", 1).try_cast("int")
