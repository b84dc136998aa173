"""Form fields: labels, values, their types, and values in other formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a value looks like, then what a label says, in order.
VALUE_TYPES = (
    ("idnum", r"^\d{6}[-\s]?[1-4]\d{6}$"),
    ("date", r"^\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}\s*일?\s*\.?$"),
    ("phone", r"^0\d{1,2}[-.)\s]?\d{3,4}[-.\s]?\d{4}$"),
    ("email", r"^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$"),
    ("amount", r"^[\d,.\s]+(?:원|명|건|개|회|부|매|%)$|^\d{1,3}(?:,\d{3})+$"),
    ("checkbox", r"[□☑✓✔]"),
)
LABEL_TYPES = (
    ("idnum", r"주민등록번호|외국인등록번호"),
    ("date", r"생년월일|일시|날짜|일자|기간|연월일|년월일|신청일|작성일|발급일|접수일"),
    ("phone", r"전화|연락처|휴대폰|핸드폰|팩스"),
    ("email", r"(?i)이메일|전자우편|email"),
    ("amount", r"금액|단가|수량|합계|소계|예산|비용|인원|급여|연봉"),
)
# Fixed values as well: a field within a line, what asks for a value, what is blank, and what a label never is.
INLINE = r"(?m)^[ \t]*([가-힣A-Za-z][가-힣A-Za-z0-9() \t]{0,20}?)[ \t]*[:：][ \t]*(.*)$"
REQUIRED = r"[*※★]|[(（]\s*필수\s*[)）]"
BLANK = r"^[\s_()（）\-—–~.·,]*$"
# Two-digit years up to this one are of this century.
PIVOT = 29


def field_type(label: Column, value: Column) -> Column:
    found = F.lit(None).cast("string")
    for subject, rules in ((F.trim(value), VALUE_TYPES), (label, LABEL_TYPES)):
        for name, pattern in rules:
            found = F.coalesce(found, F.when(F.coalesce(subject.rlike(pattern), F.lit(False)), F.lit(name)))
    return F.coalesce(found, F.lit("text"))


def is_required(label: Column) -> Column:
    return label.rlike(REQUIRED)


def is_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(BLANK)


def plain_label(label: Column) -> Column:
    """Without colons, brackets, middle dots and white space, for comparing."""
    return F.lower(F.regexp_replace(label, r"(?U)[\s:：()（）·ㆍ*※★]+", ""))


def is_label(cell: Column) -> Column:
    """A short cell that names something: compact Hangul of 2 to 12 signs, words before a colon, or a few
    English words; no numbers, no sentence."""
    text = F.trim(cell)
    compact = F.regexp_replace(text, r"\s+", "")
    hangul = compact.rlike(r"^[가-힣0-9()（）·:：\-]+$") & compact.rlike("[가-힣]") & F.length(compact).between(2, 12)
    other = text.rlike(r"^[가-힣A-Za-z\s]+[:：]$") | (text.rlike(r"^[A-Za-z][A-Za-z\s./&-]*$") & (F.length(text) <= 30))
    sentence = text.rlike(r"(?:다|요|음|함)\.?$") & (F.length(compact) > 6)
    return (hangul | other) & ~sentence & ~text.rlike(r"^[\d,.\s-]+$")


def inline_fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, value, type, required, empty) of the lines "label: value" of a text, in order of seq."""
    labels = F.regexp_extract_all(F.col(text), F.lit(INLINE), F.lit(1))
    values = F.regexp_extract_all(F.col(text), F.lit(INLINE), F.lit(2))
    rows = df.filter(F.col(text).rlike("[:：]")).select(key, F.posexplode(F.arrays_zip(labels.alias("label"), values.alias("value"))).alias("seq", "f"))
    label, value = F.col("f.label"), F.trim("f.value")
    return rows.select(key, "seq", label.alias("label"), value.alias("value"), field_type(label, value).alias("type"), is_required(label).alias("required"), is_blank(value).alias("empty"))


def _table_fields(cells: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key, "table_no", "row_no").orderBy("col_no")
    rows = cells.withColumn("value", F.lead("text").over(w))
    fields = rows.filter(is_label(F.col("text")) & F.col("value").isNotNull() & ~is_label(F.col("value")))
    return fields.select(key, "table_no", F.trim("text").alias("label"), F.trim("value").alias("value"), "row_no", "col_no", field_type(F.col("text"), F.col("value")).alias("type"))


def table_fields(cells: DataFrame, key: str) -> DataFrame:
    """(key, label, value, row_no, col_no, type) of cells (key, table_no, row_no, col_no, text): each label cell with
    the cell to its right, if that is no label."""
    return _table_fields(cells, key).drop("table_no")


def match_labels(labels: DataFrame, keys: DataFrame) -> DataFrame:
    """(label, key) of form labels and given keys: equal in plain form, or one begins with the other at three
    fifths (key in label) or three quarters (label in key) of its length; the longest key, then the least.

    The prefixes of either side are made equal keys, so that nothing is compared with everything.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    a = labels.select("label", plain_label(F.col("label")).alias("l")).filter("l <> ''").distinct()
    b = keys.select("key", plain_label(F.col("key")).alias("k")).filter("k <> ''").distinct()
    within = a.select("label", "l", F.explode(prefixes(F.col("l"))).alias("k")).join(b, "k").filter(F.length("k") >= 0.6 * F.length("l"))
    around = b.select("key", "k", F.explode(prefixes(F.col("k"))).alias("l")).join(a, "l").filter(F.length("l") >= 0.75 * F.length("k"))
    both = within.select("label", "key", "k", "l").unionByName(around.select("label", "key", "k", "l"))
    best = F.max(F.struct((F.col("k") == F.col("l")).alias("same"), F.length("k").alias("n"), (-F.crc32("key")).alias("t"), "key"))
    return both.groupBy("label").agg(best.alias("b")).select("label", "b.key")


def unmatched(keys: DataFrame, matches: DataFrame) -> DataFrame:
    return keys.join(matches.select("key"), "key", "left_anti")


def phone_format(value: Column, style: str) -> Column:
    """A Korean phone number with dashes, dots, spaces or digits only; other values stay as they are."""
    digits = F.regexp_replace(value, r"\D", "")
    mark = {"dash": "-", "dot": ".", "space": " ", "digits": ""}[style]
    return F.when(digits.rlike(r"^0\d{8,10}$"), F.regexp_replace(digits, r"^(02|0\d{2})(\d{3,4})(\d{4})$", f"$1{mark}$2{mark}$3")).otherwise(value)


def filled_mask(value: Column, pattern: str) -> Column:
    """The digits of value in the places marked # in pattern, if there are as many; else value."""
    digits = F.regexp_replace(value, r"\D", "")
    places = pattern.count("#")
    parts, n = [], 0
    for c in pattern:
        n += c == "#"
        parts.append(F.substring(digits, n, 1) if c == "#" else F.lit(c))
    return F.when(F.length(digits) == places, F.concat(*parts)).otherwise(value)


def loose_date(value: Column) -> Column:
    """Any date of three numbers in the order year, month, day, as yyyy-MM-dd: 2024. 3. 5, 24/03/05, 20240305, 2024년
    3월 5일. Two-digit years up to PIVOT are of this century. Null where the day doesn't exist."""
    digits = F.regexp_replace(value, r"\D", "")
    plain = value.rlike(r"^\s*\d+\s*$")
    parts = [F.when(plain & (F.length(digits) == 8), F.substring(digits, a, n)).when(plain & (F.length(digits) == 6), F.substring(digits, b, 2)).otherwise(F.regexp_extract(value, r"^\D*(\d{4}|\d{2})\D+(\d{1,2})\D+(\d{1,2})\D*$", i)) for i, (a, n, b) in enumerate(((1, 4, 1), (5, 2, 3), (7, 2, 5)), 1)]
    year = F.when(F.length(parts[0]) == 2, F.concat(F.when(parts[0].try_cast("int") <= PIVOT, "20").otherwise("19"), parts[0])).otherwise(parts[0])
    text = F.concat_ws("-", year, *[F.lpad(p, 2, "0") for p in parts[1:]])
    return F.when(text.try_cast("date").isNotNull(), text)


def date_format(value: Column, style: str) -> Column:
    """A loose date in a template of yyyy, yy, mm, m, dd, d; other values stay as they are."""
    iso = loose_date(value)
    year, month, day = (F.substring(iso, a, n) for a, n in ((1, 4), (6, 2), (9, 2)))
    short = lambda c: F.regexp_replace(c, "^0", "")
    made = {"yyyy": year, "yy": F.substring(year, 3, 2), "mm": month, "m": short(month), "dd": day, "d": short(day)}
    parts = [made.get(p.lower(), F.lit(p)) for p in re.split(r"((?i:yyyy|yy|mm|m|dd|d))", style) if p]
    return F.coalesce(F.concat(*parts), value)


def resident_format(value: Column, style: str) -> Column:
    """A resident's number with its dash, as digits, its front half, or masked; other values stay as they are."""
    digits = F.regexp_replace(value, r"\D", "")
    front, back = F.substring(digits, 1, 6), F.substring(digits, 7, 7)
    made = {"dash": F.concat_ws("-", front, back), "digits": digits, "front": front, "masked": F.concat(front, F.lit("-"), F.substring(back, 1, 1), F.lit("******"))}[style]
    return F.when(F.length(digits) == 13, made).otherwise(value)


def fill_format(value: Column, how: str | None) -> Column:
    """value as how says: date:TEMPLATE, phone:STYLE, idnum:STYLE, mask:PATTERN. What isn't known leaves it as it is."""
    kind, _, style = (how or "").partition(":")
    try:
        return {"date": date_format, "phone": phone_format, "idnum": resident_format, "mask": filled_mask}[kind](value, style)
    except KeyError:
        return value


def form_summary(cells: DataFrame, inline: DataFrame, key: str) -> DataFrame:
    """(key, fields, form_tables, tables, confidence) of a document's cells and inline fields: the share of its tables that have
    fields, .3 where only lines do, 0 without any."""
    found = _table_fields(cells, key)
    fields = found.select(key, "label").withColumn("_in", F.lit(1))
    tables = cells.groupBy(key).agg(F.countDistinct("table_no").alias("tables"))
    formed = found.groupBy(key).agg(F.countDistinct("table_no").alias("form_tables"))
    counted = fields.unionByName(inline.select(key, "label").withColumn("_in", F.lit(0))).groupBy(key).agg(F.count("*").alias("fields"), F.max("_in").alias("_in"))
    joined = counted.join(tables, key, "full").join(formed, key, "left").na.fill(0, ["fields", "tables", "form_tables"])
    share = F.when(F.col("form_tables") > 0, F.col("form_tables") / F.col("tables")).when(F.col("fields") > 0, F.lit(0.3)).otherwise(F.lit(0.0))
    return joined.select(key, "fields", "form_tables", "tables", share.alias("confidence"))


def form_schema(cells: DataFrame, inline: DataFrame, key: str) -> DataFrame:
    """(key, label, value, type, required, empty): the fields of tables, and those of lines whose label no table has."""
    t = table_fields(cells, key)
    shown = t.select(key, "label", "value", "type", is_required(F.col("label")).alias("required"), is_blank(F.col("value")).alias("empty"))
    known = shown.select(key, plain_label(F.col("label")).alias("_plain")).distinct()
    more = inline.withColumn("_plain", plain_label(F.col("label"))).join(known, [key, "_plain"], "left_anti")
    return shown.unionByName(more.select(key, "label", "value", "type", "required", "empty"))
