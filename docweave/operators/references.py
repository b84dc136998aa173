"""Authored references to resources, ![[name:preset | attributes]], and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The authored forms.
REFERENCE = r"!\[\[([^:|\]]+)(?::([^|\]]+))?(?:\s*\|\s*([^\]]+))?\]\]"
ATTRIBUTE = r"(\w+)(?:=(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?"


def attributes(text: Column) -> Column:
    """key=value, key="value" and key as a map; a key alone is "true", a repeated key keeps its last value."""
    part = lambda i: F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(i))
    rows = F.transform(
        F.arrays_zip(part(1).alias("k"), part(2).alias("a"), part(3).alias("b"), part(4).alias("c")),
        lambda x: F.struct(x["k"].alias("k"), F.when(F.concat(x["a"], x["b"], x["c"]) == "", "true").otherwise(F.concat(x["a"], x["b"], x["c"])).alias("v")),
    )
    last = F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.coalesce(last, F.array().cast("array<struct<k:string,v:string>>")))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, kind, value, name, preset, attributes): the text between references and the references, in order."""
    marked = F.regexp_replace(F.col(text), r"(!\[\[[^\]]+\]\])", "\u0001$1\u0001")
    rows = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.filter(F.split(marked, "\u0001"), lambda p: p != "")).alias("seq", "value"))
    is_reference = F.col("value").rlike(f"^{REFERENCE}$")
    group = lambda i: F.when(is_reference, F.nullif(F.trim(F.regexp_extract("value", REFERENCE, i)), F.lit("")))
    return rows.select(key, "seq", F.when(is_reference, "reference").otherwise("text").alias("kind"), "value", group(1).alias("name"), group(2).alias("preset"), F.when(is_reference, attributes(F.regexp_extract("value", REFERENCE, 3))).alias("attributes"))


def resolved(found: DataFrame, resources: DataFrame) -> DataFrame:
    """found with src of the resource (name, type, src) of that name; references without one keep null."""
    return found.join(resources.select("name", F.col("type").alias("resource_type"), "src"), "name", "left")


def absolute(src: Column, base: str) -> Column:
    """Relative paths below base; addresses, data and absolute paths as they are."""
    return F.when(src.rlike(r"^(?:[a-z][a-z0-9+.-]*:|/)"), src).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(src, r"^\./", "")))
