"""Text that looks the same but is written with different characters.

Method: values are mapped to a look-alike skeleton, the skeletons are grouped in SQL under the
accent- and case-sensitive Unicode collation, each class gets a deterministic canonical member, and
that is joined back to the rows.

Grouped are the skeletons of all rows that the mapping altered, and all that hold a character outside
PLAIN. A skeleton of PLAIN characters only that no row was altered to is a class of its own: under the
collation, two texts of such characters are equal only if they are the same. So its text needn't be
shuffled to find that out. Rows meet their class by digest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.functions import text as X
from docweave.llm import encoding as E

# Letters that look like Latin ones (fixed values): Cyrillic, then Greek.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYXaesijopcyxhdqwv", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγτ", "ABEZHIKMNOPTYXaiKvopuxyt".replace("aiK", "aik"), strict=True))
_ARMENIAN = dict(zip("ՍՕօհոսցյզԼ", "UOohnugjqL", strict=True))
_CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎩ", "ABCDEGHiJKLMPRSTVWZY", strict=True))
LETTERS = _CYRILLIC | _GREEK | _ARMENIAN | _CHEROKEE


def _class(*ranges: int | tuple[int, int]) -> str:
    """The body of a character class, escaped so that Java and Python read it alike."""
    return "".join(f"\\u{r:04x}" if isinstance(r, int) else f"\\u{r[0]:04x}-\\u{r[1]:04x}" for r in ranges)


_INVISIBLE = _class(
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), 0xAD, 0x34F, (0x115F, 0x1160), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), 0x3164, (0xFE00, 0xFE0F), 0xFEFF, 0xFFA0
)
_SPACES = _class(0xA0, 0x1680, (0x2000, 0x200A), 0x202F, 0x205F, 0x3000)
_WIDTHS = _class((0xFF01, 0xFF5E), (0xFF61, 0xFF9F), (0xFFA1, 0xFFDC), (0xFFE0, 0xFFE6))
_PAIRS = _class((0xFB00, 0xFB06), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3))
_IDEOGRAPHS = _class((0x2F00, 0x2FD5), (0xF900, 0xFAFF))
# Letters in another style: mathematical ones, and those among the letterlike signs that are said to be one.
_STYLES = "".join(chr(c) for c in range(0x2100, 0x2150) if unicodedata.decomposition(chr(c)).startswith("<font>"))
# Combining accents, conjoining consonants and vowels, and the two letters that are signs as well.
_PARTS = _class((0x300, 0x36F), (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), 0x212A, 0x212B)
_ANY_LETTER = "".join(LETTERS)
#: Characters that tell any two texts of them apart under the collation, and need no look.
_PLAIN_RANGES = ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF), (0x2010, 0x2027), (0x2460, 0x2473), (0x300C, 0x300F), (0xAC00, 0xD7A3))
PLAIN = _class(*_PLAIN_RANGES)
_NOT_PLAIN = X.other_characters(*_PLAIN_RANGES)
#: Rows without any of these are their own skeleton, without a look in Python.
SUSPECT = f"[{_INVISIBLE}{_SPACES}{_WIDTHS}{_PAIRS}{_IDEOGRAPHS}{_PARTS}{_ANY_LETTER}]|[\\x{{2f800}}-\\x{{2fa1f}}]"

_DROP = re.compile(f"[{_INVISIBLE}]")
_SPACE = re.compile(f"[{_SPACES}]")
_COMPAT = re.compile(f"[{_WIDTHS}{_PAIRS}{_IDEOGRAPHS}{_STYLES}\U0001d400-\U0001d7ff]+")
_COMPOSE = re.compile(f"[{_PARTS}\U0002f800-\U0002fa1f]|[{_IDEOGRAPHS}]")
# Greek, Cyrillic, Armenian, Cherokee.
_ALPHABETS = ((0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x58F), (0x13A0, 0x13F5))
_WORD = re.compile(f"[A-Za-z{_class((0xC0, 0x24F), *_ALPHABETS)}]+")
_FOREIGN = re.compile(f"[{_class(*_ALPHABETS)}]")


def _latin_word(match: re.Match) -> str:
    """A word with Latin letters has its look-alikes of other alphabets replaced, if all of its foreign letters are such."""
    word = match.group()
    foreign = _FOREIGN.findall(word)
    if not foreign or len(foreign) == len(word) or any(c not in LETTERS for c in foreign):
        return word
    return "".join(LETTERS.get(c, c) for c in word)


def skeleton(text: str) -> str:
    """text in plain characters: no invisible ones, plain spaces and widths, letter pairs and syllables
    composed as usual, unified ideographs, no foreign letters inside Latin words. Signs of their own
    (circled numbers, units, Roman numerals, fractions, brackets, quotes, dashes) stay as they are."""
    text = _SPACE.sub(" ", _DROP.sub("", text))
    text = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _COMPOSE.search(text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.sub(_latin_word, text) if _FOREIGN.search(text) else text


@F.pandas_udf(StringType())
def _skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else skeleton(t) for t in texts], dtype=object)


def skeletons(df: DataFrame, text: str) -> DataFrame:
    """df with column skeleton. Only texts with a suspect character are sent to Python, as all others are null there."""
    value = F.col(text)
    # Most texts end at the first test, which is a plain range check per character.
    suspect = value.rlike(_NOT_PLAIN) & value.rlike(SUSPECT)
    return df.withColumn("skeleton", F.coalesce(_skeletons(F.when(suspect, value)), value))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def canonical_forms(mapped: DataFrame) -> DataFrame:
    """(digest of skeleton, canonical) for the skeletons of mapped (skeleton): the least member, in code points, of
    those that are equal under the collation UNICODE, which tells cases and accents apart."""
    members = mapped.filter(F.col("skeleton").isNotNull()).select("skeleton").distinct()
    classes = members.groupBy(F.collate("skeleton", "UNICODE").alias("_class")).agg(F.min("skeleton").alias("canonical"))
    joined = members.join(classes, F.collate(F.col("skeleton"), "UNICODE") == F.col("_class"))
    return joined.select(digest(F.col("skeleton")).alias("_digest"), "canonical")


def long_form(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, row_id, value)"""
    return runs.select(F.lit("text_runs").alias("table_name"), F.col("run_id").alias("row_id"), F.col("text").alias("value")).unionByName(
        chunks.select(F.lit("legal_chunks").alias("table_name"), F.col("chunk_id").alias("row_id"), F.col("content").alias("value"))
    )


def _mapped(values: DataFrame) -> DataFrame:
    """values with skeleton and mapped, whether that differs from the value."""
    return skeletons(values, "value").withColumn("mapped", F.coalesce(F.col("value") != F.col("skeleton"), F.lit(False)))


def _forms(mapped: DataFrame) -> DataFrame:
    return canonical_forms(mapped.filter(F.col("mapped") | F.col("skeleton").rlike(_NOT_PLAIN)))


def unified(values: DataFrame) -> DataFrame:
    """Every row of values with canonical, its text in the one consistent form, and altered, whether
    that differs in characters from what the row holds. Null stays null and isn't altered; empty text
    stays empty (text of invisible characters only becomes empty). Copies keep their rows."""
    mapped = _mapped(values)
    rows = mapped.withColumn("_digest", digest(F.col("skeleton"))).join(_forms(mapped), "_digest", "left")
    canonical = F.coalesce("canonical", "skeleton")
    altered = F.col("mapped") & F.coalesce(F.col("value") != canonical, F.lit(False))
    return rows.select("table_name", "row_id", canonical.alias("canonical"), altered.alias("altered"))


def lookalikes(values: DataFrame, model: E.Model | None = None) -> DataFrame:
    """(table_name, row_id, canonical) of the rows written with look-alike characters. Rows of text_runs
    that are garbled by wrong decoding aren't among them: their odd characters are no look-alikes. The model
    that tells them is trained on all text_runs unless one is given."""
    mapped = _mapped(values)
    model = model or E.train_on_all(values.filter(F.col("table_name") == "text_runs"), "value")
    run = F.when(F.col("table_name") == "text_runs", F.col("value"))
    garbled = F.coalesce(E.verdict_udf(model)(run)["garbled"], F.lit(False))
    candidates = mapped.filter("mapped").select("table_name", "row_id", "value", digest(F.col("skeleton")).alias("_digest"), garbled.alias("garbled")).filter(~F.col("garbled"))
    return candidates.join(_forms(mapped), "_digest").filter(F.col("value") != F.col("canonical")).select("table_name", "row_id", "canonical")
