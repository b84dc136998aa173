"""Exact token counts per document, and totals by slice.

Method: oversized documents are cut only where the tokenizer provably starts a new piece, the
chunks are salted across workers, exact chunk counts are summed per document, and slices are
rolled up from those.

Why a cut is exact: every alternative of the byte-level pattern takes a space only as its first
character or inside a run of white space, so no match holds a non-space followed by white space;
and the only look-ahead, (?!\\S), is tried at the end of such a run. A position between a
non-space and a white-space character is therefore always a match boundary, whatever surrounds
it. The same fact lets a worker count each stretch "white space + word" once and remember it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import sizes

TOKENIZER = os.environ.get("DOCWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# The published split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters above which a document is cut, and kept counts per worker.
CHUNK_CHARS, MEMO = 32_768, 200_000
_SPACE = sizes.WHITESPACE
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("docweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Segment -> tokens, filled as asked for; emptied when it holds MEMO segments."""

    def __init__(self, path: str):
        self.encode = _encoding(path).encode_ordinary

    def __missing__(self, segment: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = len(self.encode(segment))
        if len(segment) < 64:
            self[segment] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _SEGMENT.findall(text)))


def _counting(path: str):
    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield pd.Series([None if t is None else counter.count(t) for t in texts], dtype="Int64")

    return tokens


def independent_chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """text as an array of chunks of at most limit characters that tokenize independently; a stretch
    without any white space stays whole however long, as no cut in it is proven."""
    edge = f"(?<=[^{_SPACE}])(?=[{_SPACE}])"
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{limit}}}\z|.{{1,{limit}}}{edge}|.+?{edge}|.+"), F.lit(0))


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, limit: int = CHUNK_CHARS, keep: Sequence[str] = ()) -> DataFrame:
    """(key, tokens, then the columns of keep) for every row of df; key must be unique.

    tokenizer is the path of a byte-level rank file, or "estimate" for the project's own size
    (exact as well: its three counters are summed over the chunks before rounding). Null text gives
    null, empty text 0. Other columns of df aren't looked at.
    """
    rows = df.select(F.col(key), *[F.col(k).alias(f"_kept_{k}") for k in keep], F.col(text).alias("_text"))
    kept = [f"_kept_{k}" for k in keep]
    if tokenizer == "estimate":
        count = sizes.size_units(F.col("_text"))
    else:
        count = _counting(tokenizer)(F.col("_text"))
    # Null is neither short nor long: coalesce sends it to the first branch.
    long = F.coalesce(F.length("_text") > limit, F.lit(False))
    short = rows.filter(~long).select(key, *kept, count.alias("tokens"))
    chunks = rows.filter(long).select(key, *kept, F.posexplode(independent_chunks(F.col("_text"), limit)).alias("_no", "_text"))
    salted = chunks.repartition(F.xxhash64(key, "_no"))
    summed = salted.select(key, *kept, count.alias("tokens")).groupBy(key).agg(*[F.first(k).alias(k) for k in kept], F.sum("tokens").alias("tokens"))
    both = short.unionByName(summed)
    tokens = F.floor(F.col("tokens") / 12).cast("long") if tokenizer == "estimate" else F.col("tokens")
    return both.select(key, tokens.alias("tokens"), *[F.col(f"_kept_{k}").alias(k) for k in keep])


# Spellings of a language (fixed values); anything else stays as it is, in lower case.
LANGUAGES = {"kor": "ko", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr"}


def canonical_language(lang: Column) -> Column:
    """ko-KR, KO and kor as ko; null and blank as null."""
    short = F.nullif(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]+)", 1), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, short), short)


def canonical_source(source: Column) -> Column:
    """Lower case, trimmed, with _ for blanks and hyphens; null and blank as null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_"), F.lit(""))


def token_budget(counts: DataFrame, slices: Sequence[str]) -> DataFrame:
    """Documents and tokens by every combination of slices, with subtotals and the grand total.

    level is Spark's grouping id: 0 where all slices are given. Documents without text count as
    documents with no tokens.
    """
    return (
        counts.rollup(*slices)
        .agg(F.grouping_id().alias("level"), F.count("*").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        .select(*slices, "level", "documents", "tokens")
    )


def misstated_counts(chunks: DataFrame, slack: int = 5, share: float = 0.1) -> DataFrame:
    """chunk_id of the rows whose token_count is null, negative, or off the size of their content by
    more than slack and more than share of that size. Null content has size 0."""
    sized = token_counts(chunks, "chunk_id", "content", "estimate", keep=["token_count"])
    size = F.coalesce("tokens", F.lit(0))
    off = F.abs(F.col("token_count") - size)
    wrong = F.col("token_count").isNull() | (F.col("token_count") < 0) | ((off > slack) & (off > share * size))
    return sized.filter(wrong).select("chunk_id")
