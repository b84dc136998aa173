"""Cutting oversized items into overlapping pieces at natural boundaries.

Method: a bounded-quantifier regular expression consumes up to the limit, its alternatives ordered
by the strength of the boundary they end at (end of text, blank line, line, sentence, word), with a
single character as fallback. Sizes are weighted, and a quantifier only counts characters, so the
expression runs over a shadow of the text: each character that weighs something is there with as many
fillers as it takes to make its twelfths of a token, and the others, which weigh nothing, aren't there at
all. An element of the text is a character that weighs something with the weightless signs at it; cuts and
the look-back that supplies the overlap are counts of elements in the shadow, which a quantifier over the text
itself turns into offsets.

Very long items are first cut into blocks at their strongest boundaries, so that no fold or array
grows with an item and one item's blocks are the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import sizes
from docweave.functions import text as X

LIMIT, OVERLAP = 512, 50
#: Characters of a block. A block's end is a piece's end.
BLOCK = 32_768
#: Characters before a block that are looked at for its overlap; more where they don't hold enough tokens.
CONTEXT = 2_048

_WS = sizes.WHITESPACE
# Control characters, of a byte each, that stand for the end of a sentence and for the rest of a character's weight.
_END, _FILL = "\x01", "\x02"
_MARKS = r"\x01\x02"
_HEAVY = f"가-힣A-Za-z0-9{_WS}"
_ENDS = r"[.!?。！？．…][\"'”’)\]」]?"


_HEAVY_RANGES = [(0x09, 0x0D), (0x20, 0x20), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xAC00, 0xD7A3)]
_LIGHT = X.other_characters(*_HEAVY_RANGES)
_LIGHT_NO_MARK = X.other_characters(*_HEAVY_RANGES, (0x01, 0x02))
#: One element: light signs after white space and at the start go with the next character, others with the one before.
_ELEMENT = rf"(?:{_LIGHT}*+[가-힣A-Za-z0-9]{_LIGHT}*+|{_LIGHT}*+[{_WS}])"


def shadow(text: Column) -> Column:
    """Every syllable with seven fillers, every ASCII letter, digit or white space with two, nothing else. Where a sentence
    ends, a mark takes the place of the last filler."""
    out = F.regexp_replace(text, f"[{_MARKS}]", "*")
    out = F.regexp_replace(out, rf"{_ENDS}(?=[{_WS}])", _END)
    out = F.regexp_replace(out, f"{_LIGHT_NO_MARK}+", "")
    for kind, fill in (("가-힣", 7), (f"A-Za-z0-9{_WS}", 2)):
        out = F.regexp_replace(out, f"[{kind}]", "$0" + _FILL * fill)
    return F.regexp_replace(F.replace(out, F.lit(_FILL + _END), F.lit(_END)), f"^{_END}", "")


def boundary_pattern(units: int) -> str:
    """Alternatives by strength. Each asks for a share of the limit at least, so that neither a heading
    nor the only word before a long unspaced run becomes a piece of its own."""
    half, f2 = units // 2, _FILL * 2
    take = lambda least, end: rf".{{{least},{units - end}}}"
    alternatives = [
        rf".{{1,{units}}}+\z",
        take(half, 9) + rf"\n{f2}(?:\r{f2})?\n{f2}",
        take(half, 3) + rf"\n{f2}",
        take(half, 4) + rf"{_END}[{_WS}]{f2}",
        take(units // 8, 3) + rf"[{_WS}]{f2}",
        take(1, 0) + rf"(?![{_MARKS}])",
    ]
    return "(?s)" + "|".join(f"(?:{a})" for a in alternatives)


def blocks(text: Column) -> Column:
    """text in blocks of BLOCK characters at most, cut at a blank line, a line end or white space if there
    is one in the second half."""
    take = lambda end: rf".{{{BLOCK // 2},{BLOCK - end}}}"
    ends = [rf".{{1,{BLOCK}}}+\z", take(3) + r"\n\r?\n", take(1) + r"\n", take(1) + rf"[{_WS}]", rf".{{1,{BLOCK}}}"]
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join(f"(?:{e})" for e in ends)), F.lit(0))


def _count(marks: Column) -> Column:
    return F.length(F.replace(F.replace(marks, F.lit(_FILL), F.lit("")), F.lit(_END), F.lit("")))


def _lookback(tail: Column) -> Column:
    """How many elements the last marks of a text belong to; one may begin before them and end within."""
    return _count(tail) + F.startswith(tail, F.lit(_FILL)).cast("int")


def _leading(text: Column, n: Column) -> Column:
    """The first n elements of text."""
    return F.call_function("regexp_extract", text, F.concat(F.lit(f"^{_ELEMENT}{{"), n.cast("string"), F.lit("}+")), F.lit(0))


def _ending(text: Column, n: Column) -> Column:
    """text without its first n elements."""
    return F.when(n == 0, text).otherwise(F.transform(F.array(F.length(_leading(text, n))), lambda k: F.substring(text, k + 1, F.length(text)))[0])


def _offsets(text: Column, indices: Column) -> Column:
    """How many characters of text the first n elements are, for each n of indices, which ascend from 0."""
    state = F.struct(text.alias("rest"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("offsets"))

    def step(s: Column, index: Column) -> Column:
        taken = F.when(index == s["n"], 0).otherwise(F.length(_leading(s["rest"], index - s["n"])))
        offset = lambda k: k + F.coalesce(F.try_element_at(s["offsets"], F.lit(-1)), F.lit(0))
        done = lambda k: F.struct(F.substring(s["rest"], k + 1, F.length(s["rest"])).alias("rest"), index.alias("n"), F.concat(s["offsets"], F.array(offset(k))).alias("offsets"))
        return F.transform(F.array(taken), done)[0]

    return F.aggregate(indices, state, step)["offsets"]


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often they are used afterwards."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, one.alias("_w")).select(*kept, *[F.col(f"_w.{n}").alias(n) for n in columns])


def split_blocks(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, block_no, pieces) of the items of df larger than limit; smaller ones and nulls are left out.

    pieces is an array of structs (start, core, stop, piece); offsets count characters of the item from 0. Each piece runs from start
    to stop; core is where its own part begins, so stop of a piece is core of the next, and start..core repeats the
    overlap: the shortest text before core that has overlap tokens, or all of it. Sizes never exceed limit.
    """
    item = df.select(F.col(key).alias("row_id"), F.col(text).alias("_text"), sizes.estimated_tokens(F.col(text)).alias("_size"))
    big = _with(item.filter(F.col("_size") > limit).select("row_id", "_text"), _blocks=blocks(F.col("_text"))).drop("_text")
    big = _with(big, _sizes=F.transform("_blocks", F.length))
    before = lambda i: F.element_at("_blocks", i)  # noqa: E731  (the block before the one at i, which counts from 0)
    enough = lambda t: sizes.estimated_tokens(t) >= overlap
    near = lambda i: F.right(before(i), F.lit(CONTEXT))
    context = lambda i: F.when(i == 0, "").when(enough(near(i)), near(i)).when(enough(before(i)), before(i)).otherwise(F.array_join(F.slice("_blocks", 1, i), ""))
    offset = lambda i: F.aggregate(F.slice("_sizes", 1, i), F.lit(0), lambda n, k: n + k)
    parts = F.transform("_blocks", lambda b, i: F.struct(b.alias("text"), context(i).alias("context"), offset(i).alias("at")))
    # Items lie unevenly, and a long one has many blocks: spread them before the work.
    spread = big.select("row_id", F.posexplode(parts).alias("block_no", "b")).repartition("row_id", "block_no")
    ready = spread.select("row_id", "block_no", F.col("b.text").alias("_text"), F.col("b.context").alias("_context"), F.col("b.at").alias("_at"))
    ready = _with(ready, _marks=shadow(F.col("_text")), _before=shadow(F.col("_context")))
    most = limit * 12 + 11
    rest = most - overlap * 12 - 7  # what a look-back leaves
    first = F.regexp_extract("_marks", f"^(?:{boundary_pattern(most)})", 0)
    cores = lambda marks: F.regexp_extract_all(marks, F.lit(boundary_pattern(rest)), F.lit(0))
    # Nothing is before the first piece, so it may be larger by the overlap.
    opening = F.concat(F.array(first), cores(F.substring(F.col("_marks"), F.length(first) + 1, F.length("_marks"))))
    ready = _with(
        ready,
        _cores=F.when(F.col("_marks") == "", F.array().cast("array<string>")).when(F.col("_context") == "", opening).otherwise(cores(F.col("_marks"))),
    )
    # Of every core: where its marks end, and how many elements are before it in the block.
    empty = F.array().cast("array<struct<marks:int,first:int,n:int>>")
    last = lambda done, field: F.coalesce(F.try_element_at(done, F.lit(-1))[field], F.lit(0))
    step = lambda done, core: F.concat(
        done,
        F.array(F.struct((last(done, "marks") + F.length(core)).alias("marks"), (last(done, "first") + last(done, "n")).alias("first"), _count(core).alias("n"))),
    )
    # A block of weightless signs alone is one piece.
    whole = F.array(F.struct(F.lit(0).alias("marks"), F.lit(0).alias("first"), F.lit(0).alias("n")))
    bounds = F.when(F.size("_cores") == 0, whole).otherwise(F.aggregate("_cores", empty, step))
    # Step by step, so that nothing is computed twice for a piece: the last marks before it, the elements they are.
    need = overlap * 12
    last_marks = lambda marks: F.replace(F.substring(marks, -need, need), F.lit(_END), F.lit(_FILL))
    end = lambda i: F.when(i == 0, 0).otherwise(F.element_at("_bounds", i)["marks"])
    near = lambda e: F.substring(F.col("_marks"), F.greatest(e - need, F.lit(0)) + 1, F.least(e, F.lit(need)))
    ready = _with(ready, _bounds=bounds, _just_before=last_marks(F.col("_before")), _lead=_count(F.col("_before")))
    ready = _with(ready, _ends=F.transform("_bounds", lambda b, i: end(i)))
    ready = _with(ready, _backs=F.transform(F.transform("_ends", lambda e: last_marks(F.concat(F.col("_just_before"), near(e)))), _lookback))
    ready = ready.select("row_id", "block_no", "_at", "_text", "_context", "_lead", "_backs", F.col("_bounds.first").alias("_firsts"))
    back = lambda i: F.element_at("_backs", i + 1)
    ready = _with(ready, _starts=F.transform("_firsts", lambda f, i: F.greatest(f - back(i), F.lit(0))), _borrowed=F.transform("_firsts", lambda f, i: F.greatest(back(i) - f, F.lit(0))))
    ready = _with(ready, _indices=F.array_sort(F.array_distinct(F.concat("_firsts", "_starts"))))
    ready = _with(ready, _offsets=_offsets(F.col("_text"), F.col("_indices")), _shares=F.transform("_borrowed", lambda n: F.when(n == 0, "").otherwise(_ending(F.col("_context"), F.col("_lead") - n))))
    at = lambda index: F.element_at("_offsets", F.array_position("_indices", index).cast("int"))
    stop = lambda i: F.when(i == F.size("_firsts") - 1, F.length("_text")).otherwise(at(F.element_at("_firsts", i + 2)))
    ready = _with(ready, _places=F.transform("_firsts", lambda f, i: F.struct(at(F.element_at("_starts", i + 1)).alias("start"), at(f).alias("core"), stop(i).alias("stop"), F.element_at("_shares", i + 1).alias("share"))))
    piece = lambda p: F.struct(
        (F.col("_at") + p["start"] - F.length(p["share"])).alias("start"),
        (F.col("_at") + p["core"]).alias("core"),
        (F.col("_at") + p["stop"]).alias("stop"),
        F.concat(p["share"], F.substring(F.col("_text"), p["start"] + 1, p["stop"] - p["start"])).alias("piece"),
    )
    return ready.select("row_id", "block_no", F.transform("_places", piece).alias("pieces"))


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """row_id of every item that is cut into several pieces."""
    counted = split_blocks(df, key, text, limit, overlap).groupBy("row_id").agg(F.sum(F.size("pieces")).alias("n"))
    return counted.filter("n > 1").select("row_id")


def pieces_of(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of an oversized item: row_id, piece_no from 1, start, stop, n_tokens, piece."""
    earlier = F.sum(F.size("pieces")).over(Window.partitionBy("row_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1))
    numbered = split_blocks(df, key, text, limit, overlap).withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
    exploded = numbered.select("row_id", "_earlier", F.posexplode("pieces").alias("no", "p"))
    return exploded.select(
        "row_id",
        (F.col("_earlier") + F.col("no") + 1).cast("int").alias("piece_no"),
        F.col("p.start").alias("start"),
        F.col("p.stop").alias("stop"),
        sizes.estimated_tokens(F.col("p.piece")).alias("n_tokens"),
        F.col("p.piece").alias("piece"),
    )
