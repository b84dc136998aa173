"""Test passages that appear in training text.

Method: rare n-gram seeds join documents to test items, and Smith-Waterman alignment scores the
pairs so found, edited copies included; an exact count of the words that stand in unbroken
stretches follows.

Both sides are brought to bare letters and digits (no case, accents, spacing, punctuation, markup
or other forms of characters). Every run of five words of an item is a window, and the first
characters of a window are its seed. Documents are read once: rolling hashes over whole batches
against two sieves of fixed size leave those positions at which a seed of some item may stand. They are
counted over the corpus and joined to the seeds of the items. A seed that several items share (an opening
instruction), or that is much more frequent in the corpus than its item's others, is no evidence and
is left out of the join, unless such seeds cover as much of the item as a leak needs: then the
item keeps all its seeds, so no pair is lost by the choice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut

#: Words of an unbroken stretch; the share of an item's words in such stretches that makes a leak; the score that
#: makes an edited copy.
RUN, SHARE, EDITED = 8, 0.4, 0.5
#: Words of a window, and the lengths of seeds; a window takes the greatest that fits into it.
SEED_WORDS, SEED_CHARS = 5, (24, 16, 12, 8)
#: A pair is aligned whose seeds cover that share of the item's words, or which may reach SHARE.
EVIDENCE = 0.3
#: A seed is common that stands in so many times as many places as the middle one of its item.
COMMON = 8
#: Parts into which the places of one seed, or the documents of one item, are spread.
SALT = 8
#: Bits of each of the two sieves. More seeds only let more places through; the join decides.
SIEVE = 1 << 24

# Letters of other alphabets that look like Latin ones (fixed values).
_TWINS = dict(zip("авеёзіјкмнорѕстухһԁԛԝαβεικνορτυχ", "abee3ijkmhopsctyxhdqwabeiknoptux", strict=True))
_MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]*>|</?[A-Za-z][A-Za-z0-9]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);|\]\([^()\s]+\)")
_OTHER = re.compile(r"[\W_]+")


def _plain_table() -> dict[int, str]:
    table = {ord(k): v for k, v in _TWINS.items()}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].casefold()
        if base != chr(code):
            table[code] = base
    return table


_PLAIN = _plain_table()
_ANY_PLAIN = re.compile(f"[{''.join(map(chr, _PLAIN))}]")
#: Characters hashed at a time, so that the arrays stay in a core's cache.
_SLAB = 100_000


def _folded(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
    text = text.casefold()
    return text.translate(_PLAIN) if _ANY_PLAIN.search(text) else text


def bare(text: str) -> str:
    """Letters and digits only, folded."""
    return _OTHER.sub("", _folded(text))


def bare_words(text: str) -> list[str]:
    return [w for w in (_OTHER.sub("", w) for w in _folded(text).split()) if w]


@dataclass
class Item:
    words: list[str]
    whole: str = field(init=False)
    at: list[int] = field(init=False)

    def __post_init__(self):
        self.whole = "".join(self.words)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).tolist()

    def windows(self, words: int = RUN) -> list[tuple[int, str]]:
        return [(i, self.whole[self.at[i] : self.at[i + words]]) for i in range(len(self.words) - words + 1)]


def _seed(window: str) -> str:
    return window[: next((k for k in SEED_CHARS if len(window) >= k), len(window))]


def _hash(seed: str) -> int:
    return xxhash.xxh64_intdigest(seed.encode("utf-8", "surrogatepass")) - (1 << 63)


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, words, seeds) with seeds (seed, length, word, offset, sieve slots) of the windows."""
    for batch in batches:
        rows = []
        for i, t in zip(batch["item_id"], batch["text"], strict=True):
            item = Item(bare_words(t))
            seeds = []
            if len(item.words) >= RUN:
                for word, window in item.windows(SEED_WORDS):
                    s = _seed(window)
                    slot = int(rolling(_codes(s), len(s))[0]) % SIEVE
                    seeds.append({"seed": _hash(s), "length": len(s), "word": word, "offset": item.at[word], "slot": slot})
            rows.append((i, item.words, seeds))
        yield pd.DataFrame(rows, columns=["item_id", "words", "seeds"])


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    marks = np.zeros((2, SIEVE), bool)
    lengths: set[int] = set()
    for batch in batches:
        marks[0, batch["slot"]] = True
        marks[1, batch["seed"] % SIEVE] = True
        lengths.update(batch["length"])
    if lengths:
        yield pd.DataFrame({"marks": [np.packbits(marks).tobytes()], "lengths": [sorted(lengths)]})


def _sieves(seeds: DataFrame) -> tuple[bytes, list[int]]:
    """The two sieves over all seeds, whose size is fixed, and the lengths of seeds (as many as SEED_CHARS has
    and a few short ones). A row of them for each partition goes to the driver, one at a time."""
    marks, lengths = np.zeros(2 * SIEVE // 8, np.uint8), set()
    for r in seeds.mapInPandas(_marked, "marks binary, lengths array<int>").toLocalIterator():
        marks |= np.frombuffer(r.marks, np.uint8)
        lengths.update(r.lengths)
    return marks.tobytes(), sorted(lengths)


def _places(sieves: bytes, lengths: list[int]):
    """Documents with a place where a seed may stand: doc_id, the bare text, places and hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.unpackbits(np.frombuffer(sieves, np.uint8)).view(bool).reshape(2, SIEVE)
        for batch in batches:
            texts = [bare(t) for t in batch["text"]]
            found: dict[int, tuple[list[int], list[int]]] = {}
            for n, p, h in _passing(texts, first, second, lengths):
                places, seeds = found.setdefault(n, ([], []))
                places.append(p)
                seeds.append(h)
            ids = batch["doc_id"].tolist()
            yield pd.DataFrame([(ids[n], texts[n], p, h) for n, (p, h) in sorted(found.items())], columns=["doc_id", "bare", "places", "seeds"])

    return run


def _passing(texts: list[str], first: np.ndarray, second: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(text no, place, hash) of the seeds' lengths that pass both sieves, many texts at a time."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < _SLAB):
            size += len(texts[end])
            end += 1
        joined = "\x01".join(texts[begin:end])
        codes = _codes(joined)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[begin:end]])])
        for k in lengths:
            if len(codes) < k:
                continue
            for p in np.flatnonzero(first[rolling(codes, k) & np.uint32(SIEVE - 1)]).tolist():
                h = _hash(joined[p : p + k])
                if second[h % SIEVE]:
                    n = int(np.searchsorted(starts, p, side="right")) - 1
                    yield begin + n, p - int(starts[n]), h
        begin = end


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of every k characters, by doubling."""
    base = 0x9E3779B1
    out, done, step, step_power = None, 0, codes + np.uint32(1), base
    width, bits = 1, k
    while bits:
        if bits & 1:
            if out is None:
                out = step
            else:
                n = len(step) - done
                out = out[:n] * np.uint32(step_power) + step[done : done + n]
            done += width
        bits >>= 1
        if bits:
            step = step[: len(step) - width] * np.uint32(step_power) + step[width:]
            step_power, width = step_power * step_power % (1 << 32), width * 2
    out = out[: len(codes) - k + 1]
    return (out ^ (out >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def smith_waterman(tasks: list[tuple[str, str, int, int]], match: int = 2, mismatch: int = -2, gap: int = -2, together: int = 64) -> list[int]:
    """The best local alignment score of each (a, b, low, high), many at a time, row by row: of a against b
    where the letter at i of a meets letters of b from i + low to i + high only."""
    scores = [0] * len(tasks)
    order = sorted((i for i, (a, b, *_) in enumerate(tasks) if a and b), key=lambda i: (tasks[i][3] - tasks[i][2], len(tasks[i][0])))
    for at in range(0, len(order), together):
        part = [tasks[i] for i in order[at : at + together]]
        width = max(high - low for *_, low, high in part) + 1
        length = max(len(a) for a, *_ in part)
        x = np.full((len(part), length), -1, np.int32)
        # y holds at [n, i + k] the letter of b that i of a meets at low + k.
        y = np.full((len(part), length + width), -2, np.int32)
        for n, (a, b, low, high) in enumerate(part):
            x[n, : len(a)] = _codes(a).astype(np.int32)
            seen = b[max(0, low) : max(0, len(a) + high)]
            y[n, max(0, -low) : max(0, -low) + len(seen)] = _codes(seen).astype(np.int32)
        inside = np.arange(width) <= np.array([[high - low] for *_, low, high in part])
        slope = np.arange(width, dtype=np.int32) * -gap
        row = np.zeros((len(part), width + 1), np.int32)
        best = np.zeros((len(part), width), np.int32)
        for i in range(length):
            new = row[:, :-1] + np.where(y[:, i : i + width] == x[:, i, None], np.int32(match), np.int32(mismatch))
            np.maximum(new, row[:, 1:] + gap, out=new)
            np.maximum(new, 0, out=new)
            # A gap along the row costs the same per step: a running maximum over levelled values.
            new += slope
            np.maximum.accumulate(new, axis=1, out=new)
            new -= slope
            new *= inside
            row[:, :-1] = new
            np.maximum(best, new, out=best)
        for i, score in zip(order[at : at + together], best.max(axis=1).tolist(), strict=True):
            scores[i] = score
    return scores


def _aligned(min_score: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [Item(list(w)) for w in batch["words"]]
            owner, tasks = [], []
            for n, (text, item, begins, met) in enumerate(zip(batch["bare"], items, batch["begins"], batch["met"], strict=True)):
                for low, high in _bands(item, begins, met):
                    owner.append(n)
                    tasks.append((item.whole, text, low, high))
            scores = [0] * len(items)
            for n, score in zip(owner, smith_waterman(tasks), strict=True):
                scores[n] = max(scores[n], score)
            rows = []
            for n, item in enumerate(items):
                score = scores[n] / (2 * len(item.whole))
                share = _covered(batch["bare"].iat[n], item, batch["begins"].iat[n]) / len(item.words)
                if score >= min_score or share >= SHARE:
                    rows.append((batch["doc_id"].iat[n], batch["item_id"].iat[n], score, share))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "share"])

    return run


def _bands(item: Item, begins, words) -> list[tuple[int, int]]:
    """The places at which the item may begin, given where it would by each of its seeds: begins that lie
    within an eighth of an item of each other share a band, and what edits insert or drop moves it by as much.
    A band counts whose seeds cover EVIDENCE of the item, and the one that covers most."""
    reach, groups = max(16, len(item.whole) // 8), []
    for b, w in sorted(zip(begins, words, strict=True)):
        if groups and b - groups[-1][1] <= reach:
            groups[-1][1] = b
        else:
            groups.append([b, b, set()])
        groups[-1][2].update(range(w, w + SEED_WORDS))
    enough = min(EVIDENCE * len(item.words), max(len(g[2]) for g in groups))
    return [(int(low) - reach, int(high) + reach) for low, high, covered in groups if len(covered) >= enough]


def _covered(text: str, item: Item, begins) -> int:
    """Words of item that stand in text in stretches of RUN words, first where they are expected."""
    covered, first = set(), min(begins)
    for word, window in item.windows():
        if not covered.issuperset(range(word, word + RUN)) and (text.startswith(window, max(0, first + item.at[word])) or window in text):
            covered.update(range(word, word + RUN))
    return len(covered)


def _kept(seeds: DataFrame, places: DataFrame) -> DataFrame:
    """The seeds that join: the rare ones, and all of an item whose common ones cover SHARE of it."""
    shared = seeds.groupBy("seed").agg(F.countDistinct("item_id").alias("items"))
    often = places.groupBy("seed").agg(F.count("*").alias("often"))
    counted = seeds.join(shared, "seed").join(often, "seed", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    of_item = Window.partitionBy("item_id")
    middle = F.percentile("often", F.lit(0.5)).over(of_item)
    marked = counted.withColumn("common", (F.col("items") > 1) | (F.col("often") > COMMON * F.greatest(middle, F.lit(1))))
    # Bounded by the words of one item.
    words = F.collect_set(F.when(F.col("common"), F.col("word"))).over(of_item)
    return marked.withColumn("_covered", F.size(_spread(words))).filter(~F.col("common") | (F.col("_covered") >= SHARE * F.col("n_words"))).select(
        "item_id", "seed", "offset", "word", "n_words", F.when(F.col("_covered") < SHARE * F.col("n_words"), F.col("_covered")).otherwise(0).alias("left_out")
    )


def _spread(words: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.sequence(w, w + SEED_WORDS - 1))))


def leaks(docs: DataFrame, items: DataFrame, min_score: float = EDITED) -> DataFrame:
    """(doc_id, item_id, score, share) of the leaked items of each document.

    score is the best Smith-Waterman score of the bands of the document where its seeds lie, as a share of the item's own;
    share is the exact share of the item's words that stand in the document in unbroken stretches of
    eight or more. A pair comes out if its score is min_score or more, which edited copies reach that
    break every stretch, or its share is SHARE or more, which many short passages far apart may reach.
    Items with fewer than eight words, and null or empty texts, give no pair. Copies of a document
    each give their own rows. No text or seed goes to the driver.
    """
    known = cut(items.filter(F.col("text").isNotNull()).select("item_id", "text").mapInPandas(_item_seeds, "item_id long, words array<string>, seeds array<struct<seed:long,length:int,word:int,offset:int,slot:int>>"))
    seeds = known.select("item_id", F.size("words").alias("n_words"), F.explode("seeds").alias("s")).select("item_id", "n_words", "s.*")
    sieves, lengths = _sieves(seeds.select("seed", "slot", "length"))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    candidates = cut(texts.mapInPandas(_places(sieves, lengths), "doc_id long, bare string, places array<int>, seeds array<long>"))
    places = candidates.select("doc_id", F.explode(F.arrays_zip("places", "seeds")).alias("p")).select("doc_id", F.col("p.places").alias("place"), F.col("p.seeds").alias("seed"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    salted = places.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALT)))
    met = salted.join(_kept(seeds, places).select("*", salts), ["seed", "salt"])
    pairs = met.groupBy("doc_id", "salt", "item_id", "n_words", "left_out").agg(F.collect_set(F.struct((F.col("place") - F.col("offset")).alias("begin"), "word")).alias("met"))
    n = F.size(_spread(F.col("met.word")))
    likely = pairs.filter((n >= EVIDENCE * F.col("n_words")) | (n + F.col("left_out") >= SHARE * F.col("n_words"))).withColumns({"begins": F.col("met.begin"), "met": F.col("met.word")})
    ready = likely.join(known.select("item_id", "words", salts), ["item_id", "salt"]).join(candidates.select("doc_id", "bare"), "doc_id")
    # Little data, much work: a fixed number of partitions, which isn't merged to the size of the data.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.select("doc_id", "item_id", "bare", "words", "begins", "met").repartition(parts, "doc_id", "item_id")
    return ready.mapInPandas(_aligned(min_score), "doc_id long, item_id long, score double, share double")


def leaked(pairs: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs whose document carries at least share of the item's words in unbroken stretches."""
    return pairs.filter(F.col("share") >= share).select("doc_id", "item_id")
