"""Text that was decoded with the wrong character encoding: finding it and restoring it.

Method: a multinomial classifier (naive Bayes over hashed bigrams of UTF-8 bytes) is trained on
synthetically garbled words to predict the encoding chain a word went through. The chain is then
inverted, and the result counts only if every step decodes strictly, garbling it again gives the
word found, and it reads better as clean text than the word did.

Words, not whole values, are judged, since a value may be garbled in part; every chain keeps the
ASCII space. Words of one value went through one chain, so the verdicts of a value are pooled.
A word with a replacement character is garbled whether it can be restored or not.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import cut

#: Values in the training sample (those with the smallest hashes), and slots for bigrams.
SAMPLE_VALUES, SLOTS = 6_000, 1 << 14
#: Nats by which a chain must explain a word better than clean text does, and by which the restored
#: word must read better; the share of its letters that clean text is known to have.
MARGIN, GAIN, KNOWN = 4.0, 1.0, 0.75
#: Where the letters of restored UTF-8 may lie: Latin, quotes and dashes, kana, ideographs, Hangul.
_SCRIPTS = re.compile(r"[\x20-\x7e\xa0-\u017f\u2010-\u2026\u3001-\u30ff\u4e00-\u9fff\uac00-\ud7a3]+")
LOST = "\ufffd"

_C1 = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TO_1252 = {chr(b): bytes([b]) for b in range(256)} | {bytes([b]).decode("cp1252"): bytes([b]) for b in range(256) if b not in _C1}
_FROM_1252 = [_C1[b] if b in _C1 else bytes([b]).decode("cp1252") for b in range(256)]


def _decode(raw: bytes, codec: str, errors: str = "strict") -> str:
    """cp1252 here takes its five undefined bytes as control characters, as most readers do."""
    return "".join(_FROM_1252[b] for b in raw) if codec == "cp1252" else raw.decode(codec, errors)


def _encode(text: str, codec: str) -> bytes:
    return b"".join(_TO_1252[c] for c in text) if codec == "cp1252" else text.encode(codec)


#: name -> steps (encoded as, read as). The encodings such texts come in.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8>latin-1": (("utf-8", "latin-1"),),
    "utf-8>cp1252": (("utf-8", "cp1252"),),
    "utf-8>cp1252>utf-8>cp1252": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf-8>latin-1>utf-8>latin-1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf-8>mac-roman": (("utf-8", "mac_roman"),),
    "utf-8>cp949": (("utf-8", "cp949"),),
    "cp949>latin-1": (("cp949", "latin-1"),),
    "cp949>cp1252": (("cp949", "cp1252"),),
    "cp949>shift-jis": (("cp949", "cp932"),),
    "cp949>gbk": (("cp949", "gbk"),),
    "cp949>utf-8": (("cp949", "utf-8"),),
    "johab>latin-1": (("johab", "latin-1"),),
    "johab>cp949": (("johab", "cp949"),),
    "latin-1>mac-roman": (("cp1252", "mac_roman"),),
    "latin-1>cp1251": (("cp1252", "cp1251"),),
    "latin-1>utf-8": (("cp1252", "utf-8"),),
}
CLEAN = "clean"
# Cyrillic letters that look like Latin ones (fixed values): a Latin word with only such letters is more
# likely written with look-alikes than decoded wrongly.
_TWINS = frozenset("АВЕЅІЈКМНОРСТУХаеѕіјорсух")
#: Chains that lose every letter outside ASCII: they can be told, not inverted.
LOSSY = {"cp949>utf-8", "latin-1>utf-8"}


def garble(text: str, chain: str) -> str | None:
    """text after the chain, with replacement characters where a reader would put them; None where
    its letters don't exist in the encoding or the chain leaves it as it is."""
    out = text
    try:
        for written, read in CHAINS[chain]:
            out = _decode(_encode(out, written), read, "replace")
    except (UnicodeError, KeyError):
        return None
    return None if out == text else out


def invert(text: str, chain: str) -> str | None:
    """What the chain made text of, if each step decodes strictly and leads back to text."""
    out = text
    try:
        for written, read in reversed(CHAINS[chain]):
            out = _decode(_encode(out, read), written)
    except (UnicodeError, KeyError):
        return None
    return out if out != text and garble(out, chain) == text else None


def _framed(word: str) -> bytes:
    return b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03"


def _bigrams(raw: bytes) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((raw[:-1] * np.uint32(257) + raw[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(18)


@lru_cache(maxsize=1 << 16)
def _slots(word: str) -> np.ndarray:
    return _bigrams(_framed(word))


@dataclass
class Model:
    """Log-probabilities of bigram slots, a row per chain and one for clean text at the end."""

    chains: list[str]
    table: np.ndarray
    letters: frozenset[str]

    def scores(self, word: str) -> np.ndarray:
        return self.table[:, _slots(word)].sum(axis=1)

    def clean(self, word: str) -> float:
        """Nats per bigram as clean text."""
        return float(self.table[-1, _slots(word)].mean())

    def known(self, word: str) -> float:
        """The share of letters outside ASCII that clean text has."""
        letters = [c for c in word if c > "\x7f"]
        return sum(c in self.letters for c in letters) / len(letters) if letters else 0.0


def _fit(words: dict[str, int]) -> Model:
    """words: clean words with counts."""
    rows = []
    for chain in [*CHAINS, None]:
        counts = np.full(SLOTS, 0.05)
        for word, n in words.items():
            seen = word if chain is None else garble(word, chain)
            if seen is not None:
                np.add.at(counts, _slots(seen), 1 + np.log(n))
        rows.append(np.log(counts / counts.sum()))
    seen: dict[str, int] = defaultdict(int)
    for word, n in words.items():
        for c in set(word):
            seen[c] += n
    return Model([*CHAINS, CLEAN], np.array(rows, np.float32), frozenset(c for c, n in seen.items() if n > 1 and c > "\x7f"))


def train(values: list[str]) -> Model:
    """A model from values most of which are clean: fitted, applied to them, and fitted again without
    those that it finds garbled. Values with replacement or control characters are left out at once."""
    usable = [v for v in values if LOST not in v and not any("\x7f" <= c <= "\x9f" for c in v)]
    for _ in range(3):
        words: dict[str, int] = defaultdict(int)
        for v in usable:
            for w in v.split(" "):
                if w and not w.isascii():
                    words[w] += 1
        model = _fit(words)
        judge = Judge(model)
        usable = [v for v in usable if not judge.value(v).garbled]
    return model


# Parts of a nat in which weights of words are summed over tasks: sums of whole numbers are the same in any order.
_PARTS = 1 << 16


def _weights(counts: pd.Series) -> np.ndarray:
    """1 + log of the counts, in parts; nothing for a word that isn't there."""
    n = counts.to_numpy(np.int64)
    return np.where(n > 0, np.rint((1 + np.log(np.maximum(n, 1))) * _PARTS), 0)


def _slot_sums(words: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The weights of words, summed by the slots of their bigrams; words that are None don't count."""
    framed = [(_framed(w), x) for w, x in zip(words, weights.tolist(), strict=True) if w is not None]
    if not framed:
        return np.zeros(SLOTS, np.int64)
    sizes = np.array([len(raw) for raw, _ in framed])
    slots, each = _bigrams(b"".join(raw for raw, _ in framed)), np.repeat([x for _, x in framed], sizes)[:-1]
    inside = np.ones(len(slots), bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    return np.bincount(slots[inside], each[inside], SLOTS).astype(np.int64)


@dataclass
class _Tally:
    """Weights by chain (the last row: as they are) and slot, and counts of letters outside ASCII."""

    sums: np.ndarray
    letters: dict[str, int]

    def __add__(self, other: _Tally) -> _Tally:
        both = self.letters.keys() | other.letters.keys()
        return _Tally(self.sums + other.sums, {c: self.letters.get(c, 0) + other.letters.get(c, 0) for c in both})

    def model(self) -> Model:
        counts = 0.05 + self.sums / _PARTS
        return Model([*CHAINS, CLEAN], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), frozenset(c for c, n in self.letters.items() if n > 1))


def _tally(words: DataFrame) -> _Tally:
    """What the tally changes by if words (word, before, after) are counted as after instead of before. Summed in
    Spark: of any number of words, a row per chain and slot and one per letter reach the driver."""
    chains = [*CHAINS, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, letters = np.zeros((len(chains), SLOTS), np.int64), Counter()
        for batch in batches:
            weights = _weights(batch["after"]) - _weights(batch["before"])
            for row, chain in zip(sums, chains, strict=True):
                row += _slot_sums([w if chain is None else garble(w, chain) for w in batch["word"]], weights)
            for word, n in zip(batch["word"], (batch["after"] - batch["before"]).tolist(), strict=True):
                for c in set(word):
                    if c > "\x7f":
                        letters[ord(c)] += n
        row, slot = sums.nonzero()
        yield pd.DataFrame({"row": row, "slot": slot, "n": sums[row, slot]})
        if letters:
            yield pd.DataFrame({"row": len(chains), "slot": list(letters.keys()), "n": list(letters.values())})

    summed = words.mapInPandas(run, "row int, slot int, n long").groupBy("row", "slot").agg(F.sum("n").alias("n")).toArrow()
    row, slot, n = (summed[c].to_numpy() for c in ("row", "slot", "n"))
    sums, of_chain = np.zeros((len(chains), SLOTS), np.int64), row < len(chains)
    sums[row[of_chain], slot[of_chain]] = n[of_chain]
    return _Tally(sums, {chr(c): k for c, k in zip(slot[~of_chain].tolist(), n[~of_chain].tolist(), strict=True)})


def _words_of_garbled(values: DataFrame, models: list[Model]) -> DataFrame:
    """(word, less): how often the words outside ASCII stand in those of values (v) that any of models finds garbled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges = [Judge(m) for m in models]
        for batch in batches:
            counts = Counter(w for v in batch["v"] if any(j.value(v).garbled for j in judges) for w in v.split(" ") if not w.isascii())
            if counts:
                yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})

    return values.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("less"))


def train_on_all(values: DataFrame, column: str) -> Model:
    """What train makes of all values of the column, whatever their number and length; copies count each. Words are
    counted, garbled and summed in the tasks. A fit after the first takes from the sums the words of values found garbled."""
    usable = values.select(F.col(column).alias("v")).filter(F.col("v").rlike(r"[^\x00-\x7f]") & ~F.col("v").rlike(r"[\x{7f}-\x{9f}\x{fffd}]"))
    words = usable.select(F.explode(F.split("v", " ")).alias("word")).filter(F.col("word").rlike(r"[^\x00-\x7f]"))
    counted = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    whole = _tally(counted.select("word", F.lit(0).cast("long").alias("before"), F.col("n").alias("after")))
    models = [whole.model()]
    for _ in range(2):
        changed = _words_of_garbled(usable, models).join(counted, "word")
        models.append((whole + _tally(changed.select("word", F.col("n").alias("before"), (F.col("n") - F.col("less")).alias("after")))).model())
    return models[-1]


# The script that a chain leaves, where it is one that is written as well.
_OWN_SCRIPT = {"cp949>gbk": re.compile("[\u3400-\u9fff]"), "latin-1>cp1251": re.compile("[\u0400-\u04ff]")}


@dataclass
class Verdict:
    garbled: bool
    chain: str | None = None
    restored: str | None = None


_FINE = Verdict(False)


class Judge:
    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, tuple[str, str] | str | None] = {}

    def word(self, word: str) -> tuple[str, str] | str | None:
        """(chain, restored), LOST if garbled beyond repair, None if fine."""
        if word.isascii():
            return None
        if word not in self.words:
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[word] = self._judge(word)
        return self.words[word]

    def _judge(self, word: str) -> tuple[str, str] | str | None:
        if LOST in word:
            return LOST
        scores, best = self.model.scores(word), None
        now = self.model.clean(word)
        for k in np.argsort(-scores[:-1])[:6].tolist():
            chain, odds = self.model.chains[k], float(scores[k] - scores[-1])
            restored = invert(word, chain) if chain not in LOSSY and odds > 0 else None
            if restored is None or any(c < " " or "\x7f" <= c <= "\x9f" for c in restored):
                continue
            gain = (self.model.clean(restored) - now) * len(_slots(restored))
            if chain == "latin-1>cp1251" and all(c in _TWINS for c in word if c > "\u0370"):
                continue
            known = self.model.known(restored)
            # Bytes that read as UTF-8 by chance are rare, whatever the restored letters are.
            reads = chain.startswith("utf-8>") and chain != "utf-8>cp949" and _SCRIPTS.fullmatch(restored)
            reads = reads or gain > GAIN and odds + gain > MARGIN and known >= (KNOWN if gain < 10 else KNOWN - 0.25)
            if reads and (best is None or odds + gain > best[0]):
                best = odds + gain, chain, restored
        return best[1:] if best else None

    def value(self, value: str) -> Verdict:
        if value.isascii():
            return _FINE
        words = value.split(" ")
        found = [self.word(w) for w in words]
        if not any(found):
            return _FINE
        # One chain for the whole value: the one that explains most of it.
        weight: dict[str, float] = defaultdict(float)
        for w, f in zip(words, found, strict=True):
            if isinstance(f, tuple):
                weight[f[0]] += len(w)
        chain = max(weight, key=lambda c: (weight[c], c), default=None)
        if chain is None:
            sums = sum(self.model.scores(w) for w, f in zip(words, found, strict=True) if f)
            return Verdict(True, self.model.chains[int(np.argmax(sums[:-1]))], None)
        if chain in _OWN_SCRIPT:
            # A script that stands for itself: of the words in it, most read as they are.
            judged = [f is not None for w, f in zip(words, found, strict=True) if _OWN_SCRIPT[chain].search(w)]
            if 2 * sum(judged) < len(judged):
                return _FINE
        out, whole = [], True
        for w, f in zip(words, found, strict=True):
            back = invert(w, chain) if f else None
            if f and back is None:
                back = f[1] if isinstance(f, tuple) else None
            if f and back is None:
                whole = False
            out.append(w if back is None else back)
        return Verdict(True, chain, " ".join(out) if whole else None)


def sample_values(values: DataFrame, column: str) -> list[str]:
    """SAMPLE_VALUES different values at most, those with the smallest hashes."""
    # Hashes first, so that no text is shuffled to find out which ones are in the sample.
    usable = values.select(F.col(column).alias("v")).filter(F.col("v").rlike(r"[^\x00-\x7f]") & (F.length("v") <= 400))
    hashed = usable.withColumn("h", F.xxhash64("v"))
    top = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_VALUES)
    last = top.agg(F.max("h")).first()[0]
    if last is None:
        return []
    return sorted(r.v for r in hashed.filter(F.col("h") <= last).select("v").distinct().collect())


def verdict_udf(model: Model):
    """value -> struct(garbled, chain, restored); null for null."""

    @F.pandas_udf("garbled boolean, chain string, restored string")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for values in batches:
            rows = [_FINE if v is None else judge.value(v) for v in values]
            yield pd.DataFrame([(r.garbled, r.chain, r.restored) for r in rows], columns=["garbled", "chain", "restored"])

    return verdict


def long_form(headers: DataFrame, runs: DataFrame) -> DataFrame:
    """(table_name, field_name, row_id, value) of the fields that may be garbled."""
    part = lambda df, t, f, k: df.select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), F.col(k).alias("row_id"), F.col(f).alias("value"))
    return (
        part(headers, "hwp3_headers", "title", "header_id")
        .unionByName(part(headers, "hwp3_headers", "author", "header_id"))
        .unionByName(part(runs, "text_runs", "text", "run_id"))
    )


def mended(values: DataFrame, column: str = "value", model: Model | None = None) -> DataFrame:
    """The rows of values that are garbled, with chain and restored (null where text was lost).

    The model is trained on a bounded sample of the values themselves unless one is given. Null,
    empty and pure ASCII values are never garbled. Copies of a value each keep their row.
    """
    model = model or train(sample_values(values, column))
    suspects = values.filter(F.col(column).rlike(r"[^\x00-\x7f]"))
    judged = suspects.withColumn("_v", verdict_udf(model)(F.col(column)))
    return judged.filter("_v.garbled").select(*values.columns, F.col("_v.chain").alias("chain"), F.col("_v.restored").alias("restored"))
