"""A character editor: an averaged perceptron that predicts, for each character of a word read from a
scan, whether to keep, replace or delete it or to insert something after it, and a second one of the same
kind that predicts whether the hyphen at a line's end joins two halves or belongs to the wording.

Hangul syllables are edited as the two or three letters they are made of, so that one misread letter
is one operation. The editor is trained on words that are frequent in the pages, to which the noise of
scanners is added. Which known words a word may have been is looked up by deletion keys; which of them it was, if any, is the editor's decision: it must be made of operations that are the
editor's best for their letters, and the scores of these decide between several.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np

#: Word types in the training sample, noisy copies of each, passes over them, slots for features.
SAMPLE_WORDS, NOISY, PASSES, SLOTS = 6_000, 5, 3, 1 << 18
# What scanners take for what (fixed values): true letters, and what is read.
CONFUSIONS = (
    "i>l i>1 i>j l>1 l>i l>I o>0 o>c s>5 g>9 g>q e>c c>e t>f f>t h>b b>h u>ii u>li u>v v>u n>ri n>u nn>rm m>rn rn>m d>cl cl>d w>vv a>o r>t y>v z>2 b>6 "
    "li>h h>li ä>a ö>o ü>u é>e è>e ê>e à>a ß>B ß>b ü>ii ä>ii ö>6 é>6 1>l 0>O 5>S 8>B ll>H in>m ri>n"
).split()
PAIRS = [tuple(c.split(">")) for c in CONFUSIONS]
# Letters that are numerals in a number.
_NUMERALS = str.maketrans("lio", "110")
_LEAD, _VOWEL, _TAIL = ([chr(c) for c in range(a, b)] for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


def letters(word: str) -> list[str]:
    """Characters, with Hangul syllables taken apart."""
    out = []
    for c in word:
        n = ord(c) - 0xAC00
        if 0 <= n < 11172:
            out += [_LEAD[n // 588], _VOWEL[n % 588 // 28]]
            if n % 28:
                out.append(_TAIL[n % 28 - 1])
        else:
            out.append(c)
    return out


def compose(parts: list[str]) -> str:
    """The inverse of letters; letters that don't make a syllable stay as they are."""
    out, i = [], 0
    parts = list("".join(parts))
    while i < len(parts):
        lead = ord(parts[i]) - 0x1100
        vowel = ord(parts[i + 1]) - 0x1161 if i + 1 < len(parts) else -1
        if 0 <= lead < 19 and 0 <= vowel < 21:
            tail = ord(parts[i + 2]) - 0x11A7 if i + 2 < len(parts) else 0
            tail = tail if 0 < tail < 28 else 0
            out.append(chr(0xAC00 + (lead * 21 + vowel) * 28 + tail))
            i += 2 + bool(tail)
        else:
            out.append(parts[i])
            i += 1
    return "".join(out)


def add_noise(word: str, rng: random.Random) -> tuple[list[str], list[str]] | None:
    """(letters as read, what each should become), with one misreading; None if there is none to make."""
    parts = letters(word)
    hangul = [i for i, c in enumerate(parts) if "ᄀ" <= c <= "ᇿ"]
    if hangul:
        i = rng.choice(hangul)
        c = parts[i]
        group = _LEAD if c in _LEAD else _VOWEL if c in _VOWEL else _TAIL
        roll = rng.random()
        if group is _TAIL and roll < 0.1:
            return parts[:i] + parts[i + 1 :], [*parts[: i - 1], parts[i - 1] + c, *parts[i + 1 :]]
        closed = i + 1 < len(parts) and parts[i + 1] in _TAIL
        if group is _VOWEL and not closed and roll < 0.1:
            tail = rng.choice(_TAIL)
            return parts[: i + 1] + [tail] + parts[i + 1 :], parts[: i + 1] + [""] + parts[i + 1 :]
        seen = rng.choice([x for x in group if x != c])
        return parts[:i] + [seen] + parts[i + 1 :], parts
    options = [(i, true, seen) for true, seen in PAIRS for i in range(len(word) - len(true) + 1) if word.startswith(true, i)]
    if not options:
        return None
    i, true, seen = rng.choice(options)
    target = [true[: len(true) - len(seen) + 1], *true[len(true) - len(seen) + 1 :]] if len(true) > len(seen) else [*true, *[""] * (len(seen) - len(true))]
    return list(word[:i] + seen + word[i + len(true) :]), [*word[:i], *target, *word[i + len(true) :]]


#: Margins in training: with all features, and with those of the letters around alone.
MARGIN, WIDE = 1.0, 12.0
#: Operations of a letter that are believed besides keeping it, at most; half of all there are if they are few.
BEST = 3
#: Which features don't hold the letter itself.
AROUND = slice(6, 10)


def _features(parts: list[str]) -> list[list[int]]:
    s = ["\x02"] * 4 + parts + ["\x03"] * 4
    out = []
    for i in range(4, len(s) - 4):
        c = s[i]
        views = (
            c,
            s[i - 1] + c,
            c + s[i + 1],
            s[i - 1] + c + s[i + 1],
            s[i - 2] + s[i - 1] + c,
            c + s[i + 1] + s[i + 2],
            s[i - 2] + s[i - 1] + "_" + s[i + 1] + s[i + 2],
            "".join(s[i - 4 : i]) + "_",
            "_" + "".join(s[i + 1 : i + 5]),
            "".join(s[i - 4 : i]) + "_" + "".join(s[i + 1 : i + 5]),
            "".join(s[i - 3 : i]) + c + "_" + s[i + 1],
            s[i - 1] + "_" + c + "".join(s[i + 1 : i + 4]),
        )
        out.append([(zlib.crc32(v.encode()) + n * 0x9E3779B1) % SLOTS for n, v in enumerate(views)])
    return out


class Editor:
    """labels[k] is what an operation makes of a character: the character itself (keep), nothing
    (delete), others (replace), or more (insert)."""

    def __init__(self, allowed: dict[str, list[str]], rows: dict[int, np.ndarray], labels: list[str]):
        self.allowed, self.rows, self.labels = allowed, rows, labels
        self.number = {label: i for i, label in enumerate(labels)}
        self.choices = {c: np.array([self.number[x] for x in a]) for c, a in allowed.items()}

    def __getstate__(self) -> dict:
        """Only the weights that aren't zero travel to the workers."""
        features = sorted(self.rows)
        where = [np.flatnonzero(self.rows[f]).astype(np.uint16) for f in features]
        weights = [self.rows[f][w].astype(np.float32) for f, w in zip(features, where, strict=True)]
        empty = [np.zeros(0, np.uint16)]
        return {
            "allowed": self.allowed, "labels": self.labels, "features": np.array(features, np.int32), "ends": np.cumsum([len(w) for w in where]),
            "where": np.concatenate(where or empty), "weights": np.concatenate(weights or empty),
        }

    def __setstate__(self, state: dict) -> None:
        rows, at = {}, 0
        for f, end in zip(state["features"].tolist(), state["ends"].tolist(), strict=True):
            rows[f] = row = np.zeros(len(state["labels"]), np.float32)
            row[state["where"][at:end]] = state["weights"][at:end]
            at = end
        self.__init__(state["allowed"], rows, state["labels"])

    def _scores(self, c: str, features: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        choices = self.choices.get(c)
        if choices is None:
            return None
        rows = [r for f in features if (r := self.rows.get(f)) is not None]
        return choices, (sum(rows)[choices] if rows else np.zeros(len(choices), np.float32))

    def table(self, word: str) -> list[dict[str, float]]:
        """For each letter of word, what the editor would make of it: the BEST operations and keeping it, each with
        by how much it is better than that."""
        parts, out = letters(word), []
        for c, features in zip(parts, _features(parts), strict=True):
            scored = self._scores(c, features)
            if scored is None:
                out.append({c: 0.0})
                continue
            choices, scores = scored
            own = self.allowed[c]
            keep = own.index(c)
            order = [k for k in np.argsort(-scores, kind="stable").tolist() if k != keep][: min(BEST, (len(own) + 1) // 2)]
            out.append({own[k]: float(scores[k] - scores[keep]) for k in (*order, keep)})
        return out

    def score(self, word: str, candidate: str, table: list[dict[str, float]] | None = None) -> float | None:
        """The score of the operations that make candidate of word, above keeping all; None if the editor's best don't."""
        table = table or self.table(word)
        target = "".join(letters(candidate))
        best = {0: 0.0}
        for row in table:
            reached: dict[int, float] = {}
            for j, so_far in best.items():
                for k in range(min(3, len(target) - j) + 1):
                    gain = row.get(target[j : j + k])
                    if gain is not None and so_far + gain > reached.get(j + k, -1e18):
                        reached[j + k] = so_far + gain
            best = reached
        return best.get(len(target))


def keys(word: str, misread: bool) -> set[str]:
    """What a word and its misreadings have in common: its letters, all of them and without any one (any two in
    a long Latin word). A misread word also has those of what it is with several letters read as others put right."""
    parts = "".join(letters(word))
    forms = [parts]
    if misread:
        forms += [parts[:i] + true + parts[i + len(seen) :] for true, seen in PAIRS if len(true) > 1 or len(seen) > 1 for i in range(len(parts)) if parts.startswith(seen, i)]
    out = set(forms)
    for n, form in enumerate(forms):
        # A word that such a form doesn't make may have one more letter misread if it is long.
        if n == 0 or takes_two(word):
            once = {form[:i] + form[i + 1 :] for i in range(len(form))}
            out |= once
            if n == 0 and takes_two(word):
                out |= {form[:i] + form[i + 1 : j] + form[j + 1 :] for i in range(len(form)) for j in range(i + 1, len(form))}
    if misread and any(c.isdigit() for c in word) and any(c in "lio" for c in word):
        out.add(numeral(word))
    return out - {""}


def numeral(word: str) -> str:
    """A number with letters in it, with digits for them; all numbers are alike."""
    return re.sub(r"\d+", "0", word.translate(_NUMERALS))


def takes_two(word: str) -> bool:
    return len(word) >= 6 and all(c < "\u0250" for c in word)


def train(words: list[str], seed: int = 7) -> Editor:
    """words: frequent words, in any order; the result depends on the words and the seed only."""
    rng, examples = random.Random(seed), []
    for w in sorted(set(words)):
        parts = letters(w)
        examples.append((parts, parts, False))
        # What a letter is must also be learned from the letters around it alone.
        examples.append((parts, parts, True))
        examples += [(*n, False) for n in (add_noise(w, rng) for _ in range(NOISY)) if n and n[0]]
    allowed: dict[str, set[str]] = defaultdict(set)
    for seen, target, _ in examples:
        for c, t in zip(seen, target, strict=True):
            allowed[c] |= {c, t}
    # A misread letter of a syllable may have been any of its kind, also where no example shows the pair.
    for group in (_LEAD, _VOWEL, _TAIL):
        own = {c for c in group if c in allowed}
        for c in own:
            allowed[c] |= own
    lists = {c: sorted(a) for c, a in sorted(allowed.items())}
    labels = sorted({t for a in lists.values() for t in a})
    number = {label: i for i, label in enumerate(labels)}
    choices = {c: np.array([number[t] for t in a]) for c, a in lists.items()}
    rows: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    step = 0
    # As small arrays: a driver holds all examples at once.
    prepared = [(seen, target, np.array([f[AROUND] if masked else f for f in _features(seen)], np.int32)) for seen, target, masked in examples]
    del examples
    for _ in range(PASSES):
        rng.shuffle(prepared)
        for seen, target, features in prepared:
            for c, t, fs in zip(seen, target, features.tolist(), strict=True):
                own = choices[c]
                if len(own) == 1:
                    continue
                step += 1
                known = [r for f in fs if (r := rows.get(f)) is not None]
                scores = sum(known)[own] if known else np.zeros(len(own), np.float32)
                right, at = number[t], lists[c].index(t)
                rival = scores.copy()
                rival[at] = -np.inf
                best = int(np.argmax(rival))
                guess = int(own[best])
                # With a margin: what is right must be so clearly, above all by the letters around.
                if scores[at] - rival[best] < (WIDE if len(fs) < 12 else MARGIN):
                    for f in fs:
                        if f not in rows:
                            rows[f], sums[f] = np.zeros(len(labels), np.float32), np.zeros(len(labels), np.float32)
                        rows[f][right] += 1
                        rows[f][guess] -= 1
                        sums[f][right] += step
                        sums[f][guess] -= step
    averaged = {f: (r - sums[f] / (step + 1)).astype(np.float32) for f, r in rows.items()}
    return Editor(lists, averaged, labels)


class Linear:
    """A binary averaged perceptron over named features."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, features: Iterable[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)


def train_linear(examples: list[tuple[list[str], bool]], passes: int = 8, margin: float = 1.0, seed: int = 9) -> Linear:
    rng, step = random.Random(seed), 0
    weights: dict[str, float] = defaultdict(float)
    sums: dict[str, float] = defaultdict(float)
    order = list(examples)
    for _ in range(passes):
        rng.shuffle(order)
        for features, yes in order:
            step += 1
            sign = 1 if yes else -1
            if sign * sum(weights[f] for f in features) < margin:
                for f in features:
                    weights[f] += sign
                    sums[f] += sign * step
    return Linear({f: w - sums[f] / (step + 1) for f, w in weights.items()})


def bucket(n: float) -> str:
    return "0" if n <= 0 else str(min(6, int(np.log2(n)) + 1))


def join_features(first: str, second: str, joined: int, hyphenated: int, suspended: int, n_first: int, n_second: int) -> list[str]:
    """What tells a broken word (joined) from one with a hyphen of its own: how often each form is seen elsewhere."""
    j, h, u, a, b = (bucket(n) for n in (joined, hyphenated, suspended, n_first, n_second))
    own = "own" if hyphenated + suspended >= joined else "joined"
    return [
        "bias", "j" + j, "h" + h, "u" + u, f"j{j}h{h}", f"a{a}b{b}", f"j{j}a{a}b{b}", own, f"{own} j{j}", f"first {min(len(first), 4)}", f"second {min(len(second), 4)}",
        "rest missing" if not second else "rest", f"rest {bool(second)} j{j} a{a}", f"words {n_first >= 3 and n_second >= 3} j{j}", f"often {n_second >= 50} j{j}",
    ]


def train_joiner(words: list[tuple[str, int]], hyphenated: list[tuple[str, str, int]], suspended: list[tuple[str, str, int]], seed: int = 10) -> Linear:
    """words with counts are broken at will, each counted once less; hyphenated and suspended forms (first, second,
    count) are the other examples. Counts of halves are those among words."""
    rng, examples = random.Random(seed), []
    count = dict(words)
    for w, n in sorted(words):
        if len(w) < 4:
            continue
        i = rng.randint(2, len(w) - 2)
        first, second = w[:i], w[i:]
        if rng.random() < 0.05:
            first, second = w[:i], ""
        examples.append((join_features(first, second, count.get(first, 0) if not second else n - 1, 0, 0, count.get(first, 0), count.get(second, 0)), True))
    # As many of the others, so that neither kind decides by its number.
    other = [(a, b, n - 1, 0) for a, b, n in hyphenated] + [(a, b, 0, n - 1) for a, b, n in suspended]
    if other:
        for a, b, h, u in (other * (len(examples) // len(other) + 1))[: max(len(examples), len(other))]:
            examples.append((join_features(a, b, count.get(a + b, 0), h, u, count.get(a, 0), count.get(b, 0)), False))
    return train_linear(examples)
