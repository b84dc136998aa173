"""Which lines at the head and foot of scanned pages are running heads or page numbers.

Two averaged perceptrons decide by page-position features: where a line stands, how long it is and how it ends,
on how many pages of its scan it recurs (whole, or one half of it, which survives a misreading in the other), and
how many of the scan's numbers run with the pages as it does. They are trained on scans made up from lines of the pages at
hand, to which heads and numbers of many kinds are added.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from docweave.llm import editor as E

#: Filled lines at head and foot that are looked at.
EDGE_LINES = 4
#: Pages whose lines make up the training scans, lines of each, scans.
SAMPLE_PAGES, SAMPLE_LINES, SCANS = 300, 60, 500
HYPHENS = "-¬­‐‑"

_NUMBER = r"(?:[\dlIOo]{0,3}\d[\dlIOo]{0,3}|[ivxlc]{1,8}|[IVXLC]{1,8})"
_ALONE = re.compile(
    rf"^(?P<mark>(?:page|p\.|seite|s\.|쪽|페이지)\s*)?(?P<open>[-–—·•\[(<|]\s*)?(?P<n>{_NUMBER})(?P<of>\s*(?:/|of|von|sur)\s*\d{{1,5}})?(?P<close>\s*[-–—·•\])>|])?(?P<unit>\s*(?:쪽|면|페이지))?$", re.I
)
_WITHIN = re.compile(rf"^(?P<head>.*\S)\s{{2,}}(?:page |p\. )?[-–—·\[(|]?\s*(?P<n>{_NUMBER})\s*[-–—·\])|]?$|^(?P<head2>.*\S)\s+[\[(](?P<n2>\d{{1,4}})[\])]$|^[-–—·\[(|]?\s*(?P<n3>\d{{1,4}})\s*[-–—·\])|]?\s{{2,}}(?P<head3>\S.*)$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
# Letters that scanners take for one another, brought to one (fixed values); longer ones first.
_SAME = [("rn", "m"), ("nn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("i", "l"), ("5", "s"), ("9", "g"), ("c", "e"), ("t", "f"), ("b", "h"), ("u", "ll")]
_WORD = re.compile(r"[^\W_]+")


def number_of(text: str) -> int | None:
    low = text.lower()
    if re.fullmatch("[ivxlc]+", low) and not any(c.isdigit() for c in low):
        values = [_ROMAN[c] for c in low]
        return sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))
    digits = low.translate(str.maketrans("lio", "110"))
    return int(digits) if digits.isdigit() else None


def _code(kind: str, text: object) -> int:
    raw = f"{kind}:{text}".encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32 | zlib.adler32(raw)) - (1 << 63)


def _keys(line: str) -> list[int]:
    """Codes of a line: whole, its first half, its second half, with letters that look alike brought together."""
    text = line.lower()
    for a, b in _SAME:
        text = text.replace(a, b)
    words = _WORD.findall(text)
    parts = words if len(words) > 1 else list("".join(words))
    if not parts:
        return []
    half = (len(parts) + 1) // 2
    halves = [_code("left", " ".join(parts[:half])), _code("right", " ".join(parts[half:]))] if len("".join(parts)) > 3 else []
    return [_code("whole", " ".join(parts)), *halves]


@dataclass
class Edge:
    line: int
    keys: list[int]  # of the text without the number
    offset: int | None  # code of the number less that of the page
    views: list[str]  # what is seen on the page alone


def edges(text: str, page_no: int) -> list[Edge]:
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line.strip()]
    widths = sorted(len(lines[i].strip()) for i in filled)
    usual = widths[len(widths) // 2] if widths else 0
    out = []
    for k, i in enumerate(filled):
        back = len(filled) - 1 - k
        if k >= EDGE_LINES and back >= EDGE_LINES:
            continue
        raw = lines[i].rstrip()
        line = head = raw.strip()
        number, sure, role = None, False, "line"
        if m := _ALONE.match(line):
            number = number_of(m["n"])
            if number is not None:
                sure = bool(m["mark"] or m["of"] or m["unit"] or (m["open"] and m["close"]) or raw[:2].isspace())
                head, role = "", "number"
        elif (m := _WITHIN.match(line)) and (number := number_of(m["n"] or m["n2"] or m["n3"])) is not None:
            head, role = m["head"] or m["head2"] or m["head3"], "within"
        place = f"top{k}" if k <= back else f"bottom{back}"
        inward = i + 1 if k <= back else i - 1
        apart = not (0 <= inward < len(lines)) or not lines[inward].strip()
        ends = "hyphen" if head[-1:] in HYPHENS and head else "stop" if head.endswith((".", ",", ";", ":", "。", "?", "!")) else "open"
        shape = "short" if len(head) * 2 <= usual else "long" if len(head) * 5 >= usual * 4 else "middle"
        title = "title" if head[:1].isupper() or "가" <= head[:1] <= "힣" else "digit" if head[:1].isdigit() else "other"
        views = [role, place, "apart" if apart else "joined", ends, shape, title, "sure" if sure else "bare", "indented" if raw[:2].isspace() else "flush"]
        out.append(Edge(i, _keys(head) if head else [], _code("offset", number - page_no) if number is not None else None, views))
    return out


def _often(n: int) -> str:
    return str(min(n, 4))


def head_views(e: Edge, on: dict[int, int]) -> list[str]:
    role, place, apart, ends, shape, title, _, _ = e.views
    counts = [on.get(k, 1) for k in e.keys]
    whole, half = counts[0] if counts else 0, max(counts[1:], default=0)
    w, h = _often(whole), _often(half)
    return [
        "bias", role, place, apart, ends, shape, title, f"w{w}", f"h{h}", f"{role} w{w}", f"{place} w{w}", f"{place} h{h}", f"{place} {apart} w{w}", f"{ends} w{w}", f"{ends} h{h}", f"{shape} w{w}", f"{shape} {ends} h{h}", f"{title} w{w} {ends}",
        f"{apart} {ends} h{h}", f"w{w} h{h}", f"{role} h{h}",
    ]


def number_views(e: Edge, on: dict[int, int]) -> list[str]:
    role, place, apart, _, _, _, sure, indented = e.views
    n = _often(on.get(e.offset, 1))
    head = _often(max((on.get(k, 1) for k in e.keys), default=0))
    return ["bias", role, place, apart, sure, indented, f"n{n}", f"{role} n{n}", f"{sure} n{n}", f"{place} n{n}", f"{role} {sure} n{n}", f"{role} {place}", f"{role} head{head}", f"{role} {apart} n{n}", f"{role} n{n} head{head}"]


@dataclass
class Judge:
    head: E.Linear
    number: E.Linear

    def kinds(self, text: str, page_no: int, on: dict[int, int]) -> list[tuple[int, str]]:
        """(line, kind) of the furniture of a page; on tells on how many pages of the scan a code occurs."""
        out = []
        for e in edges(text, page_no):
            numbered = e.offset is not None and self.number.score(number_views(e, on)) > 0
            if e.keys and self.head.score(head_views(e, on)) > 0:
                out.append((e.line, "running_head"))
            if numbered:
                out.append((e.line, "page_number"))
        return out


def codes(text: str, page_no: int) -> set[int]:
    return {c for e in edges(text, page_no) for c in (*e.keys, *([e.offset] if e.offset is not None else []))}


def _number_text(rng: random.Random, n: int) -> tuple[str, bool]:
    roman = "".join("x" * (n // 10 % 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]) or "i"
    text = rng.choice((str(n), str(n), str(n), f"- {n} -", f"– {n} –", f"[{n}]", f"Page {n}", f"p. {n}", f"{n} / {n + 40}", f"{n}쪽", f"Seite {n}", roman, f"({n})"))
    if rng.random() < 0.1:
        text = text.replace("1", "l", 1).replace("0", "O", 1)
    return " " * rng.choice((0, 0, 4, 20)) + text, True


def _misread(rng: random.Random, text: str) -> str:
    i = rng.randrange(len(text))
    return text[:i] + (rng.choice("aeinortlc") if text[i].isascii() else chr(ord(text[i]) + rng.choice((1, -1, 28)))) + text[i + 1 :] if text[i].isalpha() else text


def _made_scan(rng: random.Random, pages: list[list[str]], words: list[str]) -> list[tuple[int, list[str], dict[int, set[str]]]]:
    """Pages (number, lines, kinds by line) of an invented scan."""

    def title() -> str:
        made = " ".join(w[0].upper() + w[1:] for w in rng.choices(words, k=rng.randint(1, 7)))
        return rng.choice((made, made, made, made.upper(), f"{rng.randint(1, 12)}. {made}", f"Chapter {rng.randint(1, 9)} {made}", f"제{rng.randint(1, 9)}장 {made}"))

    n, first = rng.choice((2, 2, 3, 4, 5, 6, 8, 12)), rng.randint(1, 300)
    heads = [title() for _ in range(rng.choice((0, 1, 1, 1, 2)))]
    chapters = len(heads) == 2 and rng.random() < 0.5
    foot, within, numbered = rng.random() < 0.2, rng.random() < 0.3, rng.random() < 0.75
    style = rng.randint(0, 10**9)
    gap = rng.choice((0, 0, 1, 1, 2))
    out = []
    for k in range(n):
        body = [x for x in rng.choice(pages)]
        start = rng.randrange(max(1, len(body) - 8))
        body = body[start : start + rng.randint(6, 25)]
        kinds: dict[int, set[str]] = {}
        if rng.random() < 0.15:
            body = [title() if rng.random() < 0.8 else str(rng.randint(1, 400)), *([""] * rng.randint(0, 1)), *body]
        if rng.random() < 0.05:
            body.insert(rng.randint(0, len(body)), str(rng.randint(1, 400)))
        top: list[tuple[str, set[str]]] = []
        bottom: list[tuple[str, set[str]]] = []
        head = heads[(k * 2 // n if chapters else k % len(heads))] if heads and rng.random() < 0.92 else None
        number = _number_text(random.Random(style), first + k)[0] if numbered and rng.random() < 0.95 else None
        if head is not None:
            head = _misread(rng, head) if rng.random() < 0.15 else head
            if number is not None and within:
                plain = number.strip()
                line = rng.choice((f"{head}    {plain}", f"{plain}   {head}", f"{head} [{first + k}]")) if k % 2 else f"{head}     {plain}"
                (bottom if foot else top).append((line, {"running_head", "page_number"}))
                number = None
            else:
                (bottom if foot else top).append((head, {"running_head"}))
        if number is not None:
            (top if style % 5 == 0 else bottom).append((number, {"page_number"}))
        lines = []
        for text, what in top:
            kinds[len(lines)] = what
            lines.append(text)
        lines += [""] * (gap if top else 0) + body + [""] * (gap if bottom else 0)
        for text, what in bottom:
            kinds[len(lines)] = what
            lines.append(text)
        out.append((first + k if rng.random() < 0.9 else k + 1, lines, kinds))
    # Page numbers of a scan start anywhere, but run with the numbers printed.
    base = rng.choice((0, first - 1))
    return [(first + i - base, lines, kinds) for i, (_, lines, kinds) in enumerate(out)]


def train(pages: Iterable[list[str]], words: list[str], seed: int = 12) -> Judge:
    """pages: lines of sample pages. Their own first and last lines, which may be furniture, are left out."""
    rng = random.Random(seed)
    bodies = [b for p in pages if len(b := [x for x in p if x.strip()][EDGE_LINES:-EDGE_LINES]) >= 4]
    bodies = bodies or [["a plain line of text that goes on and"] * 8]
    # Blank lines between paragraphs come back at random.
    bodies = [[y for x in b for y in ([x, ""] if x.rstrip().endswith(".") and rng.random() < 0.3 else [x])] for b in bodies]
    heads, numbers = [], []
    for _ in range(SCANS):
        scan = _made_scan(rng, bodies, words or ["line", "text", "page"])
        on: dict[int, int] = defaultdict(int)
        for page_no, lines, _ in scan:
            for c in codes("\n".join(lines), page_no):
                on[c] += 1
        for page_no, lines, kinds in scan:
            for e in edges("\n".join(lines), page_no):
                said = kinds.get(e.line, set())
                if e.keys:
                    # A head seen once in its scan recurs nowhere, so it isn't one.
                    heads.append((head_views(e, on), "running_head" in said and max(on[k] for k in e.keys) > 1))
                if e.offset is not None:
                    numbers.append((number_views(e, on), "page_number" in said))
    return Judge(E.train_linear(heads), E.train_linear(numbers))
