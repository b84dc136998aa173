"""Personal information in free text: finding it, and putting placeholders or surrogates in its place.

Method: surrogate generation. Every entity found gets a replacement of the same kind and in the same script,
format and gender, made with a secret key. Digits and letters of numbers and addresses of e-mail go through
a keyed permutation of all values of that format, so that different ones stay different everywhere;
names and places get readable invented ones by keyed hash, with a check for collisions within the document.
Mentions of one person (Miller, Ada; Ada Miller; A. Miller; Mr Miller) share their replacement, part by part.
As the task asks for placeholders, the standard output is a typed placeholder that carries the number of
the entity in its document; the surrogate text is the other output.

Numbers, addresses and names next to an unmistakable cue (a title, a field's label) are found by patterns; names
anywhere else by the trained tagger of names.py.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docweave.llm import names as N

KINDS = ("email", "phone", "id_number", "address", "name")

# One character for one, so that positions stay: wide forms, dashes and spaces to their plain ones.
_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2007: 0x20} | {c: 0x2D for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63)}

_FOLDED = re.compile(f"[{''.join(map(chr, _FOLD))}]")

_AT = r"(?:@|\s@\s|\s?\((?:at|골뱅이)\)\s?|\s?\[(?:at|골뱅이)\]\s?|\s골뱅이\s)"
_DOT = r"(?:\.|\s?\((?:dot|점)\)\s?|\s?\[(?:dot|점)\]\s?|\s점\s)"
EMAIL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
EMAIL_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])? at [A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)* dot [A-Za-z]{2,}(?![A-Za-z0-9])", re.I)

_START, _END = r"(?<![A-Za-z0-9_.\-/@#])", r"(?![A-Za-z0-9_@])(?!-\d)(?!\.\d)"
_SPELLED = "[공영일이삼사오육륙칠팔구]"
PHONE = re.compile(
    "|".join(
        [
            rf"{_START}\+82[ \-]?(?:\(0\)[ \-]?)?0?\d{{1,2}}[ \-.]?\d{{3,4}}[ \-.]?\d{{4}}{_END}",
            rf"{_START}0(?:1[016-9]|2|[3-6][1-5]|50\d|70)[ \-.]\d{{3,4}}[ \-.]\d{{4}}{_END}",
            rf"{_START}01[016-9]\d{{7,8}}{_END}",
            rf"{_START}\(0(?:2|[3-6][1-5])\)[ \-.]?\d{{3,4}}[ \-.]\d{{4}}{_END}",
            rf"(?<![가-힣])(?:공|영)일[공영일육칠팔구][ \-.]?{_SPELLED}{{3,4}}[ \-.]?{_SPELLED}{{4}}(?![가-힣])",
            rf"{_START}\+(?!82)\d{{1,3}}[ \-.]?(?:\(0\)[ ]?)?\(?\d(?:[ \-./()]{{0,2}}\d){{6,12}}{_END}",
            rf"{_START}(?:1[ \-.])?\(?[2-9]\d{{2}}\)?[ \-.]\d{{3}}[ \-.]\d{{4}}{_END}",
            rf"{_START}0[1-9](?:[ .\-]\d{{2}}){{4}}{_END}",
            rf"{_START}\(?0\d{{2,4}}\)? ?[ /\-] ?\d{{3,8}}(?:[ \-]\d{{2,6}}){{0,2}}{_END}",
        ]
    )
)

ID_NUMBER = re.compile(
    "|".join(
        [
            rf"{_START}\d{{6}} ?- ?[1-9]\d{{6}}{_END}",
            rf"{_START}\d{{6}} [1-9]\d{{6}}{_END}",
            rf"{_START}\d{{2}}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[1-9]\d{{6}}{_END}",
            rf"{_START}\d{{2}}-\d{{2}}-\d{{6}}-\d{{2}}{_END}",
            rf"{_START}[A-Z]\d{{8}}{_END}",
            rf"{_START}\d{{3}}-\d{{2}}-\d{{4}}{_END}",
        ]
    )
)

_REGION = r"[가-힣]{1,6}(?:특별시|광역시|특별자치시|특별자치도)|[가-힣]{2,3}도"
_DISTRICT = r"[가-힣]{1,4}[시군구]"
_STREET = r"[가-힣0-9]{1,10}(?:대로|로|길|동|리|가)"
_LOT = r" ?(?:\d{1,4}번길 )?(?:산 ?)?\d{1,4}(?:-\d{1,4})?(?:번지)?(?: ?\d{1,4}호)?"
_FLAT = r"(?:, ?(?:\d{1,4}동 ?)?\d{1,5}호)?"
_NOT_LOT = r"(?![\d.,]*\d)(?!\s?(?:일|월|년|%|개|건|명|원|차|항|조|시간|분기|번길|퍼센트|점|위|회))"
ADDRESS_KO = re.compile(
    rf"(?:\(?\d{{5}}\)? )?(?:(?:{_REGION}) (?:{_DISTRICT} ){{1,2}}|(?:{_DISTRICT} ){{1,2}}(?={_STREET} ?\d{{1,4}}(?:번길|번지|-)| ?{_STREET} \d))(?:[가-힣]{{1,6}}[읍면] )?{_STREET}{_LOT}{_NOT_LOT}{_FLAT}"
)
_ROAD = r"(?:Street|Avenue|Road|Way|Court|Close|Lane|Drive|Place|Terrace|Square|Crescent|Row|Hill|Gate|Walk|Gardens|Green|Parade|(?:St|Ave|Rd|Ln|Dr|Ct|Pl|Blvd)\.?|Boulevard)"
_PROPER = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ’'\-]+"
_TOWN = rf"(?:,? (?:[A-Z]{{1,3}}-)?\d{{4,5}} {_PROPER}(?: {_PROPER})?|, {_PROPER}(?: {_PROPER})?(?: [A-Z]{{0,2}}\d[A-Z\d]* ?\d?[A-Z\d]{{0,4}})?)?"
ADDRESS_X = re.compile(
    "|".join(
        [
            rf"{_START}(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \w{{1,5}}, )?\d{{1,5}}[A-Za-z]? (?:{_PROPER} ){{1,3}}{_ROAD}(?![A-Za-z]){_TOWN}",
            rf"{_START}\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|square|passage) (?:(?:de|du|des|la|le|les|l['’]|d['’]|aux?) ?)*{_PROPER}(?:[ \-](?:de|du|des|la|le|les|{_PROPER}))*{_TOWN}",
            rf"{_START}(?:(?:Am|An der|Im|Zum|Zur|Auf der) )?[A-ZÄÖÜ][a-zäöüß\-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|steig|hof|markt|graben) \d{{1,4}} ?[a-z]?(?![A-Za-z\d]){_TOWN}",
            rf"{_START}[A-ZÄÖÜ][a-zäöüß\-]+(?:er|e) (?:Straße|Weg|Platz|Allee|Gasse|Ring|Ufer|Damm) \d{{1,4}} ?[a-z]?(?![A-Za-z\d]){_TOWN}",
        ]
    )
)

_FAMILY1, _FAMILY2, _W1 = N.FAMILY1, N.FAMILY2, N.W
_GIVEN = "[가-힣]{1,2}"
NAME_KO = rf"(?:(?:{'|'.join(_FAMILY2)})(?: ?{_GIVEN}| [가-힣] [가-힣])|[{_FAMILY1}](?:{_GIVEN}| [가-힣] [가-힣]| [가-힣]{{2}}))"
_TITLES_KO = "과장|팀장|부장|차장|대리|사원|주임|계장|국장|실장|소장|원장|센터장|교수|연구원|선임|책임|간사|주무관|사무관|서기관|변호사|회계사|위원|위원장|이사|감사|대표|선생|박사|조교|강사|의원|장관|씨|님|군|양"
_CUES_KO = "|".join(
    [
        r"담당(?:자)?\s?[:：]\s?",
        r"문의는 ",
        r"신청인 ",
        r"청구인 ",
        r"피?신청인\s?[:：]?\s?",
        r"대표자\s?[:：]\s?",
        r"작성자\s?[=:：]\s?",
        r"검토자\s?[=:：]\s?",
        r"성명\s?[|:：]\s?",
        r"이 문서는 ",
        r"작성하고 ",
        r"회의에는 ",
        r"수신인\s?[:：]?\s?",
    ]
)
_NAME_KO_AFTER = re.compile(rf"(?:{_CUES_KO})({NAME_KO})(?=\s*(?:{_TITLES_KO})?\s*(?:[(,;|/.\s]|님이|에게|이 |가 |은 |는 |등이|$))")
_NAME_KO_BEFORE = re.compile(rf"(?<![가-힣])({NAME_KO})(?=[이가]? ?제출한 의견|님이 (?:작성|검토)|님(?:께서|에게|이) | ?\((?:인|서명)\)| (?:{_TITLES_KO})[은는이가] 위 안건)")
_NAME_KO_LIST = re.compile(rf"(?<=회의에는 )({NAME_KO}(?:\s?[,·]\s?{NAME_KO})*)(?= ?등이| ?[이가] 참석)")
_NAME_KO_ONE = re.compile(NAME_KO)

NAME_X = rf"(?:(?:{_W1}|[A-Z]\.) (?:[A-Z]\. )?{_W1}|{_W1}, (?:{_W1}|[A-Z]\.))"
_TITLES_X = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|M|Herrn?|Frau|Monsieur|Madame|Messrs)\.?"
_CUES_X = "|".join(
    [
        rf"(?<![A-Za-z]){_TITLES_X} ",
        r"(?:[Dd]rafted|[Cc]hecked|[Pp]repared|[Ww]ritten|[Aa]pproved|[Ss]igned|[Rr]eviewed) by ",
        r"and mention ",
        r"[Cc]ontact\s?: ",
        r"author=",
        r"(?<![A-Za-z])[Ss]igned\)?:? ",
        r"(?<![A-Za-z])[Ss]ignée? ",
        r"[Gg]ezeichnet ",
        r"gez\. ",
        r"[Aa]ttended by ",
        r"(?:Name|Nom|Applicant|Director|Representative|Manager)\s?[|:=]\s?",
        r"(?:Ansprechpartner(?:in)?|Bearbeiter(?:in)?|Verfasser(?:in)?|Rédacteur|Rédactrice|Auteur)\s?: ",
    ]
)
_NAME_X_AFTER = re.compile(rf"(?:{_CUES_X})(?:{_TITLES_X} )?({NAME_X})(?![A-Za-zÀ-ÿ])")
_NAME_X_BEFORE = re.compile(rf"(?<![A-Za-zÀ-ÿ] )(?<![A-Za-zÀ-ÿ,\-])({NAME_X})(?= (?:asked for|objected to|attended|was present|requested a copy))")
_NAME_X_LIST = re.compile(rf"(?:[Pp]resent were |[Aa]nwesend waren |[Éé]taient présents |[Aa]ttended by )({NAME_X}(?:, {NAME_X})*(?:,? (?:and|und|et) {NAME_X})?)")
_NAME_X_ONE = re.compile(NAME_X)


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    stop: int
    text: str


_FIRST = re.compile(r"[^\W_]|\+")


# What an entity is anchored at: cheap to search for, and the patterns above run only around it.
_AT_ANCHOR = re.compile(r"@|골뱅이|[(\[]at[)\]]", re.I)
_SPOKEN_ANCHOR = re.compile(r" at (?=[A-Za-z0-9\-]+ dot |[A-Za-z0-9\-]+ dot$)", re.I)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = re.compile(r"[\d(+][\d\-. ()/]{7,}|[A-Z]\d{8}|[공영]일[공영일육칠팔구]")
_LOT_ANCHOR = re.compile(r"[시군구읍면] [가-힣0-9]{1,10}(?:로|길|동|리|가) ?\d")
#: The longest Korean address that the pattern allows, before and behind its anchor.
_LOT_BACK, _LOT_AHEAD = 48, 64
_ROAD_ANCHORS = (re.compile(rf" {_ROAD}(?![A-Za-z])"), re.compile(r"\d,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route|cours|square|passage) "))
_ROAD_ENDS = tuple("straße strasse str. weg platz allee gasse ring ufer damm steig hof markt graben Straße Weg Platz Allee Gasse Ring Ufer Damm".split())
_ENDS_LOT = re.compile(r"[a-zß.] \d")
# Plain strings that a name's cue holds, looked for with str.find; pattern; words before and behind that it may take.
_NAME_ANCHORS = (
    ("담당 문의는 신청인 청구인 대표자 작성자 검토자 성명 수신인".split() + ["이 문서는 ", "작성하고 ", "회의에는 "], _NAME_KO_AFTER, 2, 7),
    ("제출한 의견|님이 |님께서|님에게|(인)|(서명)|위 안건".split("|"), _NAME_KO_BEFORE, 5, 3),
    (
        ["Mr", "Ms", "Mrs", "Miss ", "Dr", "Prof", "Mme", "Mlle", "M. ", "Herr", "Frau ", "Monsieur ", "Madame ", " by ", "mention ", "ontact"]
        + ["author=", "igned", "igné", "ezeichnet ", "gez. ", "Name", "Nom", "Applicant", "Director", "Representative", "Manager", "partner", "earbeiter", "erfasser", "édact", "Auteur"],
        _NAME_X_AFTER,
        2,
        8,
    ),
    ([" asked for", " objected to", " attended", " was present", " requested a copy"], _NAME_X_BEFORE, 5, 4),
)
# What opens a list of names, which is then read to its own end.
_LIST_ANCHORS = (
    (["회의에는 "], _NAME_KO_LIST, _NAME_KO_ONE, False),
    (["resent were ", "nwesend waren ", "taient présents ", "ttended by "], _NAME_X_LIST, _NAME_X_ONE, True),
)


def _at(text: str, words: list[str]) -> Iterator[tuple[int, int]]:
    for w in words:
        at = text.find(w)
        while at >= 0:
            yield at, at + len(w)
            at = text.find(w, at + len(w))


def _words_back(text: str, at: int, n: int) -> int:
    """Where the n-th word before at begins, however long the words are."""
    for _ in range(n):
        at = text.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


def _words_ahead(text: str, at: int, n: int) -> int:
    for _ in range(n):
        at = text.find(" ", at + 1)
        if at < 0:
            return len(text)
    return at


def _touching(text: str, anchor: tuple[int, int], pattern: re.Pattern, start: int, stop: int) -> Iterator[re.Match]:
    """Matches of pattern within start..stop that touch the anchor, or end shortly before it."""
    for m in pattern.finditer(text, max(0, start), min(len(text), stop)):
        if m.start() <= anchor[1] and m.end() >= anchor[0] - 8:
            yield m


def _email(text: str, at: int, pattern: re.Pattern) -> Iterator[re.Match]:
    """The address whose local part ends before at, from that part's own beginning to its own end."""
    while at > 0 and text[at - 1] == " ":
        at -= 1
    start = at
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    while start < at and not text[start].isalnum():
        start += 1
    if start < at and (m := pattern.match(text, start)):
        yield m


def _spans(text: str) -> Iterator[tuple[str, int, int]]:
    for anchors, pattern in ((_AT_ANCHOR, EMAIL), (_SPOKEN_ANCHOR, EMAIL_SPOKEN)):
        for at in anchors.finditer(text):
            for m in _email(text, at.start(), pattern):
                yield "email", *m.span()
    for digits in _DIGITS.finditer(text):
        # The run holds the whole number but for two characters before it and spelled digits, 13 at most.
        for kind, pattern in (("id_number", ID_NUMBER), ("phone", PHONE)):
            for m in _touching(text, digits.span(), pattern, digits.start() - 2, digits.end() + 20):
                yield kind, *m.span()
    for lot in _LOT_ANCHOR.finditer(text):
        for m in _touching(text, lot.span(), ADDRESS_KO, lot.start() - _LOT_BACK, lot.end() + _LOT_AHEAD):
            yield "address", *m.span()
    roads = [m.span() for anchor in _ROAD_ANCHORS for m in anchor.finditer(text)]
    roads += [m.span() for m in _ENDS_LOT.finditer(text) if text.endswith(_ROAD_ENDS, 0, m.start() + 1)]
    for road in roads:
        for m in _touching(text, road, ADDRESS_X, _words_back(text, road[0], 8), _words_ahead(text, road[1], 14)):
            yield "address", *m.span()
    for words, pattern, back, ahead in _NAME_ANCHORS:
        for cue in _at(text, words):
            for m in _touching(text, cue, pattern, _words_back(text, cue[0], back), _words_ahead(text, cue[1], ahead)):
                yield "name", *m.span(1)
    for words, pattern, one, within in _LIST_ANCHORS:
        for start, stop in _at(text, words):
            m = pattern.match(text, start - 1) if within else pattern.match(text, stop)
            if m:
                for n in one.finditer(text, *m.span(1)):
                    yield "name", *n.span()


def _folded(text: str) -> str:
    return text.translate(_FOLD) if _FOLDED.search(text) else text


_RANK = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4, "tagged": 5}


def find(text: str, tagger: N.Tagger | None = None) -> list[Entity]:
    """Entities in order of position, without overlaps: where two overlap, the kind that comes first in
    the order of certainty (email, id_number, phone, address, name by a cue, name by the tagger) holds, then the longer one."""
    folded = _folded(text)
    taken, out = bytearray(len(text)), []
    spans = set(_spans(folded))
    if tagger:
        spans.update(("tagged", a, b) for a, b in tagger.names(folded))
    for kind, a, b in sorted(spans, key=lambda s: (_RANK[s[0]], s[1], -s[2])):
        first = _FIRST.search(folded, a, b)
        if first is None or any(taken[a:b]):
            continue
        taken[a:b] = b"\x01" * (b - a)
        out.append(Entity("name" if kind == "tagged" else kind, first.start(), b, text[first.start() : b]))
    return sorted(out, key=lambda e: e.start)


# Persons: the parts of a name, and which mentions are of one.
_TITLE_BEFORE = re.compile(rf"({_TITLES_X})\s$")
_SURNAME = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:{_TITLES_X}) ({_W1})(?![A-Za-zÀ-ÿ])(?! [A-ZÀ-Ý])")
_FEMALE_TITLE, _MALE_TITLE = re.compile("Mrs|Ms|Miss|Mme|Mlle|Frau|Madame"), re.compile("Mr|Herr|M|Monsieur")


@dataclass
class Name:
    """family and given are positions in the text of the mention (start, stop); given may be missing."""

    family: tuple[int, int]
    given: tuple[int, int] | None
    gender: str


def _korean(text: str) -> bool:
    return "가" <= text[:1] <= "힣"


def parts_of(text: str, before: str = "", after: str = "") -> Name:
    if _korean(text):
        n = 2 if text[:2] in _FAMILY2 else 1
        given = (n, len(text)) if len(text) > n else None
        female = re.match(r"\s?(?:양|여사|부인)", after) or text[-1:] in _FEMALE_ENDS
        male = re.match(r"\s?군", after) or text[-1:] in _MALE_ENDS
        return Name((0, n), given, "f" if female else "m" if male else "")
    title = _TITLE_BEFORE.search(before)
    gender = "f" if title and _FEMALE_TITLE.match(title[1]) else "m" if title and _MALE_TITLE.match(title[1]) else ""
    words = [m.span() for m in re.finditer(rf"{_W1}|[A-Z]\.", text)] or [(0, len(text))]
    if len(words) == 1:
        return Name(words[0], None, gender)
    return Name(words[0], words[1], gender) if "," in text else Name(words[-1], words[0], gender)


def _plain(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.translate(_FOLD).casefold())


class Persons:
    """Which mentions of a document are of one person: those of equal family name whose given names are
    equal, or one of which is the other's initial or missing."""

    def __init__(self):
        self.known: list[tuple[str, str, str]] = []  # family, given, gender

    def of(self, text: str, name: Name) -> int:
        family, given = _plain(text[slice(*name.family)]), _plain(text[slice(*name.given)]) if name.given else ""
        for i, (f, g, gender) in enumerate(self.known):
            if f == family and (g == given or not given or not g or (min(len(g), len(given)) == 1 and g[0] == given[0])):
                self.known[i] = (f, max(g, given, key=len), gender or name.gender)
                return i
        self.known.append((family, given, name.gender))
        return len(self.known) - 1


# Surrogates.
# Syllables of Korean given names (fixed values): first ones, and last ones by gender.
_KO_FIRST = "가 건 경 규 기 다 도 동 리 민 보 상 서 선 성 세 소 수 승 시 아 영 예 유 윤 은 재 정 주 준 지 진 태 하 한 현 혜".split()
_MALE_ENDS, _FEMALE_ENDS = "석 호 철 준 훈 혁 욱 환 섭 범 식 태 빈 찬".split(), "희 숙 미 아 은 연 영 린 경 나 슬 원 주 혜".split()
_KO_PLACE = "가람 나루 다솔 마루 바다 사랑 아람 자연 하늘 노을 소담 여울 이슬 한별 도담 미르 새솔 온누리".split()
_ONSETS, _VOWELS, _CODAS = "b br c d dr f g gr h j k l m n p r s st t tr v w".split(), "a e i o u ai ea o".split(), "l m n r s t nd rk ll nt".split()
_FAMILY_ENDS = "er ton ley son wick man ard ham by ford more field".split()
_GIVEN_ENDS = {"f": "a ia ine elle ette".split(), "m": "o us an or ric".split(), "": "is en el in yn".split()}


class Surrogates:
    """Replacements for the entities of one document."""

    def __init__(self, key: bytes):
        self.key, self.made, self.used = key, {}, set()

    def noise(self, *parts: object) -> bytes:
        return hmac.new(self.key, "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha512).digest()

    def permuted(self, kind: str, values: list[int], sizes: list[int]) -> list[int]:
        """values, each below its size, under a keyed permutation of all such lists: two halves, each shifted in
        turn by a keyed function of the other (what a Feistel network does, with sums for bits)."""
        half = len(values) // 2
        pack = lambda vs, ns: sum(v * _product(ns[i + 1 :]) for i, v in enumerate(vs))
        left, right = pack(values[:half], sizes[:half]), pack(values[half:], sizes[half:])
        many, few = _product(sizes[half:]), _product(sizes[:half])
        for turn in range(4):
            left = (left + int.from_bytes(self.noise(kind, sizes, turn, "l", right)[:32], "big")) % few
            right = (right + int.from_bytes(self.noise(kind, sizes, turn, "r", left)[:32], "big")) % many
        out = []
        for n, ns in ((left, sizes[:half]), (right, sizes[half:])):
            unpacked = []
            for size in reversed(ns):
                n, v = divmod(n, size)
                unpacked.append(v)
            out += reversed(unpacked)
        return out

    def encoded(self, kind: str, text: str, keep: set[int]) -> str:
        """Digits for digits, letters for letters of the same case, all but the characters at keep."""
        at, values, sizes = [], [], []
        for i, c in enumerate(text):
            alphabet = next((a for a in _ALPHABETS if c in a), None)
            if i not in keep and alphabet and (kind != "phone" or not c.isalpha() or c in _NUMERALS) and (kind != "address" or c not in _NUMERALS):
                at.append((i, alphabet))
                values.append(alphabet.index(c))
                sizes.append(len(alphabet))
        out = list(text)
        for (i, alphabet), v in zip(at, self.permuted(kind, values, sizes), strict=True):
            out[i] = alphabet[v]
        return "".join(out)

    def unique(self, kind: str, who: str, make) -> str:
        """make(try) for the first try whose result no other entity of the document has."""
        if (kind, who) not in self.made:
            n = 0
            while (kind, _plain(made := make(n))) in self.used or _plain(made) == who:
                n += 1
            self.used.add((kind, _plain(made)))
            self.made[kind, who] = made
        return self.made[kind, who]

    def word(self, kind: str, text: str, ends: list[str]) -> str:
        def make(n: int) -> str:
            take = iter(self.noise(kind, _plain(text), n))
            pick = lambda xs: xs[(next(take) * 256 + next(take)) % len(xs)]
            # Each further try may be longer, so that there is always one left.
            return "".join([pick(_ONSETS) + pick(_VOWELS) + pick(_CODAS), *[pick(_VOWELS) + pick(_CODAS) for _ in range(n // 64)], pick(ends)]).capitalize()

        made = self.unique(kind, _plain(text), make)
        return made.upper() if text.isupper() and len(text) > 1 else made

    def hangul(self, kind: str, text: str, pools: list[list[str]]) -> str:
        def make(n: int) -> str:
            take = iter(self.noise(kind, text, n))
            return "".join(pool[(next(take) * 256 + next(take)) % len(pool)] for pool in [*pools[:1] * (n // 64), *pools])

        return self.unique(kind, text, make)

    def name(self, text: str, name: Name, person: tuple[str, str, str]) -> str:
        """text with its parts replaced: equal parts of names alike, so that all mentions of a person agree."""
        family, given, gender = person
        if _korean(text):
            plain = re.sub(r"\s", "", text)
            own = _FAMILY2 if plain[:2] in _FAMILY2 else list(_FAMILY1)
            last = _MALE_ENDS if gender == "m" else _FEMALE_ENDS if gender == "f" else _KO_FIRST
            given_pools = [_KO_FIRST] * (len(plain) - len(own[0]))
            made = self.hangul("person", plain, [own, *given_pools[:-1], *([last] if given_pools else [])])
            # Blanks stay where they were.
            out = iter(made)
            return "".join(c if c.isspace() else next(out, "") for c in text) + "".join(out)
        out = {name.family: self.word("family", text[slice(*name.family)], _FAMILY_ENDS)}
        if name.given:
            seen = text[slice(*name.given)]
            made = self.word("given" + gender, given or seen, _GIVEN_ENDS[gender])
            out[name.given] = made[0] + "." if seen.endswith(".") else made.upper() if seen.isupper() else made
        done, at = "", 0
        for (a, b), made in sorted(out.items()):
            done, at = done + text[at:a] + made, b
        return done + text[at:]

    def address(self, text: str) -> str:
        """Streets, towns and numbers replaced; the words that tell their kind stay, as does the order."""
        if re.search("[가-힣]", text):
            stem = lambda m: self.hangul("place", m[1], [_KO_PLACE]) + m[2]
            named = re.sub(r"(?<![가-힣0-9])([가-힣]{1,10}?)(특별시|광역시|특별자치시|특별자치도|도|시|군|구|읍|면|대로|로|길|동|리|가)(?=[ \d]|$)", stem, text)
        else:

            def other(m: re.Match) -> str:
                word = m[0]
                if _KEPT_WORD.fullmatch(word):
                    return word
                end = next((e for e in _ROAD_ENDS if word.endswith(e) and len(word) > len(e)), "")
                return self.word("place", word[: len(word) - len(end)], _FAMILY_ENDS if not end else ["en", "er", "el"]) + end

            named = re.sub(r"[A-ZÀ-Ý][A-Za-zÀ-ÿ’'\-]*[A-Za-zÀ-ÿ.]", other, text)
        return self.encoded("address", named, {i for i, c in enumerate(named) if not c.isdigit()})

    def of(self, e: Entity) -> str:
        """The replacement of what isn't a name."""
        if e.kind == "address":
            return self.address(e.text)
        if e.kind == "phone":
            # The number of the country or network stays, as its format hangs on it.
            digits = [i for i, c in enumerate(e.text) if c.isdigit() or c in _NUMERALS]
            return self.encoded("phone", e.text, set(digits[:3]))
        if e.kind == "id_number":
            digits = [i for i, c in enumerate(e.text) if c.isdigit()]
            # Of a resident's number the date stays one, and the digit that tells century and gender stays.
            keep = {digits[i] for i in (2, 4, 6)} if len(digits) == 13 and re.match(r"[\d０-９]{6}", e.text) else set()
            return self.encoded("id_number", e.text, keep)
        domain = re.search(r"\.?[A-Za-z]+$", e.text)
        return self.encoded("email", e.text, {*range(domain.start(), len(e.text)), *[i for m in re.finditer(r"[(\[]at[)\]]|[(\[]dot[)\]]|(?<= )(?:at|dot)(?= )", e.text, re.I) for i in range(*m.span())]})


def _product(sizes: list[int]) -> int:
    out = 1
    for s in sizes:
        out *= s
    return out


_NUMERALS = "공일이삼사오육칠팔구"
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "０１２３４５６７８９", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ", _NUMERALS)
# Words of an address that tell its kind.
_KEPT_WORD = re.compile(rf"{_ROAD}|Flat|Apt\.?|Apartment|Unit|Suite|Room|Am|An|Im|Zum|Zur|Auf|Straße|Weg|Platz|Allee|Gasse|Ring|Ufer|Damm|[A-Z]{{1,3}}")


def redact(text: str, key: bytes, tagger: N.Tagger | None = None) -> tuple[list[Entity], str, str]:
    """(entities, text with placeholders, text with surrogates); the rest of the text is unchanged. A family name
    alone behind a title is no entity of its own, but is replaced as well if it is that of a person found."""
    found, surrogates, persons, numbers = find(text, tagger), Surrogates(key), Persons(), {}
    # All mentions first, as a later one may tell a given name or gender.
    mentions: list[tuple[Entity, Name | None, int]] = []
    for e in found:
        name = parts_of(e.text, text[max(0, e.start - 16) : e.start], text[e.stop : e.stop + 4]) if e.kind == "name" else None
        mentions.append((e, name, persons.of(e.text, name) if name else -1))
    families = {f for f, *_ in persons.known}
    held = bytearray(len(text))
    for e in found:
        held[e.start : e.stop] = b"\x01" * (e.stop - e.start)
    for m in _SURNAME.finditer(text) if families else ():
        if _plain(m[1]) in families and not any(held[m.start(1) : m.end(1)]):
            e = Entity("name", m.start(1), m.end(1), m[1])
            name = parts_of(e.text, text[max(0, e.start - 16) : e.start])
            mentions.append((e, name, persons.of(e.text, name)))
    placed, natural, at = [], [], 0
    for e, name, person in sorted(mentions, key=lambda x: x[0].start):
        who = person if name else _plain(e.text)
        n = numbers.setdefault((e.kind, who), sum(k == e.kind for k, _ in numbers) + 1)
        placed += [text[at : e.start], f"[{e.kind.upper()}_{n}]"]
        natural += [text[at : e.start], surrogates.name(e.text, name, persons.known[person]) if name else surrogates.of(e)]
        at = e.stop
    return found, "".join([*placed, text[at:]]), "".join([*natural, text[at:]])


_RESULT = StructType(
    [
        StructField("entities", ArrayType(StructType([StructField("pii_kind", StringType()), StructField("start_pos", IntegerType()), StructField("length", IntegerType())]))),
        StructField("placeholders", StringType()),
        StructField("surrogates", StringType()),
    ]
)


def _redacting(key: bytes, tagger: N.Tagger | None):
    @F.pandas_udf(_RESULT)
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found, placed, natural = redact(t, key, tagger) if t is not None else ([], None, None)
                rows.append(([{"pii_kind": e.kind, "start_pos": e.start + 1, "length": e.stop - e.start} for e in found], placed, natural))
            yield pd.DataFrame(rows, columns=["entities", "placeholders", "surrogates"])

    return redacted


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for t in batch["text"]:
            folded = _folded(t)
            rows += N.labelled(folded, [(e.kind, e.start, e.stop) for e in find(folded)])
        yield pd.DataFrame(rows, columns=["features", "name"])


def name_tagger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> N.Tagger:
    """The tagger of names, fitted besides its own sentences to a sample of docs: the SAMPLE_DOCS with the
    smallest hashes of their ids, and of their candidates SAMPLE_NONE at most."""
    ids = docs.filter(F.col(text).isNotNull()).select(id_col, F.xxhash64(id_col).alias("_h")).orderBy("_h", id_col).limit(N.SAMPLE_DOCS).select(id_col)
    sample = docs.filter(F.col(text).isNotNull()).select(id_col, F.col(text).alias("text")).join(F.broadcast(ids), id_col, "left_semi")
    examples = sample.select("text").mapInPandas(_labelled, "features array<string>, name boolean")
    rows = examples.orderBy(~F.col("name"), F.hash("features"), "features").limit(N.SAMPLE_NONE).collect()
    return N.train((list(r.features), r.name) for r in rows)


def redacted(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text", tagger: N.Tagger | None = None) -> DataFrame:
    """(doc_id, entities, placeholders, surrogates) of every document.

    key is the secret that surrogates hang on. Without tagger one is trained on a sample of docs. Null text gives no
    entities and null texts, empty text stays empty. Positions count characters from 1. Copies of a document are
    treated alike, as replacements depend on key and text only.
    """
    tagger = tagger or name_tagger(docs, id_col, text)
    done = docs.select(id_col, _redacting(key, tagger)(F.col(text)).alias("_r"))
    return done.select(id_col, "_r.entities", "_r.placeholders", "_r.surrogates")


def occurrences(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per occurrence: doc_id, pii_kind, start_pos."""
    exploded = found.select(id_col, F.explode("entities").alias("e"))
    return exploded.select(id_col, F.col("e.pii_kind").alias("pii_kind"), F.col("e.start_pos").cast("long").alias("start_pos"))
