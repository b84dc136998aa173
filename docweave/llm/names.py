"""A tagger for names of persons: an averaged perceptron over the context and the shape of whatever might be one.

Two capitalized words, an initial and a word, or a Korean family name with one or two syllables are
candidates wherever they stand. The model is trained on sentences made from the frames below, filled with
invented names, bodies and places, and on a bounded sample of the documents at hand, in which what the
sure patterns of pii.py find are names and all other candidates are none. It sees the words around a
candidate (whole and by their beginnings and ends), punctuation and shape, so it generalizes to
phrasings that no pattern lists; what it learns about the words of names themselves helps where
a known name stands in a context without any cue.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

#: Documents in the training sample; candidates of it, at most; passes.
SAMPLE_DOCS, SAMPLE_NONE, PASSES = 1_000, 20_000, 6
#: The perceptron's margin in training, and the scores that Latin and Korean candidates must reach.
MARGIN, LATIN_SCORE, KOREAN_SCORE = 4.0, 6.0, 4.0

# Korean family names (fixed values), the ones of two syllables first.
FAMILY2 = "남궁 황보 제갈 사공 선우 서문 독고 동방".split()
FAMILY1 = "김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모"
W = r"[A-ZÀ-Ý](?:[a-zà-ÿ]+|[A-ZÀ-Ý]+)(?:[\-’'][A-ZÀ-Ý](?:[a-zà-ÿ]+|[A-ZÀ-Ý]+))?"
LATIN = re.compile(rf"(?<![A-Za-zÀ-ÿ.\-@_/])(?=((?:{W}|[A-Z]\.) (?:[A-Z]\. )?{W})(?![A-Za-zÀ-ÿ]))")
HANGUL = re.compile(rf"(?<![가-힣A-Za-z0-9])((?:{'|'.join(FAMILY2)})[가-힣]{{1,2}}|[{FAMILY1}][가-힣]{{2}})(?=(?:님|씨)?(?:[은는이가을를의와과도께]|에게|에서|께서|이라고|라고|이다|입니다)?(?:[\s.,;:)\]’”\"']|$))")

# What a person is called or does, for frames made of both.
_PERSONS = {
    "en": "teacher doctor clerk driver judge baker student witness neighbour chairman farmer officer lawyer editor tenant customer member applicant brother daughter uncle colleague pilot singer guard visitor painter reporter".split(),
    "de": "Lehrer Arzt Fahrer Richterin Bäcker Schüler Zeuge Nachbarin Bauer Anwältin Mieter Kunde Mitglied Antragsteller Bruder Tochter Onkel Kollege Pilotin Sänger Besucher Malerin Reporter".split(),
    "fr": "professeur médecin chauffeur juge boulanger élève témoin voisin fermier avocate locataire client membre demandeur frère fille oncle collègue pilote chanteuse visiteur peintre".split(),
    "ko": "교사 의사 기사 판사 학생 증인 이웃 위원장 농부 경찰관 변호사 편집자 세입자 고객 위원 신청인 동생 딸 삼촌 동료 조종사 가수 방문객 화가 기자 주민 직원 담당자 대표 원장 감독 선수 배우 상인 소방관".split(),
}
_DEEDS = {
    "en": "said,explained,answered,left,arrived,called,wrote,died,moved,lives,works,thinks,agreed,refused,asked,paid,complained,smiled,visited,returned,knows,spoke,signed,came,told".split(","),
    "de": "sagte,erklärte,antwortete,ging,kam,rief,schrieb,starb,zog,wohnt,arbeitet,meint,lehnte,fragte,zahlte,besuchte,kehrte,weiß,unterschrieb,berichtete,dachte".split(","),
    "fr": "déclara,expliqua,répondit,partit,arriva,appela,écrivit,mourut,vit,habite,travaille,pense,accepta,refusa,demanda,paya,visita,revint,sait,parla,signa,vint".split(","),
    "ko": "말했다 설명했다 답했다 떠났다 도착했다 전화했다 썼다 이사했다 산다 일한다 생각한다 동의했다 거절했다 물었다 냈다 웃었다 방문했다 돌아왔다 안다 서명했다 왔다 결석했다 주장했다 태어났다 살았다".split(),
}

# Frames: {n} is a name, {o} a body or heading, {p} a place.
_FRAMES = {
    "en": """my friend {n} moved to {p} | our neighbour {n} called the {o} | the teacher {n} said that | {n} told us that the {o} | {n} wrote a letter to | I spoke with {n} about the | {n} was born in {p} |
        an answer from {n} reached the | please call {n} at home | {n} works for the {o} | her husband {n} and | the witness {n} stated | patient {n} was treated in {p} | his sister {n} lives in {p} | tenant {n} paid the | thanks to {n} for |
        {n} lives at | {n} explained why | {n} , aged 43 , | according to {n} , the | the secretary {n} noted | employee {n} left the {o} | {n} 's mother | a complaint by {n} against the {o} | director {n} opened the | {n} thinks that | {n} asked whether | dear {n} ,""",
    "de": """mein Freund {n} zog nach {p} | unser Nachbar {n} rief die {o} an | die Lehrerin {n} sagte | {n} schrieb einen Brief an | ich sprach mit {n} über | {n} wurde in {p} geboren | die Zeugin {n} erklärte | der Mieter {n} zahlte | laut {n} ist die {o} |
        {n} wohnt in {p} | {n} arbeitet bei der {o} | ihr Mann {n} und | Kollegin {n} meinte | Direktor {n} eröffnete | bitte rufen Sie {n} an | ein Antrag von {n} gegen | {n} erläuterte | Patient {n} wurde""",
    "fr": """mon ami {n} habite à {p} | notre voisine {n} appela la {o} | le témoin {n} déclara | {n} écrivit une lettre à | j' ai parlé avec {n} de | {n} est née à {p} | selon {n} , la {o} | {n} travaille pour la {o} | son mari {n} et | la directrice {n} ouvrit |
        le patient {n} fut soigné | {n} expliqua | {n} demeure à | une plainte de {n} contre | le locataire {n} paya | cher {n} , | notre collègue {n} pense""",
    "ko": """친구 {n}이 {p}로 이사했다 | 이웃 {n}은 전화했다 | 교사 {n}가 설명했다 | {n} 씨는 답했다 | {n} 씨의 집 | {n}님께 알렸다 | 증인 {n}은 진술했다 | 환자 {n}의 기록 | 세입자 {n}가 냈다 | 동생 {n}과 함께 | {n} 선생은 가르쳤다 | {n} 박사가 발표했다 |
        학생 {n}은 결석했다 | 직원 {n}에게 물었다 | {n} 변호사를 만났다 | {n} 대표는 밝혔다 | 남편 {n}과 | 어머니 {n}는 | {n} 군이 | {n} 양은 | 주민 {n}이 제기했다 | 피해자 {n}은 | {n} 교수는 주장했다 | {n} 의원이 물었다 | 배우 {n}의""",
}
_NONE = {
    "en": "the {o} published the | {o} | in {p} the | annual meeting of the {o} | under the {o} of | {o} said that the | from {p} to {p} | the {o} wrote a letter to | on {o} and {o} | see {o} , chapter | {o} : | according to {o} , the | {o} works for the {o} | the town of {p} was | {o} asked whether",
    "de": "die {o} gilt ab | der {o} wird | die {o} schrieb einen Brief an | {o} | in {p} wurde | ab {p} | seit {p} | laut {o} ist | gemäß {o} | der {o} erklärte | von {p} nach {p} | Sitzung der {o} | {o} und {o}",
    "fr": "la {o} écrivit une lettre | {o} | à {p} la | selon la {o} , | de {p} à {p} | séance de la {o} | {o} et {o} | la {o} expliqua",
    "ko": "이 {o} 필요하다 | {o} 높다 | 모든 {o} 조사했다 | 그 {o} 전액 | {o} 정한다 | {o}은 정한다 | {o}의 기록 | {o}가 설명했다 | {o}에서 | {o}를 제출하고 | 모든 {o}은 | 해당 {o}이 | {o} 및 {o} | 새 {o}의 | {o}에게 알렸다 | {o} 대표는 밝혔다 | {o} 직원은",
}
_BODIES = {
    "en": [f"{a} {b}" for a in "Harbour City Central Annual Public National Housing Water Review Regional Finance Safety Local Joint School Data Appeals Legal Health Senior General".split() for b in "Office Council Library Committee Report Board Agency Court Department Notice Service Authority Programme Fund Rules Centre Plan Meeting Budget Act".split()],
    "de": [f"{a} {b}" for a in "Städtische Zentrale Neue Öffentliche Regionale Gemeinsame Technische Allgemeine Erste Zweite".split() for b in "Bibliothek Behörde Verwaltung Kommission Ordnung Stelle Prüfung Sitzung Abteilung Kasse Satzung".split()],
    "fr": [f"{a} {b}" for a in "Commission Agence Direction Régie Mairie Chambre Autorité Cellule Mission Société".split() for b in "Générale Centrale Publique Régionale Municipale Technique Nationale Permanente Locale Annuelle".split()],
    "ko": "이용자 조사관 정보원 전문가 이사회 주민회 안전망 지원금 신청서 공무원 위원회 고객층 기관장 문서철 임대료 도서관 박물관 유치원 연구소 제출처 관리인 방문객 조합원 보고서 계약서 심의회 구청장 정책과 배상금 한국어 서비스 이행률 장학금 허가증 고지서 원산지 마을회 지방세 강의실 차량등 성적표 현황판 우편물 표준안 소비자 유효성 방청객 선거인".split(),
}
# Last syllables of Korean nouns that aren't persons.
_NOUN_ENDS = "성 청 률 율 료 비 금 소 실 도 액 제 권 법 서 국 과 회 관 력 량 화 론 물 품 점 식 처 부 용 업 형".split()
# What follows a noun of two syllables.
_PARTICLES = list("은는이가을를의와과도에로만서")
_PLACES = {"en": "Port Ellery;North Barrow;New Stanton;Lower Mill;Friday Evening;Tuesday Morning;East Harrow;Upper Green;Saint Orban".split(";"), "de": "Bad Orlen;Neu Ulmen;Alt Harrow;Dienstag Abend;Freitag Mittag;Mittwoch Nachmittag;Sonntag Morgen;Ober Weiden".split(";"), "fr": "Mont Orval;Saint Brice;Port Vallon;Val Clair".split(";"), "ko": "새마을 큰고을 들머리 물가촌 솔고개".split()}


def invented(rng: random.Random, lang: str) -> str:
    """A name that no list holds."""
    if lang == "ko":
        syllable = lambda: chr(0xAC00 + rng.randrange(19) * 588 + rng.choice((0, 4, 8, 13, 18, 20)) * 28 + rng.choice((0, 0, 0, 4, 8, 16, 21)))
        return (rng.choice(FAMILY1) if rng.random() < 0.97 else rng.choice(FAMILY2)) + syllable() + syllable()
    part = lambda: rng.choice("b br c d dr f g gr h j k l m n p r s st t tr v w".split()) + rng.choice("a e i o u ai ea".split()) + rng.choice("l m n r s t nd rk ll".split())
    given, family = (part() + rng.choice(("", "a", "e", "in", "o"))).capitalize(), (part() + rng.choice(("", "er", "ton", "ley", "son", "wick", "mann", "ard"))).capitalize()
    if rng.random() < 0.08:
        given = given[0] + "."
    if rng.random() < 0.05:
        family = f"{family}-{part().capitalize()}"
    return f"{given} {family}"


def candidates(text: str) -> Iterator[tuple[int, int]]:
    for m in LATIN.finditer(text):
        yield m.span(1)
    for m in HANGUL.finditer(text):
        yield m.span(1)


#: Candidates whose own score a worker remembers.
REMEMBERED = 50_000
_ZEROS = [0.0] * 64
_OWN = ("k", "w=", "s=", "upper", "mixed", "initial", "full")
_TOKEN = re.compile(r"[^\W_]+(?:[’'][^\W\d_]+)?|[^\w\s]")
_AFTER = re.compile(rf"\s*({_TOKEN.pattern})?\s*({_TOKEN.pattern})?")
#: Characters before a candidate in which its neighbours are looked for.
_NEAR = 28


def own_features(name: str) -> list[str]:
    """What is seen of a candidate alone."""
    if "가" <= name[0] <= "힣":
        return ["k" + str(len(name)), "kf=" + name[0], "k1=" + name[-2], "k2=" + name[-1], "k=" + name]
    words = name.split(" ")
    return ["w=" + w for w in words] + ["s=" + w[-3:] for w in words] + ["upper" if name.isupper() else "mixed", "initial" if name[1:2] == "." else "full"]


def features(text: str, start: int, stop: int) -> list[str]:
    """What is seen around a candidate."""
    before = _TOKEN.findall(text, max(0, start - _NEAR), start)
    after = _AFTER.match(text, stop)
    p1, p2 = before[-1] if before else "^", before[-2] if len(before) > 1 else "^"
    n1, n2 = after[1] or "$", after[2] or "$"
    glued = "+" if text[stop : stop + 1].isalnum() else ""
    low1, low2 = p1.lower(), n2.lower()
    next1 = glued + n1.lower()
    return [
        "p1=" + low1, "p2=" + p2.lower() + " " + low1, "n1=" + next1, "n2=" + next1 + " " + low2, "pn=" + low1 + "_" + next1, "pe=" + low1[-3:], "ne=" + next1[-3:], "nb=" + next1[:3], "ne2=" + low2[-2:], "pn2=" + low1[-2:] + "_" + next1[:2],
        "p1 is " + ("lower" if p1.islower() else "upper" if p1[0].isupper() else "digit" if p1.isdigit() else p1), "n1 is " + ("lower" if n1.islower() else "upper" if n1[0].isupper() else "digit" if n1.isdigit() else n1),
        "line" if not text[max(0, start - 2) : start].rstrip(" ")[-1:].strip() else "within",
    ]


def _deed(rng: random.Random, lang: str, subject: str) -> str:
    person, deed = rng.choice(_PERSONS[lang]), rng.choice(_DEEDS[lang])
    if subject == "{o}":
        # Nouns stand where names do, but for titles: their last syllables tell them apart.
        after = rng.choice(("은", "는", "이", "가", "의", "에", "과", "를", "와", ""))
        return rng.choice((f"{person} {subject}{after} {deed}", f"{subject}{after} {deed}", f"{subject}{after} {{o}}{after} 높다", f"새 {subject}{after} {person}"))
    if lang == "ko":
        after = rng.choice(("은", "는", "이", "가", "의 집", "에게", "과", " 씨는", " 씨가", "님이", " 씨의", " 군은", " 양이", " 선생은", " 박사가", "님께"))
        return rng.choice((f"{person} {subject}{after} {deed}", f"어제 {subject}{after} {deed}", f"{subject}{after} {person}", f"{person} {subject}{after}"))
    article = {"en": ("the", "our", "my", "a"), "de": ("der", "die", "unsere", "ein"), "fr": ("le", "la", "notre", "mon")}[lang]
    return rng.choice((f"{rng.choice(article)} {person} {subject} {deed}", f"{subject} {deed} and", f"{rng.choice(article)} {person}, {subject},", f"{person} {subject} {deed}"))


def _filled(rng: random.Random, lang: str, frame: str) -> tuple[str, list[tuple[int, int, bool]]]:
    text, spans = rng.choice(("", "", ". ", "\n", ", ")), []
    for part in re.split(r"(\{[nop]\})", frame):
        if part in ("{n}", "{o}", "{p}"):
            made = invented(rng, lang) if part == "{n}" else rng.choice((_BODIES if part == "{o}" else _PLACES)[lang])
            if lang == "ko" and part == "{o}" and rng.random() < 0.8:
                made = invented(rng, lang)[:2] + rng.choice(_NOUN_ENDS if rng.random() < 0.6 else _PARTICLES)
            spans.append((len(text), len(text) + len(made), part == "{n}"))
            part = made
        text += part
    return text, spans


def _examples(rng: random.Random) -> Iterator[tuple[list[str], bool]]:
    split = lambda frames: [f.strip() for f in frames.split("|")]
    for lang in _FRAMES:
        frames = split(_FRAMES[lang]) * 10 + [_deed(rng, lang, "{n}") for _ in range(1_500)] + split(_NONE[lang]) * 80 + [_deed(rng, lang, "{o}") for _ in range(1_500 * (lang == "ko"))]
        for frame in frames:
            text, spans = _filled(rng, lang, frame)
            for a, b, name in spans:
                # Bodies in frames of names may be the name of a person as well: only names count there.
                if name or "{n}" not in frame:
                    yield own_features(text[a:b]) + features(text, a, b), name


class Tagger:
    """floors: what the words alone of Latin and Korean names score at least in training. A candidate below that isn't
    looked at further."""

    def __init__(self, weights: dict[str, float], floors: tuple[float, float] = (-1e9, -1e9)):
        self.weights, self.floors = weights, floors
        self.alone: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "floors": self.floors, "alone": {}}

    def own(self, name: str) -> float:
        known = self.alone.get(name)
        if known is None:
            if len(self.alone) >= REMEMBERED:
                self.alone.clear()
            known = self.alone[name] = sum(map(self.weights.get, own_features(name), _ZEROS))
        return known

    def score(self, text: str, start: int, stop: int) -> float:
        return self.own(text[start:stop]) + sum(map(self.weights.get, features(text, start, stop), _ZEROS))

    def names(self, text: str) -> list[tuple[int, int]]:
        """The candidates above the margin; of those that overlap the best ones."""
        scored = []
        for a, b in candidates(text):
            korean = text[a] >= "가"
            if self.own(text[a:b]) >= self.floors[korean] and (s := self.score(text, a, b)) >= (KOREAN_SCORE if korean else LATIN_SCORE):
                scored.append((-s, a, b))
        out: list[tuple[int, int]] = []
        for _, a, b in sorted(scored):
            if all(b <= c or d <= a for c, d in out):
                out.append((a, b))
        return sorted(out)


def labelled(text: str, found: list[tuple[str, int, int]]) -> Iterator[tuple[list[str], bool]]:
    """Examples from a document in which found (kind, start, stop) is sure: its names, and as none of them the
    candidates that touch nothing found."""
    names = {(a, b) for kind, a, b in found if kind == "name"}
    taken = bytearray(len(text))
    for _, a, b in found:
        taken[a:b] = b"\x01" * (b - a)
    for a, b in candidates(text):
        if (a, b) in names:
            yield own_features(text[a:b]) + features(text, a, b), True
        elif not any(taken[a:b]):
            yield own_features(text[a:b]) + features(text, a, b), False


def train(sample: Iterable[tuple[list[str], bool]] = (), seed: int = 11) -> Tagger:
    """sample: labelled examples from documents, in any order; the result depends on them and the seed only."""
    rng = random.Random(seed)
    examples = [*_examples(rng), *sample]
    weights: dict[int, float] = {}
    sums: dict[int, float] = {}
    step = 0
    for _ in range(PASSES):
        rng.shuffle(examples)
        for fs, name in examples:
            step += 1
            score = sum(weights.get(f, 0.0) for f in fs)
            sign = 1 if name else -1
            # A wide margin on both sides; names may lose the words next to them, so that no single one decides.
            if sign * score < (2 * MARGIN if name else MARGIN / 2):
                for f in fs if not name or rng.random() < 0.5 else [f for f in fs if rng.random() < 0.7]:
                    weights[f] = weights.get(f, 0.0) + sign
                    sums[f] = sums.get(f, 0.0) + sign * step
    averaged = {f: w - sums[f] / (step + 1) for f, w in weights.items()}
    tagger = Tagger({f: round(w, 4) for f, w in averaged.items() if abs(w) > 1e-3})
    floors = [1e9, 1e9]
    for fs, name in examples:
        if name:
            own = [f for f in fs if f.startswith(_OWN)]
            korean = own[0][0] == "k"
            floors[korean] = min(floors[korean], sum(map(tagger.weights.get, own, _ZEROS)))
    return Tagger(tagger.weights, tuple(floors))
