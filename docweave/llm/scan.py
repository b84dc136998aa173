"""Repair of text read from scanned pages.

Method: perceptrons decide everything. Furniture (running heads, page numbers) is told by page-position features
(furniture.py). An averaged-perceptron character editor (editor.py) says for each word what its letters should
become: keep, replace, delete or insert; known words within reach are looked up by deletion keys, and the
editor's score decides between them and keeping the word. A third perceptron predicts line joins.
What the corpus knows of a word (how often it is seen, whole, hyphenated or suspended) are counts over all pages.

Everything that concerns a scan or a word is an aggregate with a map-side part; no scan is gathered
in one task. A page's own lines are handled in the page's row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import editor as E
from docweave.llm import furniture as U
from docweave.session import cut

#: A correction must occur so often, and so many times as often as the word.
LEAST_COUNT, RATIO = 3, 8
#: How much being frequent speaks for a correction, beside the editor's score.
FREQUENT = 0.5
#: Hyphenated and suspended forms in the training sample of the line joins.
SAMPLE_FORMS = 3_000
HYPHENS = U.HYPHENS
_WORD = re.compile(r"[^\W_]+")


def _split(text: str, drop: set[int]) -> tuple[list[str], list[str]]:
    lines = text.split("\n")
    return [x for i, x in enumerate(lines) if i not in drop], [x for i, x in enumerate(lines) if i in drop]


def shape(word: str) -> str:
    """Lower case; numbers of a word without Latin letters are alike."""
    low = word.lower()
    return low if re.search("[a-zà-ÿ]", low) else re.sub(r"\d+", "0", low)


_BREAK = re.compile(rf"([^\W_]+)[{HYPHENS}]\s*$")
_FIRST = re.compile(r"^\s*([^\W_]+)")


def _goes_on(following: str | None) -> bool:
    return bool(following) and (following[0].islower() or "가" <= following[0] <= "힣")


def body_words(text: str, drop: set[int]) -> tuple[list[str], list[str], list[str], list[tuple[str, str]], str | None, str | None]:
    """(words, hyphenated forms, suspended forms, breaks, half at the page's end, first word) of a page. A break is
    (first half, second half). Halves aren't among the words."""
    body, dropped = _split(text, drop)
    words, hyphenated, suspended, breaks, skip_first, half = [], [], [], [], False, None
    full = [line for line in body if line.strip()]
    for at, line in enumerate(full):
        m = _BREAK.search(line)
        if skip_first:
            line = _FIRST.sub("", line, count=1)
            skip_first = False
        if m:
            following = (f[1] if (f := _FIRST.match(full[at + 1])) else None) if at + 1 < len(full) else None
            if at + 1 == len(full) or _goes_on(following):
                if at + 1 == len(full):
                    half = m[1]
                else:
                    breaks.append((m[1], following))
                    skip_first = True
                line = line[: m.start() - len(full[at])] if len(line) >= len(full[at]) - m.start() else ""
        words += _WORD.findall(line)
        hyphenated += re.findall(r"[^\W_]+-[^\W_]+", line)
        suspended += re.findall(r"[^\W_]+- [^\W_]+", line)
    for line in dropped:
        words += _WORD.findall(line)
    first = _FIRST.match(full[0]) if full else None
    return words, hyphenated, suspended, breaks, half, first[1] if first else None


def _edge_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(s, p, r, sorted(U.codes(t, p or 0))) for s, p, r, t in zip(batch["scan_id"], batch["page_no"], batch["row_id"], batch["text"], strict=True)]
        yield pd.DataFrame(rows, columns=["scan_id", "page_no", "row_id", "codes"])


_JUDGED = "scan_id long, page_no int, row_id long, text string, drop array<int>, kinds array<string>"


def _judging(judge: U.Judge):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s, p, r, t, known, on in zip(*[batch[c] for c in ("scan_id", "page_no", "row_id", "text", "known", "on")], strict=True):
                kinds = judge.kinds(t, p or 0, dict(zip(known, on, strict=True)) if known is not None else {})
                rows.append((s, p, r, t, sorted({i for i, _ in kinds}), [k for _, k in kinds]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _JUDGED.split(", ")])

    return run


def sample_lines(pages: DataFrame) -> list[list[str]]:
    """Lines of the SAMPLE_PAGES pages with the smallest hashes of their ids, SAMPLE_LINES of each."""
    lines = F.slice(F.split("text", "\n"), 1, U.SAMPLE_LINES).alias("lines")
    rows = pages.filter(F.col("text").isNotNull()).select("row_id", F.xxhash64("row_id").alias("h"), lines).orderBy("h", "row_id").limit(U.SAMPLE_PAGES).collect()
    return [list(r.lines) for r in rows]


def furniture(pages: DataFrame, judge: U.Judge) -> DataFrame:
    """pages with drop, the lines that are furniture, and kinds, of what sort (running_head, page_number; both where the
    number stands within the head). Pages read twice count once for recurrence."""
    usable = pages.filter(F.col("text").isNotNull()).select("scan_id", "page_no", "row_id", "text")
    found = cut(usable.mapInPandas(_edge_codes, "scan_id long, page_no int, row_id long, codes array<long>"))
    each = found.select("scan_id", "page_no", "row_id", F.explode("codes").alias("code"))
    recurring = each.groupBy("scan_id", "code").agg(F.countDistinct("page_no").alias("on")).filter("on > 1")
    known = each.join(recurring, ["scan_id", "code"]).groupBy("row_id").agg(F.collect_list(F.struct("code", "on")).alias("k"))
    ready = usable.join(known.select("row_id", F.col("k.code").alias("known"), F.col("k.on").alias("on")), "row_id", "left")
    return ready.mapInPandas(_judging(judge), _JUDGED)


_PAGE_WORDS = "scan_id long, page_no int, row_id long, forms array<string>, counts array<long>, words array<string>, first array<string>, second array<string>, half string, opening string"


def _page_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per page: its different forms with counts (a word, w:word; hyphenated, h:a-b; suspended, s:a- b), its
    words, and its breaks. This is a fraction of a row per word."""
    for batch in batches:
        rows = []
        for s, p, r, t, drop in zip(batch["scan_id"], batch["page_no"], batch["row_id"], batch["text"], batch["drop"], strict=True):
            words, hyphenated, suspended, breaks, half, opening = body_words(t, set(drop))
            shapes = Counter(map(shape, words))
            forms = Counter({"w:" + w: n for w, n in shapes.items()})
            forms.update("h:" + h.lower() for h in hyphenated)
            forms.update("s:" + h.lower() for h in suspended)
            rows.append((s, p, r, list(forms), list(forms.values()), list(shapes), [a.lower() for a, _ in breaks], [b.lower() for _, b in breaks], half, opening))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGE_WORDS.split(", ")])


def _looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forms whose counts decide about a break, by role."""
    for batch in batches:
        rows = []
        for a, b in zip(batch["first"], batch["second"], strict=True):
            rows += [(a, b, "joined", "w:" + shape(a + b)), (a, b, "first", "w:" + shape(a)), (a, b, "hyphenated", f"h:{a}-{b}"), (a, b, "suspended", f"s:{a}- {b}")]
            if b:
                rows.append((a, b, "second", "w:" + shape(b)))
        yield pd.DataFrame(rows, columns=["first", "second", "role", "form"])


def _joining(joiner: E.Linear):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[c].tolist() for c in ("first", "second", "joined", "hyphenated", "suspended", "n_first", "n_second")]
            rows = [(a, b, shape(a + b), joiner.score(E.join_features(a, b, *map(int, n))) > 0) for a, b, *n in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=["first", "second", "word", "joins"])

    return run


def _keyed(misread: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, n, xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 63)) for w, n in zip(batch["word"], batch["n"], strict=True) for k in E.keys(w, misread)]
            yield pd.DataFrame(rows, columns=["word", "n", "key"])

    return run


def _scored(model: E.Editor):
    """The candidates that the editor's best operations make; and numbers with letters read in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for word, candidates in zip(batch["word"], batch["candidates"], strict=True):
                table = model.table(word)
                for c in candidates:
                    score = model.score(word, c["candidate"], table)
                    if score is None and E.numeral(word) == c["candidate"] and re.search(r"\d", word):
                        score = 0.0
                    if score is not None:
                        rows.append((word, c["candidate"], score, c["m"]))
            yield pd.DataFrame(rows, columns=["word", "candidate", "score", "m"])

    return run


class Repair:
    """All that is found on a set of pages: scan_id, page_no, row_id, text. Null text is left out; empty
    text has no noise. Ties and repeated pages are kept as they are. A page without number recurs like others."""

    def __init__(self, pages: DataFrame):
        judge = U.train(sample := sample_lines(pages), sorted({w.lower() for p in sample for line in p for w in _WORD.findall(line) if len(w) > 1}))
        self.pages = cut(furniture(pages, judge))
        found = cut(self.pages.mapInPandas(_page_words, _PAGE_WORDS))
        forms = found.select(F.explode(F.arrays_zip("forms", "counts")).alias("f"))
        self.lexicon = cut(forms.groupBy(F.col("f.forms").alias("form")).agg(F.sum("f.counts").alias("n")))
        self.breaks = self._breaks(found)
        self.joins = cut(self._joined())
        joined = self.breaks.join(self.joins.filter("joins"), ["first", "second"])
        self.hyphens = joined.select("row_id").distinct()
        whole = joined.filter(F.col("second") != "")
        self.words = found.select("row_id", F.explode("words").alias("word")).unionByName(whole.select("row_id", "word"))
        self.corrections = cut(self._corrected(whole))

    def _breaks(self, found: DataFrame) -> DataFrame:
        """(row_id, first, second): a word broken at a page's end has its second half from the next page, and
        none where that isn't there."""
        within = found.select("row_id", F.explode(F.arrays_zip("first", "second")).alias("b")).select("row_id", "b.first", "b.second")
        opening = found.groupBy("scan_id", (F.col("page_no") - 1).alias("page_no")).agg(F.min_by("opening", "row_id").alias("second"), F.lit(True).alias("there"))
        ends = found.filter(F.col("half").isNotNull()).select("scan_id", "page_no", "row_id", F.lower("half").alias("first")).join(opening, ["scan_id", "page_no"], "left")
        goes_on = F.col("second").rlike("^[가-힣]") | ((F.col("second") == F.lower("second")) & F.col("second").rlike(r"^\p{L}"))
        across = ends.filter(F.col("there").isNull() | goes_on).select("row_id", "first", F.lower(F.coalesce("second", F.lit(""))).alias("second"))
        return cut(within.unionByName(across))

    def _joined(self) -> DataFrame:
        """(first, second, word, joins): whether the hyphen between only breaks the word."""
        spark, kind = self.lexicon.sparkSession, lambda k: self.lexicon.filter(F.col("form").startswith(k))
        # Bounded samples: the most frequent forms.
        top = lambda k, most: [(r.form[2:], r.n) for r in kind(k).orderBy(F.col("n").desc(), "form").limit(most).collect()]
        pair = lambda forms, sign: [(*form.split(sign, 1), n) for form, n in forms]
        joiner = E.train_joiner(top("w:", E.SAMPLE_WORDS), pair(top("h:", SAMPLE_FORMS), "-"), pair(top("s:", SAMPLE_FORMS), "- "))
        asked = self.breaks.select("first", "second").distinct().mapInPandas(_looked_up, "first string, second string, role string, form string")
        n = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0))
        known = asked.join(self.lexicon, "form", "left").groupBy("first", "second").agg(
            n("joined").alias("joined"), n("hyphenated").alias("hyphenated"), n("suspended").alias("suspended"), n("first").alias("n_first"), n("second").alias("n_second")
        )
        return known.mapInPandas(_joining(joiner), "first string, second string, word string, joins boolean")

    def _corrected(self, whole: DataFrame) -> DataFrame:
        """(word, correction) for every misread word."""
        words = self.lexicon.filter(F.col("form").startswith("w:")).select(F.substring("form", 3, 1 << 30).alias("word"), "n")
        joined = whole.groupBy("word").agg(F.count("*").alias("n"))
        counts = cut(words.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") > 1))
        frequent = counts.filter(F.col("n") >= LEAST_COUNT).orderBy(F.col("n").desc(), "word")
        # The bounded training sample: the words seen most often are the least likely to be misread.
        sample = [r.word for r in frequent.limit(E.SAMPLE_WORDS).collect()]
        if not sample:
            return counts.select("word", F.col("word").alias("correction")).limit(0)
        model = E.train(sample)
        # Little data, much work: a fixed number of partitions, which isn't merged to the size of the data.
        parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        schema = "word string, n long, key long"
        most = counts.agg(F.max("n").alias("most"))
        rare = counts.join(F.broadcast(most), F.col("n") * RATIO <= F.col("most")).select("word", "n").mapInPandas(_keyed(True), schema)
        known = counts.filter(F.col("n") >= LEAST_COUNT).mapInPandas(_keyed(False), schema).select(F.col("word").alias("candidate"), F.col("n").alias("m"), "key")
        near = rare.join(known, "key").filter((F.col("m") >= RATIO * F.col("n")) & (F.col("candidate") != F.col("word")))
        asked = near.groupBy("word").agg(F.collect_set(F.struct("candidate", "m")).alias("candidates")).repartition(parts, "word")
        rated = asked.mapInPandas(_scored(model), "word string, candidate string, score double, m long")
        best = F.max_by("candidate", F.struct(F.col("score") + FREQUENT * F.log("m"), "candidate"))
        return rated.groupBy("word").agg(best.alias("correction"))

    def noise(self) -> DataFrame:
        """(row_id, noise_kind), one row per page and kind."""
        furnished = self.pages.select("row_id", F.explode(F.array_distinct("kinds")).alias("noise_kind"))
        misread = self.words.join(self.corrections, "word", "left_semi").select("row_id").distinct()
        return furnished.unionByName(self.hyphens.withColumn("noise_kind", F.lit("hyphen"))).unionByName(misread.withColumn("noise_kind", F.lit("misread")))

    def paragraphs(self) -> DataFrame:
        """(row_id, scan_id, page_no, text) with text repaired: furniture gone, broken words joined, misread
        words put right in the case they had, lines of a paragraph in one line."""
        fixes = self.words.join(self.corrections, "word").groupBy("row_id").agg(F.collect_set(F.struct("word", "correction")).alias("fixes"))
        joined = self.breaks.join(self.joins.filter("joins"), ["first", "second"])
        joins = joined.groupBy("row_id").agg(F.collect_set(F.concat_ws("|", "first", "second")).alias("joins"))
        ready = self.pages.join(fixes, "row_id", "left").join(joins, "row_id", "left")
        return ready.mapInPandas(_repaired, "row_id long, scan_id long, page_no int, text string")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r, s, p, t, drop, fixes, joins in zip(*[batch[c] for c in ("row_id", "scan_id", "page_no", "text", "drop", "fixes", "joins")], strict=True):
            made = {f["word"]: f["correction"] for f in fixes} if fixes is not None else {}
            rows.append((r, s, p, repair_text(t, set(drop), made, set(joins) if joins is not None else set())))
        yield pd.DataFrame(rows, columns=["row_id", "scan_id", "page_no", "text"])


def _cased(word: str, correction: str) -> str:
    if word.isupper() and len(word) > 1:
        return correction.upper()
    return correction[0].upper() + correction[1:] if word[:1].isupper() else correction


def repair_text(text: str, drop: set[int], fixes: dict[str, str], joins: set[str]) -> str:
    """One page repaired. A word broken across pages is completed here; the next page keeps its half,
    as it stands alone there."""
    body, _ = _split(text, drop)
    out, glue = "", False
    blank = True
    for i, line in enumerate(body):
        if not line.strip():
            blank = True
            continue
        indented = line[:2].isspace()
        line = line.strip()
        if not out:
            out = line
        elif glue:
            out += line
        elif blank or indented:
            out += "\n\n" + line
        else:
            out += " " + line
        blank = glue = False
        if m := _BREAK.search(out):
            rest = next((x for x in body[i + 1 :] if x.strip()), None)
            if rest is None:
                # The half on the next page is known by the break it makes.
                for pair in joins:
                    half, _, following = pair.partition("|")
                    if half == m[1].lower() and following:
                        out = out[: m.end(1)] + following
                        break
            elif (f := _FIRST.match(rest)) and f"{m[1].lower()}|{f[1].lower()}" in joins:
                out = out[: m.end(1)]
                glue = True

    def fixed(m: re.Match) -> str:
        word = m.group()
        made = fixes.get(shape(word))
        if made is None or made == shape(word):
            return word
        if "0" in made and re.search(r"\d", word):
            numbers = iter(re.findall(r"[\dlIOo]*\d[\dlIOo]*", word))
            made = re.sub("0", lambda _: next(numbers, "0").translate(str.maketrans("lIOo", "1100")), made)
        return _cased(word, made)

    return _WORD.sub(fixed, out)


def result_pages(results: DataFrame) -> DataFrame:
    return results.select("scan_id", "page_no", F.col("ocr_id").alias("row_id"), F.col("extracted_text").alias("text"))


def output_pages(outputs: DataFrame) -> DataFrame:
    """The pages that enhanced_text carries in full, in their order; the cut-short quotes at the images are
    left out, as the whole pages follow. row_id is scan_id and page in one number, for 2^24 pages of
    a scan and 2^39 scans."""
    whole = F.regexp_extract_all("enhanced_text", F.lit(r"(?s)```text\n(.*?)\n```"), F.lit(1))
    pages = outputs.select("scan_id", F.posexplode(whole).alias("at", "text"))
    return pages.select("scan_id", (F.col("at") + 1).cast("int").alias("page_no"), (F.shiftleft(F.col("scan_id"), 24) + F.col("at")).alias("row_id"), "text")


def scan_texts(outputs: DataFrame) -> DataFrame:
    """(scan_id, text): the pages of each scan repaired, in order, one text per scan. Scans without pages
    give no row."""
    repaired = Repair(output_pages(outputs)).paragraphs()
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return repaired.groupBy("scan_id").agg(F.concat_ws("\n\n", F.transform(ordered, lambda p: p["text"])).alias("text"))
