"""Registered queries of the core operators and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import sizes
from docweave.functions import text as X
from docweave.operators import assets as A
from docweave.operators import blocks as B
from docweave.operators import diff as D
from docweave.operators import forms as FM
from docweave.operators import history as H
from docweave.operators import layout as Y
from docweave.operators import legal as L
from docweave.operators import rules as R
from docweave.operators import scores as S
from docweave.session import table
from docweave.sources import files as FS
from docweave.sources import writers as W


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.law_history(table(spark, d, "law_revisions")).select("law_id", "revision_number", "valid_from", "valid_to")


def p6_history(spark: SparkSession, d: str) -> DataFrame:
    return H.law_history(table(spark, d, "law_revisions"))



_EMAIL = R.PII_PATTERNS["email"]


def email_pii_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Documents, hits and documents with hits by language; languages without hits have zeros."""
    docs = table(spark, d, "documents").select("lang", F.size(F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0))).alias("n"))
    hits = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0))
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(hits).alias("hits"), F.sum((hits > 0).cast("long")).alias("affected"))


def email_masked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").rlike(_EMAIL))
    return docs.select("doc_id", F.length(R.masked_emails(F.col("text"))).cast("long").alias("n"), F.size(F.split(R.masked_emails(F.col("text"), "●"), "●")).cast("long").alias("parts"))


def pii_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.detect_pii(table(spark, d, "documents"), "doc_id", "text")


def pii_redacted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.redacted_text(F.col("text")).alias("text"))


def markdown_redacted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "convert_results").select("result_id", R.redacted_text(F.col("markdown"), markdown=True).alias("markdown"))


def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    return R.lint(table(spark, d, "documents"), "doc_id", "text")


def text_tidy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.tidy(F.col("text"))).alias("digest"))


def text_dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.dense(F.col("text"))).alias("digest"))


def text_comparable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "convert_results").select("result_id", F.md5(X.comparable(F.col("markdown"))).alias("digest"))


def garbled_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_runs").filter(F.col("text").isNotNull()).select("run_id", F.round(X.garbled_share(F.col("text")), 6).alias("share"))


def markdown_structure(spark: SparkSession, d: str) -> DataFrame:
    md = table(spark, d, "convert_results").filter(F.col("markdown").isNotNull())
    return md.select("result_id", *[c.alias(n) for n, c in X.structure(F.col("markdown")).items()])


def list_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(X.is_list_line(F.col("line")).cast("long")).alias("list_lines"), F.count("*").alias("lines"))


def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_chunks").select("chunk_id", X.heading_level(F.col("content")).cast("int").alias("level"))


def markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of the places of all text runs in their blocks."""
    n = F.coalesce("run_idx", F.lit(0)) + F.coalesce("block_idx", F.lit(0)) % 500
    t = table(spark, d, "text_runs").select("run_id", n.cast("int").alias("n"))
    return t.select("run_id", "n", X.ganada(F.col("n")).alias("ganada"), X.chosung(F.col("n")).alias("chosung"), X.letters(F.col("n") + 1).alias("letters"), X.roman(F.col("n") + 1).alias("roman"))


def document_copies(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicates(table(spark, d, "documents"), "doc_id", "text")


def image_assets(spark: SparkSession, d: str) -> DataFrame:
    return A.image_rows(table(spark, d, "convert_results"))


def asset_manifests(spark: SparkSession, d: str) -> DataFrame:
    return A.manifests(A.image_rows(table(spark, d, "convert_results")))


def char_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    windows = docs.select("doc_id", F.posexplode(B.char_windows(F.col("text"), 500, 50)).alias("window_no", "w"))
    return windows.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.md5("w").alias("digest"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sizes.estimated_tokens(F.col("text")).alias("tokens"))


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    return B.chunks(table(spark, d, "convert_results"), "result_id", "markdown", most=1000, overlap=100)


def markdown_rendered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "convert_results").select("result_id", B.blocks_markdown(B.markdown_blocks(F.col("markdown"))).alias("markdown"))


def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "convert_results").select(F.explode(B.markdown_blocks(F.col("markdown"))).alias("b"))
    return blocks.groupBy("b.kind").agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Each conversion of a file beside the one before it. Only ids are brought together by file; the texts, of
    which a file may have a large share, are joined to the pairs by id."""
    w = Window.partitionBy("source_file").orderBy("converted_at", "result_id")
    rows = table(spark, d, "convert_results")
    pairs = rows.filter(F.col("source_file").isNotNull()).select("result_id", F.lag("result_id").over(w).alias("_before")).filter(F.col("_before").isNotNull())
    new = rows.select("result_id", "title", F.col("markdown").alias("after"))
    old = rows.select(F.col("result_id").alias("_before"), F.col("markdown").alias("before"), F.col("title").alias("title_before"))
    return pairs.join(new, "result_id").join(old, "_before").filter(F.col("before").isNotNull()).drop("_before")


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.document_diff(_versions(spark, d), "result_id", "before", "after")


def version_word_diff(spark: SparkSession, d: str) -> DataFrame:
    """Word diffs of the text and of the title; field says which."""
    of = lambda field, before, after: D.word_diffs(_versions(spark, d), "result_id", before, after).withColumn("field", F.lit(field))
    return of("markdown", "before", "after").unionByName(of("title", "title_before", "title"))


def version_table_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.table_diffs(_versions(spark, d), "result_id", "before", "after")


def version_line_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.line_diffs(_versions(spark, d), "result_id", "before", "after")


def version_unified_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.unified_diffs(_versions(spark, d), "result_id", "before", "after")


def version_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.score(_versions(spark, d), "result_id", "after", "before")


def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the titles of conversions that follow each other, whatever their script."""
    w = Window.partitionBy("source_file").orderBy("converted_at", "result_id")
    pairs = table(spark, d, "convert_results").select("result_id", "title", F.lag("title").over(w).alias("before")).filter(F.col("before").isNotNull() & F.col("title").isNotNull())
    return pairs.select("result_id", F.round(X.similarity(F.col("title"), F.col("before")), 6).alias("similarity"))


def part_name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of part names that follow each other."""
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    pairs = table(spark, d, "part").select("p_partkey", "p_name", F.lag("p_name").over(w).alias("before")).filter(F.col("before").isNotNull())
    return pairs.select("p_partkey", F.round(X.similarity(F.col("p_name"), F.col("before")), 6).alias("similarity"))


def layout_elements(spark: SparkSession, d: str) -> DataFrame:
    """The elements of scanned pages: the boxes of a page with its lines of text, in order, as runs."""
    lines = F.filter(F.split(F.coalesce("extracted_text", F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    boxes = F.slice("bounding_boxes", 1, F.least(F.size("bounding_boxes"), F.size(lines)))
    runs = F.transform(boxes, lambda b, i: F.struct(b["x"].alias("x"), (842 - b["y"] - b["height"]).alias("y"), b["width"].alias("width"), b["height"].alias("size"), F.trim(F.element_at(lines, i + 1)).alias("text"), F.lit(False).alias("bold")))
    pages = table(spark, d, "ocr_results").filter(F.size(F.coalesce("bounding_boxes", F.array())) > 0).select("ocr_id", runs.alias("runs"))
    return Y.page_elements(pages, ["ocr_id"])


def layout_bins(spark: SparkSession, d: str) -> DataFrame:
    """Where the boxes of a page begin, in bins of ten points: what columns are told by."""
    pages = table(spark, d, "ocr_results").select("ocr_id", F.explode(Y.begin_bins(F.col("bounding_boxes"))).alias("b"))
    return pages.select("ocr_id", "b.bin", "b.n")


def ocr_targets(spark: SparkSession, d: str) -> DataFrame:
    """Pages that must be read from their image, of the first two pages of a scan."""
    pages = page_classes(spark, d).join(table(spark, d, "ocr_results").select("ocr_id", "page_no"), "ocr_id")
    wanted = spark.createDataFrame([(1,), (2,)], "page_no int")
    return S.ocr_targets(pages, wanted).select("ocr_id", "page_no", "category")


def docx_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every conversion's Markdown written as a word processor file, and that file converted again."""
    rows = table(spark, d, "convert_results").filter(F.col("markdown").isNotNull())
    made = rows.select(F.concat(F.lit("/made/"), F.col("result_id").cast("string"), F.lit(".docx")).alias("path"), W.generated(F.col("markdown")).alias("content"))
    done = FS.convert(made)
    return done.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("result_id"), "format", F.length("markdown").alias("characters"), "error")


def form_formats(spark: SparkSession, d: str) -> DataFrame:
    """The dates of headers as forms write them."""
    rows = table(spark, d, "hwp3_headers").filter(F.col("doc_date").isNotNull())
    return rows.select("header_id", FM.loose_date(F.col("doc_date")).alias("iso"), FM.fill_format(F.col("doc_date"), "date:yyyy.mm.dd").alias("dotted"), FM.fill_format(F.col("doc_date"), "date:yy/m/d").alias("short"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages beside the page before of the same scan."""
    w = Window.partitionBy("scan_id").orderBy("page_no", "ocr_id")
    rows = table(spark, d, "ocr_results")
    return rows.select("ocr_id", F.col("extracted_text").alias("hyp"), F.lag("extracted_text").over(w).alias("ref")).filter(F.col("ref").isNotNull())


def ngram_matches(spark: SparkSession, d: str) -> DataFrame:
    return S.ngram_precision(_pages(spark, d), "ocr_id", "hyp", "ref")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Measurements in long form: confidence and covered share of pages, by language and scan."""
    rows = table(spark, d, "ocr_results").withColumn("cover", S.grid_cover(F.col("bounding_boxes"), 595.0, 842.0))
    unpivoted = rows.selectExpr("ocr_id", "scan_id", "page_no", "lang", "stack(2, 'confidence', confidence, 'cover', cover) AS (metric, value)")
    return unpivoted.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    board = S.scoreboard(_samples(spark, d).filter("metric = 'confidence'"), ["lang", "scan_id"])
    return board.select("level", "lang", "scan_id", "metric", F.round("mean", 6).alias("mean"), "n")


def scoreboard_pivot(spark: SparkSession, d: str) -> DataFrame:
    return S.pivoted(_samples(spark, d), "lang", ["confidence", "cover"]).select("lang", F.round("confidence", 6).alias("confidence"), F.round("cover", 6).alias("cover"))


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Odd pages against even ones, by scan."""
    samples = _samples(spark, d).filter("metric = 'confidence'")
    mean = lambda odd: samples.filter(F.col("page_no") % 2 == odd).groupBy("scan_id", "metric").agg(F.avg("value").alias("mean"))
    return S.gate(mean(1), mean(0), ["scan_id"]).select("scan_id", "metric", F.round("current", 6).alias("current"), F.round("baseline", 6).alias("baseline"), "verdict")


def rolling_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = S.rolling_baseline(table(spark, d, "ocr_results").withColumn("o", F.col("page_no") * 1000000 + F.col("ocr_id")), ["scan_id"], "o", "confidence", 3)
    return rows.select("ocr_id", F.round("confidence", 6).alias("confidence"), F.round("baseline", 6).alias("baseline"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return S.disagreements(_samples(spark, d).filter("metric = 'confidence'"), "scan_id", "page_no", 0.2).withColumn("max_spread", F.round("max_spread", 6))


def word_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a scan as tools, words of four letters or more as tokens."""
    words = table(spark, d, "ocr_results").select("scan_id", "page_no", F.explode(F.regexp_extract_all(F.lower("extracted_text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return S.consensus(words.withColumn("page_no", F.col("page_no").cast("string")), "scan_id", "page_no", "word", "1")


def page_classes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "ocr_results").withColumn("cover", S.grid_cover(F.col("bounding_boxes"), 595.0, 842.0))
    c = S.page_class(F.col("cover"), F.lit(0.05))
    return pages.select("ocr_id", F.round("cover", 6).alias("cover"), c["category"].alias("category"))


def boxes_below(spark: SparkSession, d: str) -> DataFrame:
    """Every box that is wider than half the page with the last narrow one at or above it."""
    boxes = table(spark, d, "ocr_results").select("ocr_id", F.posexplode("bounding_boxes").alias("box_no", "b")).select("ocr_id", "box_no", "b.y", "b.width")
    wide, narrow = boxes.filter("width > 297.5"), boxes.filter("width <= 297.5").withColumn("y", F.round("y", 3))
    return S.nearest_above(wide, narrow, "ocr_id", "y", "y").select("ocr_id", "box_no", "y", F.col("line_y").alias("above"))


def event_islands(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events without a gap of more than an hour."""
    events = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"))
    runs = S.islands(events.withColumn("o", F.struct("t", "event_id")), ["user_id"], "o", "t", 3600)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("t").alias("first"), F.max("t").alias("last"))


def legal_references(spark: SparkSession, d: str) -> DataFrame:
    return L.references(table(spark, d, "legal_chunks"), "chunk_id", "content")


def legal_articles(spark: SparkSession, d: str) -> DataFrame:
    return L.articles(table(spark, d, "documents"), "doc_id", "text")


def legal_large_articles(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs_of(table(spark, d, "legal_chunks"), "chunk_id", "content")


def legal_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_chunks").select("chunk_id", L.chunk_id(F.col("law_name"), F.col("article_number"), F.coalesce("content", F.lit(""))).alias("id"))


def legal_annexes(spark: SparkSession, d: str) -> DataFrame:
    """Annexes and forms of every chunk, each under a heading made for it, as the tables hold none of their own."""
    n = lambda k: (F.col("chunk_id") % k + 1).cast("string")
    told = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit("[별표 "), n(9), F.lit("] "), told("article_title"), F.lit("\n"), told("content"), F.lit("\n별지 제"), n(5), F.lit("호서식 "), told("law_name"))
    return L.annexes(table(spark, d, "legal_chunks").select("chunk_id", text.alias("text")), "chunk_id", "text")


def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.embedding_rows(table(spark, d, "legal_chunks")).select("chunk_id", "id", F.md5("text").alias("digest"))


def header_dates(spark: SparkSession, d: str) -> DataFrame:
    return L.header_dates(table(spark, d, "hwp3_headers")).select("header_id", "iso")


def date_expressions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", L.date_expression(F.col("text"), F.to_date(F.lit("2025-01-15"))).alias("e"))
    return docs.filter("e IS NOT NULL").select("doc_id", "e.date", "e.end_date", "e.format")


def form_fields(spark: SparkSession, d: str) -> DataFrame:
    return FM.inline_fields(table(spark, d, "documents"), "doc_id", "text")


def conversion_stats(spark: SparkSession, d: str) -> DataFrame:
    """Conversions by format: how many, how many without text, pages, words."""
    rows = table(spark, d, "convert_results")
    empty = F.sum((F.coalesce(F.col("markdown"), F.lit("")) == "").cast("long"))
    return rows.groupBy("doc_format").agg(F.count("*").alias("results"), empty.alias("failed"), F.sum("page_count").alias("pages"), F.sum("word_count").alias("words"))


def median_font_size(spark: SparkSession, d: str) -> DataFrame:
    sizes_ = table(spark, d, "text_runs").groupBy("font_name").agg(F.percentile("font_size", F.lit(0.5)).alias("m"))
    return sizes_.select("font_name", F.coalesce("m", F.lit(12.0)).alias("median_size"))


QUERIES = {
    f.__name__: f
    for f in (
        p6_found, p6_history, email_pii_by_lang, email_masked, pii_hits, pii_redacted, markdown_redacted, lint_findings, text_tidy, text_dense,
        text_comparable, garbled_share, markdown_structure, list_lines, heading_levels, markers, document_copies, image_assets, asset_manifests, char_windows, token_estimates,
        markdown_chunks, markdown_rendered, block_kinds, version_diff, version_word_diff, version_table_diff, version_line_diff, version_unified_diff, version_scores, title_similarity, part_name_similarity, layout_elements, layout_bins, ocr_targets, docx_round_trip, form_formats, ngram_matches, scoreboard,
        scoreboard_pivot, regression_gate, rolling_confidence, review_queue, word_consensus, page_classes, boxes_below, event_islands, legal_references,
        legal_articles, legal_large_articles, legal_chunk_ids, legal_annexes, embedding_rows, header_dates, date_expressions, form_fields, conversion_stats,
        median_font_size,
    )
}

_ISO = r"""CAST(try_cast(nullif(regexp_replace({0}, '^\D*(\d{{4}})\D*?(\d{{1,2}})\D*?(\d{{1,2}})\D*$', '\1-\2-\3'), '') AS DATE) AS VARCHAR)"""
_HISTORY = rf"""
    WITH n AS (
        SELECT upper(regexp_replace(law_id, '\s+', '', 'g')) AS law_id,
               try_cast(nullif(regexp_extract(revision_number, '(\d+)', 1), '') AS BIGINT) AS num,
               {_ISO.format("revision_date")} AS rd, {_ISO.format("effective_date")} AS ed,
               nullif(trim(law_name), '') AS law_name, nullif(trim(category), '') AS category,
               (received_at, notice_id) AS o
        FROM law_revisions WHERE nullif(trim(law_id), '') IS NOT NULL),
    dated AS (SELECT law_id, rd, min(num) AS num FROM n WHERE num IS NOT NULL AND rd IS NOT NULL GROUP BY ALL),
    filled AS (
        SELECT n.* EXCLUDE (num), coalesce(n.num, dated.num) AS num
        FROM n LEFT JOIN dated ON n.num IS NULL AND n.law_id = dated.law_id AND n.rd = dated.rd),
    revision AS (
        SELECT law_id, num AS revision_number,
               arg_max(law_name, o) FILTER (law_name IS NOT NULL) AS law_name,
               arg_max(category, o) FILTER (category IS NOT NULL) AS category,
               arg_max(rd, o) FILTER (rd IS NOT NULL) AS revision_date,
               arg_max(ed, o) FILTER (ed IS NOT NULL) AS effective_date
        FROM filled WHERE num IS NOT NULL GROUP BY ALL),
    started AS (
        SELECT *, coalesce(effective_date, revision_date) AS valid_from FROM revision
        WHERE coalesce(effective_date, revision_date) IS NOT NULL)
    SELECT COLUMNS_HERE, valid_from,
           coalesce(lead(valid_from) OVER (PARTITION BY law_id ORDER BY valid_from, revision_number), '9999-12-31') AS valid_to
    FROM started"""

_TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), '\A\s+|\s+\z', '', 'g')"
_COMPARABLE = r"substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!\[([^\]]*)\]\([^)]*\)', '<IMG:\1>', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', repeat(chr(10), 2), 'g'), '\A\s+|\s+\z', '', 'g'), 1, 200000)"
_COUNT = lambda text, p: "len(regexp_extract_all({0}, '{1}'))".format(text, p.replace("'", "''"))
_CELLS = """len(list_distinct(flatten(list_transform(list_filter(coalesce(bounding_boxes, []), lambda b: b.width > 0 AND b.height > 0 AND b.x < 595 AND b.y < 842 AND b.x + b.width > 0 AND b.y + b.height > 0),
    lambda b: flatten(list_transform(range(greatest(floor(b.x / 595 * 20), 0)::INT, least(ceil((b.x + b.width) / 595 * 20) - 1, 19)::INT + 1),
        lambda i: list_transform(range(greatest(floor(b.y / 842 * 20), 0)::INT, least(ceil((b.y + b.height) / 842 * 20) - 1, 19)::INT + 1), lambda j: i * 20 + j)))))))"""
_MEASURED = "confidence IS NOT NULL AND NOT isnan(confidence)"
_SIZE_WS = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LAW = L.LAW_REFERENCE
_INNER = L.INNER_REFERENCE
_SIZE = "((8 * length(regexp_replace(content, '[^가-힣]+', '', 'g')) + 3 * length(regexp_replace(content, '[^A-Za-z0-9" + _SIZE_WS + "]+', '', 'g'))) // 12)"
_LINES = r"""SELECT {key}, generate_subscripts(ls, 1) - 1 AS no, trim(unnest(ls), ' ') AS line FROM (SELECT {key}, string_split_regex(regexp_replace({text}, '\r?\n\z', ''), '\r?\n') AS ls FROM {table})"""
_LEVEL_CASE = lambda i: "nullif(last_value(CASE WHEN regexp_matches(line, '{0}') THEN line {1} END IGNORE NULLS) OVER w, '')".format(
    list(L.LEVELS.values())[i], " ".join(f"WHEN regexp_matches(line, '{p}') THEN ''" for p in list(L.LEVELS.values())[:i])
)
_ANY_LEVEL = " OR ".join(f"regexp_matches(line, '{p}')" for p in L.LEVELS.values())
_PART = lambda i: f"nullif(regexp_extract(head, '{L.ARTICLE}', {i}), '')"
_ARTICLES = f"""
    WITH l AS ({_LINES.format(key="doc_id", text="text", table="documents")}),
    h AS (SELECT doc_id, no, line, {", ".join(f"{_LEVEL_CASE(i)} AS {n}_title" for i, n in enumerate(L.LEVELS))},
                 count(*) FILTER (regexp_matches(line, '{L.ARTICLE}')) OVER w AS article_no, {_ANY_LEVEL} AS level
          FROM l WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT doc_id, article_no, {", ".join(f"arg_min({n}_title, no) AS {n}_title" for n in L.LEVELS)}, arg_min(line, no) AS head, string_agg(line, chr(10) ORDER BY no) AS content,
                 CAST(min(no) + 1 AS INT) AS line_start, CAST(max(no) + 1 AS INT) AS line_end
          FROM h WHERE article_no > 0 AND NOT level GROUP BY ALL)
    SELECT doc_id, article_no, {", ".join(f"{n}_title" for n in L.LEVELS)}, {_PART(1)} || coalesce('의' || {_PART(2)}, '') AS article_number, {_PART(3)} AS article_title,
           concat_ws(' > ', {", ".join(f"{n}_title" for n in L.LEVELS)}, '제' || {_PART(1)} || '조' || coalesce('의' || {_PART(2)}, '') || coalesce('(' || {_PART(3)} || ')', '')) AS context_path,
           content, CAST({_SIZE} AS BIGINT) AS token_count, line_start, line_end FROM g"""
_ANNEX_TEXT = "[별표 ' || (chunk_id % 9 + 1) || '] ' || coalesce(article_title, '') || chr(10) || coalesce(content, '') || chr(10) || '별지 제' || (chunk_id % 5 + 1) || '호서식 ' || coalesce(law_name, '')"
_ANNEX_CASE = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(head, '{p}') THEN nullif(regexp_extract(head, '{p}', {i}), '')" for p in L.ANNEXES.values()) + " END"
_ANNEXES = f"""
    WITH t AS (SELECT chunk_id, '{_ANNEX_TEXT} AS text FROM legal_chunks), l AS ({_LINES.format(key="chunk_id", text="text", table="t")}),
    r AS (SELECT *, count(*) FILTER ({" OR ".join(f"regexp_matches(line, '{p}')" for p in L.ANNEXES.values())}) OVER (PARTITION BY chunk_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS region FROM l),
    g AS (SELECT chunk_id, region, arg_min(line, no) AS head, CAST(min(no) AS INT) AS start_line, CAST(max(no) + 1 AS INT) AS end_line, string_agg(line, chr(10) ORDER BY no) AS content FROM r WHERE region > 0 GROUP BY ALL)
    SELECT chunk_id, CASE {" ".join(f"WHEN regexp_matches(head, '{p}') THEN '{n}'" for n, p in L.ANNEXES.items())} END AS annex_type, CAST({_ANNEX_CASE(1)} AS INT) AS number, CAST({_ANNEX_CASE(2)} AS INT) AS sub_number,
           coalesce({_ANNEX_CASE(3)}, '') AS title, start_line, end_line, content FROM g"""
_RULE = lambda subject, rules: " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{n}'" for n, p in rules)
_FORM_FIELDS = f"""
    WITH f AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS seq, unnest(a) AS label, trim(rtrim(unnest(b), chr(13))) AS value
               FROM (SELECT doc_id, regexp_extract_all(text, '{FM.INLINE}', 1) AS a, regexp_extract_all(text, '{FM.INLINE}', 2) AS b FROM documents))
    SELECT doc_id, CAST(seq AS INT) AS seq, label, value, CASE {_RULE("value", FM.VALUE_TYPES)} {_RULE("label", FM.LABEL_TYPES)} ELSE 'text' END AS type,
           regexp_matches(label, '{FM.REQUIRED}') AS required, regexp_matches(value, '{FM.BLANK}') AS empty FROM f"""

_MOVED = lambda n, unit: f"CASE {unit} WHEN '일' THEN CAST({n} AS INT) * INTERVAL 1 DAY WHEN '주' THEN CAST({n} AS INT) * INTERVAL 7 DAY WHEN '달' THEN CAST({n} AS INT) * INTERVAL 1 MONTH WHEN '개월' THEN CAST({n} AS INT) * INTERVAL 1 MONTH WHEN '분기' THEN CAST({n} AS INT) * INTERVAL 3 MONTH WHEN '년' THEN CAST({n} AS INT) * INTERVAL 12 MONTH END"
_DAY = lambda d: f"strftime({d}, '%Y%m%d')"
_WRITTEN = lambda x: f"try_cast({x}.y || '-' || lpad({x}.m, 2, '0') || '-' || lpad({x}.d, 2, '0') AS DATE)"
_NAMED_DAYS = (("모레", "2025-01-17"), ("내일", "2025-01-16"), ("오늘", "2025-01-15"), ("그제", "2025-01-13"), ("어제", "2025-01-14"), ("올해", "2025-01-01"), ("작년", "2024-01-01"), ("다음달", "2025-02-01"), ("지난달", "2024-12-01"), ("이번달", "2025-01-01"))
_DATES = rf"""
    WITH x AS (SELECT doc_id, text, DATE '2025-01-15' AS today, regexp_extract(text, '(\d{{4}})년\s*(\d{{1,2}})월\s*(\d{{1,2}})일', ['y', 'm', 'd']) AS a,
            regexp_extract(text, '(\d{{4}})\.\s?(\d{{1,2}})\.\s?(\d{{1,2}})', ['y', 'm', 'd']) AS b, regexp_extract(text, '(\d{{1,4}})\s*(일|주|달|개월|년)\s*(전|후|이내|뒤|내)', ['n', 'u', 's']) AS o,
            regexp_extract(text, '(이번|다음|지난|저번|다다음)주\s*(월|화|수|목|금|토|일)요일', ['w', 'd']) AS w, regexp_extract(text, '최근\s*(\d{{1,4}})?\s*(일|주|달|개월|년|분기)', ['n', 'u']) AS r,
            regexp_extract(text, '(?:(\d{{4}})년\s*)?(상반기|하반기|([1-4])분기)', ['y', 'h', 'q']) AS q FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, CASE WHEN {_WRITTEN("a")} IS NOT NULL THEN 'korean' WHEN {_WRITTEN("b")} IS NOT NULL THEN 'dotted' WHEN {" OR ".join(f"contains(text, '{w}')" for w, _ in _NAMED_DAYS)} THEN 'relative'
            WHEN o.n <> '' THEN 'offset' WHEN w.w <> '' THEN 'weekday' WHEN r.u <> '' THEN 'range' WHEN q.h <> '' THEN 'quarter' END AS format,
            make_date(coalesce(try_cast(q.y AS INT), 2025), CASE q.h WHEN '상반기' THEN 1 WHEN '하반기' THEN 7 ELSE coalesce(try_cast(q.q AS INT) * 3 - 2, 1) END, 1) AS first FROM x)
    SELECT doc_id, CASE format WHEN 'korean' THEN {_DAY(_WRITTEN("a"))} WHEN 'dotted' THEN {_DAY(_WRITTEN("b"))} WHEN 'relative' THEN CASE {" ".join(f"WHEN contains(text, '{w}') THEN '{d.replace('-', '')}'" for w, d in _NAMED_DAYS)} END
            WHEN 'offset' THEN {_DAY("(today + " + _MOVED("(CASE WHEN o.s IN ('후', '뒤') THEN 1 ELSE -1 END * try_cast(o.n AS INT))", "o.u") + ")")}
            WHEN 'weekday' THEN {_DAY("(today + CAST(instr('월화수목금토일', w.d) - 1 - 2 + 7 * CASE w.w WHEN '이번' THEN 0 WHEN '다음' THEN 1 WHEN '다다음' THEN 2 ELSE -1 END AS INT) * INTERVAL 1 DAY)")}
            WHEN 'range' THEN {_DAY("(today - " + _MOVED("coalesce(try_cast(r.n AS INT), 1)", "r.u") + ")")} WHEN 'quarter' THEN {_DAY("first")} END AS date,
           CASE format WHEN 'range' THEN '20250115' WHEN 'quarter' THEN {_DAY("last_day(CAST(first + CASE WHEN q.h IN ('상반기', '하반기') THEN 5 ELSE 2 END * INTERVAL 1 MONTH AS DATE))")} END AS end_date, format
    FROM k WHERE format IS NOT NULL"""

SQL = {
    "date_expressions": _DATES,
    "p6_found": _HISTORY.replace("COLUMNS_HERE", "law_id, revision_number"),
    "p6_history": _HISTORY.replace("COLUMNS_HERE", "law_id, revision_number, law_name, category, revision_date, effective_date"),
    "email_pii_by_lang": f"""
        WITH h AS (SELECT lang, coalesce({_COUNT("text", _EMAIL)}, 0) AS n FROM documents)
        SELECT lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS affected FROM h GROUP BY lang""",
    "text_tidy": "SELECT doc_id, md5(" + _TIDY.replace("{0}", "text") + ") AS digest FROM documents",
    "text_dense": f"SELECT doc_id, md5(lower(regexp_replace(text, '[{_SIZE_WS}]+', '', 'g'))) AS digest FROM documents",
    "text_comparable": "SELECT result_id, md5(" + _COMPARABLE.replace("{0}", "markdown") + ") AS digest FROM convert_results",
    "garbled_share": r"""
        SELECT run_id, round(CASE WHEN text = '' THEN 0 ELSE length(regexp_replace(text, '[^\x{fffd}\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{e000}-\x{f8ff}]', '', 'g')) / length(text) END, 6) AS share
        FROM text_runs WHERE text IS NOT NULL""",
    "markdown_structure": "SELECT result_id, "
    + ", ".join(f"CAST({_COUNT('markdown', p)} AS BIGINT) AS {n}" for n, p in X.STRUCTURE.items())
    + r", CAST(len(regexp_extract_all(markdown, '\n')) + 1 AS BIGINT) AS lines FROM convert_results WHERE markdown IS NOT NULL",
    "list_lines": r"""
        SELECT doc_id, count(*) FILTER (regexp_matches(trim(line), '^([-*•–—□○▪◦]\s|\d{1,3}[.)]\s|[가-하][.)]\s|[①-⑳])')) AS list_lines, count(*) AS lines
        FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line FROM documents) GROUP BY doc_id""",
    "heading_levels": r"""
        WITH h AS (SELECT chunk_id, split_part(content, chr(10), 1) AS line, content FROM legal_chunks)
        SELECT chunk_id, CAST(CASE WHEN strlen(content) <= 240 AND strlen(line) <= 80 THEN
            CASE WHEN regexp_matches(line, '^부칙') THEN 1 WHEN regexp_matches(line, '^제\s*\d+\s*[편장]') THEN 2
                 WHEN regexp_matches(line, '^제\s*\d+\s*(절|조)') THEN 3 WHEN regexp_matches(line, '^제\s*\d+\s*목') THEN 4 END END AS INT) AS level FROM h""",
    "markers": """
        WITH t AS (SELECT run_id, CAST(coalesce(run_idx, 0) + coalesce(block_idx, 0) % 500 AS INT) AS n FROM text_runs)
        SELECT run_id, n, substr('가나다라마바사아자차카타파하', n % 14 + 1, 1) AS ganada, substr('ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ', n % 14 + 1, 1) AS chosung,
               CASE WHEN n < 26 THEN chr(97 + n) ELSE chr(97 + (n - 26) // 26) || chr(97 + (n - 26) % 26) END AS letters,
               repeat('M', (n + 1) // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[(n + 1) // 100 % 10 + 1]
               || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[(n + 1) // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[(n + 1) % 10 + 1] AS roman
        FROM t""",
    "asset_manifests": """
        WITH i AS (SELECT result_id, unnest(images) AS im, generate_subscripts(images, 1) AS pos FROM convert_results),
        k AS (SELECT result_id, im.filename AS filename, im.media_type AS media_type, im.width AS width, im.height AS height, min(pos) AS pos FROM i GROUP BY ALL),
        a AS (SELECT result_id, printf('image_%03d', row_number() OVER (PARTITION BY result_id ORDER BY pos, filename, media_type, width, height)) AS asset_id, filename, media_type, width, height FROM k),
        part AS (SELECT result_id, asset_id, '{"asset_id":"' || asset_id || '"' || coalesce(',"filename":"' || filename || '"', '') || coalesce(',"media_type":"' || media_type || '"', '')
                        || coalesce(',"width":' || width, '') || coalesce(',"height":' || height, '') || '}' AS j FROM a)
        SELECT result_id, '{"version":"2.0","assets":[' || string_agg(j, ',' ORDER BY asset_id) || '],"stats":{"total_assets":' || count(*) || '}}' AS manifest FROM part GROUP BY result_id""",
    "document_copies": """
        WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, content_hash, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM h WINDOW w AS (PARTITION BY content_hash)""",
    "image_assets": """
        WITH i AS (SELECT result_id, unnest(images) AS im, generate_subscripts(images, 1) AS pos FROM convert_results),
        k AS (SELECT result_id, im.filename AS filename, im.media_type AS media_type, im.width AS width, im.height AS height, min(pos) AS pos FROM i GROUP BY ALL)
        SELECT result_id, printf('image_%03d', row_number() OVER (PARTITION BY result_id ORDER BY pos, filename, media_type, width, height)) AS asset_id, filename, media_type, width, height FROM k""",
    "char_windows": """
        WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 500, 0) / 450) AS INT) + 1)) AS window_no FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, window_no, md5(substring(text, window_no * 450 + 1, 500)) AS digest FROM w""",
    "token_estimates": f"""
        SELECT doc_id, CAST((8 * length(regexp_replace(text, '[^가-힣]+', '', 'g')) + 3 * length(regexp_replace(text, '[^A-Za-z0-9{_SIZE_WS}]+', '', 'g'))) // 12 AS BIGINT) AS tokens FROM documents""",
    "part_name_similarity": """
        WITH p AS (SELECT p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_size ORDER BY p_partkey) AS before FROM part)
        SELECT p_partkey, round(CASE WHEN p_name = before THEN 1 ELSE 1 - levenshtein(p_name, before) / greatest(length(p_name), length(before)) END, 6) AS similarity FROM p WHERE before IS NOT NULL""",
    "layout_bins": """
        WITH b AS (SELECT ocr_id, unnest(bounding_boxes) AS b FROM ocr_results)
        SELECT ocr_id, CAST(floor(b.x / 10) AS INT) AS bin, count(*) AS n FROM b GROUP BY ALL""",
    "ocr_targets": f"""
        SELECT ocr_id, page_no, 'unknown' AS category FROM ocr_results WHERE page_no IN (1, 2) AND {_CELLS} / 400 < 0.2""",
    "form_formats": r"""
        WITH p AS (SELECT header_id, doc_date,
            CASE WHEN regexp_matches(doc_date, '^\s*\d{8}\s*$') THEN regexp_extract(doc_date, '(\d{4})(\d{2})(\d{2})', ['y', 'm', 'd'])
                 WHEN regexp_matches(doc_date, '^\s*\d{6}\s*$') THEN regexp_extract(doc_date, '(\d{2})(\d{2})(\d{2})', ['y', 'm', 'd'])
                 ELSE regexp_extract(doc_date, '^\D*(\d{4}|\d{2})\D+(\d{1,2})\D+(\d{1,2})\D*$', ['y', 'm', 'd']) END AS x FROM hwp3_headers WHERE doc_date IS NOT NULL),
        i AS (SELECT header_id, doc_date, CAST(try_cast(nullif(CASE WHEN length(x.y) = 2 THEN CASE WHEN try_cast(x.y AS INT) <= 29 THEN '20' ELSE '19' END ELSE '' END || x.y || '-' || x.m || '-' || x.d, '--') AS DATE) AS VARCHAR) AS iso FROM p)
        SELECT header_id, iso, coalesce(replace(iso, '-', '.'), doc_date) AS dotted,
               coalesce(substr(iso, 3, 2) || '/' || CAST(CAST(substr(iso, 6, 2) AS INT) AS VARCHAR) || '/' || CAST(CAST(substr(iso, 9, 2) AS INT) AS VARCHAR), doc_date) AS short FROM i""",
    "form_fields": _FORM_FIELDS,
    "legal_articles": _ARTICLES,
    "legal_large_articles": rf"""
        WITH big AS (SELECT chunk_id, content FROM legal_chunks WHERE {_SIZE} > 512),
        p AS (SELECT chunk_id, list_filter(string_split(regexp_replace(content, '(?m)^(\s*(?:[①-⑳]|\(\d+\)))', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x) <> '') AS ps FROM big)
        SELECT chunk_id, CAST(no - 1 AS INT) AS piece_no, content, CAST({_SIZE} AS BIGINT) AS token_count
        FROM (SELECT chunk_id, unnest(ps) AS content, generate_subscripts(ps, 1) AS no FROM p)""",
    "legal_annexes": _ANNEXES,
    "ngram_matches": r"""
        WITH p AS (SELECT ocr_id, extracted_text AS hyp, lag(extracted_text) OVER (PARTITION BY scan_id ORDER BY page_no, ocr_id) AS ref FROM ocr_results),
        w AS (SELECT ocr_id, side, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ws FROM (
              SELECT ocr_id, 'h' AS side, hyp AS t FROM p WHERE ref IS NOT NULL UNION ALL SELECT ocr_id, 'r', ref FROM p WHERE ref IS NOT NULL)),
        g AS (SELECT ocr_id, side, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram FROM w, range(1, 5) AS t(n)),
        c AS (SELECT ocr_id, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL)
        SELECT ocr_id, CAST(n AS INT) AS n, CAST(sum(least(h, r)) AS BIGINT) AS matched, CAST(sum(h) AS BIGINT) AS total FROM c GROUP BY ALL""",
    "scoreboard": f"""
        SELECT CASE WHEN grouping(lang) = 1 THEN 0 WHEN grouping(scan_id) = 1 THEN 1 ELSE 2 END AS level, lang, scan_id, 'confidence' AS metric, round(avg(confidence), 6) AS mean, count(*) AS n
        FROM ocr_results WHERE {_MEASURED} GROUP BY GROUPING SETS ((), (lang), (lang, scan_id))""",
    "scoreboard_pivot": f"""
        SELECT lang, round(avg(confidence) FILTER ({_MEASURED}), 6) AS confidence, round(avg({_CELLS} / 400), 6) AS cover FROM ocr_results GROUP BY lang""",
    "regression_gate": f"""
        WITH m AS (SELECT scan_id, page_no % 2 AS odd, avg(confidence) AS mean FROM ocr_results WHERE {_MEASURED} GROUP BY ALL),
        c AS (SELECT * FROM m WHERE odd = 1), b AS (SELECT * FROM m WHERE odd = 0)
        SELECT coalesce(c.scan_id, b.scan_id) AS scan_id, 'confidence' AS metric, round(c.mean, 6) AS current, round(b.mean, 6) AS baseline,
               CASE WHEN c.mean IS NULL OR b.mean IS NULL THEN 'blocked' WHEN c.mean - b.mean < -0.05 THEN 'fail' ELSE 'ok' END AS verdict
        FROM c FULL JOIN b ON c.scan_id = b.scan_id""",
    "rolling_confidence": f"""
        SELECT ocr_id, round(confidence, 6) AS confidence, round(avg(confidence) OVER (PARTITION BY scan_id ORDER BY page_no, ocr_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS baseline
        FROM ocr_results WHERE {_MEASURED}""",
    "review_queue": f"""
        SELECT scan_id, round(max(confidence) - min(confidence), 6) AS max_spread, 'confidence' AS metric FROM ocr_results WHERE {_MEASURED}
        GROUP BY scan_id HAVING count(DISTINCT page_no) >= 2 AND max(confidence) - min(confidence) >= 0.2""",
    "word_consensus": """
        WITH w AS (SELECT DISTINCT scan_id, page_no, unnest(regexp_extract_all(lower(extracted_text), '[a-z]{4,}')) AS word FROM ocr_results),
        t AS (SELECT scan_id, count(DISTINCT page_no) AS tools FROM w GROUP BY ALL),
        k AS (SELECT scan_id, word, count(*) AS n, max(CASE WHEN page_no = 1 THEN 1 ELSE 0 END) AS own FROM w GROUP BY ALL)
        SELECT scan_id, count(*) FILTER (n = tools) AS agreed, count(*) FILTER (own = 0 AND n = tools - 1 AND n > 0) AS missing, count(*) FILTER (own = 1 AND n = 1 AND tools > 1) AS alone
        FROM k JOIN t USING (scan_id) GROUP BY scan_id""",
    "page_classes": f"""
        SELECT ocr_id, round({_CELLS} / 400, 6) AS cover, CASE WHEN {_CELLS} / 400 >= 0.2 THEN 'text_native' ELSE 'unknown' END AS category FROM ocr_results""",
    "boxes_below": """
        WITH b AS (SELECT ocr_id, unnest(bounding_boxes) AS b, generate_subscripts(bounding_boxes, 1) - 1 AS box_no FROM ocr_results)
        SELECT w.ocr_id, CAST(w.box_no AS INT) AS box_no, w.b.y AS y, max(round(n.b.y, 3)) AS above
        FROM b w LEFT JOIN b n ON w.ocr_id = n.ocr_id AND n.b.width <= 297.5 AND round(n.b.y, 3) <= w.b.y WHERE w.b.width > 297.5 GROUP BY ALL""",
    "event_islands": """
        WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
        j AS (SELECT *, coalesce(CAST(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 AS INT), 0) AS jump FROM e),
        i AS (SELECT *, sum(jump) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM j)
        SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(t) AS first, max(t) AS last FROM i GROUP BY ALL""",
    "legal_references": f"""
        WITH x AS (SELECT chunk_id, regexp_extract_all(content, '{_LAW}', 0) AS raw, regexp_extract_all(content, '{_LAW}', 1) AS law, regexp_extract_all(content, '{_LAW}', 2) AS no,
                   regexp_extract_all(content, '{_INNER}', 0) AS iraw, regexp_extract_all(content, '{_INNER}', 1) AS ino, regexp_extract_all(content, '{_INNER}', 2) AS ib FROM legal_chunks)
        SELECT chunk_id, 'external' AS reference_type, unnest(law) AS target_law,
               unnest(list_transform(no, lambda n: CASE WHEN n <> '' THEN '제' || n || '조' END)) AS target_article, unnest(raw) AS raw_text FROM x
        UNION ALL
        SELECT chunk_id, 'internal', NULL, '제' || n || '조' || CASE WHEN b <> '' THEN '의' || b ELSE '' END, r
        FROM (SELECT chunk_id, raw, unnest(iraw) AS r, unnest(ino) AS n, unnest(ib) AS b FROM x)
        WHERE len(list_filter(raw, lambda o: contains(o, r))) = 0""",
    "legal_chunk_ids": """
        SELECT chunk_id, substring(sha256(coalesce(law_name, '') || ':' || coalesce(article_number, '') || ':' || substring(coalesce(content, ''), 1, 100)), 1, 16) AS id FROM legal_chunks""",
    "embedding_rows": """
        SELECT chunk_id, id, md5(CASE WHEN coalesce(context_path, '') <> '' THEN '[' || context_path || ']' || chr(10) || chr(10) ELSE '' END || coalesce(content, '')) AS digest FROM legal_chunks""",
    "header_dates": f"SELECT header_id, {_ISO.format('doc_date')} AS iso FROM hwp3_headers",
    "conversion_stats": """
        SELECT doc_format, count(*) AS results, count(*) FILTER (coalesce(markdown, '') = '') AS failed, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(word_count) AS BIGINT) AS words
        FROM convert_results GROUP BY doc_format""",
    "median_font_size": "SELECT font_name, coalesce(quantile_cont(font_size, 0.5), 12.0) AS median_size FROM text_runs GROUP BY font_name",
}
