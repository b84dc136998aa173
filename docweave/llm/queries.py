"""The pN_ queries of the training-text operators and their SQL equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import encoding as E
from docweave.llm import leak as L
from docweave.llm import lookalike as K
from docweave.llm import mix as M
from docweave.llm import pii as P
from docweave.llm import scan as C
from docweave.llm import split as S
from docweave.llm import tokens as T
from docweave.session import table


#: The secret of the surrogates; the one here only serves tests.
_KEY = os.environ.get("DOCWEAVE_SURROGATE_KEY", "for tests only").encode()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_restored(spark, d).select("table_name", "field_name", "row_id")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return E.mended(E.long_form(table(spark, d, "hwp3_headers"), table(spark, d, "text_runs")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_lookalikes(spark, d).select("table_name", "row_id")


def p5_lookalikes(spark: SparkSession, d: str) -> DataFrame:
    return K.lookalikes(K.long_form(table(spark, d, "text_runs"), table(spark, d, "legal_chunks")))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return K.unified(K.long_form(table(spark, d, "text_runs"), table(spark, d, "legal_chunks")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return C.Repair(C.result_pages(table(spark, d, "ocr_results"))).noise().select(F.col("row_id").alias("ocr_id"), "noise_kind")


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.Repair(C.result_pages(table(spark, d, "ocr_results"))).paragraphs().select(F.col("row_id").alias("ocr_id"), "text")


def p2_scans(spark: SparkSession, d: str) -> DataFrame:
    return C.scan_texts(table(spark, d, "ocr_outputs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return T.misstated_counts(table(spark, d, "legal_chunks"))


def p3_document_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumns({"source": T.canonical_source(F.col("source")), "lang": T.canonical_language(F.col("lang"))})
    slices = ["source", "lang", "doc_domain"]
    return T.token_budget(T.token_counts(docs, "doc_id", "text", keep=slices), slices)


def p3_category_budget(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "legal_chunks").withColumn("category", F.nullif(F.trim(F.col("category")), F.lit("")))
    return T.token_budget(T.token_counts(chunks, "chunk_id", "content", keep=["category"]), ["category"])


def p3_chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    return T.token_counts(table(spark, d, "legal_chunks"), "chunk_id", "content", "estimate")


def _oversized(spark: SparkSession, d: str, operator) -> DataFrame:
    named = lambda name, key, text: operator(table(spark, d, name), key, text).select(F.lit(name).alias("table_name"), "*")
    return named("legal_chunks", "chunk_id", "content").unionByName(named("convert_results", "result_id", "markdown"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """An item is oversized if the operator had to cut it."""
    return _oversized(spark, d, S.oversized)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d, S.pieces_of)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return L.leaked(L.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    pairs = L.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return pairs.select("doc_id", "item_id", F.round("score", 4).alias("score"), F.round("share", 4).alias("share"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return P.occurrences(P.redacted(table(spark, d, "documents"), _KEY))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return P.redacted(table(spark, d, "documents"), _KEY).select("doc_id", F.col("placeholders").alias("text"))


def p9_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return P.redacted(table(spark, d, "documents"), _KEY).select("doc_id", F.col("surrogates").alias("text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_pages, p2_scans, p3_found, p3_document_budget, p3_category_budget, p3_chunk_sizes, p4_found, p4_pieces, p5_found, p5_lookalikes, p5_unified, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_redacted, p9_surrogates)}

_WS = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _size_sql(text: str) -> str:
    kept = lambda keep: f"length(regexp_replace({text}, '[^{keep}]+', '', 'g'))"
    return f"((8 * {kept('가-힣')} + 3 * {kept('A-Za-z0-9' + _WS)}) // 12)"


SQL = {
    "p3_found": f"""
        SELECT chunk_id FROM (SELECT chunk_id, token_count, coalesce({_size_sql("content")}, 0) AS size FROM legal_chunks)
        WHERE token_count IS NULL OR token_count < 0 OR (abs(token_count - size) > 5 AND abs(token_count - size) > 0.1 * size)""",
    "p3_chunk_sizes": f"SELECT chunk_id, CAST({_size_sql('content')} AS BIGINT) AS tokens FROM legal_chunks",
    "p4_found": f"""
        SELECT 'legal_chunks' AS table_name, chunk_id AS row_id FROM legal_chunks WHERE {_size_sql("content")} > 512
        UNION ALL SELECT 'convert_results', result_id FROM convert_results WHERE {_size_sql("markdown")} > 512""",
}
