"""Folders of documents as DataFrames, and the sinks for what is made of them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import formats

CONVERTED = "path string, format string, markdown string, error string"


def documents(spark: SparkSession, folder: str | Sequence[str], extensions: Sequence[str] = tuple(formats.EXTENSIONS), most: int = formats.FILE_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of the files below folder with these extensions. Files beyond most
    bytes are left out by their listed length, before any is read."""
    glob = "*.{" + ",".join(sorted({e for x in extensions for e in (x, x.upper())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.filter(F.col("length") <= most)


def _convert(precedence: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, *formats.to_markdown(content, path, precedence), None))
                except Exception as e:  # noqa: BLE001  # one damaged file doesn't end the job
                    rows.append((path, formats.detect(content, path, precedence), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "format", "markdown", "error"])

    return run


def convert(files: DataFrame, precedence: str = "magic") -> DataFrame:
    """(path, format, markdown, error): every file of files (path, content) converted; where that fails, error says why."""
    return files.select("path", "content").mapInPandas(_convert(precedence), CONVERTED)


def conversion_counts(converted: DataFrame) -> DataFrame:
    return converted.groupBy("format").agg(F.count("*").alias("files"), F.count("error").alias("failed"))


def mdx(converted: DataFrame) -> DataFrame:
    """(path, mdx): Markdown with front matter by format: of tables the rows and the columns of the first, of slides and
    pages their number, of others the lines."""
    name = F.replace(F.element_at(F.split("path", "/"), -1), F.lit('"'), F.lit("'"))
    count = lambda pattern: F.regexp_count("markdown", F.lit(pattern)).cast("string")
    table_rows = F.filter(F.split("markdown", "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|?$"))
    columns = F.size(F.split(F.coalesce(F.try_element_at(table_rows, F.lit(1)), F.lit("||")), r"(?<!\\)\|")) - 2
    lines = F.concat(F.lit("lines: "), (F.regexp_count("markdown", F.lit("\n")) + 1).cast("string"))
    own = (
        F.when(F.col("format").isin("csv", "tsv", "xlsx", "xls", "ods"), F.concat(F.lit("rows: "), F.size(table_rows).cast("string"), F.lit("\ncolumns: "), columns.cast("string")))
        .when(F.col("format") == "pptx", F.concat(F.lit("slides: "), count(r"(?m)^## Slide \d+")))
        .when(F.col("format").isin("docx", "hwpx", "hwp", "html", "epub", "pdf"), F.concat(F.lit("headings: "), count(r"(?m)^#{1,6} "), F.lit("\n"), lines))
        .otherwise(lines)
    )
    head = F.concat(F.lit('---\nformat: "'), F.col("format"), F.lit('"\nsource: "'), name, F.lit('"\n'), own, F.lit("\n---\n\n"))
    return converted.filter(F.col("markdown").isNotNull()).select("path", F.concat(head, F.col("markdown")).alias("mdx"))


def write_json_lines(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_json_array(rows: DataFrame, folder: str, per_file: int = 100_000) -> None:
    """rows as JSON arrays, files of per_file objects each, one to a line: each part of the data is written where it is, so
    no array is gathered."""
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    lines = rows.select(body.alias("j")).withColumn("_id", F.monotonically_increasing_id())
    parts = lines.groupBy(F.floor(F.col("_id") / per_file).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_id", "j"))).alias("rows"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("rows", lambda r: r["j"]), ",\n"), F.lit("\n]"))
    # Each array is a file of its own: one row to a partition file.
    parts.select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)


def write_asset_files(assets: DataFrame, folder: str) -> DataFrame:
    """assets (doc_id, content_hash, extension, content) once per content as folder/assets/<first two>/<first twelve>.<extension>;
    gives (path, bytes). folder is one that all executors share. A file that is there isn't written again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, x, c in zip(batch["content_hash"], batch["extension"], batch["content"], strict=True):
                path = os.path.join(folder, "assets", h[:2], f"{h[:12]}.{x}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if not os.path.exists(path):
                    # Whole or not at all, however often a task is tried.
                    made = f"{path}.{uuid.uuid4().hex}"
                    with open(made, "wb") as f:
                        f.write(c)
                    os.replace(made, path)
                rows.append((path, len(c)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return assets.dropDuplicates(["content_hash"]).select("content_hash", "extension", "content").mapInPandas(run, "path string, bytes long")


def write_assets(assets: DataFrame, folder: str) -> None:
    """assets (doc_id, content_hash, content) once per content, by the first characters of the hash."""
    once = assets.dropDuplicates(["content_hash"]).withColumn("shard", F.substring("content_hash", 1, 2))
    once.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(folder)
