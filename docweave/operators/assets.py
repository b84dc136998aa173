"""Assets of documents: copies by content, numbered images, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content_hash, first_id, copies): every row with the class of its exact text. Null is left out.

    Counts and first ids are aggregated on the map side before the join, so a text that a third of
    the rows share stays one row in it; the texts themselves aren't shuffled.
    """
    hashed = df.filter(F.col(text).isNotNull()).select(key, F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"))
    classes = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return hashed.join(classes, "content_hash").select(key, "content_hash", "first_id", "copies")


def image_rows(results: DataFrame) -> DataFrame:
    """(result_id, asset_id, filename, media_type, width, height): the images of each result, equal ones once,
    numbered in order of appearance."""
    images = results.select("result_id", F.posexplode("images").alias("pos", "i")).select("result_id", "pos", "i.filename", "i.media_type", "i.width", "i.height")
    same = ["filename", "media_type", "width", "height"]
    kept = images.groupBy("result_id", *same).agg(F.min("pos").alias("pos"))
    number = F.row_number().over(Window.partitionBy("result_id").orderBy("pos", *same))
    return kept.select("result_id", F.format_string("image_%03d", number).alias("asset_id"), *same)


def manifests(assets: DataFrame, version: str = "2.0") -> DataFrame:
    """(result_id, manifest): the assets of each result as JSON."""
    listed = assets.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("asset_id", "filename", "media_type", "width", "height"))).alias("assets"))
    body = F.struct(F.lit(version).alias("version"), F.col("assets"), F.struct(F.size("assets").alias("total_assets")).alias("stats"))
    return listed.select("result_id", F.to_json(body).alias("manifest"))


def asset_by_name(assets: DataFrame, names: DataFrame) -> DataFrame:
    """(result_id, name, asset_id): the last asset of a result whose file name ends with the name asked for."""
    found = names.join(assets, "result_id").filter(F.col("filename").endswith(F.col("name")))
    return found.groupBy("result_id", "name").agg(F.max("asset_id").alias("asset_id"))


MANIFEST = "version string, assets array<struct<asset_id:string,filename:string,media_type:string,width:int,height:int>>, stats struct<total_assets:int>"


def parsed_manifests(df: DataFrame, manifest: str = "manifest") -> DataFrame:
    """df with the manifest's parts beside its text; text that is none gives nulls."""
    return df.withColumn("_m", F.from_json(manifest, MANIFEST)).select(*df.columns, "_m.version", "_m.assets", "_m.stats.total_assets")


def is_effective(before: Column, after: Column, least: float) -> Column:
    """Whether a file became smaller by a share of least or more; false for empty ones."""
    return F.coalesce((before > 0) & ((before - after) / before >= least), F.lit(False))


def barcode_suffix(payload: Column) -> Column:
    """What stands behind the image of a barcode: a web address as a link, anything else as a note in one line."""
    plain = F.trim(payload)
    link = plain.rlike(r"^https?://[^\s<>]+$")
    note = F.regexp_replace(F.regexp_replace(payload, r"\s+", " "), r"([\[\]()|<>])", r"\\$1")
    return F.when(link, F.concat(F.lit(" <"), plain, F.lit(">"))).otherwise(F.concat(F.lit(" (QR: "), note, F.lit(")")))
