"""A watched folder as a stream of converted documents.

Files are taken up once, by path; they have to be put into the folder whole (written elsewhere and
renamed), as a stream of files can't see later changes.
"""

from __future__ import annotations

import ipaddress
import socket
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.sources import files, formats

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """The stream of (path, format, markdown, error) of the files that come into folder."""
    raw = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    usable = raw.filter(extension.isin(*formats.EXTENSIONS) & (F.col("length") > 0) & (F.col("length") <= formats.FILE_BYTES))
    return files.convert(usable)


def event_json(converted: DataFrame, shown: int = 1000) -> DataFrame:
    """(path, event): what is told of each file, with the first characters of its text."""
    body = F.struct(
        F.col("path").alias("file"), "format", F.col("error").isNull().alias("success"), "error", F.substring("markdown", 1, shown).alias("markdown")
    )
    return converted.select("path", F.to_json(body, {"ignoreNullFields": "false"}).alias("event"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream into Parquet below out; with once it ends when what is there now is done."""
    writer = watched(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def page_counts(stream: DataFrame, at: str, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Documents by format and window of event time; those later than late are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), "format").agg(F.count("*").alias("files"), F.count("error").alias("failed"))


def is_private_address(host: str) -> bool:
    """Whether a host is this machine or an address that isn't public, also one of version 4 within version 6."""
    try:
        address = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return host.lower().rstrip(".") == "localhost" or host.lower().endswith(".localhost")
    inner = getattr(address, "ipv4_mapped", None) or getattr(address, "sixtofour", None)
    return not address.is_global or inner is not None and not inner.is_global


def checked_webhook(url: str) -> str:
    """url, if it is http or https to a host that is no private address."""
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"no http address: {url}")
    if is_private_address(parts.hostname):
        raise ValueError(f"a private address: {url}")
    return url


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def post_events(events: DataFrame, url: str, timeout: float = 10.0) -> DataFrame:
    """(path, status, error) of events (path, event), each sent as JSON to url; redirects aren't followed, and a failure
    doesn't end the job. The address is checked here and the host again by every task, after it is looked up."""
    checked_webhook(url)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = urllib.request.build_opener(_NoRedirect)
        for batch in batches:
            rows = []
            for path, event in zip(batch["path"], batch["event"], strict=True):
                try:
                    found = {a[4][0] for a in socket.getaddrinfo(urlparse(url).hostname, None)}
                    if any(map(is_private_address, found)):
                        raise ValueError("a private address")
                    request = urllib.request.Request(url, event.encode(), {"Content-Type": "application/json"}, method="POST")
                    with opener.open(request, timeout=timeout) as answer:
                        rows.append((path, answer.status, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, getattr(e, "code", None), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "status", "error"]).astype({"status": "Int32"})

    return events.select("path", "event").mapInPandas(run, "path string, status int, error string")
