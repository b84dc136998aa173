"""Histories of entities whose attributes change, built from a feed of notices.

A feed holds updates and periodic snapshots, out of order, repeated and with gaps. Map-side
combinable aggregates bring it to runs: what one revision's notices of one stated date say last.
The runs are co-partitioned by ranges of (entity, time), so an entity that holds a third of the feed
spreads over many tasks, and sorted there by key. Each partition is then one pass of a merge: runs of
the same revision come one after the other and are merged value by value, a version is emitted as
soon as the next differs in payload, and only the open version is held. What a partition must know
of its neighbours comes from its first and its last version, two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from docweave.session import cut

END_OF_TIME = "9999-12-31"


def iso_date(value: Column) -> Column:
    """A date in one of the feed's spellings (2004-03-25, 2004.03.25, 2004. 3. 25., 20040325,
    2004년 3월 25일) as yyyy-MM-dd; null where there is none or the day doesn't exist."""
    pattern = r"^\D*(\d{4})\D*?(\d{1,2})\D*?(\d{1,2})\D*$"
    part = lambda i, width: F.lpad(F.regexp_extract(value, pattern, i), width, "0")
    text = F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2))
    return F.when(text.try_cast("date").isNotNull(), text)


def revision_ordinal(value: Column) -> Column:
    """3, 003, 3차 and 제3차 as 3; null without digits."""
    return F.regexp_extract(value, r"(\d+)", 1).try_cast("long")


def entity_id(value: Column) -> Column:
    """In capitals and without blanks; empty becomes null."""
    return F.nullif(F.upper(F.regexp_replace(value, r"\s+", "")), F.lit(""))


def revision_runs(notices: DataFrame, attributes: Sequence[str] = ("law_name", "category")) -> DataFrame:
    """(law_id, revision_number, valid_from, then of each date and attribute the last value received with
    its place in the order of arrival): one row per revision and stated revision date.

    A notice without number belongs to the revision of that law with its revision date and counts
    for nothing if there is none; blank attributes count as missing; a notice without law_id is
    left out, and so is a revision with neither date. Repeated notices change nothing. Ties in
    received_at go to the greater notice_id.
    """
    clean = notices.select(
        entity_id(F.col("law_id")).alias("law_id"),
        revision_ordinal(F.col("revision_number")).alias("revision_number"),
        iso_date(F.col("revision_date")).alias("revision_date"),
        iso_date(F.col("effective_date")).alias("effective_date"),
        *[F.nullif(F.trim(F.col(a)), F.lit("")).alias(a) for a in attributes],
        F.struct(F.col("received_at").alias("at"), F.col("notice_id").alias("id")).alias("o"),
    ).filter(F.col("law_id").isNotNull() & (F.col("revision_number").isNotNull() | F.col("revision_date").isNotNull()))
    columns = ["effective_date", *attributes]
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("o", F.col(c).alias("v")))).alias(c)
    runs = clean.groupBy("law_id", "revision_number", F.col("revision_date").alias("on_date")).agg(latest("revision_date"), *[latest(c) for c in columns])
    # Runs without date stand apart, each for itself: they name their revision and need no other.
    same_date = Window.partitionBy("law_id", F.coalesce("on_date", F.col("revision_number").cast("string")))
    owned = runs.withColumn("revision_number", F.coalesce("revision_number", F.min("revision_number").over(same_date))).filter("revision_number IS NOT NULL")
    last = lambda c: F.max(c).over(Window.partitionBy("law_id", "revision_number"))["v"]
    dated = owned.withColumn("valid_from", F.coalesce(last("effective_date"), last("revision_date"))).filter("valid_from IS NOT NULL")
    return dated.select("law_id", "revision_number", "valid_from", "revision_date", *columns)


def _merging(keys: list[str], merged: list[str], payload: list[str], schema: StructType):
    """The pass over rows sorted by keys (entity, start, order). Rows with equal keys are runs of one
    version if merged names the columns to merge; else each row is a version."""
    entity, start, _ = keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, arrow = TaskContext.get().partitionId(), to_arrow_schema(schema)
        done: list[dict] = []
        said: dict | None = None  # the version not closed yet
        here: dict | None = None  # the one whose runs are being merged
        first = True

        def close(until: str | None) -> None:
            done.append(said | {"valid_to": until, "_part": part})

        def complete() -> None:
            nonlocal said, first
            for c in merged:
                here[c] = here[c] and here[c]["v"]
            same = said is not None and said[entity] == here[entity]
            if same and all(said[c] == here[c] for c in payload):
                return
            if said is not None:
                close(here[start] if same else END_OF_TIME)
            said = here | {"_first": first, "_open": False}
            first = False

        for batch in batches:
            for row in batch.to_pylist():
                if merged and here is not None and all(row[k] == here[k] for k in keys):
                    for c in merged:
                        if row[c] is not None and (here[c] is None or tuple(row[c]["o"].values()) > tuple(here[c]["o"].values())):
                            here[c] = row[c]
                    continue
                if here is not None:
                    complete()
                here = row
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()
        if here is not None:
            complete()
            said["_open"] = True
            close(None)
            yield pa.RecordBatch.from_pylist(done, arrow)

    return run


def _bounds(edges: list, keys: list[str], payload: list[str]) -> list[tuple[int, bool, str]]:
    """(partition, whether its first version only goes on the one before, end of its open version)."""
    entity, start, _ = keys
    by_part: dict[int, list] = {}
    for r in edges:
        by_part.setdefault(r["_part"], []).append(r)
    goes_on, ends, waiting = {}, {}, None
    for part in sorted(by_part):
        first = next(r for r in by_part[part] if r["_first"])
        last = next(r for r in by_part[part] if r["_open"])
        if waiting is not None:
            if waiting[entity] != first[entity]:
                ends[waiting["_part"]] = END_OF_TIME
            elif all(waiting[c] == first[c] for c in payload):
                goes_on[part] = True
                if first["_open"]:
                    continue
                ends[waiting["_part"]] = first["valid_to"]
            else:
                ends[waiting["_part"]] = first[start]
        waiting = last
    if waiting is not None:
        ends[waiting["_part"]] = END_OF_TIME
    return [(p, goes_on.get(p, False), ends.get(p)) for p in by_part]


def _closed(rows: DataFrame, keys: list[str], merged: list[str], payload: list[str]) -> DataFrame:
    kept = [StructField(f.name, f.dataType["v"].dataType) if f.name in merged else f for f in rows.schema]
    marks = [StructField("valid_to", StringType()), StructField("_part", IntegerType()), StructField("_first", BooleanType()), StructField("_open", BooleanType())]
    schema = StructType([*kept, *marks])
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    versions = cut(ordered.mapInArrow(_merging(keys, merged, payload, schema), schema))
    # Two rows of each partition at most: their number is that of the partitions, not of the entities.
    edges = versions.filter("_first OR _open").collect()
    bounds = rows.sparkSession.createDataFrame(_bounds(edges, keys, payload), "_part int, _goes_on boolean, _end string")
    known = versions.join(F.broadcast(bounds), "_part").filter(~(F.col("_first") & F.col("_goes_on")))
    return known.withColumn("valid_to", F.when(F.col("_open"), F.col("_end")).otherwise(F.col("valid_to"))).drop("_part", "_first", "_open", "_goes_on", "_end")


def close_versions(rows: DataFrame, entity: str, start: str, order: str, payload: Sequence[str]) -> DataFrame:
    """Versions of each entity: rows in order of (start, order), without those whose payload equals
    the one before, each valid from start up to the start of the next, the last to 9999-12-31.

    start is a yyyy-MM-dd string; rows without start or entity are left out. Of two rows with equal
    start the one with the smaller order closes at once. payload may hold nulls; null equals null.
    Rows equal in entity, start and order are taken in order of their payload.
    """
    base = rows.filter(F.col(start).isNotNull() & F.col(entity).isNotNull())
    tied = base.withColumn("_tie", F.struct(order, F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})))
    return _closed(tied, [entity, start, "_tie"], [], list(payload)).drop("_tie")


def law_history(notices: DataFrame, attributes: Sequence[str] = ("law_name", "category")) -> DataFrame:
    """The history of every law: one row per revision with its attributes and period of validity.

    valid_from is the effective date or, if never stated, the revision date; a revision with neither
    is left out. valid_to is the valid_from of the next revision, or 9999-12-31. A revision is a version
    of its own even if all it says was said before, as every revision must come out; its repeated
    notices are one. An empty feed gives an empty history.
    """
    merged = ["revision_date", "effective_date", *attributes]
    runs = revision_runs(notices, attributes)
    return _closed(runs, ["law_id", "valid_from", "revision_number"], merged, ["revision_number", *merged]).select(
        "law_id", "revision_number", *attributes, "revision_date", "effective_date", "valid_from", "valid_to"
    )
