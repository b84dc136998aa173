"""Plans of steps that depend on one another: what can run together, and their results in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(steps: DataFrame) -> DataFrame:
    """(plan, turn, steps) of steps (plan, step, parallel_group): steps of a group run together, one without a group
    alone, in order of the number."""
    turn = F.coalesce(F.col("parallel_group"), F.col("step") + 100)
    grouped = steps.groupBy("plan", turn.alias("_turn")).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return grouped.select("plan", F.row_number().over(Window.partitionBy("plan").orderBy("_turn")).alias("turn"), "steps")


def report(results: DataFrame) -> DataFrame:
    """(plan, report) of results (plan, step, title, body): bodies that aren't blank under their titles, in order."""
    told = results.filter(F.trim(F.coalesce("body", F.lit(""))) != "")
    listed = told.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("step", "title", "body"))).alias("r"))
    return listed.select("plan", F.concat_ws("\n\n", F.transform("r", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"]))).alias("report"))
