"""Mixing sources to target shares of tokens.

Method: Efraimidis-Spirakis sampling. A document's key is -ln(u) / weight with u in (0, 1) from a
hash of its id and weight its quality; documents of a source are taken in order of their keys up
to a token budget. Complete epochs of a source come first, a fractional epoch after them.

The prefix sums never put a source into one task: keys are laid over BUCKETS intervals by the
monotone 1 - exp(-key), a bucket is summed in its own window, and what lies before a bucket comes
from one summary row per source and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm import tokens as T
from docweave.session import cut

BUCKETS = 1024


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1: the share of letters, of whatever script, in the text, less for texts under 200 characters."""
    n = F.length(text)
    letters = n - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return F.round(F.lit(0.25) + 0.75 * letters / F.greatest(n, F.lit(1)) * F.least(n / 200, F.lit(1.0)), 6)


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), fixed by key and seed: 52 bits of a hash."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sampling_keys(docs: DataFrame, tokenizer: str = T.TOKENIZER, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, key, bucket) of the documents that have a source and a token."""
    rows = docs.select("doc_id", T.canonical_source(F.col("source")).alias("source"), quality(F.col("text")).alias("weight"), F.col("text").alias("_words")).filter(F.col("source").isNotNull())
    sized = T.token_counts(rows, "doc_id", "_words", tokenizer, keep=["source", "weight"]).filter(F.col("tokens") > 0)
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight")
    keyed = sized.select("doc_id", "source", "tokens", key.alias("key"))
    return keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def plan_budgets(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, available, budget, epochs, rest).

    A plan's total is the largest at which every source it names that has documents reaches its share
    with max_repeats passes at most. A source without documents gets nothing. Rows without a positive
    share or repeat are left out; a source named twice in a plan counts with its summed share and
    lower repeat.
    """
    wanted = (
        targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0))
        .groupBy("plan_id", T.canonical_source(F.col("source")).alias("source"))
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    with_totals = wanted.join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    reach = F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = F.min(reach).over(Window.partitionBy("plan_id"))
    budget = F.when(F.col("available") > 0, F.least(F.floor(F.col("target_share") * F.col("plan_tokens") + 1e-6), F.col("available") * F.col("max_repeats")))
    return (
        with_totals.withColumn("plan_tokens", total)
        .withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long"))
        .withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
        .drop("plan_tokens")
    )


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = T.TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) for every plan of targets.

    selection: plan_id, source, doc_id, epoch, tokens; a document that is taken n times has n rows.
    shares: plan_id, source, target_share, max_repeats, available, selected, actual_share, repeats,
    where selected is the sum nearest to the budget that a run of documents has: the last one is taken if more
    than half of it is within. Documents without source, text or tokens take no part. Ties in the key go by doc_id.
    """
    keyed = cut(sampling_keys(docs, tokenizer, seed))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = buckets.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    totals = buckets.groupBy("source").agg(F.sum("in_bucket").alias("available"))
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        keyed.withColumn("upto", within)
        .join(offsets, ["source", "bucket"])
        .select("doc_id", "source", "tokens", (2 * (F.col("before") + F.col("upto")) - F.col("tokens")).alias("twice_middle"))
    )
    budgets = plan_budgets(targets, totals)
    chosen = (
        placed.join(budgets.select("plan_id", "source", "epochs", "rest"), "source")
        .withColumn("copies", F.col("epochs") + (F.col("twice_middle") < 2 * F.col("rest")).cast("int"))
        .filter(F.col("copies") > 0)
    )
    selection = chosen.select("plan_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"), "tokens")
    reached = chosen.groupBy("plan_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("selected"))
    share = F.col("selected") / F.sum("selected").over(Window.partitionBy("plan_id"))
    shares = (
        budgets.join(reached, ["plan_id", "source"], "left")
        .withColumn("selected", F.coalesce("selected", F.lit(0)))
        .withColumn("actual_share", F.round(share, 6))
        .withColumn("repeats", F.when(F.col("available") > 0, F.round(F.col("selected") / F.col("available"), 6)).otherwise(0.0))
        .select("plan_id", "source", F.round("target_share", 6).alias("target_share"), "max_repeats", "available", "selected", "actual_share", "repeats")
    )
    return selection, shares
