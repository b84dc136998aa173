"""Text-quality metrics, grouped scoreboards and the regression gate."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics that are better when lower.
LOWER_IS_BETTER = ("cer", "edit_distance")
#: Tolerated loss overall, by slice and by fixture.
TOLERANCE = {"overall": 0.05, "slice": 0.05, "fixture": 0.10}


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, rows of bits at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for y in b:
        x = row | where.get(y, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def bleu(hypothesis: str, reference: str, most: int = 4) -> float:
    """Sentence BLEU over words with a tenth added to empty counts; 1 for two empty texts."""
    h, r = hypothesis.split(), reference.split()
    if not h or not r:
        return float(h == r)
    total = 0.0
    for n in range(1, most + 1):
        x, y = (Counter(zip(*[t[i:] for i in range(n)], strict=False)) for t in (h, r))
        hits = (x & y).total()
        total += math.log((hits or 0.1) / max(x.total(), 1))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(total / most)


def rouge_l(hypothesis: str, reference: str) -> float:
    h, r = (re.findall(r"[a-z0-9]+", t.lower()) for t in (hypothesis, reference))
    common = _lcs(h, r)
    return 2 * common / (len(h) + len(r)) if common else 0.0


def cer(hypothesis: str, reference: str) -> float:
    from docweave.operators.diff import edit_distance

    return edit_distance(hypothesis, reference) / max(len(reference), 1)


def edit_ratio(hypothesis: str, reference: str) -> float:
    total = len(hypothesis) + len(reference)
    return 2 * _lcs(hypothesis, reference) / total if total else 1.0


Node = tuple[str, list]


def block_tree(markdown: str) -> Node:
    """The blocks of a Markdown text as a tree: sections under their heading, items under their list, rows and cells
    under their table."""
    from docweave.operators.blocks import parse_blocks

    root: Node = ("document", [])
    open_: list[tuple[int, Node]] = [(0, root)]
    for b in parse_blocks(markdown):
        if b["kind"] == "heading":
            while open_[-1][0] >= b["level"]:
                open_.pop()
            node: Node = (f"heading{b['level']}", [])
            open_[-1][1][1].append(node)
            open_.append((b["level"], node))
            continue
        below: list[Node] = []
        if b["kind"] == "list":
            below = [(f"item{i['depth']}", []) for i in b["items"]]
        elif b["kind"] == "table":
            below = [("row", [("cell", []) for _ in r]) for r in b["cells"]]
        open_[-1][1][1].append((b["kind"], below))
    return root


def tree_distance(a: Node, b: Node) -> int:
    """Least number of nodes inserted, deleted or renamed (Zhang and Shasha 1989)."""

    def indexed(root: Node) -> tuple[list[str], list[int], list[int]]:
        labels: list[str] = []
        leftmost: list[int] = []
        work: list[tuple[Node, int, int]] = [(root, 0, 0)]
        while work:
            node, child, first = work.pop()
            if child == 0:
                first = len(labels)
            if child < len(node[1]):
                work += [(node, child + 1, first), (node[1][child], 0, 0)]
            else:
                labels.append(node[0])
                leftmost.append(first)
        last = {left: i for i, left in enumerate(leftmost)}
        return labels, leftmost, sorted(last.values())

    x, left_x, keys_x = indexed(a)
    y, left_y, keys_y = indexed(b)
    tree = [[0] * len(y) for _ in x]
    for i in keys_x:
        for j in keys_y:
            li, lj = left_x[i], left_y[j]
            n, m = i - li + 2, j - lj + 2
            forest = [[0] * m for _ in range(n)]
            for p in range(1, n):
                forest[p][0] = p
            for q in range(1, m):
                forest[0][q] = q
            for p in range(1, n):
                for q in range(1, m):
                    u, v = li + p - 1, lj + q - 1
                    best = min(forest[p - 1][q], forest[p][q - 1]) + 1
                    if left_x[u] == li and left_y[v] == lj:
                        forest[p][q] = tree[u][v] = min(best, forest[p - 1][q - 1] + (x[u] != y[v]))
                    else:
                        forest[p][q] = min(best, forest[left_x[u] - li][left_y[v] - lj] + tree[u][v])
    return tree[-1][-1]


def outline_similarity(hypothesis: str, reference: str) -> float:
    """1 - tree edit distance of the blocks / nodes of the larger tree."""
    a, b = block_tree(hypothesis), block_tree(reference)

    def size(root: Node) -> int:
        n, work = 0, [root]
        while work:
            node = work.pop()
            n += 1
            work += node[1]
        return n

    return 1.0 - tree_distance(a, b) / max(size(a), size(b))


def word_ratio(hypothesis: str, reference: str) -> float:
    """Share of common words, by difflib's ratio."""
    return difflib.SequenceMatcher(None, reference.split(), hypothesis.split()).ratio()


METRICS = {"bleu": bleu, "rouge_l": rouge_l, "cer": cer, "edit_ratio": edit_ratio, "outline": outline_similarity, "word_ratio": word_ratio}


def score(pairs: DataFrame, key: str, hypothesis: str, reference: str, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """(key, metric, value, error): a metric that fails on a pair gives null and its error. Null counts as empty."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, h, r in zip(batch[key], batch["_h"], batch["_r"], strict=True):
                for m in metrics:
                    try:
                        rows.append((k, m, METRICS[m](h or "", r or ""), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((k, m, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "metric", "value", "error"])

    return pairs.select(key, F.col(hypothesis).alias("_h"), F.col(reference).alias("_r")).mapInPandas(run, f"`{key}` {kind}, metric string, value double, error string")


def ngram_precision(pairs: DataFrame, key: str, hypothesis: str, reference: str, most: int = 4) -> DataFrame:
    """(key, n, matched, total): n-grams of the hypothesis, and those of them the reference has, each as often as it has
    it. Both texts are in one row, so they are counted there. Null counts as empty; without n-grams on either side there is no row."""

    @F.pandas_udf("array<struct<n:int,matched:long,total:long>>")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for h, r in zip(a, b, strict=True):
            x, y = (re.split(r"[ \t\n\x0b\f\r]+", t.strip(" \t\n\x0b\f\r")) if t and t.strip(" \t\n\x0b\f\r") else [] for t in (h, r))
            found = []
            for n in range(1, most + 1):
                u, v = (Counter(zip(*[w[i:] for i in range(n)])) for w in (x, y))
                if u or v:
                    found.append({"n": n, "matched": (u & v).total(), "total": u.total()})
            out.append(found)
        return pd.Series(out, dtype=object)

    return pairs.select(key, F.inline(counted(F.col(hypothesis), F.col(reference))))


def scoreboard(samples: DataFrame, slices: Sequence[str]) -> DataFrame:
    """Means by metric overall, by the first of slices, and by all of them: (level, slices, metric, mean, n)."""
    sets = [slices[:i] for i in range(len(slices) + 1)]
    out = None
    rolled = samples.rollup("metric", *slices).agg(F.grouping_id().alias("_g"), F.avg("value").alias("mean"), F.count("value").alias("n")).filter(F.col("metric").isNotNull())
    full = (1 << len(slices)) - 1
    names = {full >> len(s): len(s) for s in sets}
    level = F.lit(None).cast("int")
    for gid, depth in names.items():
        level = F.when(F.col("_g") == gid, depth).otherwise(level)
    out = rolled.withColumn("level", level)
    return out.select("level", *slices, "metric", "mean", "n")


def gate(current: DataFrame, baseline: DataFrame, groups: Sequence[str], tolerance: float = TOLERANCE["overall"]) -> DataFrame:
    """(groups, metric, current, baseline, delta, verdict) of two sets of means. fail where the loss is greater
    than tolerance in the metric's direction; blocked where one side lacks the group or its value."""
    on = [*groups, "metric"]
    c = current.select(*on, F.col("mean").alias("current"))
    b = baseline.select(*[F.col(x).alias(f"_{x}") for x in on], F.col("mean").alias("baseline"))
    same = F.lit(True)
    for x in on:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    both = c.join(b, same, "full_outer").select(*[F.coalesce(F.col(x), F.col(f"_{x}")).alias(x) for x in on], "current", "baseline")
    delta = F.col("current") - F.col("baseline")
    lost = F.when(F.col("metric").isin(*LOWER_IS_BETTER), delta > tolerance).otherwise(delta < -tolerance)
    absent = lambda x: F.col(x).isNull() | F.isnan(x)
    verdict = F.when(absent("current") | absent("baseline"), "blocked").when(lost, "fail").otherwise("ok")
    return both.select(*on, "current", "baseline", delta.alias("delta"), verdict.alias("verdict"))


def exit_code(verdicts: DataFrame) -> int:
    """0 if all is well, 1 if anything failed, else 2 if anything was blocked."""
    seen = {r.verdict for r in verdicts.select("verdict").distinct().collect()}
    return 1 if "fail" in seen else 2 if "blocked" in seen else 0


def rolling_baseline(runs: DataFrame, group: Sequence[str], order: str, value: str, last: int) -> DataFrame:
    """runs with baseline: the mean of up to last earlier runs of the group that were measured."""
    frame = Window.partitionBy(*group).orderBy(order).rowsBetween(-last, -1)
    measured = runs.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return measured.withColumn("baseline", F.avg(value).over(frame))


def disagreements(samples: DataFrame, item: str, by: str, least: float) -> DataFrame:
    """(item, max_spread, metric) of items on which those in by differ by least or more in some metric, the
    greatest first."""
    spread = samples.groupBy(item, "metric").agg((F.max("value") - F.min("value")).alias("spread"), F.countDistinct(by).alias("n")).filter("n >= 2")
    worst = spread.groupBy(item).agg(F.max(F.struct("spread", "metric")).alias("w"))
    return worst.select(item, F.col("w.spread").alias("max_spread"), F.col("w.metric").alias("metric")).filter(F.col("max_spread") >= least).orderBy(F.desc("max_spread"), item)


def consensus(outputs: DataFrame, item: str, by: str, token: str, primary: str) -> DataFrame:
    """(item, agreed, missing, alone) of the tokens several tools find in an item: agreed by all, found by all others
    but not by primary, found by primary alone."""
    tools = outputs.select(item, by).distinct().groupBy(item).agg(F.count("*").alias("tools"))
    tokens = outputs.select(item, by, token).distinct().groupBy(item, token).agg(F.count("*").alias("n"), F.max((F.col(by) == primary).cast("int")).alias("own"))
    rows = tokens.join(tools, item)
    count = lambda cond: F.sum(cond.cast("long"))
    own = F.col("own") == 1
    return rows.groupBy(item).agg(
        count(F.col("n") == F.col("tools")).alias("agreed"), count(~own & (F.col("n") == F.col("tools") - 1) & (F.col("n") > 0)).alias("missing"), count(own & (F.col("n") == 1) & (F.col("tools") > 1)).alias("alone")
    )


def pivoted(samples: DataFrame, rows: str, metrics: Sequence[str]) -> DataFrame:
    return samples.groupBy(rows).pivot("metric", list(metrics)).agg(F.avg("value"))


def page_class(text_cover: Column, image_cover: Column) -> Column:
    """struct(category, confidence) of a page by the shares that text and images cover (fixed thresholds, in
    single precision)."""
    t, i = text_cover.cast("float"), image_cover.cast("float")
    limit = lambda x: F.lit(x).cast("float")
    made = lambda name, c: F.struct(F.lit(name).alias("category"), F.lit(c).cast("float").alias("confidence"))
    return (
        F.when((t >= limit(0.2)) & (i <= limit(0.1)), made("text_native", 0.9))
        .when((t <= limit(0.05)) & (i >= limit(0.6)), made("scanned", 0.88))
        .when((t > limit(0.05)) & (i > limit(0.1)), made("mixed", 0.7))
        .otherwise(made("unknown", 0.4))
    )


def refined_class(base: Column, signals: dict[str, Column]) -> Column:
    """page_class put right by signals: underlay, image_cover, invisible, font_reliability, text_cover, garbled, shows."""
    s = signals
    made = lambda name, c: F.struct(F.lit(name).alias("category"), F.lit(c).cast("float").alias("confidence"))
    return (
        F.when((s["underlay"] >= 0.5) & (s["image_cover"] >= 0.3), made("scanned", 0.87))
        .when((s["invisible"] >= 0.5) & (s["image_cover"] >= 0.3), made("scanned", 0.82))
        .when((s["font_reliability"] <= 0.5) & (s["text_cover"] >= 0.05) & (s["image_cover"] >= 0.1), made("mixed", 0.75))
        .when((s["garbled"] >= 0.3) & (s["shows"] >= 20), made("mixed", 0.72))
        .when(base["category"] == "unknown", made("text_native", 0.65))
        .otherwise(base)
    )


def grid_cover(boxes: Column, width: float, height: float, cells: int = 20) -> Column:
    """The share of a page that boxes cover, on a grid of cells by cells: overlapping boxes count once."""
    spans = lambda at, size, page: F.sequence(
        F.greatest(F.floor(at / page * cells), F.lit(0)).cast("int"), F.least(F.ceil((at + size) / page * cells) - 1, F.lit(cells - 1)).cast("int")
    )
    inside = F.filter(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0) & (b["x"] < width) & (b["y"] < height) & (b["x"] + b["width"] > 0) & (b["y"] + b["height"] > 0))
    touched = F.flatten(F.transform(inside, lambda b: F.flatten(F.transform(spans(b["x"], b["width"], width), lambda i: F.transform(spans(b["y"], b["height"], height), lambda j: i * cells + j)))))
    return F.coalesce(F.size(F.array_distinct(touched)) / (cells * cells), F.lit(0.0))


def nearest_above(points: DataFrame, lines: DataFrame, group: str, at: str, line_at: str) -> DataFrame:
    """points with line_<group columns> of the last line at or above each, an as-of join as one sorted stream: both
    sides are merged by position and the last line is carried down, so nothing is multiplied."""
    fields = [c for c in lines.columns if c != group]
    payload = F.struct(*fields)
    left = points.select(group, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[c for c in points.columns if c != group]).alias("_p"))
    right = lines.select(group, F.col(line_at).alias("_at"), F.lit(0).alias("_side"), payload.alias("_l"))
    upto = Window.partitionBy(group).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right, allowMissingColumns=True).withColumn("_l", F.last("_l", ignorenulls=True).over(upto)).filter("_side = 1")
    return merged.select(group, "_p.*", *[F.col(f"_l.{c}").alias(f"line_{c}") for c in fields])


def islands(df: DataFrame, group: Sequence[str], order: str, value: str, gap: float) -> DataFrame:
    """df with island: rows of a group in order, a new island wherever value grows by more than gap."""
    w = Window.partitionBy(*group).orderBy(order)
    jump = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_jump", jump).withColumn("island", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def font_reliability(fonts: DataFrame, page: str) -> DataFrame:
    """(page, reliability): the share of a page's used fonts that map their codes to text; fonts (page, font, mapped)."""
    return fonts.groupBy(page, "font").agg(F.max(F.col("mapped").cast("int")).alias("m")).groupBy(page).agg(F.avg("m").alias("reliability"))


def inside_share(texts: DataFrame, images: DataFrame, page: str) -> DataFrame:
    """(page, share): the share of a page's text boxes (x, y, width, height) whose centre lies in an image box.

    A page's image boxes are one array beside its text boxes, so no pairs are made; pages hold few images.
    """
    boxes = images.groupBy(page).agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("_images"))
    x, y = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    within = F.exists(F.coalesce("_images", F.array().cast("array<struct<x:double,y:double,width:double,height:double>>")), lambda b: x.between(b["x"], b["x"] + b["width"]) & y.between(b["y"], b["y"] + b["height"]))
    return texts.join(boxes, page, "left").groupBy(page).agg(F.avg(within.cast("int")).alias("share"))


def word_recall(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """(key, precision, recall) of the word sets of two columns; null where a set is empty."""
    from docweave.functions.text import token_set

    h, r = token_set(F.coalesce(F.col(hypothesis), F.lit(""))), token_set(F.coalesce(F.col(reference), F.lit("")))
    common = F.size(F.array_intersect(h, r))
    return pairs.select(key, F.try_divide(common, F.size(h)).alias("precision"), F.try_divide(common, F.size(r)).alias("recall"))


def by_tool(scores: DataFrame, tool: str = "tool") -> DataFrame:
    """(tool, metric, mean, least, most, n): the report of each tool over (tool, metric, value)."""
    return scores.groupBy(tool, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


def ocr_targets(pages: DataFrame, wanted: DataFrame | None = None, kinds: Sequence[str] = ("scanned", "mixed", "unknown")) -> DataFrame:
    """Pages (with category) whose text must be read from the image; of them those in wanted (with page_no), if given."""
    found = pages.filter(F.col("category").isin(*kinds))
    return found if wanted is None else found.join(wanted.select("page_no").distinct(), "page_no", "left_semi")


def longest(samples: DataFrame, group: str, text: str, k: int) -> DataFrame:
    """The k longest texts of each group, ties in order of the text: (group, rank, text)."""
    w = Window.partitionBy(group).orderBy(F.length(text).desc(), text)
    return samples.select(group, F.row_number().over(w).alias("rank"), text).filter(F.col("rank") <= k)
