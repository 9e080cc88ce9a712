"""Mixing sources to target weights, by subset-sum budget fitting.

Each source gets a target of words; a document is taken once, twice, or not at all.

1. Documents are counted by exact length (``size``, in words) within each source.
2. Targets share ``SHARE`` of all words by weight; one that would be above ``MOST`` times its source's words
   stops there, and what is left is shared by the others, until none is above.
3. Whole repeats come first; the rest of a target is a budget for a part of the documents. Each length gives
   its share of the budget, rounded down; lengths in seeded order give one more document each until the
   budget left is small; bounded-knapsack dynamic programming over the counts left then finds the sum
   nearest to it. Its table is twice as long as that budget, at most ``max(REACH, 2 x longest size)``.
4. Documents are chosen by seeded hash, as many of each length as step 3 says: buckets of hashes are taken
   whole in turn, and one bucket of each length by rank, so no length is ranked as a whole.

A group in Python holds the distinct lengths of one source, never its documents; texts are not shuffled.

Defined results: a null text and one without words have size 0 and are taken 0 times; a null source is a
source of its own, after all others; rows with equal id and text are rows of their own that may be taken
differently; null ids are chosen by their text; other columns are ignored; a table without words has targets
of 0; an empty table gives no rows. Targets don't depend on the order of rows, and reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.words import mix as spread_bits
from folioscope.session import cut_lineage, fresh_folder

#: Weights of the sources in code point order, repeating; words to share, and the most of a source.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 13
#: Budget left, in words, that dynamic programming takes over; more where a single text is longer.
REACH = 1 << 15
#: Hash buckets of one length of one source: 2 ** BUCKET_BITS.
BUCKET_BITS = 12
SOURCE = ("no_source", "source")


def _stored(frame: DataFrame, name: str) -> DataFrame:
    folder = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def sized(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """(no_source, source, size, bucket, pick, doc_id, copies, ahead): rows by exact length and seeded hash;
    ``ahead`` counts the rows before in the bucket. Equal rows of a split are one row with its copies."""
    pick = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    rows = documents.select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        pick.alias("pick"), "doc_id", F.spark_partition_id().alias("split"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("pick", 64 - BUCKET_BITS))
    before = Window.partitionBy(*SOURCE, "size", "bucket").orderBy("pick", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    return _stored(rows.withColumn("ahead", F.coalesce(F.sum("copies").over(before), F.lit(0))).drop("split"), "sized")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``number``: the place of each source in code point order, null last, from 0."""
    parted = cut_lineage(sources.repartitionByRange(*SOURCE).withColumn("part", F.spark_partition_id()))
    # one row for each partition
    offsets = parted.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn("offset", F.coalesce(F.sum(
        "rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE))
    return parted.join(offsets, "part").withColumn("number", F.col("offset") + inside - 1).drop("part", "rows", "offset")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(no_source, source, source_size, target) from (no_source, source, source_size). All targets below
    their limit are the same multiple of their weight; each round raises it by what the limits cut off."""
    if not 0 <= share <= most:
        raise ValueError("the share can't be met")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    known = cut_lineage(_numbered(sources).withColumn("weight", weight.cast("double")).drop("number"))
    limit = F.col("source_size") * float(most)
    budget = (known.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * level > limit
        row = known.agg(F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.sum(F.when(above, limit)).alias(
            "cut"), F.count(F.when(above, 1)).alias("stopped")).first()
        if row["weight"] is None or row["stopped"] == stopped:
            break
        stopped, level = row["stopped"], (budget - (row["cut"] or 0.0)) / row["weight"]
    return known.select(*SOURCE, "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def nearest_sum(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that their sum is nearest to the budget (the lower of two). Bounded
    knapsack: counts are split into powers of two, and each sum keeps the item that first reached it."""
    width = 2 * budget + 1
    reached, by = np.zeros(width, bool), np.zeros(width, np.int32)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        left, step = min(count, (width - 1) // size), 1
        while left > 0 and not reached[budget]:
            several = min(step, left)
            total = several * size
            new = reached[:-total] & ~reached[total:]
            by[total:][new] = len(items)
            reached[total:] |= new
            items.append((k, several))
            left -= several
            step *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    taken = [0] * len(sizes)
    while at:
        k, several = items[by[at]]
        taken[k] += several
        at -= several * sizes[k]
    return taken


def fit(sizes: list[int], counts: list[int], budget: int, seed: int = SEED, reach: int = REACH) -> list[int]:
    """How many documents of each length fill the budget; sizes are above 0 and differ."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = np.argsort(spread_bits(np.array(sizes, np.uint64) + np.uint64(seed << 40)), kind="stable").tolist()
    reach = max(reach, 2 * max(sizes, default=0))
    for k in order:
        if rest <= reach:
            break
        if taken[k] < counts[k]:
            taken[k] += 1
            rest -= sizes[k]
    # sizes above twice the budget are farther from it than nothing at all
    small = [k for k in order if sizes[k] <= 2 * rest and taken[k] < counts[k]]
    for k, more in zip(small, nearest_sum([sizes[k] for k in small], [counts[k] - taken[k] for k in small], rest), strict=True):
        taken[k] += more
    return taken


def plan(lengths: DataFrame, wanted: DataFrame, seed: int = SEED) -> DataFrame:
    """(no_source, source, size, source_size, target, whole, chosen): repeats of all documents of a length, and
    how many of them are taken once more."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        words, target = int(group["source_size"][0]), float(group["target"][0])
        # the budget in whole words; exactly whole repeats need no part
        whole, rest = divmod(round(target), words) if words else (0, 0)
        own = group["size"] > 0
        chosen = np.zeros(len(group), np.int64)
        chosen[own] = fit(group["size"][own].tolist(), group["rows"][own].tolist(), rest, seed)
        return group.drop(columns="rows").assign(whole=whole, chosen=chosen)

    return lengths.join(wanted, [*SOURCE]).groupBy(*SOURCE).applyInPandas(
        work, "no_source boolean, source string, size long, source_size long, target double, whole long, chosen long")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: words of the document, of its source,
    what the source is to give, and what the document gives, repeats counted."""
    rows = sized(documents, seed)
    lengths = rows.groupBy(*SOURCE, "size").agg(F.sum("copies").alias("rows"))
    sources = lengths.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    planned = plan(lengths, targets(sources, weights, share, most), seed)
    buckets = rows.groupBy(*SOURCE, "size", "bucket").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy(*SOURCE, "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = buckets.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows").join(
        planned, [*SOURCE, "size"]).withColumn("quota", F.col("chosen") - F.col("before")).drop("before", "chosen")
    found = rows.join(quotas, [*SOURCE, "size", "bucket"])
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    extra = (F.col("copy") + F.col("ahead") <= F.col("quota")).cast("long")
    return found.withColumn("copy", copy).select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + extra)).alias("taken"))
