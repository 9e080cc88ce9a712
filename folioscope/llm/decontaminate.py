"""Benchmark decontamination: word windows of the training texts against a hash set of test windows.

Only DataFrame functions. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
A test window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one
window. Windows are looked up by a 64-bit hash and then compared word by word.

Defined results: a null or empty text has no words and is clean; a null item has no windows; null ids
are ids like any other; items or documents that are repeated rows are each reported; with no items
nothing is contaminated; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 10
#: Test windows are broadcast up to this many bytes of item text; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 16 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text. lower() is the faster way for texts without other letters."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def _key(length: Column | int, parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, *parts)


def test_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, length, window, items): each distinct window with the ids of its items."""
    taken = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    cut = taken.select("item_id", length.alias("length"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - length + 1),
        lambda i: F.slice(F.col("w"), i, length))).alias("window"))
    parts = [F.try_element_at("window", F.lit(i + 1)) for i in range(size)]
    return cut.groupBy("length", "window").agg(F.array_sort(F.collect_set(F.coalesce(
        F.col("item_id").cast("string"), F.lit("null")))).alias("items")).select(
            _key(F.col("length"), parts).alias("key"), "length", "window", "items")


def hits(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, digest, start, length, items): every occurrence of a test window in a document,
    start counted in words from 0. digest tells rows apart that share a doc_id."""
    tests = test_windows(items, size)
    about = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
                      F.collect_set(F.least(F.size(words(F.col("text"))), F.lit(size)))).first()
    lengths = sorted(n for n in about[1] if n > 0)
    if about[0] * size <= BROADCAST_BYTES:
        tests = F.broadcast(tests)
    spread = documents.select(
        "doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    names = [f"w{i}" for i in range(size)]
    windows = spread.where(F.size("w") > 0).select("doc_id", "digest", F.inline(F.arrays_zip(
        F.sequence(F.lit(0), F.size("w") - 1).alias("start"), F.col("w").alias("w0"),
        *(F.slice("w", F.lit(i + 1), F.size("w")).alias(f"w{i}") for i in range(1, size)))
    ).alias("start", *names))

    def keyed(n: int) -> DataFrame:
        parts = [F.col(c) if i < n else F.lit(None).cast("string") for i, c in enumerate(names)]
        same = F.lit(True)
        for i in range(n):
            same = same & (F.col(f"w{i}") == F.col("window")[i])
        return (windows.where(F.col(f"w{n - 1}").isNotNull()).withColumn("key", _key(n, parts))
                .join(tests.where(F.col("length") == n), "key").where(same)
                .select("doc_id", "digest", "start", "length", "items"))

    found = [keyed(n) for n in lengths] or [keyed(size).limit(0)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def decontaminate(documents: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: n_words, n_hit (words inside any occurrence of a test window), n_items,
    items_sha256 (of the sorted ids, comma-joined), contaminated, spans (merged hit runs of words)."""
    spans = F.aggregate(
        F.array_sort("found"),
        F.lit(None).cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(acc.isNull(), F.array(x))
        .when(F.element_at(acc, -1)["end"] >= x["start"], F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))
    by_document = hits(documents, items, size).groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct(F.col("start").cast("int").alias("start"), (
            F.col("start") + F.col("length")).cast("int").alias("end"))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    ).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "ids",
             spans.alias("spans"))
    base = documents.select(
        "doc_id", F.xxhash64("text").alias("digest"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(by_document, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (
        F.col("digest") == F.col("hit_digest")), "left")
    covered = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["start"])
    return joined.select(
        "doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"), "spans", "digest")
