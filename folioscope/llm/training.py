"""Labelled samples of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, of: int) -> Column:
    """crc32(doc_id as text) mod ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _kept(value: Column, sizes: dict[int, int], per_class: int) -> Column:
    """Whether a hash stays when a class is cut to ``per_class``; all do where it is no larger."""
    share = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, per_class / size)).otherwise(share)
    return (value / F.lit(float(1 << 64))) + 0.5 <= share


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, taken: Column,
                    per_class: int) -> DataFrame:
    """(doc_id, text, label): about ``per_class`` labelled documents of either class, chosen by hashes
    among the rows where ``taken`` holds: first of ids, then of rows, as many may share an id. The chosen ids, at
    most a few tens of thousands by that parameter, are broadcast, so the texts aren't shuffled. Null labels and
    ids are left out; an id with both labels counts as 1."""
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & taken)
             .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label")))
    chosen = F.broadcast(known.where(_kept(F.xxhash64("doc_id"), _sizes(known), per_class)))
    rows = _sizes(documents.select("doc_id").join(chosen, "doc_id"))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").where(
        _kept(F.xxhash64("text", "doc_id"), rows, per_class))
