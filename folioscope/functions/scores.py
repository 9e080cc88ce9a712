"""Column functions over scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def share_of(value: Column, maximum: Column) -> Column:
    """value / maximum within 0..1; nothing when the maximum is not positive."""
    return F.when(maximum <= 0, F.lit(0.0)).otherwise(clamp(value / maximum))


def saturate(value: Column) -> Column:
    return F.when(value <= 0, F.lit(0.0)).otherwise(clamp(1.0 - F.exp(-value)))


def reciprocal_rank(rank: Column, k: int) -> Column:
    return 1.0 / (F.lit(float(k)) + rank)


def idf_tfidf(df: Column, documents: Column) -> Column:
    return F.log(1.0 + (documents + 1.0) / (df + 1.0))


def idf_bm25(df: Column, documents: Column) -> Column:
    return F.log(1.0 + (documents - df + 0.5) / (df + 0.5))


def tf_weight(weight: Column) -> Column:
    return 1.0 + F.log(F.greatest(F.lit(1.0), weight))


def log2_gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1.0) / (F.log(rank + 1.0) / F.log(F.lit(2.0)))
