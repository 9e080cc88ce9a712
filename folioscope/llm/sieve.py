"""A bitmap that keeps rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap has 2 ** BITS bits: at most 2 ** 18 rows of a word and its bits are broadcast, however many
#: hashes it stands for.
BITS = 24


def marked(frame: DataFrame, value: str, wanted: DataFrame, wanted_value: str, bits: int = BITS) -> DataFrame:
    """Adds ``maybe``: whether a row's hash may be among the wanted hashes. It is true for all that are,
    and for few others while the bitmap is sparse."""
    def spot(hash_: Column) -> Column:
        return F.shiftrightunsigned(hash_, 64 - bits)

    def bit(hash_: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot(hash_), F.lit(64)).cast("int"))

    held = wanted.select(F.shiftright(spot(F.col(wanted_value)), 6).alias("_word"), bit(F.col(wanted_value)).alias(
        "_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return frame.withColumn("_word", F.shiftright(spot(F.col(value)), 6)).join(F.broadcast(held), "_word", "left").withColumn(
        "maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(F.col(value))) != 0, F.lit(False))).drop("_word", "_bits")


def sieve(frame: DataFrame, value: str, wanted: DataFrame, wanted_value: str, bits: int = BITS) -> DataFrame:
    """Rows of ``frame`` whose hash may be among the wanted hashes. The join that follows is what decides."""
    return marked(frame, value, wanted, wanted_value, bits).where("maybe").drop("maybe")
