"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes all documents that the one before kept and returns the columns of documents; the last
returns pieces of training sequences. Each is written as Parquet and read again as the next one's
documents. Stages ignore further columns, take nulls in any column and keep repeated rows unless they are
what the stage removes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, near_duplicates, packing, repeats, tokens, toxicity
from folioscope.llm.queries import table, vocabulary_path
from folioscope.llm.training import labelled_sample, remainder
from folioscope.session import fresh_folder, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from the labels, doesn't reject."""
    ship_package(spark)
    lexicon = toxicity.learn(labelled_sample(
        docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 5) != 0, toxicity.PER_CLASS))
    return toxicity.keep_mild(docs.select(*COLUMNS), lexicon)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id, a null one only where all are null.
    Groups go by their root: different groups may have the same least id."""
    ship_package(spark)
    groups = near_duplicates.similar(docs)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("root", "group_id").agg(
        F.min("digest").alias("kept_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.xxhash64("text") == F.col("kept_digest"))
    return docs.select(*COLUMNS).join(kept, same, "left_semi").withColumn("digest", F.xxhash64("text")) \
        .dropDuplicates(["doc_id", "digest"]).drop("digest")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that stand elsewhere too; a text of which nothing but space is left
    goes. Bytes of a character that a cut parts go with the cut."""
    ship_package(spark)
    kept = repeats.repeats(docs, keep=COLUMNS[2:])
    changed = kept.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("rest", r"\s+", " ")) != ""))
    text = F.when(F.col("n_removed") > 0, F.col("rest")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("rest").cast("long")).otherwise(F.col("n_chars"))
    return changed.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    ship_package(spark)
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_digest"))
    return docs.select(*COLUMNS).join(bad, same, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs, tokens.share_vocabulary(spark, vocabulary_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("benchmark_decontamination", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: Signatures, learned weights and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
