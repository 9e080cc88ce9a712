"""Postings, document frequencies, TF-IDF and corpus statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from folioscope.config import DOCUMENT_WEIGHTS, QUERY_WEIGHTS, TermWeights
from folioscope.functions import fixed, scores, text as tx

#: Postings that leave a task at once.
BATCH = 100_000


def indexed_text(chunks: DataFrame) -> DataFrame:
    """Adds the text a chunk is indexed under: file name, location and content."""
    return chunks.withColumn("indexed_text", F.concat_ws(
        "\n", "file_name", "source_location", "content"))


def _normalized(texts: DataFrame, text: str) -> DataFrame:
    """Adds ``__norm``, the normalised text. This step goes through Arrow, and Spark forgets a partitioning there."""
    return texts.withColumn("__split", tx.split_camel(F.col(text))).withColumn(
        "__norm", tx.normalize_text(F.col("__split"))).drop("__split")


def _han_terms(norm: Column, weights: TermWeights) -> Column:
    runs = F.when(tx.is_ascii(norm), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(norm, F.lit(r"[\p{IsHan}]+"), 0))
    return tx.han_terms(runs, weights)


def _wide_terms(texts: DataFrame, weights: TermWeights) -> DataFrame:
    """Adds ``terms``: the Han and concept terms of ``__norm``."""
    return (texts
            .withColumn("__compact", F.regexp_replace("__norm", r"\s+", ""))
            .withColumn("__han", _han_terms(F.col("__norm"), weights))
            .withColumn("terms", F.concat("__han", tx.concept_terms(F.col("__compact"), weights)))
            .drop("__compact", "__han"))


def _terms_of_normalized(texts: DataFrame, query: bool) -> DataFrame:
    weights = QUERY_WEIGHTS if query else DOCUMENT_WEIGHTS
    return _wide_terms(texts, weights).withColumn("terms", F.concat(
        tx.latin_terms(F.col("__norm"), weights), "terms")).drop("__norm")


def with_terms(texts: DataFrame, text: str, query: bool = False) -> DataFrame:
    """Adds ``terms``: every term occurrence of the text with its weight.

    The steps are columns of their own, so that each is computed once per row.
    """
    return _terms_of_normalized(_normalized(texts, text), query)


def weighted_postings(texts: DataFrame, key: str, text: str, query: bool = False) -> DataFrame:
    """(key, term, weight, doc_length), one row per distinct term of a text.

    The normalised texts are spread and sorted by key before they are taken apart, a fraction of the size of their
    postings. The terms of a text are counted where it is read, so a task holds the terms of one text and of
    one batch, however many texts it has; rows of one key follow each other and are added up.
    """
    weights = QUERY_WEIGHTS if query else DOCUMENT_WEIGHTS
    spread = _normalized(texts.select(F.col(key).alias("key"), text), text).select("key", "__norm").repartition(
        "key").sortWithinPartitions("key")
    rare = spread.select("key", F.col("__norm").alias("text"), _han_terms(F.col("__norm"), weights).alias("terms"))
    kind = rare.schema["key"].dataType
    return rare.mapInArrow(partial(_counted, weights.latin, to_arrow_type(kind), concept=weights.concept), StructType([
        StructField("key", kind), StructField("term", StringType()), StructField("weight", DoubleType()),
        StructField("doc_length", DoubleType())])).withColumnRenamed("key", key)


def _counted(latin: float, kind: pa.DataType, batches: Iterator[pa.RecordBatch],
             concept: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Postings of texts that come sorted by key. Latin terms and concepts of this weight are found here, the
    others come along."""
    inner, stop = b"abcdefghijklmnopqrstuvwxyz0123456789", frozenset(fixed.STOP_WORDS)
    parted = bytes(b if b in inner else 32 for b in range(256))
    phrases = [(f"concept:{name}", [p.replace(" ", "") for p in of]) for name, of in fixed.CONCEPTS.items()]
    last, found, length = None, {}, 1.0
    keys, sizes, lengths, terms, weights = [], [], [], [], []

    def postings() -> pa.RecordBatch:
        owner = pa.array(np.repeat(np.arange(len(keys)), sizes))
        rows = pa.RecordBatch.from_arrays(
            [pa.array(keys, kind).take(owner), pa.array(terms, pa.string()), pa.array(weights, pa.float64()),
             pa.array(lengths, pa.float64()).take(owner)], names=["key", "term", "weight", "doc_length"])
        for column in (keys, sizes, lengths, terms, weights):
            column.clear()
        return rows

    def keep() -> None:
        keys.append(last)
        sizes.append(len(found))
        lengths.append(length)
        terms.extend(found)
        weights.extend(found.values())

    for batch in batches:
        for key, text, others in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "terms"))):
            if text is None:
                continue
            # runs of letters a to z and digits; a sign outside ASCII becomes one that parts
            counts = Counter(text.encode("ascii", "replace").translate(parted).decode("ascii").split())
            own = {term: n * latin for term, n in counts.items() if len(term) > 1 and term not in stop}
            total = sum(own.values())
            for other in others:
                own[other["term"]] = own.get(other["term"], 0.0) + other["weight"]
                total += other["weight"]
            if concept:
                compact = text
                for space in " \t\n\x0b\f\r":
                    compact = compact.replace(space, "")
                for name, of in phrases:
                    if any(phrase in compact for phrase in of):
                        own[name] = concept
                        total += concept
            if found and key == last:
                for term, weight in own.items():
                    found[term] = found.get(term, 0.0) + weight
                continue
            if found:
                keep()
            last, found, length = key, own, max(1.0, total)
            if len(terms) > BATCH:
                yield postings()
    if found:
        keep()
    if keys:
        yield postings()


def chunk_postings(chunks: DataFrame) -> DataFrame:
    return weighted_postings(indexed_text(chunks), "chunk_id", "indexed_text")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: number of chunks and average length. A chunk without terms has length one."""
    lengths = postings.groupBy("chunk_id").agg(F.first("doc_length").alias("doc_length"))
    summed = lengths.agg(F.coalesce(F.sum("doc_length"), F.lit(0.0)).alias("total"),
                         F.count("*").alias("with_terms"))
    counted = chunks.agg(F.count("*").alias("documents"))
    # Two global aggregates, one row each.
    joined = counted.join(F.broadcast(summed), F.lit(True))
    total = F.col("total") + (F.col("documents") - F.col("with_terms"))
    return joined.select(
        "documents",
        F.greatest(F.lit(1.0), F.coalesce(total / F.col("documents"), F.lit(1.0)))
        .alias("average_length"))


def hot_terms(term_stats: DataFrame, stats: DataFrame, hot_share: float = 0.01) -> DataFrame:
    """(term, hot_df) of the terms that occur in more than ``hot_share`` of the chunks.

    There can be at most (distinct terms per chunk / hot_share) such terms, however large the
    corpus, so they may be shipped to the tasks.
    """
    sized = term_stats.join(F.broadcast(stats.select("documents")), F.lit(True))
    return sized.where(F.col("df") > F.col("documents") * F.lit(hot_share)).select(
        "term", F.col("df").alias("hot_df"))


def with_document_frequency(postings: DataFrame, term_stats: DataFrame, stats: DataFrame,
                            hot_share: float = 0.01) -> DataFrame:
    """Adds df to every posting.

    A hot term would make one reducer receive all of its postings. Hot terms are shipped to the
    tasks; only the postings of the others are shuffled.
    """
    hot = hot_terms(term_stats, stats, hot_share)
    marked = postings.join(F.broadcast(hot), "term", "left").withColumnRenamed("hot_df", "df")
    cold = marked.where(F.col("df").isNull()).drop("df").join(term_stats.select("term", "df"), "term", "left")
    return marked.where(F.col("df").isNotNull()).unionByName(cold).withColumn("df", F.coalesce("df", F.lit(0)))


def tfidf(postings: DataFrame, term_stats: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds df and tfidf to every posting."""
    return (with_document_frequency(postings, term_stats, stats)
            .join(F.broadcast(stats.select("documents")), F.lit(True))
            .withColumn("tfidf", scores.tf_weight(F.col("weight"))
                        * scores.idf_tfidf(F.col("df"), F.col("documents")))
            .drop("documents"))


def document_stats(tfidf_postings: DataFrame) -> DataFrame:
    """Length and TF-IDF norm of each chunk that has terms."""
    return tfidf_postings.groupBy("chunk_id").agg(
        F.first("doc_length").alias("length"),
        F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
