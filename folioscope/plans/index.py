"""The searchable index: chunks and everything derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import ChunkRules
from folioscope.operators import chunking, dense, impacts, lexical
from folioscope.session import narrow_rows, write


@dataclass(frozen=True)
class Index:
    """chunks (with embedding), postings, term_stats, the one-row corpus_stats, and impacts: the
    postings by term in blocks."""
    chunks: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    impacts: DataFrame


def index_chunks(chunks: DataFrame, vectors: DataFrame | None = None) -> Index:
    """Derives postings and statistics; joins vectors (chunk_id, embedding) when given."""
    postings = lexical.chunk_postings(chunks)
    stats = lexical.corpus_stats(chunks, postings)
    if vectors is not None:
        chunks = chunks.drop("embedding").join(vectors, "chunk_id", "left")
    elif "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    frequency = lexical.document_frequency(postings)
    return Index(chunks, postings, frequency, stats, impacts.blocks(postings, frequency, stats))


def build_index(documents: DataFrame, embedder: dense.Embedder | None = dense.hashed_vectors,
                rules: ChunkRules = ChunkRules()) -> Index:
    """Chunks and indexes plain-text documents (document_id, path, root, file_name, extension,
    modified_at, text)."""
    chunks = chunking.chunk_sections(chunking.text_sections(documents), rules)
    if embedder is not None:
        chunks = dense.with_vectors(chunks, F.concat_ws(
            "\n", "file_name", "source_location", "content"), embedder)
    return index_chunks(chunks)


TABLES = ("chunks", "postings", "term_stats", "corpus_stats", "impacts")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def materialize(index: Index, path: str) -> Index:
    """Writes the index as tables under ``path`` and reads it back, so that searches start from
    stored postings instead of from the texts. Postings are derived from the chunks just written, so
    texts are cut into chunks once, and statistics from the postings just written."""
    spark = index.chunks.sparkSession
    write(index.chunks, f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    write(lexical.chunk_postings(chunks), f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    write(lexical.document_frequency(postings), f"{path}/term_stats")
    write(lexical.corpus_stats(chunks, postings), f"{path}/corpus_stats")
    with narrow_rows(spark):
        write(impacts.blocks(postings, spark.read.parquet(f"{path}/term_stats"), spark.read.parquet(
            f"{path}/corpus_stats")), f"{path}/impacts", "bucket")
    return open_index(spark, path)


def index_facets(chunks: DataFrame) -> DataFrame:
    """One row: distinct files, chunks, and the sorted distinct extensions."""
    per_file = chunks.groupBy("path").agg(F.count("*").alias("chunks"),
                                          F.first("extension").alias("extension"))
    return per_file.agg(F.count("*").alias("files"),
                        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
                        F.sort_array(F.collect_set("extension")).alias("extensions"))
