"""Keeping chunks and postings current, one micro-batch of documents at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import ChunkRules
from folioscope.operators import chunking, lexical
from folioscope.session import stored
from folioscope.streaming import segments


def newest_rows(batch: DataFrame) -> DataFrame:
    """One row per document: the greatest seq, a deletion before other rows of the same seq. Only documents that
    come more than once are shuffled with their texts; rows without an id are taken as they are."""
    repeated = stored(batch.groupBy("document_id").count().where("count > 1").select("document_id"), "repeated")
    others = F.struct(*[c for c in batch.columns if c != "document_id"])
    chosen = batch.join(repeated, "document_id", "left_semi").groupBy("document_id").agg(
        F.max_by(others, F.struct("seq", "deleted", "text")).alias("row")).select("document_id", "row.*")
    return batch.join(repeated, "document_id", "left_anti").unionByName(chosen)


def apply_batch(spark: SparkSession, batch: DataFrame, number: int, folder: str,
                rules: ChunkRules = ChunkRules()) -> None:
    """Adds a segment with the chunks and postings of the documents a batch touches.

    ``batch``: document rows with seq and deleted. What is written follows the batch, not the index; ``current``
    reads the newest version of each document, so a row that comes late doesn't replace a newer one.
    """
    rows = newest_rows(batch)

    def chunks(_) -> DataFrame:
        return chunking.chunk_sections(chunking.text_sections(rows.where(~F.col("deleted"))), rules)

    def postings(written) -> DataFrame:
        # the document goes along in the key, so that postings are grouped where their texts are
        cut = lexical.indexed_text(written("chunks")).withColumn("owner", F.struct("document_id", "chunk_id"))
        return lexical.weighted_postings(cut, "owner", "indexed_text").select("owner.*", "term", "weight", "doc_length")

    segments.add(spark, folder, number, rows, {"chunks": chunks, "postings": postings}, spread=("postings",))


def current(spark: SparkSession, folder: str, table: str, of: DataFrame | None = None) -> DataFrame:
    """``chunks`` or ``postings`` as all batches so far leave them, of some documents (document_id) if asked."""
    return segments.newest(spark, folder, table, of)


def incremental_index(documents: DataFrame, folder: str, checkpoint: str,
                      rules: ChunkRules = ChunkRules(), first: int = 0):
    """Starts the stream; the result after all batches equals a full build. ``first`` is the number of the
    first batch, where an earlier stream has written to the folder."""
    spark = documents.sparkSession
    return (documents.writeStream
            .foreachBatch(lambda batch, n: apply_batch(spark, batch, first + n, folder, rules))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
