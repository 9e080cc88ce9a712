"""The rebuild job: from a listing to a published revision, reading and embedding only what changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import ChunkRules, ScanRules
from folioscope.functions import fixed, text as tx
from folioscope.operators import chunking, dense, impacts, indexing, lexical
from folioscope.plans.index import TABLES, Index
from folioscope.session import cut_lineage, stored
from folioscope.sources import decode, html, scan, snapshot

FACTS = ["size", "modified_at", "content_hash", "reader_id", "reader_version"]


@dataclass(frozen=True)
class Rebuilt:
    """revision: the new one. published: whether readers see it. plan: (root, rel_path, change).
    unreadable: (path, reader_id, message, skipped) of files that gave no text, and a row if the scan's
    budget cut files off."""
    revision: int
    published: bool
    plan: DataFrame
    unreadable: DataFrame


def rebuild(spark: SparkSession, listing: Callable[[], DataFrame], read: Callable[[DataFrame], DataFrame],
            folder: str, base_id: str, revision: int, signature: str = "hashed:64",
            embedder: dense.Embedder | None = dense.hashed_vectors, scan_rules: ScanRules = ScanRules(),
            chunk_rules: ChunkRules = ChunkRules(), built_at: int = 0) -> Rebuilt:
    """Builds and publishes a revision.

    ``listing()`` gives the files (root, path, rel_path, size, modified_at), ``read(files)`` the contents
    (path, content) of the files it is given, and
    an ``error`` where one couldn't be read: it becomes a warning and the rest is published. Files of unchanged size and time are not opened. Chunks of
    unchanged files are kept where model and chunker are those of the published revision; otherwise
    everything is cut and embedded again. The revision is published if the sources are still as listed.
    """
    accepted = cut_lineage(_accepted(listing(), scan_rules).select(
        *indexing.KEY, "path", "size", "modified_at", "reader_id", "reader_version"))
    files = cut_lineage(scan.within_budget(accepted, scan_rules))
    expected = _state(indexing.source_set_hash(accepted))
    before = snapshot.published_revision(spark, folder)
    earlier = None if before is None else snapshot.load_revision(spark, folder, before, ["chunks", "entries", "postings"])
    known = None if earlier is None else earlier["entries"]
    opened = files if known is None else files.join(
        known.select(*indexing.KEY, "size", "modified_at"), [*indexing.KEY, "size", "modified_at"], "left_anti")
    # what is opened is read once, so hashes and chunks are of the same bytes
    first_read = stored(_with_errors(read(opened)), "contents")
    hashed = cut_lineage(indexing.fingerprints(files, first_read, known))
    if known is None:
        plan = cut_lineage(hashed.select(*indexing.KEY, F.lit("ADDED").alias("change")))
        again, kept = plan.select(*indexing.KEY), None
    else:
        manifest = earlier.get("manifest")
        allowed = manifest is not None and bool(
            indexing.reuse_compatible(earlier["chunks"], manifest, signature).first()[0])
        plan = cut_lineage(indexing.diff(known, hashed, allowed))
        kept, again = indexing.split_reusable(plan, known.select(*indexing.KEY, "chunk_ids"), earlier["chunks"])
    wanted = files.join(again, indexing.KEY, "left_semi")
    unopened = wanted.join(opened.select("path"), "path", "left_anti")
    every = first_read.unionByName(_with_errors(read(unopened)))
    contents = wanted.join(every.where("error IS NULL").drop("error"), "path")
    sections, unreadable = _sections(contents)
    failed = files.join(every.where("error IS NOT NULL").select("path", "error"), "path").select(
        "path", "reader_id", F.col("error").alias("message"), F.lit(True).alias("skipped"))
    chunks = chunking.chunk_sections(sections, chunk_rules)
    if embedder is not None:
        chunks = dense.with_vectors(chunks, F.concat_ws("\n", "file_name", "source_location", "content"), embedder)
    else:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    if kept is not None:
        chunks = indexing.assemble(kept, earlier["chunks"], chunks)
    facts = hashed.select(
        *indexing.KEY, "path", *FACTS, F.lit(fixed.CHUNKING_VERSION).alias("chunking_version"),
        decode.document_id(F.col("root"), F.col("rel_path")).alias("document_id"))

    def manifest_of(at: Callable[[str], DataFrame]) -> DataFrame:
        dimension = 0 if embedder is None else at("chunks").agg(
            F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
        return snapshot.manifest_row(spark, base_id, revision, expected, signature, dimension, built_at)

    snapshot.write_revision(spark, folder, revision, {
        "chunks": chunks, "postings": lambda at: postings_of(at("chunks"), earlier),
        "term_stats": lambda at: lexical.document_frequency(at("postings")),
        "corpus_stats": lambda at: lexical.corpus_stats(at("chunks"), at("postings")),
        "impacts": lambda at: impacts.blocks(at("postings"), at("term_stats"), at("corpus_stats")),
        "entries": lambda at: indexing.entries(facts, at("chunks")),
    }, manifest_of)
    current = _state(indexing.source_set_hash(_accepted(listing(), scan_rules)))
    published = snapshot.publish_revision(spark, folder, revision, expected, current)
    return Rebuilt(revision, published, plan, unreadable.unionByName(failed).unionByName(
        scan.budget_warning(accepted, files)))


def postings_of(chunks: DataFrame, earlier: dict[str, DataFrame] | None) -> DataFrame:
    """Postings of a revision's chunks. A chunk's id stands for its names and text, so the postings of chunks
    that the earlier revision holds are taken from there, and only new chunks are taken apart."""
    if earlier is None:
        return lexical.chunk_postings(chunks)
    fresh = chunks.join(earlier["chunks"].select("chunk_id"), "chunk_id", "left_anti")
    return earlier["postings"].join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(
        lexical.chunk_postings(fresh))


def _with_errors(contents: DataFrame) -> DataFrame:
    """Readers that can't fail give no error column."""
    error = F.col("error") if "error" in contents.columns else F.lit(None).cast("string")
    return contents.select("path", "content", error.alias("error"))


def _accepted(files: DataFrame, scan_rules: ScanRules) -> DataFrame:
    return scan.classify(files, scan.reader_registry(files.sparkSession), scan_rules).where("verdict = 'ACCEPTED'")


def _sections(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of the files by their readers, and warnings of the files that gave none."""
    paged = contents.where(F.col("reader_id") == fixed.HTML_READER[0])
    plain = contents.where(F.col("reader_id") != fixed.HTML_READER[0])
    documents = decode.text_documents(plain)
    silent = plain.join(documents.select("path"), "path", "left_anti").select(
        "path", "reader_id", F.lit("no readable text").alias("message"), F.lit(True).alias("skipped"))
    units, failed = html.split_failures(html.extract_pages(
        paged.select("path", decode.decoded(F.col("content")).alias("html")), "path"), "path")
    named = paged.select(
        decode.document_id(F.col("root"), F.col("rel_path")).alias("document_id"), "path", "root",
        tx.file_name(F.col("rel_path")).alias("file_name"), "modified_at").withColumn(
            "extension", tx.file_extension(F.col("file_name"), "html"))
    return chunking.text_sections(documents).unionByName(
        html.html_sections(units, named, "path")), silent.unionByName(failed)


def _state(hashes: DataFrame) -> str:
    """One hash for all roots. Roots are configured by hand, so they are few."""
    row = hashes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("source_hash")), ","), 256)).first()
    return row[0]


def published_index(spark: SparkSession, folder: str, signature: str = "hashed:64") -> Index:
    """The published revision for searches. Vectors that another model made, or that are incomplete, are left
    out, so a search of them falls back to terms."""
    revision = snapshot.published_revision(spark, folder)
    tables = snapshot.load_revision(spark, folder, revision, list(TABLES))
    if tables is None:
        raise FileNotFoundError(f"revision {revision} of {folder} is incomplete")
    chunks, manifest = tables.pop("chunks"), tables.pop("manifest", None)
    usable = manifest is not None and bool(dense.compatibility(chunks, manifest, signature).first()[0])
    if not usable:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    return Index(chunks, **tables)
