"""Incremental index maintenance: fingerprints, the diff plan, assembly, hashes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.sources.scan import in_ignored_directory

KEY = ["root", "rel_path"]


def fingerprints(files: DataFrame, contents: DataFrame, previous: DataFrame | None = None,
                 force: bool = False) -> DataFrame:
    """Adds content_hash: the stored one where size and time are unchanged, else SHA-256.

    ``files`` comes from the listing and ``contents`` (path, content) is only joined for the rest.
    """
    hashed = contents.select("path", F.sha2("content", 256).alias("new_hash"))
    if previous is None or force:
        return files.join(hashed, "path").withColumnRenamed("new_hash", "content_hash")
    known = previous.select(*KEY, F.col("size").alias("p_size"),
                            F.col("modified_at").alias("p_modified"),
                            F.col("content_hash").alias("p_hash"))
    same = ((F.col("size") == F.col("p_size")) & (F.col("modified_at") == F.col("p_modified"))
            & (F.coalesce("p_hash", F.lit("")) != ""))
    marked = files.join(known, KEY, "left").withColumn("kept_hash", F.when(same, F.col("p_hash")))
    reread = marked.where(F.col("kept_hash").isNull()).select("path")
    fresh = hashed.join(reread, "path", "left_semi")
    return (marked.join(fresh, "path", "left")
            .withColumn("content_hash", F.coalesce("kept_hash", "new_hash"))
            .where(F.col("content_hash").isNotNull())
            .drop("p_size", "p_modified", "p_hash", "kept_hash", "new_hash"))


def diff(previous: DataFrame, current: DataFrame, compatible: Column | bool = True,
         chunking_version: int = fixed.CHUNKING_VERSION) -> DataFrame:
    """(root, rel_path, change) with change one of ADDED, MODIFIED, DELETED, REUSED.

    ``previous`` holds index entries with fingerprint, reader and chunker version; ``current``
    holds fingerprints with reader.
    """
    facts = ["size", "modified_at", "content_hash", "reader_id", "reader_version"]
    before = previous.select(*KEY, F.struct(*facts).alias("was"),
                             F.col("chunking_version").alias("was_chunked"))
    now = current.select(*KEY, F.struct(*facts).alias("is"))
    allowed = compatible if isinstance(compatible, Column) else F.lit(compatible)
    reused = allowed & (F.col("was") == F.col("is")) & (F.col("was_chunked") == chunking_version)
    return before.join(now, KEY, "full_outer").select(
        *KEY,
        F.when(F.col("was").isNull(), "ADDED").when(F.col("is").isNull(), "DELETED")
        .when(F.coalesce(reused, F.lit(False)), "REUSED").otherwise("MODIFIED").alias("change"))


def reuse_compatible(previous_chunks: DataFrame, manifest: DataFrame, signature: str) -> DataFrame:
    """One row: may unchanged documents keep their chunks? Same model, and all chunks embedded, or
    none when there is no model."""
    counted = previous_chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) > 0).alias("embedded"))
    wanted = F.col("embedded") == (F.col("chunks") if signature else F.lit(0))
    return manifest.join(F.broadcast(counted), F.lit(True)).select(
        ((F.col("model_signature") == signature) & wanted).alias("compatible"))


def entries(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunk ids in chunk order. The ids belong to one document each."""
    ids = chunks.groupBy("document_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("section_id", "cut_no", "chunk_id"))),
        lambda c: c["chunk_id"]).alias("chunk_ids"))
    return documents.join(ids, "document_id", "left").withColumn(
        "chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def split_reusable(plan: DataFrame, previous_entries: DataFrame,
                   previous_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose chunks are all there, documents to read again)."""
    reused = plan.where("change = 'REUSED'").join(previous_entries, KEY)
    wanted = reused.select(*KEY, F.explode_outer("chunk_ids").alias("chunk_id"))
    missing = (wanted.where(F.col("chunk_id").isNotNull())
               .join(previous_chunks.select("chunk_id"), "chunk_id", "left_anti")
               .select(*KEY).distinct())
    keep = reused.join(missing, KEY, "left_anti")
    again = (plan.where("change IN ('ADDED', 'MODIFIED')").select(*KEY)
             .unionByName(missing))
    return keep, again


def assemble(keep: DataFrame, previous_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks of the new snapshot: kept ones by id, and the newly cut ones."""
    ids = keep.select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return previous_chunks.join(ids, "chunk_id", "left_semi").unionByName(
        new_chunks, allowMissingColumns=True)


def source_set_hash(files: DataFrame) -> DataFrame:
    """(root, files, source_hash): changes when any file of the root changes, appears or goes.

    The hashes of the files are added up in four lanes, so a root of any size is summed by
    map-side combine and no task ever holds a root's listing. Files in ignored folders don't count.
    """
    files = files.where(~in_ignored_directory(F.col("rel_path")))
    one = F.sha2(F.concat_ws("\u0000", "rel_path", F.col("size").cast("string"),
                             F.col("modified_at").cast("string")), 256)
    lanes = [F.conv(F.substring("file_hash", 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
             for i in range(4)]
    summed = files.withColumn("file_hash", one).groupBy("root").agg(
        F.count("*").alias("files"),
        *[F.sum(lane).cast("decimal(38,0)").cast("string").alias(f"lane{i}")
          for i, lane in enumerate(lanes)])
    return summed.select("root", "files", F.sha2(F.concat_ws(
        ":", "root", F.col("files").cast("string"), "lane0", "lane1", "lane2", "lane3"), 256)
        .alias("source_hash"))


def source_state_hash(roots: DataFrame, files: DataFrame) -> DataFrame:
    """The same for configured roots, where a root without a listing counts as missing."""
    return roots.select("root").distinct().join(source_set_hash(files), "root", "left").select(
        "root", F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("source_hash", F.sha2(F.concat(F.col("root"), F.lit("\u0000missing")), 256))
        .alias("source_hash"))


def model_signature(provider: Column, name: Column, file_signature: Column, dimension: Column,
                    preprocessing: Column) -> Column:
    return F.concat_ws(":", provider, name, file_signature, dimension.cast("string"),
                       preprocessing.cast("string"))


def artefact_signature(artefacts: DataFrame, contents: DataFrame,
                       cached: DataFrame | None = None) -> DataFrame:
    """One hash over a model's files; only files whose path, size or time changed are hashed
    again. A model has a handful of files."""
    hashed = fingerprints(artefacts, contents, cached)
    return hashed.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "path", "content_hash"))), lambda f: f["content_hash"]), ""), 256).alias("signature"))


def validate_loaded(bases: DataFrame, manifests: DataFrame, current_hashes: DataFrame,
                    signature: str) -> DataFrame:
    """Status each base has to take when its snapshot is loaded, by the first rule that applies.

    ``bases``: base_id, source_revision. ``manifests``: base_id, manifest_revision,
    source_set_hash, model_signature, dimension, chunking_version, format_version.
    ``current_hashes``: base_id, current_hash.
    """
    joined = bases.join(manifests, "base_id", "left").join(current_hashes, "base_id", "left")
    outdated_model = (F.col("dimension") > 0) & (F.col("model_signature") != signature)
    return joined.select(
        "base_id",
        F.when(F.col("manifest_revision").isNull(), "INCOMPATIBLE")
        .when(F.col("manifest_revision") != F.col("source_revision"), "DIRTY")
        .when(~F.col("source_set_hash").eqNullSafe(F.col("current_hash")), "DIRTY")
        .when((F.col("format_version") != fixed.INDEX_FORMAT_VERSION)
              | (F.col("chunking_version") != fixed.CHUNKING_VERSION) | outdated_model,
              "INCOMPATIBLE")
        .otherwise("READY").alias("status"))


def coverage(classified: DataFrame, index_entries: DataFrame) -> DataFrame:
    """State of every file a scan or the index knows.

    ``classified`` comes from the scan with a verdict, ``index_entries`` has root, rel_path, size,
    modified_at and chunk_count.
    """
    known = index_entries.select(*KEY, F.col("size").alias("e_size"),
                                 F.col("modified_at").alias("e_modified"),
                                 F.col("chunk_count").alias("e_chunks"))
    joined = classified.select(*KEY, "verdict", "size", "modified_at").join(
        known, KEY, "full_outer")
    out = F.col("verdict").isin("IGNORED", "SENSITIVE", "SENSITIVE_DIRECTORY", "LINK", "TOO_DEEP")
    state = (F.when(F.col("verdict").isNull(), "DELETED").when(out, "IGNORED")
             .when(F.col("verdict").isin("UNSUPPORTED", "OVERSIZED"), F.col("verdict"))
             .when(F.col("e_size").isNull(), "NOT_INDEXED")
             .when((F.col("size") == F.col("e_size"))
                   & (F.col("modified_at") == F.col("e_modified")), "INDEXED")
             .otherwise("MODIFIED"))
    return joined.select(
        *KEY, state.alias("state"),
        F.when(state.isin("INDEXED", "MODIFIED", "DELETED"), F.coalesce("e_chunks", F.lit(0)))
        .otherwise(0).alias("chunks"))


def directory_rollup(index_entries: DataFrame) -> DataFrame:
    """(root, directory, files): indexed files below each directory, the root included."""
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1),
                        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return (index_entries.where((F.col("root") != "") & (F.col("rel_path") != ""))
            .select("root", F.explode(above).alias("directory"))
            .groupBy("root", "directory").agg(F.count("*").alias("files")))


def listing_order(nodes: DataFrame) -> DataFrame:
    """Directories first, then names without regard to case."""
    return nodes.orderBy(~F.col("is_dir"), F.lower("name"), "name")


def build_metrics(stages: list[tuple[str, float]], counts: dict[str, int], spark) -> DataFrame:
    """(metric, value): milliseconds per stage, their total, and the counts."""
    rows = [(name, float(ms)) for name, ms in stages]
    rows.append(("total", float(sum(ms for _, ms in stages))))
    rows += [(name, float(n)) for name, n in counts.items()]
    return spark.createDataFrame(rows, "metric string, value double")
