"""Versioned snapshots: one folder of Parquet tables per revision, published by a rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.session import narrow_rows

MANIFEST = ("base_id string, revision long, source_set_hash string, model_signature string,"
            " dimension int, chunking_version int, format_version int, built_at long")
POINTER = "published.json"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def hadoop_path(jvm, text: str):
    return jvm.org.apache.hadoop.fs.Path(text)


#: A table, or what derives it from tables written before it, which it asks for by name.
Table = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


def write_revision(spark: SparkSession, folder: str, revision: int,
                   tables: dict[str, Table], manifest: Table) -> str:
    """Writes all tables aside and renames the folder when everything is there. A failed write
    leaves nothing behind, and an earlier build of the revision is deleted only once the new one has
    its place. Renames are atomic on HDFS and local disks; an object store needs a committer of its
    own."""
    fs, jvm = file_system(spark, folder)
    staging = f"{folder}/_staging/{uuid.uuid4()}"
    final, aside = f"{folder}/revision={revision}", f"{folder}/_staging/{uuid.uuid4()}"

    def written(name: str) -> DataFrame:
        return spark.read.parquet(f"{staging}/{name}")

    try:
        for name, table in tables.items():
            if callable(table):
                table = table(written)
            # postings by term lie in folders by bucket, which searches read by name
            by = ["bucket"] if "bucket" in table.columns else []
            with narrow_rows(spark) if by else nullcontext():
                table.write.mode("errorifexists").partitionBy(*by).parquet(f"{staging}/{name}")
        manifest = manifest(written) if callable(manifest) else manifest
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{staging}/manifest")
        earlier = fs.exists(hadoop_path(jvm, final))
        if earlier and not fs.rename(hadoop_path(jvm, final), hadoop_path(jvm, aside)):
            raise OSError(f"could not move {final} aside")
        if not fs.rename(hadoop_path(jvm, staging), hadoop_path(jvm, final)):
            if earlier:
                fs.rename(hadoop_path(jvm, aside), hadoop_path(jvm, final))
            raise OSError(f"could not move the snapshot to {final}")
    finally:
        fs.delete(hadoop_path(jvm, staging), True)
    fs.delete(hadoop_path(jvm, aside), True)
    return final


def manifest_row(spark: SparkSession, base_id: str, revision: int, source_set_hash: str,
                 model_signature: str, dimension: int, built_at: int) -> DataFrame:
    return spark.createDataFrame([(base_id, revision, source_set_hash, model_signature, dimension,
                                   fixed.CHUNKING_VERSION, fixed.INDEX_FORMAT_VERSION, built_at)],
                                 MANIFEST)


def load_revision(spark: SparkSession, folder: str, revision: int,
                  names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of a revision, or None when it is missing or unreadable. A snapshot of an older
    format comes without its manifest and so counts as incompatible."""
    base = f"{folder}/revision={revision}"
    tables = {name: _table(spark, f"{base}/{name}") for name in names}
    if any(table is None for table in tables.values()):
        return None
    manifest = _table(spark, f"{base}/manifest")
    if manifest is not None and not manifest.where(
            F.col("format_version") == fixed.INDEX_FORMAT_VERSION).isEmpty():
        tables["manifest"] = manifest
    return tables


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """None where there is no table or no Parquet schema; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def published_revision(spark: SparkSession, folder: str) -> int | None:
    fs, jvm = file_system(spark, folder)
    if not fs.exists(hadoop_path(jvm, f"{folder}/{POINTER}")):
        return None
    return json.loads(spark.read.text(f"{folder}/{POINTER}", wholetext=True).first()[0])["revision"]


def publish_revision(spark: SparkSession, folder: str, revision: int, expected_hash: str,
                     current_hash: str) -> bool:
    """Points readers to a revision if the sources are still what it was built from.

    The pointer is replaced by one atomic rename, so readers always see a revision. A stale build
    deletes its own revision.
    """
    fs, jvm = file_system(spark, folder)
    published = published_revision(spark, folder)
    if published == revision:
        return False
    if expected_hash != current_hash or (published or 0) > revision:
        fs.delete(hadoop_path(jvm, f"{folder}/revision={revision}"), True)
        return False
    aside = hadoop_path(jvm, f"{folder}/_staging/{uuid.uuid4()}.json")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"revision": revision}).encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(aside), fs.makeQualified(hadoop_path(jvm, f"{folder}/{POINTER}")), overwrite)
    return True


def retire(spark: SparkSession, folder: str) -> list[str]:
    """Deletes every revision but the published one, and leftovers of failed writes."""
    fs, jvm = file_system(spark, folder)
    keep = published_revision(spark, folder)
    gone = []
    for status in fs.listStatus(hadoop_path(jvm, folder)):
        name = status.getPath().getName()
        stale = name == "_staging" or (
            name.startswith("revision=") and keep is not None and name != f"revision={keep}")
        if stale and fs.delete(status.getPath(), True):
            gone.append(name)
    return sorted(gone)


def write_report(report: DataFrame, path: str) -> None:
    """Evaluation, ablation and diagnostic reports as JSON lines."""
    report.write.mode("overwrite").json(path)
