"""Corpus scans: which files are taken, which are reported, and where a scan stops."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.config import ScanRules
from folioscope.functions import fixed, text as tx
from folioscope.session import cut_lineage, ship_package

WARNING = "path string, reader_id string, message string, skipped boolean"


def _open(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:"):]
    found, path = pa.fs.FileSystem.from_uri(root)
    return found, path.rstrip("/") or "/"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(root, path, rel_path, size, modified_at, is_link) of every file below a root, whatever its name;
    contents unread.

    Folders are listed in tasks, one level of the tree after the other; a level is stored, so that
    it is listed once. Links are reported and not followed. The root may be a path or a URI of any
    file system that Arrow opens; paths are given as the root spells them, without ``file:``.
    """
    ship_package(spark)
    clean_root = re.sub(r"^file:/+", "/", root.rstrip("/"))

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = _open(root)
        local = isinstance(found, pa.fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                where = f"{base}/{folder}" if folder else base
                infos = found.get_file_info(pa.fs.FileSelector(where, allow_not_found=True))
                links = [local and os.path.islink(i.path) for i in infos]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder}/{i.base_name}" if folder else i.base_name for i in infos], pa.string()),
                    pa.array([i.size for i in infos], pa.int64()),
                    pa.array([(i.mtime_ns or 0) // 1_000_000 for i in infos], pa.int64()),
                    pa.array([i.type == pa.fs.FileType.Directory and not link
                              for i, link in zip(infos, links, strict=True)], pa.bool_()),
                    pa.array(links, pa.bool_())], ["rel_path", "size", "modified_at", "is_folder", "is_link"])

    schema = "rel_path string, size long, modified_at long, is_folder boolean, is_link boolean"
    folders = spark.createDataFrame([("",)], "rel_path string")
    levels: list[DataFrame] = []
    while True:
        level = cut_lineage(folders.mapInArrow(children, schema))
        levels.append(level.where("not is_folder"))
        below = level.where("is_folder").select("rel_path")
        if below.isEmpty():
            break
        folders = below.repartition(spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionAll, levels).select(
        F.lit(clean_root).alias("root"), F.concat(F.lit(clean_root + "/"), "rel_path").alias("path"),
        "rel_path", F.coalesce("size", F.lit(0)).alias("size"), "modified_at", "is_link")


def read_contents(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(path, content, error) of the given files below a root, or of all; only these are opened. A file that
    can't be read, as one without permission or deleted since it was listed, has no content but its error."""
    wanted = (list_files(spark, root).where("not is_link") if files is None else files).select(
        "path", "rel_path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = _open(root)
        for batch in batches:
            for path, rel_path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content, error = None, None
                try:
                    with found.open_input_stream(f"{base}/{rel_path}", compression=None) as stream:
                        content = stream.read()
                except OSError as fault:
                    error = f"{type(fault).__name__}: {fault}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())],
                    ["path", "content", "error"])

    return wanted.mapInArrow(read, "path string, content binary, error string")


def _directories(rel_path: Column) -> Column:
    parts = F.split(F.lower(rel_path), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def in_ignored_directory(rel_path: Column) -> Column:
    return F.exists(_directories(rel_path), lambda d: d.isin(*fixed.IGNORED_DIRECTORIES))


def in_sensitive_directory(rel_path: Column) -> Column:
    return F.exists(_directories(rel_path), lambda d: d.isin(*fixed.SENSITIVE_DIRECTORIES))


def meets_ignored_first(rel_path: Column) -> Column:
    """Whether a walk from the root meets an ignored directory, and none that is sensitive before it."""
    directories = _directories(rel_path)
    stops = F.filter(directories, lambda d: d.isin(*fixed.IGNORED_DIRECTORIES, *fixed.SENSITIVE_DIRECTORIES))
    return F.coalesce(F.get(stops, F.lit(0)).isin(*fixed.IGNORED_DIRECTORIES), F.lit(False))


def is_sensitive_file(name: Column) -> Column:
    key = F.lower(tx.strip(name))
    return (key.isin(*fixed.SENSITIVE_NAMES) | key.startswith(fixed.SENSITIVE_PREFIX)
            | F.regexp_extract(key, r"\.([^.]+)$", 1).isin(*fixed.SENSITIVE_EXTENSIONS))


def reader_registry(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """(key, kind, reader_id, reader_version, max_bytes). A key may be registered once."""
    rows = [(e, "extension", *fixed.TEXT_READER) for e in fixed.TEXT_EXTENSIONS]
    rows += [(n, "name", *fixed.TEXT_READER) for n in fixed.TEXT_FILE_NAMES]
    rows += [(e, "extension", *fixed.HTML_READER) for e in fixed.HTML_EXTENSIONS]
    rows += list(extra)
    keys = [(r[0], r[1]) for r in rows]
    twice = sorted({k for k in keys if keys.count(k) > 1})
    if twice:
        raise ValueError(f"registered twice: {twice}")
    return spark.createDataFrame(
        rows, "key string, kind string, reader_id string, reader_version int, max_bytes long")


def route_readers(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the reader of each file: by whole name first, then by extension."""
    name = F.lower(tx.file_name(F.col("rel_path")))
    keyed = (files.withColumn("file_name", tx.file_name(F.col("rel_path")))
             .withColumn("__name", name)
             .withColumn("__ext", F.regexp_extract(name, r"\.([^.]+)$", 1)))

    def lookup(kind: str, prefix: str) -> DataFrame:
        # The registry is a fixed list of reader keys.
        return F.broadcast(registry.where(F.col("kind") == kind).select(
            F.col("key").alias(f"__{prefix}"), F.col("reader_id").alias(f"{prefix}_id"),
            F.col("reader_version").alias(f"{prefix}_version"),
            F.col("max_bytes").alias(f"{prefix}_max")))

    routed = keyed.join(lookup("name", "name"), "__name", "left").join(
        lookup("extension", "ext"), "__ext", "left")
    return (routed.withColumn("reader_id", F.coalesce("name_id", "ext_id"))
            .withColumn("reader_version", F.coalesce("name_version", "ext_version"))
            .withColumn("max_bytes", F.coalesce("name_max", "ext_max"))
            .drop("__name", "__ext", "name_id", "ext_id", "name_version", "ext_version",
                  "name_max", "ext_max"))


def classify(files: DataFrame, registry: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """Adds ``verdict``: ACCEPTED, or the first rule that keeps the file out."""
    routed = route_readers(files, registry)
    guarded = F.lit(rules.skip_sensitive)
    depth = F.size(F.split("rel_path", "/"))
    ignored = meets_ignored_first if rules.skip_sensitive else in_ignored_directory
    return routed.withColumn(
        "verdict",
        F.when(ignored(F.col("rel_path")), "IGNORED")
        .when(guarded & in_sensitive_directory(F.col("rel_path")), "SENSITIVE_DIRECTORY")
        .when(depth > rules.max_depth, "TOO_DEEP")
        .when(F.coalesce(F.col("is_link"), F.lit(False)) if "is_link" in files.columns
              else F.lit(False), "LINK")
        .when(guarded & is_sensitive_file(F.col("file_name")), "SENSITIVE")
        .when(F.col("reader_id").isNull(), "UNSUPPORTED")
        .when(F.col("size") > F.col("max_bytes"), "OVERSIZED")
        .otherwise("ACCEPTED"))


def within_budget(accepted: DataFrame, rules: ScanRules = ScanRules(), partitions: int = 64) -> DataFrame:
    """The longest prefix of the files, in root and path order, that stays within both limits.

    Ranges of the order, a total per range, and the totals of the ranges before. The ranges are
    stored first, since computing them again might cut them differently.
    """
    order = ["root", "path"]
    size = F.greatest(F.lit(0), F.col("size"))
    ranged = cut_lineage(accepted.repartitionByRange(partitions, *order)
                         .withColumn("__range", F.spark_partition_id()))
    # One row for each of the ranges, whose number is a parameter.
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = (ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.sum(size).alias("__b"))
              .withColumn("__n0", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
              .withColumn("__b0", F.coalesce(F.sum("__b").over(earlier), F.lit(0)))
              .select("__range", "__n0", "__b0"))
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    return (ranged.withColumn("__n", F.count("*").over(inside))
            .withColumn("__b", F.sum(size).over(inside))
            .join(F.broadcast(totals), "__range")
            .where((F.col("__n") + F.col("__n0") <= rules.max_files)
                   & (F.col("__b") + F.col("__b0") <= rules.max_total_bytes))
            .drop("__range", "__n", "__b", "__n0", "__b0"))


def outermost_roots(roots: DataFrame) -> DataFrame:
    """(root, position): distinct roots that lie in no other root, in their first order."""
    clean = roots.withColumn("root", F.regexp_replace("root", r"(?<=.)/+$", "")).groupBy(
        "root").agg(F.min("position").alias("position"))
    parts = F.split("root", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    above = clean.select("root", "position", F.explode(ancestors).alias("ancestor")).where(
        F.col("ancestor").isNotNull())
    nested = (above.withColumn("ancestor", F.when(F.col("ancestor") == "", "/").otherwise(
        F.col("ancestor"))).join(clean.select(F.col("root").alias("ancestor")), "ancestor",
                                 "left_semi").where(F.col("ancestor") != F.col("root"))
              .select("root").distinct())
    return clean.join(nested, "root", "left_anti")


def unsupported_summary(classified: DataFrame, rules: ScanRules = ScanRules()) -> DataFrame:
    """One row: how many files no reader takes, and the most frequent extensions."""
    extension = F.regexp_extract(F.lower("file_name"), r".\.([^.]+)$", 1)
    counted = (classified.where("verdict = 'UNSUPPORTED'")
               .withColumn("ext", F.when(extension == "", "无扩展名").otherwise(extension))
               .groupBy("ext").agg(F.count("*").alias("n")))
    totals = counted.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    top = counted.orderBy(F.desc("n"), "ext").limit(rules.reported_extensions).agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "ext"))),
                    lambda e: F.concat_ws(" ", e["ext"], (-e["k"]).cast("string"))).alias("parts"))
    detail = F.concat(F.array_join("parts", "、"), F.when(
        F.col("kinds") > rules.reported_extensions, " 等").otherwise(""))
    return totals.join(F.broadcast(top), F.lit(True)).where("total > 0").select(
        "total", "kinds", F.concat(F.lit("跳过 "), F.col("total").cast("string"),
                                   F.lit(" 个不支持格式的文件（"), detail, F.lit("）"))
        .alias("message"))


def budget_warning(accepted: DataFrame, kept: DataFrame) -> DataFrame:
    """One row if the budget cut files off, else none."""
    sizes = accepted.agg(F.count("*").alias("a")).join(
        F.broadcast(kept.agg(F.count("*").alias("k"))), F.lit(True))
    return sizes.where("k < a").select(
        F.lit("").alias("path"), F.lit("scan-budget").alias("reader_id"),
        F.lit("扫描已达上限，后续文件未进入索引").alias("message"), F.lit(True).alias("skipped"))


def scan_warnings(classified: DataFrame, accepted: DataFrame, kept: DataFrame,
                  rules: ScanRules = ScanRules()) -> DataFrame:
    """All rows a scan reports: one per refused file or directory, one per summary."""
    sensitive = classified.where("verdict = 'SENSITIVE'").select(
        "path", F.lit("sensitive-file").alias("reader_id"))
    parts = F.split("rel_path", "/")
    position = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(
            F.lit(0).alias("at"), F.lit(0).alias("found")),
        lambda s, d: F.struct((s["at"] + 1).alias("at"), F.when(
            (s["found"] == 0) & F.lower(d).isin(*fixed.SENSITIVE_DIRECTORIES),
            s["at"] + 1).otherwise(s["found"]).alias("found")), lambda s: s["found"])
    directories = (classified.where("verdict = 'SENSITIVE_DIRECTORY'")
                   .withColumn("at", position)
                   .select(F.concat_ws("/", "root", F.array_join(
                       F.slice(parts, F.lit(1), F.col("at")), "/")).alias("path"),
                       F.lit("sensitive-file").alias("reader_id")).distinct())
    guarded = sensitive.unionByName(directories).select(
        "*", F.lit("疑似凭据文件，已按安全策略跳过").alias("message"), F.lit(True).alias("skipped"))
    oversized = classified.where("verdict = 'OVERSIZED'").select(
        "path", "reader_id", F.concat(F.lit("文件超过 reader 大小限制（"),
                                      F.col("max_bytes").cast("string"), F.lit(" bytes）"))
        .alias("message"), F.lit(True).alias("skipped"))
    unsupported = unsupported_summary(classified, rules).select(
        F.lit("").alias("path"), F.lit("unsupported-format").alias("reader_id"), "message",
        F.lit(False).alias("skipped"))
    counted = classified.agg(
        F.count_if(F.col("verdict") == "LINK").alias("links"),
        F.count_if(F.col("verdict") == "TOO_DEEP").alias("deep"))
    links = counted.where("links > 0").select(
        F.lit("").alias("path"), F.lit("symbolic-link").alias("reader_id"),
        F.concat(F.lit("跳过 "), F.col("links").cast("string"), F.lit(" 个符号链接")).alias("message"),
        F.lit(False).alias("skipped"))
    deep = counted.where("deep > 0").select(
        F.lit("").alias("path"), F.lit("scan-budget").alias("reader_id"),
        F.concat(F.col("deep").cast("string"), F.lit(f" 个文件超过最大深度 {rules.max_depth}"))
        .alias("message"), F.lit(True).alias("skipped"))
    out = guarded
    for more in (oversized, unsupported, links, deep, budget_warning(accepted, kept)):
        out = out.unionByName(more)
    return out
