"""Tables of documents kept as segments: a batch writes what it brings, readers take the newest version.

A segment holds, for each document of its batches, one version (seq and whether the document is deleted) and the
rows of that version in every table, in folders by document bucket. Which segments are live is a small table of
its own for every batch, the state. Nothing of earlier segments is read or written to add one; ``fan`` segments of
one level are merged into one of the next, so a row is written once for every level.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StringType, StructType

from folioscope.session import stored
from folioscope.sources.snapshot import file_system, hadoop_path

BUCKETS = 16
FAN = 4
VERSIONS = "versions"
_STATE = "name string, level int, schemas map<string,string>"


class Segment(NamedTuple):
    """``name`` is the first and the last batch in it, so names sort by age."""
    name: str
    level: int


def named(first: int, last: int) -> str:
    return f"{first:012d}-{last:012d}"


def bucket_of(document_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def states(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the states that were written to their end."""
    fs, jvm = file_system(spark, folder)
    root = hadoop_path(jvm, f"{folder}/states")
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName()) for p in found
                  if p.getName().isdigit() and fs.exists(hadoop_path(jvm, f"{p}/_SUCCESS")))


def _state(spark: SparkSession, folder: str, number: int) -> tuple[list[Segment], dict[str, str]]:
    rows = spark.read.schema(_STATE).parquet(f"{folder}/states/{number}").collect()
    return sorted(Segment(r["name"], r["level"]) for r in rows), rows[0]["schemas"]


def _read(spark: SparkSession, folder: str, table: str, segments: list[Segment], schema: str) -> DataFrame:
    base = f"{folder}/{table}"
    return (spark.read.schema(StructType.fromJson(json.loads(schema))).option("basePath", base)
            .parquet(*[f"{base}/segment={s.name}" for s in segments]))


def _ranked(versions: DataFrame) -> DataFrame:
    """Adds ``age`` to versions: 1 for the newest of a document. Of equal seq the one that came first stands."""
    return versions.withColumn("age", F.row_number().over(
        W.partitionBy("document_id").orderBy(F.desc("seq"), "segment")))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone`` is stored, so Spark ships it where it is small and leaves the rows where they are."""
    return rows.join(gone.select("document_id", "segment"), ["document_id", "segment"], "left_anti")


def _write(frame: DataFrame, folder: str, table: str, name: str, buckets: int, spread: bool = False) -> str:
    """Files follow the bytes of a bucket: Spark splits large ones and puts small ones together. Rows that are
    ``spread`` already, as a shuffle has left them, are written by the tasks that hold them."""
    plain = frame.drop("segment", "bucket")
    placed = plain.withColumn("bucket", bucket_of(F.col("document_id"), buckets))
    if not spread:
        placed = placed.hint("rebalance", F.col("bucket"))
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{table}/segment={name}")
    return plain.schema.add("segment", StringType()).add("bucket", IntegerType()).json()


def add(spark: SparkSession, folder: str, number: int, versions: DataFrame,
        tables: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]], fan: int = FAN,
        buckets: int = BUCKETS, spread: tuple[str, ...] = ()) -> None:
    """Adds a batch: ``versions`` (document_id, seq, deleted; a document once) and the rows of each table, all with
    a document_id. A table is derived from tables before it, which it asks for by name; those named in ``spread``
    end in a shuffle and are not shuffled again.

    A batch that is run again after a failure starts from the state before it and writes the same names.
    """
    earlier = [n for n in states(spark, folder) if n < number]
    live, _ = _state(spark, folder, earlier[-1]) if earlier else ([], {})
    own = Segment(named(number, number), 0)
    schemas = {VERSIONS: _write(versions.select("document_id", "seq", "deleted"), folder, VERSIONS, own.name, buckets)}

    def written(table: str) -> DataFrame:
        return _read(spark, folder, table, [own], schemas[table]).drop("segment", "bucket")

    for table, derive in tables.items():
        schemas[table] = _write(derive(written), folder, table, own.name, buckets, table in spread)
    live = [*live, own]
    while len(live) >= fan and len({s.level for s in live[-fan:]}) == 1:
        live = [*live[:-fan], _merge(spark, folder, live[-fan:], schemas, buckets)]
    spark.createDataFrame([(*s, schemas) for s in live], _STATE).coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/states/{number}")
    _expire(spark, folder, [*earlier, number], list(schemas))


def _merge(spark: SparkSession, folder: str, parts: list[Segment], schemas: dict[str, str], buckets: int) -> Segment:
    """One segment of the newest versions in ``parts``. Deletions stay as versions, so that a row that comes late
    brings nothing back."""
    merged = Segment(f"{parts[0].name[:12]}-{parts[-1].name[-12:]}", parts[0].level + 1)
    ranked = _ranked(_read(spark, folder, VERSIONS, parts, schemas[VERSIONS]))
    gone = stored(ranked.where("age > 1 OR deleted").select("document_id", "segment"), "superseded")
    for table, schema in schemas.items():
        rows = _read(spark, folder, table, parts, schema)
        kept = ranked.where("age = 1").drop("age") if table == VERSIONS else _without(rows, gone)
        _write(kept, folder, table, merged.name, buckets)
    return merged


def _expire(spark: SparkSession, folder: str, numbers: list[int], tables: list[str]) -> None:
    """Deletes states and segments that neither the last state nor the one before it names: readers of the
    earlier one may still be at work, and a batch that is run again starts from it."""
    fs, jvm = file_system(spark, folder)
    wanted = {s.name for n in numbers[-2:] for s in _state(spark, folder, n)[0]}
    for number in numbers[:-2]:
        fs.delete(hadoop_path(jvm, f"{folder}/states/{number}"), True)
    for table in tables:
        for status in fs.listStatus(hadoop_path(jvm, f"{folder}/{table}")):
            if status.getPath().getName().removeprefix("segment=") not in wanted:
                fs.delete(status.getPath(), True)


def live_segments(spark: SparkSession, folder: str) -> list[Segment]:
    numbers = states(spark, folder)
    return _state(spark, folder, numbers[-1])[0] if numbers else []


def newest(spark: SparkSession, folder: str, table: str, of: DataFrame | None = None,
           buckets: int = BUCKETS) -> DataFrame:
    """The rows of a table for the newest version of every document that is not deleted. ``of`` (document_id)
    asks for some documents: only their buckets are read."""
    live, schemas = _state(spark, folder, states(spark, folder)[-1])
    versions = _read(spark, folder, VERSIONS, live, schemas[VERSIONS])
    rows = _read(spark, folder, table, live, schemas[table])
    if of is not None:
        # no more numbers than there are buckets
        read = F.col("bucket").isin([r[0] for r in of.select(
            bucket_of(F.col("document_id"), buckets)).distinct().collect()])
        versions, rows = versions.where(read), rows.where(read).join(
            of.select("document_id").distinct(), "document_id", "left_semi")
    gone = stored(_ranked(versions).where("age > 1 OR deleted").select("document_id", "segment"), "superseded")
    return _without(rows, gone).drop("segment", "bucket")
