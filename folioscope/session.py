"""What a Spark session needs for the jobs: the package on the executors, a checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Folders of the turns that are running, innermost last.
_turns: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application. Submitting the job with
    ``--py-files`` does the same."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), "folioscope.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="folioscope-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Spreads rows over all cores when the input has fewer splits than cores, as one small file
    has. An input of many splits is left as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores, key)


def narrow_rows(spark: SparkSession):
    """While rows of a few numbers and short texts are handed to Python. Spark adds up the bytes of an Arrow batch
    after every row to keep texts within its limit, which costs more than such rows themselves; here only the
    number of rows bounds a batch."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """While results are stored that later steps read instead of the shuffles they came from. Spark keeps shuffle
    files until the driver happens to collect its garbage; here they go as soon as the result is written."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Stores a small intermediate result that later steps read several times, so that it is not
    computed again for each of them and a lost executor costs no more than a read."""
    if _turns:
        return stored(frame, "cut")
    shared_folder(frame.sparkSession)
    with freed_shuffles(frame.sparkSession):
        return frame.select("*").checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """As ``cut_lineage``, for a table that is joined afterwards: Parquet tells Spark its size, so it
    ships the table to the tasks where that is small."""
    folder = fresh_folder(frame.sparkSession, name)
    write(frame, folder)
    return frame.sparkSession.read.parquet(folder)


def write(frame: DataFrame, folder: str, *partition_by: str) -> None:
    """Writes a table that later steps read, on as little disk as Spark's own means allow."""
    with freed_shuffles(frame.sparkSession):
        frame.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(folder)


def only(frame: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``frame`` whose key is among those of ``wanted``. The keys are stored first: Spark ships them where it
    finds them small, so that a table of texts is not shuffled for the sake of a few of them."""
    return frame.join(stored(wanted.select(key).distinct(), "wanted"), key, "left_semi")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, or below that of the running turn."""
    return f"{_turns[-1] if _turns else shared_folder(spark)}/{name}-{uuid.uuid4()}"


@contextmanager
def turn(spark: SparkSession) -> Iterator[None]:
    """A part of a large job whose result is written before the next part begins. What it stores on the way is
    deleted with it, so that the job needs the disk of one part, however many there are."""
    folder = fresh_folder(spark, "turn")
    _turns.append(folder)
    try:
        yield
    finally:
        _turns.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_turns(rows: DataFrame, key: str, most: int, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``step`` of all rows, done for about ``most`` of them at a time and stored. Rows of one key stay together."""
    spark, folder = rows.sparkSession, fresh_folder(rows.sparkSession, name)
    turns = max(1, -(-rows.count() // most))
    for nth in range(turns):
        with turn(spark):
            write(step(rows.where(F.pmod(F.xxhash64(key), F.lit(turns)) == nth)), f"{folder}/{nth}")
    return spark.read.parquet(*[f"{folder}/{nth}" for nth in range(turns)])
