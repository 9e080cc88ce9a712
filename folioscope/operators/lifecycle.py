"""Status of knowledge bases, as the outcome of their event log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an event leads to and from which states it may happen.
TRANSITIONS = (
    ("begin", "BUILDING", ("EMPTY", "READY", "DIRTY", "FAILED", "INCOMPATIBLE")),
    ("publish", "READY", ("BUILDING",)),
    ("fail", "FAILED", ("BUILDING",)),
    ("discard", "DIRTY", ("BUILDING",)),
    ("incompatible", "INCOMPATIBLE", ("EMPTY", "READY", "DIRTY", "BUILDING", "FAILED",
                                      "INCOMPATIBLE")),
    ("change", "DIRTY", ("READY", "BUILDING", "FAILED", "DIRTY")),
    ("source", "DIRTY", ("EMPTY", "READY", "DIRTY", "BUILDING", "FAILED", "INCOMPATIBLE")),
)


def latest_status(events: DataFrame) -> DataFrame:
    """(base_id, status, seq) by the latest status of each base; combines map-side."""
    return events.groupBy("base_id").agg(F.max_by("status", "seq").alias("status"),
                                         F.max("seq").alias("seq"))


def legal_events(events: DataFrame) -> DataFrame:
    """Drops events that their base's preceding status does not allow.

    ``events`` has base_id, seq, event and the status the base had before (``from_status``).
    """
    spark = events.sparkSession
    allowed = spark.createDataFrame(
        [(name, source, target) for name, target, sources in TRANSITIONS for source in sources],
        "event string, from_status string, to_status string")
    return events.join(F.broadcast(allowed), ["event", "from_status"])


STATES = ("EMPTY", "READY", "DIRTY", "BUILDING", "FAILED", "INCOMPATIBLE")
#: A map of states is one number: the state that state i leads to stands in bits 3 i to 3 i + 2.
_BITS = 3


def _packed(reached) -> int:
    return sum(int(state) << _BITS * i for i, state in enumerate(reached))


def _at(packed: int, state: int) -> int:
    return packed >> _BITS * state & (1 << _BITS) - 1


def _composed(moves: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds to every move (a packed map) of a key what the moves up to it make together: ``before`` without it,
    ``after`` with it. Rows are sorted by Spark and read once, so a key takes no memory and no call of its own."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = _packed(range(len(STATES)))
        known: dict[tuple[int, int], int] = {}
        last, reached = None, nothing
        for batch in batches:
            before, after = [], []
            for *key, move in zip(*(batch.column(c).to_pylist() for c in (*keys, "move"))):
                if key != last:
                    last, reached = key, nothing
                before.append(reached)
                pair = (reached, move)
                if pair not in known:
                    known[pair] = _packed(_at(move, _at(reached, i)) for i in range(len(STATES)))
                reached = known[pair]
                after.append(reached)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*keys, order)), pa.array(before, pa.int32()), pa.array(after, pa.int32())],
                names=[*keys, order, "before", "after"])

    kinds = ", ".join(f"{c} {moves.schema[c].dataType.simpleString()}" for c in (*keys, order))
    return moves.select(*keys, order, "move").repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(
        walk, f"{kinds}, before int, after int")


def with_preceding_status(events: DataFrame, width: int = 65_536) -> DataFrame:
    """Adds the status that a base has before each of its events; EMPTY at the start. An event that this
    status doesn't allow leaves it as it is.

    An event is a map from the six states to six states. Maps are composed inside buckets of ``seq``,
    then the buckets of a base, and only then states are looked up: a base with very many events is
    never one task, and very many bases or buckets with few events each cost no more than their rows.
    """
    move = F.create_map(*[F.lit(x) for name, target, sources in TRANSITIONS for x in (name, _packed(
        STATES.index(target) if s in sources else i for i, s in enumerate(STATES)))])
    known = events.where(F.col("event").isin(*(name for name, _, _ in TRANSITIONS)))
    moves = known.where(F.col("base_id").isNotNull() & F.col("seq").isNotNull()).select(
        "base_id", F.floor(F.col("seq") / F.lit(width)).cast("long").alias("__bucket"), "seq",
        F.element_at(move, F.col("event")).alias("move"))
    maps = _composed(moves, ["base_id", "__bucket"], "seq")
    buckets = maps.groupBy("base_id", "__bucket").agg(F.max_by("after", "seq").alias("move"))
    starts = _composed(buckets, ["base_id"], "__bucket").select(
        "base_id", "__bucket", F.col("before").bitwiseAND((1 << _BITS) - 1).alias("start"))
    status = F.expr(f"shiftright(before, cast(start * {_BITS} AS int)) & {(1 << _BITS) - 1}")
    found = maps.join(starts, ["base_id", "__bucket"]).select(
        "base_id", "seq", F.get(F.array(*map(F.lit, STATES)), status).alias("from_status"))
    return known.join(found, ["base_id", "seq"])


def allocate_revisions(bases: DataFrame, requests: DataFrame) -> DataFrame:
    """Revision a build may start at, for requests that saw the current revision.

    ``bases``: base_id, source_revision, published_revision, status. ``requests``: base_id,
    expected_revision. A revision that is already published is not built again: it moves on.
    """
    begin = next(sources for name, _, sources in TRANSITIONS if name == "begin")
    return (bases.join(requests, "base_id")
            .where((F.col("source_revision") == F.col("expected_revision"))
                   & F.col("status").isin(*begin))
            .select("base_id", (F.col("source_revision") + F.when(
                F.col("published_revision").eqNullSafe(F.col("source_revision")), 1).otherwise(0))
                .alias("source_revision"), "published_revision", F.lit("BUILDING").alias("status")))


def publish(bases: DataFrame, manifests: DataFrame) -> DataFrame:
    """Bases after publishing: READY where the manifest's revision is the one being built."""
    offered = manifests.groupBy("base_id").agg(F.max("revision").alias("offered"))
    wins = ((F.col("offered") == F.col("source_revision")) & (F.col("status") == "BUILDING"))
    return bases.join(offered, "base_id", "left").select(
        "base_id", "source_revision",
        F.when(wins, F.col("offered")).otherwise(F.col("published_revision"))
        .alias("published_revision"),
        F.when(wins, "READY").otherwise(F.col("status")).alias("status"),
        F.coalesce(wins, F.lit(False)).alias("published_now"))


def apply_source_changes(bases: DataFrame, current: DataFrame, requested: DataFrame) -> DataFrame:
    """Bases after their sources were set: only an effective difference moves the revision.

    ``current`` and ``requested`` hold (base_id, root).
    """
    now, wanted = current.distinct(), requested.distinct()
    changed = (now.exceptAll(wanted).unionByName(wanted.exceptAll(now))
               .groupBy("base_id").agg(F.count("*").alias("changes")))
    effective = F.coalesce("changes", F.lit(0)) > 0
    return bases.join(changed, "base_id", "left").select(
        "base_id", (F.col("source_revision") + effective.cast("int")).alias("source_revision"),
        "published_revision",
        F.when(effective, "DIRTY").otherwise(F.col("status")).alias("status"))
