"""Keeping bases fresh from change streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.sources.scan import in_ignored_directory

CHANGE = "base_id string, revision long, kind string, rel_path string, is_dir boolean, ts timestamp"


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Change events dropped as Parquet files into a folder, without those in ignored
    directories."""
    events = (spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch)
              .parquet(folder))
    return effective_changes(events)


def effective_changes(events: DataFrame) -> DataFrame:
    return events.where(~in_ignored_directory(F.concat(
        F.coalesce("rel_path", F.lit("")), F.when(F.col("is_dir"), "/").otherwise(""))))


def debounced(changes: DataFrame, gap: str = "250 milliseconds", late: str = "10 seconds",
              keys: tuple[str, ...] = ("base_id",)) -> DataFrame:
    """One row per burst: a burst ends when nothing happened for the gap. Works on streams and,
    with the same plan, on tables."""
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    return (changes.groupBy(*keys, F.session_window("ts", gap).alias("burst"))
            .agg(F.count("*").alias("events"), F.max("ts").alias("last_event"))
            .select(*keys, F.col("burst.start").alias("burst_start"),
                    F.col("burst.end").alias("quiet_at"), "events", "last_event"))


FRESHNESS = ("base_id string, revision long, state string, generation long,"
             " reconciliations long")
_STATE = "revision long, state string, generation long, reconciliations long, invalidated boolean"


def step(state: tuple, event) -> tuple:
    """One event on (revision, state, generation, reconciliations, invalidated).

    Kinds: start, stop, touch (something may have changed), change (something has), verified and
    differs (results of a reconciliation that saw ``generation``), unavailable.
    """
    revision, name, generation, reconciliations, invalid = state
    kind = event.kind
    if kind == "start":
        return (event.revision, "VERIFYING", 0, 0, False)
    if name == "STOPPED" or event.revision != revision:
        return state
    if kind == "stop":
        return (-1, "STOPPED", 0, 0, False)
    if kind == "unavailable":
        return (revision, "UNAVAILABLE", generation, reconciliations, invalid)
    if kind == "touch":
        return (revision, "VERIFYING", generation + 1, reconciliations, invalid)
    if kind == "change":
        return (revision, "CHANGED", generation + 1, reconciliations, True)
    if event.generation != generation:
        # Something happened while the check ran; it has to be done again.
        return (revision, "VERIFYING", generation + 1, reconciliations, invalid)
    invalid = invalid or kind == "differs"
    return (revision, "CHANGED" if invalid else "VERIFIED", generation, reconciliations + 1,
            invalid)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
    current = state.get if state.exists else (-1, "STOPPED", 0, 0, False)
    current = tuple(current)
    # Frames of a micro-batch come in any order.
    for event in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
        current = step(current, event)
    state.update(current)
    revision, name, generation, reconciliations, _ = current
    yield pd.DataFrame([(key[0], revision, name, generation, reconciliations)],
                       columns=["base_id", "revision", "state", "generation", "reconciliations"])


def freshness_states(events: DataFrame) -> DataFrame:
    """The state of each base after every micro-batch.

    ``events``: base_id, revision, seq, kind, generation.
    """
    return events.groupBy("base_id").applyInPandasWithState(
        _advance, FRESHNESS, _STATE, "update", GroupStateTimeout.NoTimeout)


def fresh_only(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests (base_id, revision) whose sources are proven fresh."""
    verified = states.where("state = 'VERIFIED'").select("base_id", "revision")
    return requests.join(verified, ["base_id", "revision"], "left_semi")


def reconcile(changes: DataFrame, current_hashes, expected: DataFrame, sink, checkpoint: str,
              every: str = "30 seconds", once: bool = False):
    """Compares source hashes with the expected ones on every trigger that saw changes.

    ``current_hashes(bases)`` computes (base_id, current_hash) for the touched bases, ``sink``
    takes (base_id, verdict, batch).
    """
    def check(batch: DataFrame, number: int) -> None:
        touched = batch.select("base_id").distinct()
        compared = current_hashes(touched).join(expected, "base_id").select(
            "base_id", F.when(F.col("current_hash") == F.col("expected_hash"), "VERIFIED")
            .otherwise("CHANGED").alias("verdict"), F.lit(number).alias("batch"))
        sink(compared)

    writer = changes.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return writer.trigger(**trigger).start()
