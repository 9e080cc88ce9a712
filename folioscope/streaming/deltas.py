"""Streams of model output: reassembling tagged deltas, learning token factors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.functions import fixed

_FACTOR_STATE = "factor double, observations long"


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """What a micro-batch has of a key, by ``seq``: frames come in any order."""
    return pd.concat([f[columns] for f in frames]).sort_values("seq", kind="stable")


def _learn(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
    """One step is f -> 0.7 f + 0.3 r; all steps of a micro-batch are one weighted sum."""
    factor, seen = state.get if state.exists else (1.0, 0)
    usable = (f[(f["raw_estimate"] >= 50) & (f["actual_tokens"] > 0)] for f in frames)
    reports = _in_order(usable, ["seq", "raw_estimate", "actual_tokens"])
    ratio = np.clip(reports["actual_tokens"] / reports["raw_estimate"], 0.25, 4.0).to_numpy(float)
    age = np.arange(len(ratio) - 1, -1, -1)
    factor = factor * 0.7 ** len(ratio) + float((0.3 * ratio * 0.7 ** age).sum())
    seen += len(ratio)
    state.update((factor, seen))
    yield pd.DataFrame([(key[0], factor, seen)], columns=["model", "factor", "observations"])


def running_calibration(observations: DataFrame) -> DataFrame:
    """The factor of each model after every micro-batch (model, seq, raw_estimate,
    actual_tokens)."""
    return observations.where("trim(model) <> ''").groupBy("model").applyInPandasWithState(
        _learn, "model string, factor double, observations long", _FACTOR_STATE, "update",
        GroupStateTimeout.NoTimeout)


def _begun(tag: str) -> re.Pattern:
    """The beginning of a tag at the end of a text, the longest first."""
    return re.compile("|".join(re.escape(tag[:n]) + r"\Z" for n in range(len(tag) - 1, 0, -1)))


_NEXT = {True: fixed.THINK_CLOSE, False: fixed.THINK_OPEN}
_HELD = {inside: _begun(tag) for inside, tag in _NEXT.items()}


def feed(pending: str, inside: bool, started: bool, chunk: str, end: bool):
    """Adds a chunk to what is held back; returns the new state and the (is_reasoning, text) pieces
    that are certain now. A tag may be split over chunks; it opens only before any answer text."""
    text, pieces = pending + chunk, []
    while True:
        before, tag, after = text.partition(_NEXT[inside])
        if not tag or (not inside and (started or before.strip())):
            break
        pieces.append((inside, before))
        text, inside = after, not inside
    held = None if end else _HELD[inside].search(text)
    certain = text[:held.start()] if held else text
    pieces = [p for p in [*pieces, (inside, certain)] if p[1]]
    started = started or (not inside and bool(certain.strip()))
    return text[len(certain):], inside, started, pieces


_DELTA_STATE = "pending string, inside boolean, started boolean, at long, due long, early string"
_DELTA = "stream_id string, seq long, stage string, text string"


def _due(waiting: dict[int, tuple], due: int) -> Iterator[tuple]:
    """Takes the deltas whose turn it is out of those that wait."""
    while due in waiting:
        yield waiting.pop(due)
        due += 1


def _split(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
    pending, inside, started, at, due, early = state.get if state.exists else ("", False, False, 0, 0, "[]")
    waiting = {seq: tuple(delta) for seq, *delta in json.loads(early)}
    for frame in frames:
        for delta in frame.itertuples():
            if delta.seq >= due:
                text = None if pd.isna(delta.text) else delta.text
                waiting.setdefault(int(delta.seq), (delta.stage, text, bool(delta.is_last)))
    rows = []
    for stage, text, is_last in _due(waiting, due):
        due += 1
        pieces = [(None, text)]
        if stage != "PLANNING":
            pending, inside, started, pieces = feed(pending, inside, started, text or "", is_last)
        for reasoning, piece in pieces:
            named = {None: "PLANNING", True: "ANSWER_THINKING", False: "ANSWER"}[reasoning]
            rows.append((key[0], at, named, piece))
            at += 1
    if rows:
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "stage", "text"])
    state.update((pending, inside, started, at, due, json.dumps([(seq, *delta) for seq, delta in waiting.items()])))


def reassemble(deltas: DataFrame) -> DataFrame:
    """Deltas (stream_id, seq from 0, stage, text, is_last) with reasoning told from answer text.

    A delta is written in its turn: one that is ahead waits in the state until those before it have come, in
    whatever micro-batch, and one that comes again is left out.
    """
    return deltas.groupBy("stream_id").applyInPandasWithState(
        _split, _DELTA, _DELTA_STATE, "append", GroupStateTimeout.NoTimeout)
