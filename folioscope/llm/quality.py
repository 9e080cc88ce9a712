"""Quality classifier: logistic regression on hashed word n-grams, learned with follow-the-regularised-
leader updates and scored as sparse dot products.

Tokens are runs of word characters and runs of signs. Features are single tokens and pairs of
neighbours, each as written (lower case) and as a shape (signs stay, words become capitals, capitalised,
lower case, with digits or without letters; pairs tell whether a token repeats the one or two before), hashed into ``2 ** BITS`` places; a feature's value is its
count over the root of the number of tokens.

Defined results: null and empty texts have no features and get the score of the intercept; repeated rows
get equal scores; with no labels every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tasks import released
from folioscope.llm.words import LOWER, WORD, RangeHash, mix, slices

BITS = 18
#: Labelled documents of either class that are learned from, at most.
PER_CLASS = 10_000
SHARDS, PASSES = 8, 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_CLASS = np.where(_SPACE, 0, np.where(WORD, 1, 2)).astype(np.int8)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags)))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tokens of each row) of every n-gram of a slice of texts."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    kind = _CLASS[data]
    turn = np.ones(len(data), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(turn)
    end = np.append(start[1:], len(data))
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    row = np.searchsorted(offsets, start, side="right") - 1
    surface = RangeHash(LOWER[data])(start, end)
    upper, lower, digit = (_sums((data >= a) & (data <= b)) for a, b in ((65, 90), (97, 122), (48, 57)))
    n_upper, n_lower, n_digit = (s[end] - s[start] for s in (upper, lower, digit))
    first_upper = upper[start + 1] - upper[start]
    shape = np.select(
        [n_digit > 0, (n_upper > 1) & (n_lower == 0), first_upper > 0, n_lower > 0], [1, 2, 3, 4], 5)
    shape = np.where(kind[start] == 1, mix(shape.astype(np.uint64)), surface)
    pair = np.flatnonzero(row[1:] == row[:-1])
    # a shape pair also tells whether the word is that of one or two tokens before
    again = np.zeros(len(row), np.uint64)
    again[1:] += ((surface[1:] == surface[:-1]) & (row[1:] == row[:-1])).astype(np.uint64)
    again[2:] += 2 * ((surface[2:] == surface[:-2]) & (row[2:] == row[:-2])).astype(np.uint64)
    hashes = [surface, mix(shape + np.uint64(1))]
    for values, salt in ((surface, np.uint64(3)), (shape, np.uint64(5) + again[pair + 1])):
        hashes.append(mix(values[pair] * np.uint64(0x9E3779B97F4A7C15) + values[pair + 1] + salt))
    place = np.concatenate(hashes) >> np.uint64(64 - bits)
    return np.concatenate((row, row, row[pair], row[pair])), place.astype(np.int64), np.bincount(row, minlength=rows)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _update(indices: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, bits: int,
            passes: int) -> np.ndarray:
    """Follow-the-regularised-leader over the documents in turn; the last place is the intercept."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(passes):
        for i, x, y in zip(indices, values, labels, strict=True):
            zi, root = z[i], np.sqrt(n[i])
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            rise = np.sqrt(n[i] + g * g) - root
            z[i] += g - rise / ALPHA * w
            n[i] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(sample: DataFrame, bits: int = BITS, shards: int = SHARDS, passes: int = PASSES) -> Model:
    """Learns from (doc_id, text, label) rows. Each shard learns by itself, and the weights are
    averaged; the driver gets at most ``2 ** bits`` of them."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("text", "ascending")]).combine_chunks()
        labels = table["label"].to_numpy()
        indices, values = [], []
        for lo, hi, data, offsets in slices(table["text"].combine_chunks()):
            row, place, tokens = features(data, offsets, bits)
            key, count = np.unique(row << bits | place, return_counts=True)
            cut = np.searchsorted(key, np.arange(hi - lo + 1) << bits)
            for r in range(hi - lo):
                own = slice(cut[r], cut[r + 1])
                indices.append(np.append(key[own] & ((1 << bits) - 1), 1 << bits))
                values.append(np.append(count[own] / max(tokens[r], 1) ** 0.5, 1.0))
        w = _update(indices, values, labels, bits, passes)
        at = np.flatnonzero(w)
        return pa.table({"place": at, "weight": w[at]})

    place = F.xxhash64("doc_id")
    dealt = sample.select(place.alias("place"), "text", "label", F.pmod(place, F.lit(shards)).alias("shard"))
    used = max(1, dealt.select("shard").distinct().count())
    mean = dealt.groupBy("shard").applyInArrow(learn, "place long, weight double").groupBy("place").agg(
        (F.sum("weight") / used).alias("weight")).toPandas()
    weights = np.zeros((1 << bits) + 1)
    weights[mean["place"].to_numpy(int)] = mean["weight"].to_numpy(float)
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; whole texts, no shuffle."""
    bits = len(model.weights).bit_length() - 1
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch.column(1)):
                row, place, tokens = features(data, offsets, bits)
                dot = np.bincount(row, model.weights[place], hi - lo) / np.sqrt(np.maximum(tokens, 1))
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(dot + model.bias, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(
        work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
