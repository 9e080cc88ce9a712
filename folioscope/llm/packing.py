"""Packing token sequences into windows by non-negative least squares.

Tasks pack cells of about ``CELL`` tokens, so memory is bounded and nothing is shuffled. A cell's documents are
cut into full windows and a rest each. For the histogram of rests, combinations of two or three lengths
that fill a window are enumerated, their repeat counts are solved by non-negative least squares against the
histogram and rounded down, and what is left is packed greedily: the longest piece first, then the longest
that fits, and where none fits one is cut. The last window of a cell is cut into runs whose lengths are
powers of two, which aren't padded.

Defined results: a null or empty text has the end id only; repeated rows are packed each by itself; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from folioscope.llm.tasks import released
from folioscope.llm.tokens import encode, encoding
from folioscope.llm.words import strings

WINDOW, END = 2048, 1
CELL = 1 << 22
#: Triples are enumerated with the most frequent lengths as the middle one.
PARTNERS, STEPS = 16, 300


def combinations(histogram: np.ndarray, window: int, partners: int = PARTNERS) -> np.ndarray:
    """Rows of two or three lengths that fill the window, 0 where there is no third; only lengths that
    the histogram has."""
    has = histogram > 0
    half = np.arange(1, window // 2 + 1)
    pairs = half[has[half] & has[window - half]]
    rows = [np.column_stack((pairs, window - pairs, np.zeros_like(pairs)))]
    lengths = np.flatnonzero(has)
    for b in lengths[np.argsort(-histogram[lengths], kind="stable")[:partners]]:
        a = lengths[lengths <= (window - b) // 2]
        a = a[has[window - b - a]]
        rows.append(np.column_stack((a, np.full_like(a, b), window - b - a)))
    return np.unique(np.sort(np.concatenate(rows), axis=1)[:, ::-1], axis=0)


def solve(columns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that make the used lengths come near the histogram in squares: gradient steps
    with a step width for each count, kept at zero or above."""
    if not len(columns):
        return np.zeros(0)
    used = np.bincount(columns.ravel(), minlength=len(histogram)).astype(float)
    used[0] = 0
    width = 1 / np.maximum(used[columns].sum(axis=1), 1)
    target = histogram.astype(float)
    x, y, t = np.zeros(len(columns)), np.zeros(len(columns)), 1.0
    for _ in range(steps):
        fill = np.bincount(columns.ravel(), np.repeat(y, 3), len(histogram))
        short = target - fill
        short[0] = 0
        new = np.maximum(y + width * short[columns].sum(axis=1), 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x


def pack_cell(tokens: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of documents with so many tokens."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rests: dict[int, list[tuple[int, int]]] = {}
    sequence = 0
    for d, n in enumerate(tokens):
        for start in range(0, n - n % window, window):
            pieces.append((d, start, window, sequence, 0))
            sequence += 1
        if n % window:
            rests.setdefault(n % window, []).append((d, n - n % window))
    histogram = np.zeros(window + 1, np.int64)
    for length, found in rests.items():
        histogram[length] = len(found)
    columns = combinations(histogram, window)
    for lengths, count in zip(columns.tolist(), np.floor(solve(columns, histogram) + 1e-6).astype(int).tolist(),
                              strict=True):
        for _ in range(count):
            wanted = [n for n in lengths if n]
            if any(len(rests.get(n, ())) < wanted.count(n) for n in wanted):
                break
            offset = 0
            for n in wanted:
                d, start = rests[n].pop()
                pieces.append((d, start, n, sequence, offset))
                offset += n
            sequence += 1
    left = sorted(n for n, found in rests.items() if found)

    def take(length: int) -> tuple[int, int]:
        d, start = rests[length].pop()
        if not rests[length]:
            left.pop(bisect.bisect_left(left, length))
        return d, start

    def give(length: int, piece: tuple[int, int]) -> None:
        if not rests.setdefault(length, []):
            bisect.insort(left, length)
        rests[length].append(piece)

    while left:
        offset, own = 0, []
        while offset < window and left:
            at = bisect.bisect_right(left, window - offset) - 1
            if at >= 0:
                length = left[at]
                d, start = take(length)
            else:  # none fits: a piece is cut
                d, start = take(whole := left[0])
                length = window - offset
                give(whole - length, (d, start + length))
            own.append((d, start, length, offset))
            offset += length
        if offset == window:
            pieces += [(d, start, length, sequence, at) for d, start, length, at in own]
            sequence += 1
            continue
        filled, room = 0, 1 << (offset.bit_length() - 1)
        total = offset
        for d, start, length, _ in own:
            while length:
                part = min(length, room - filled)
                pieces.append((d, start, part, sequence, filled))
                d, start, length, filled = d, start + part, length - part, filled + part
                if filled == room:
                    total -= room
                    sequence, filled, room = sequence + 1, 0, 1 << max(total.bit_length() - 1, 0)
    return pieces


def pack(documents: DataFrame, vocabulary: Broadcast, window: int = WINDOW, end: int = END,
         cell: int = CELL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(vocabulary.value)
        base = TaskContext.get().partitionId() << 36
        documents, ids, held = [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal base
            rows = pack_cell([len(x) for x in ids], window)
            values = np.array([(
                start, length, zlib.crc32(ids[d][start:start + length].tobytes()), len(ids[d]), base + sequence,
                offset) for d, start, length, sequence, offset in rows], np.int64)
            base += 1 + max(r[3] for r in rows)
            key = pa.concat_arrays(documents).take(pa.array([r[0] for r in rows]))
            return pa.RecordBatch.from_arrays([key, *(pa.array(values[:, i]) for i in range(6))], names)

        for batch in batches:
            for i, text in enumerate(strings(batch.column(1))):
                documents.append(batch.column(0).slice(i, 1))
                ids.append(np.append(encode(bpe, text.as_py()), end).astype("<u4"))
                held += len(ids[-1])
                if held >= cell:
                    yield emit()
                    documents, ids, held = [], [], 0
        if ids:
            yield emit()

    return documents.select("doc_id", "text").mapInArrow(
        work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, start long, length long,"
              " ids_crc32 long, doc_tokens long, sequence_id long, offset long")
