"""Periodic runs of words: maximal stretches in which one sequence of words stands again and again.

A run is a stretch with smallest period q and at least ``max(LEAST, EXPONENT * q)`` words that no neighbouring word
extends. Within a document:

1. Stretches that can't hold a run are set aside, exactly: in a run of period q each three words stand again
   q words on, for at least 3 q - 2 places in turn. Places whose next equal three words are missing, or farther
   away than the stretch of such places allows, are cut out until nothing changes. What is left, with a mark of
   its own between stretches, is the sequence that follows; most documents end here.
2. Ukkonen's suffix trees of the sequence and of its reversal. An Euler tour of a tree visits leaves in suffix
   order; the depth at which it turns between two leaves is their lowest common ancestor's, so the longest
   common extension of any two places is a minimum over a range of turns, in constant time from a sparse table.
3. The longest Lyndon word from each place, under the order of the words and under the reverse order, ends
   where the next lesser, or greater, suffix begins. Each run has such a word as its root, so each is extended
   to both sides by the trees, and those with enough words are the runs.

Trees take some hundred bytes a word of the sequence, in one task per document at a time; the sparse tables
four bytes a word and level. Documents go through Arrow batches and aren't shuffled.

Defined results: a null text and one without words have no runs and collapse to the empty text; a null id is
altered by nothing; repeated rows and ties are rows of their own; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.tasks import released
from folioscope.llm.words import strings

EXPONENT, LEAST = 4, 6
#: Words of the grams that a run must repeat.
GRAM = 3
#: Bytes of collapsed texts in one batch that leaves a task.
OUT_BYTES = 8 << 20


def stretches(word: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts of a sequence of word numbers that hold all its runs whole."""
    n = len(word) - GRAM + 1
    if n < GRAM:
        return []
    gram, most = word[:n], int(word.max()) + 1
    for k in range(1, GRAM):  # pairs are numbered anew, so products stay small
        gram = np.unique(gram * most + word[k:n + k], return_inverse=True)[1]
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    ahead = np.full(n, n + len(word))
    ahead[order[:-1][again]] = np.diff(order)[again]
    alive = ahead < n
    while True:
        turn = np.diff(np.concatenate(([0], alive.view(np.int8), [0])))
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        period = (end - start + 2) // 3  # no run among these places has a longer one
        limit = np.repeat(period, end - start)
        fits = ahead[alive] <= limit
        if fits.all():
            break
        alive[np.flatnonzero(alive)[~fits]] = False
    keep = end - start >= GRAM
    out: list[tuple[int, int]] = []
    for a, b in zip(start[keep].tolist(), (end + GRAM - 1 + period)[keep].tolist(), strict=True):
        b = min(b, len(word))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_tree(s: list[int]) -> tuple[array, array, dict[int, int]]:
    """Ukkonen's tree of a sequence that ends in a symbol of its own: (start, end) of each node's edge, root 0,
    and node << 32 | symbol -> child."""
    n = len(s)
    start, end, link = array("i", [0]), array("i", [0]), array("i", [0])
    edges: dict[int, int] = {}
    node = edge = length = due = 0
    for i, symbol in enumerate(s):
        unlinked = 0
        due += 1
        while due:
            if not length:
                edge = i
            key = node << 32 | s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                first = start[child]
                span = min(end[child], i + 1) - first
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if s[first + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                parted = len(start)
                start.extend((first, i))
                end.extend((first + length, n))
                link.extend((0, 0))
                edges[key] = parted
                edges[parted << 32 | symbol] = parted + 1
                start[child] = first + length
                edges[parted << 32 | s[first + length]] = child
                if unlinked:
                    link[unlinked] = parted
                unlinked = parted
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - due + 1
    return start, end, edges


class Extensions:
    """Longest common extensions of places of a sequence, by lowest common ancestors in its suffix tree."""

    def __init__(self, s: list[int]) -> None:
        begin, end, edges = suffix_tree(s)
        n, nodes = len(s), len(begin)
        span = (np.array(end) - np.array(begin)).tolist()
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(-keys)  # the last child first, as a stack wants it
        children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        del edges
        counts = np.bincount(keys >> 32, minlength=nodes)[::-1]
        last = np.cumsum(counts)[::-1].tolist()
        first = (np.cumsum(counts) - counts)[::-1].tolist()
        depth, turns, leaves = [0] * nodes, [], []
        for child in children[first[0]:last[0]]:
            depth[child] = span[child]
        stack, low = children[first[0]:last[0]], 0
        while stack:
            node = stack.pop()
            own = depth[node]
            low = min(low, own - span[node])
            if first[node] == last[node]:
                leaves.append(n - own)
                turns.append(low)
                low = n
            else:
                below = children[first[node]:last[node]]
                for child in below:
                    depth[child] = own + span[child]
                stack += below
        #: place -> its suffix's number in order
        self.rank = np.zeros(n, np.int64)
        self.rank[leaves] = np.arange(n)
        levels = [np.array(turns, np.int32)]
        while 2 << len(levels) - 1 <= n:
            half = 1 << len(levels) - 1
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        self._levels = levels

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self._levels[k][low[at]], self._levels[k][high[at] - (1 << k) + 1])
        return out


def lyndon_ends(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest Lyndon words from each place, under both orders."""
    starts, ends = [], []
    for values in (rank.tolist(), (-rank).tolist()):
        stack: list[int] = []
        for i, value in enumerate(values):
            while stack and values[stack[-1]] > value:
                starts.append(stack.pop())
                ends.append(i)
            stack.append(i)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def runs_of(word: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    none = np.zeros((0, 3), np.int64)
    parts = stretches(word)
    if not parts:
        return none
    marks = int(word.max()) + 1
    s, place = [], []
    for k, (a, b) in enumerate(parts):
        s += word[a:b].tolist()
        place += range(a, b)
        s.append(marks + k)
        place.append(-1)
    n = len(s) - 1  # the last mark ends the sequence
    forward = Extensions(s)
    i, j = lyndon_ends(forward.rank)
    period = j - i
    right = forward(i, j)
    backward = Extensions([*reversed(s[:n]), s[n]])
    left = backward(n - i, n - j)
    length = left + period + right
    found = np.flatnonzero(length >= np.maximum(least, exponent * period))
    if not len(found):
        return none
    start = np.array(place)[(i - left)[found]]
    rows = np.unique(np.stack((start, period[found], length[found]), axis=1), axis=0)
    return rows[:, [0, 2, 1]]


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words stays: those that a run holds after its first period go."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def unaltered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Words as they stand."""
    return None


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids, the word that takes each place: from a word that the id chooses on, the words
    repeat with a period that it chooses too."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(documents: DataFrame, alter: Callable[[int | None, int], np.ndarray | None] = unaltered,
              exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): all runs as (start, length, period), by start, then period, and the words that
    are left when each run keeps its first period, joined by one space. ``alter`` may put other words of the
    text in each place first."""
    if exponent < 4 or least < 6:
        raise ValueError("stretches are cut for an exponent of 4 and 6 words at least")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def made(ids: pa.Array, runs: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
        rows = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        cut = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], fields=list(run))
        return pa.RecordBatch.from_arrays(
            [ids, pa.ListArray.from_arrays(pa.array(cut), values), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"])

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), strings(batch.column(1)).cast(pa.large_binary())
            runs, collapsed, low, held = [], [], 0, 0
            for row, doc_id in enumerate(ids.to_pylist()):
                words = texts[row].as_py().split()  # bytes are parted at 0x20 and 0x09-0x0D
                known: dict[bytes, int] = {}
                word = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                moved = alter(doc_id, len(words))
                if moved is not None:
                    word, words = word[moved], [words[k] for k in moved.tolist()]
                own = runs_of(word, exponent, least)
                if len(own):
                    words = [words[k] for k in np.flatnonzero(kept_words(own, len(words))).tolist()]
                runs.append(own)
                collapsed.append(b" ".join(words))
                held += len(collapsed[-1])
                if held > OUT_BYTES:
                    yield made(ids.slice(low, row + 1 - low), runs, collapsed)
                    runs, collapsed, low, held = [], [], row + 1, 0
            yield made(ids.slice(low), runs, collapsed)

    return documents.select("doc_id", "text").mapInArrow(
        work, f"doc_id {documents.schema['doc_id'].dataType.simpleString()},"
              " runs array<struct<start:long,length:long,period:long>>, collapsed string")
