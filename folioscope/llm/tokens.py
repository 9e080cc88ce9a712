"""Byte-level BPE ids from a public vocabulary file, and edit-aware token counts.

The file is a ``tokenizers`` JSON; its path is a parameter, the driver reads it and broadcasts it. Ids are
made by tiktoken from the same ranks, which is several times faster; tests hold them against tokenizers.

Edit-aware counts keep a segment tree per document: leaves are stretches of about ``LEAF`` characters that
begin where every reading of the text begins a pre-token, so that a leaf's count depends on nothing
outside it, and inner nodes hold sums. An edit re-encodes the leaves that it touches, and neighbours only
where the edit took away the boundary between them; sums above are updated.

Defined results: a null text is an empty one with count 0; null edits are none; places beyond a text are
moved to its end; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.tasks import released
from folioscope.llm.words import strings

# Fixed value: how the vocabulary's byte-level pre-tokenizer splits.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 256
#: A sign or letter of ASCII before a space: a pre-token begins at the space, whatever stands around.
_SAFE = re.compile(r"[!-~](?= )")


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's bytes (about 2 MB), for all tasks."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


@lru_cache(2)
def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    read = json.loads(vocabulary)
    special = {t["content"]: t["id"] for t in read["added_tokens"] if t["special"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in read["model"]["vocab"].items()
             if token not in special}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    return bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """Cuts a text at safe places, each leaf at least ``size`` characters but for the last."""
    out, at = [], 0
    while at < len(text):
        found = _SAFE.search(text, at + size)
        to = found.end() if found else len(text)
        out.append(text[at:to])
        at = to
    return out


class Tree:
    """Sums of characters and tokens over leaves, in one array of nodes for each."""

    def __init__(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self._grow([len(x) for x in leaves], tokens)

    def _grow(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(len(chars) - 1, 0).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + len(chars), 0] = chars
        self.sums[self.width:self.width + len(chars), 1] = tokens
        level = self.width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level = half

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def counts(self) -> list[int]:
        return self.sums[self.width:self.width + len(self.leaves), 1].tolist()

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, place in it) of a character; the end of the text lies in the last leaf that has any."""
        place = min(max(place, 0), self.chars)
        if place == self.chars:
            last = max((i for i, x in enumerate(self.leaves) if x), default=0)
            return last, len(self.leaves[last])
        node = 1
        while node < self.width:
            node *= 2
            if place >= self.sums[node, 0]:
                place -= int(self.sums[node, 0])
                node += 1
        return node - self.width, place

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.width
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, stop: int, new: str, bpe: tiktoken.Encoding) -> int:
        """Replaces characters start .. stop; the characters that were encoded again."""
        if not self.leaves:
            self.leaves = [""]
            self._grow([0], [0])
        start = min(max(start, 0), self.chars)
        stop = min(max(stop, start), self.chars)
        a, at = self.find(start)
        b, to = self.find(stop)
        text = self.leaves[a][:at] + new + self.leaves[b][to:]
        before = next((i for i in range(a - 1, -1, -1) if self.leaves[i]), None)
        if before is not None and text and not text.startswith(" "):
            text, a = self.leaves[before] + text, before  # the edit took the boundary before it away
        after = next((i for i in range(b + 1, len(self.leaves)) if self.leaves[i]), None)
        if after is not None and text and not "!" <= text[-1] <= "~":
            text, b = text + self.leaves[after], after
        parts = leaves_of(text)
        tokens = [len(encode(bpe, x)) for x in parts]
        if len(parts) <= b - a + 1:
            for i in range(b - a + 1):
                self.put(a + i, *((parts[i], tokens[i]) if i < len(parts) else ("", 0)))
        else:
            counts = self.counts()
            self.leaves[a:b + 1], counts[a:b + 1] = parts, tokens
            self._grow([len(x) for x in self.leaves], counts)
        return len(text)


def build_trees(documents: DataFrame, vocabulary: Broadcast, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, leaf_tokens, columns of ``keep``): the first, full encoding of every text, leaf by
    leaf. Where the leaves lie follows from the text."""
    kept = documents.select("doc_id", "text", *keep)

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(vocabulary.value)
        for batch in batches:
            counts = [[len(encode(bpe, x)) for x in leaves_of(t.as_py())] for t in strings(batch.column(1))]
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                columns + [batch.column(2 + i) for i in range(len(keep))],
                ["doc_id", "text", "leaf_tokens", *keep])

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(work, ", ".join(
        f"{n} {t}" for n, t in [("doc_id", types["doc_id"]), ("text", types["text"]), (
            "leaf_tokens", "array<int>"), *((k, types[k]) for k in keep)]))


def recount(trees: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded_chars) from build_trees() with
    a column edits: array<struct<start, stop, text>>, each on the text as the edits before left it."""

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(vocabulary.value)
        for batch in batches:
            rows = []
            for text, counts, edits in zip(
                    strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tree = Tree(leaves_of(text.as_py()), counts or [])
                before, again = (tree.chars, tree.tokens), 0
                for e in edits or []:
                    if e and e["start"] is not None:
                        stop = e["start"] if e["stop"] is None else e["stop"]
                        again += tree.edit(e["start"], stop, e["text"] or "", bpe)
                rows.append((*before, tree.chars, tree.tokens, again))
            values = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(values[:, i]) for i in range(5))],
                ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"])

    return trees.select("doc_id", "text", "leaf_tokens", "edits").mapInArrow(
        work, f"doc_id {trees.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long,"
              " edited_chars long, edited_tokens long, reencoded_chars long")
