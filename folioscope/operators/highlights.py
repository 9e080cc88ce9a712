"""Passages inside a hit that come closest to the query."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed
from folioscope.operators import dense

_LINE = re.compile(r"[^\r\n]*[^\r\n\s][^\r\n]*")
_NOT_SPACE = re.compile(r"\S")
#: A sentence reaches to its closing marks and the space after them, to a full-width mark, or to the end of a line.
_SENTENCE = re.compile(r".+?(?:[.!?]+[\"')\]]*\s+|[。！？]+|\n|\Z)", re.S)


def _paragraphs(content: str, lines: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Lines with nothing but one line break between them, from the first sign that is no space."""
    first = 0
    for n in range(1, len(lines) + 1):
        if n == len(lines) or content.count("\n", lines[n - 1][1], lines[n][0]) > 1:
            yield _NOT_SPACE.search(content, lines[first][0]).start(), lines[n - 1][1]
            first = n


def _spans(content: str) -> Iterator[tuple[int, int]]:
    lines = [m.span() for m in _LINE.finditer(content)]
    for start, end in _paragraphs(content, lines):
        yield start, end
        yield from (m.span() for m in _SENTENCE.finditer(content, start, end))
    yield from lines
    for at in range(0, len(lines) - 1, fixed.SPAN_STRIDE):
        window = lines[at:at + fixed.SPAN_WINDOW]
        yield window[0][0], window[-1][1]


def _fits(start: int, end: int) -> bool:
    return fixed.SPAN_SHORTEST <= end - start <= fixed.SPAN_LONGEST


def candidate_spans(content: str) -> list[tuple[int, int]]:
    """Paragraphs, their sentences, lines, and windows of lines of the whole content, each once and
    without space around; the whole content if none has a fitting length."""
    inner = [(a + len(t) - len(t.lstrip()), b - len(t) + len(t.rstrip()))
             for a, b in _spans(content) for t in [content[a:b]]]
    fitting = dict.fromkeys(s for s in inner if _fits(*s))
    text = content.strip()
    whole = content.find(text)
    return list(fitting) or ([(whole, whole + len(text))] if _fits(0, len(text)) else [])


def highlights(hits: DataFrame, query_vectors: DataFrame, limit: int = 3,
               embedder: dense.Embedder = dense.hashed_vectors) -> DataFrame:
    """(query_id, chunk_id, start, end, similarity): the best spans that do not overlap.

    ``hits`` has query_id, chunk_id, content. A hit is one row with its query's vector, so spans
    are cut, embedded and chosen without a shuffle of texts.
    """
    columns = ["query_id", "chunk_id", "start", "end", "similarity"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for hit in frame.itertuples():
                spans = candidate_spans(hit.content)
                if not spans:
                    continue
                vectors = np.asarray(embedder([hit.content[a:b] for a, b in spans]), dtype=float)
                query = np.asarray(hit.embedding, dtype=float)
                norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
                similarity = np.maximum(0.0, np.divide(
                    vectors @ query, norms, out=np.zeros(len(spans)), where=norms > 0))
                start, end = np.array(spans).T
                rank = similarity - np.minimum(fixed.SPAN_PENALTY_MOST, np.log1p(
                    (end - start) / fixed.SPAN_PENALTY_LENGTH) * fixed.SPAN_PENALTY)
                left = np.flatnonzero(similarity >= fixed.SPAN_THRESHOLD)
                left = left[np.argsort(-rank[left], kind="stable")]
                chosen = []
                while len(left) and len(chosen) < limit:
                    best = left[0]
                    chosen.append((int(start[best]), int(end[best]), float(similarity[best])))
                    left = left[(end[left] <= start[best]) | (start[left] >= end[best])]
                rows += [(hit.query_id, hit.chunk_id, *c) for c in sorted(chosen)]
            yield pd.DataFrame(rows, columns=columns)

    id_type = hits.schema["query_id"].dataType.simpleString()
    return (hits.select("query_id", "chunk_id", "content").join(query_vectors, "query_id")
            .mapInPandas(run, f"query_id {id_type}, chunk_id string, start int, end int,"
                              " similarity double"))
