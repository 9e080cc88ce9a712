"""Exact vector search: block matrix products on Spark partitions.

Every task multiplies the query vectors with its own block of chunk vectors and emits only the
best hits of the block, so what is shuffled is bounded by queries x limit x tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.config import SearchRules
from folioscope.operators.queries import first_per_query
from folioscope.operators.sparse import HIT_META, branch_order, extension_matches

_BEST = ("query_id string, chunk_id string, file_name string, source_location string,"
         " score double")


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_of_block(query_ids: np.ndarray, query_matrix: np.ndarray, block: pd.DataFrame,
                   rules: SearchRules) -> pd.DataFrame:
    """Top hits of one block for every query, in branch order, so never more than the limit."""
    names = ["chunk_id", "file_name", "source_location"]
    parts = []
    fits = block[block["embedding"].map(len) == query_matrix.shape[1]]
    if len(fits):
        # Chunks stand in the order that settles ties.
        fits = fits.sort_values(["file_name", "source_location", "chunk_id"])
        chunks, named = _unit_rows(fits["embedding"]).T, fits[names]
        limit = rules.branch_limit
        # Queries are multiplied in slabs, so that a product has a bounded size.
        slab = max(1, rules.vector_slab_bytes // (8 * len(fits)))
        for start in range(0, len(query_ids), slab):
            similarity = query_matrix[start:start + slab] @ chunks
            np.round(similarity, rules.score_digits, out=similarity)
            floor = np.full(len(similarity), rules.dense_threshold)
            if len(fits) > limit:
                at = len(fits) - limit
                floor = np.fmax(floor, np.partition(similarity, at, axis=1)[:, at])
            row, column = np.nonzero(similarity >= floor[:, None])
            order = np.lexsort((-similarity[row, column], row))
            row, column = row[order], column[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < limit
            row, column = row[kept], column[kept]
            if len(row):
                part = named.iloc[column].copy()
                part.insert(0, "query_id", query_ids[start + row])
                part["score"] = similarity[row, column]
                parts.append(part)
    if parts:
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame(columns=["query_id", *names, "score"])


def _by_dimension(query_rows: list) -> list[tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, list] = {}
    for row in query_rows:
        groups.setdefault(len(row[1]), []).append(row)
    return [(np.array([r[0] for r in rows], dtype=object),
             _unit_rows(pd.Series([r[1] for r in rows]))) for rows in groups.values()]


def _shipped(corpus: DataFrame, query_rows: list, rules: SearchRules) -> DataFrame:
    groups = corpus.sparkSession.sparkContext.broadcast(_by_dimension(query_rows))

    def scan(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for query_ids, matrix in groups.value:
                yield _best_of_block(query_ids, matrix, block, rules)

    return corpus.mapInPandas(scan, _BEST)


def _joined(corpus: DataFrame, queries: DataFrame, rules: SearchRules) -> DataFrame:
    """Both sides cut into blocks of bounded size; each pair of blocks is one task's work."""
    rows = rules.vector_block_rows
    corpus_blocks = max(1, -(-corpus.count() // rows))
    query_blocks = max(1, -(-queries.count() // rows))
    left = corpus.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(corpus_blocks))).withColumn(
        "qb", F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn(
        "cb", F.explode(F.expr(f"sequence(0L, {corpus_blocks - 1}L)")))

    def scan(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        parts = [_best_of_block(ids, matrix, block, rules) for ids, matrix in _by_dimension(
            list(zip(asked["query_id"], asked["embedding"])))]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
            columns=["query_id", "chunk_id", "file_name", "source_location", "score"])

    return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(scan, _BEST)


def dense_top(vectors: DataFrame, query_vectors: DataFrame, rules: SearchRules = SearchRules(),
              extension: str | None = None) -> DataFrame:
    """The dense branch: (query_id, chunk_id, rank, score), best first.

    ``vectors`` has the chunk's id, name, location, extension and embedding; ``query_vectors`` has
    query_id and embedding.
    """
    corpus = (vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
              .where(extension_matches(F.col("extension"), extension))
              .select(F.col("chunk_id").cast("string").alias("chunk_id"), "file_name",
                      "source_location", "embedding"))
    asked = query_vectors.where(F.size("embedding") > 0).select(
        F.col("query_id").cast("string").alias("query_id"), "embedding")
    # What may be shipped is decided by size; one row more than fits tells that it does not.
    sized = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if sized.n * (sized.d or 0) * 8 <= rules.max_shipped_vector_bytes:
        best = _shipped(corpus, [(r.query_id, r.embedding) for r in asked.collect()], rules)
    else:
        best = _joined(corpus, asked, rules)
    id_type = query_vectors.schema["query_id"].dataType
    return first_per_query(best, ["query_id"], branch_order(), rules.branch_limit).select(
        F.col("query_id").cast(id_type).alias("query_id"), "chunk_id", "rank", "score")


def cosine(left, right):
    """The same score as a built-in expression: zero for null, unequal length or zero norm."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"),
                                      lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(F.size(left) == F.size(right), F.coalesce(
        dot(left, right) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def hashed_vectors(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Deterministic stand-in for a model: each word adds +1 or -1 at a hashed position. Words are runs of two or
    more letters a to z or digits; all other bytes of the lower-cased text part them."""
    import hashlib

    class Places(dict):
        """Word to position: words that count downwards after the others, single signs, which don't count, at the end."""

        def __missing__(self, word: bytes) -> int:
            place = 2 * dimension
            if len(word) > 1:
                digest = hashlib.md5(word).digest()
                place = int.from_bytes(digest[:4]) % dimension + (0 if digest[4] < 128 else dimension)
            self[word] = place
            return place

    inner = b"abcdefghijklmnopqrstuvwxyz0123456789"
    parted = bytes(b if b in inner else 32 for b in range(256))
    place_of = Places().__getitem__
    out = np.zeros((len(texts), dimension), dtype=np.float32)
    for row, text in enumerate(texts):
        words = text.lower().encode("utf-8", "replace").translate(parted).split()
        counts = np.bincount(np.fromiter(map(place_of, words), np.int64, len(words)), minlength=2 * dimension + 1)
        out[row] = counts[:dimension] - counts[dimension:-1]
    return out


Embedder = Callable[[list[str]], np.ndarray]


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder = hashed_vectors,
          batch: int = 24) -> DataFrame:
    """(key, embedding) by a pluggable batch function; the count and the dimension must match."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dimension = None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                matrix = np.asarray(embedder(part[text].tolist()), dtype=np.float32)
                if matrix.ndim != 2 or len(matrix) != len(part):
                    raise ValueError("the embedder returned a wrong number of vectors")
                if dimension is not None and matrix.shape[1] != dimension:
                    raise ValueError("the embedder changed its dimension")
                dimension = matrix.shape[1]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(matrix)})

    key_type = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {key_type}, embedding array<float>")


def with_vectors(chunks: DataFrame, text, embedder: Embedder = hashed_vectors) -> DataFrame:
    """Adds ``embedding`` to every chunk in place, without a join."""
    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        matrix = np.asarray(embedder(texts.tolist()), dtype=np.float32)
        if matrix.ndim != 2 or len(matrix) != len(texts):
            raise ValueError("the embedder returned a wrong number of vectors")
        return pd.Series(list(matrix))

    return chunks.withColumn("embedding", vector(text))


def embed_new(chunks: DataFrame, existing: DataFrame | None,
              embedder: Embedder = hashed_vectors) -> DataFrame:
    """Vectors of all chunks: known ones are kept, only the others are computed."""
    texts = chunks.select("chunk_id", F.concat_ws(
        "\n", "file_name", "source_location", "content").alias("embedded_text"))
    if existing is None:
        return embed(texts, "chunk_id", "embedded_text", embedder)
    known = existing.select("chunk_id", "embedding").where(F.size("embedding") > 0)
    fresh = embed(texts.join(known, "chunk_id", "left_anti"), "chunk_id", "embedded_text", embedder)
    return known.join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(fresh)


def compatibility(chunk_vectors: DataFrame, manifest: DataFrame, signature: str) -> DataFrame:
    """One row: may the dense branch run? Needs a known dimension, the same model, and every
    vector of that dimension."""
    sizes = (chunk_vectors.where(F.size("embedding") > 0)
             .agg(F.min(F.size("embedding")).alias("smallest"),
                  F.max(F.size("embedding")).alias("largest")))
    return manifest.join(F.broadcast(sizes), F.lit(True)).select(
        ((F.col("dimension") > 0) & (F.col("model_signature") == signature)
         & F.coalesce((F.col("smallest") == F.col("dimension"))
                      & (F.col("largest") == F.col("dimension")), F.lit(True)))
        .alias("compatible"))
