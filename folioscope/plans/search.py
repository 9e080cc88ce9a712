"""Search: a table of queries in, ranked hits out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.config import SearchRules
from folioscope.functions import fixed, scores
from folioscope.operators import dense, fusion, queries, sparse
from folioscope.operators.queries import first_per_query
from folioscope.plans.index import Index
from folioscope.session import cut_lineage, only

STRATEGIES = ("BM25", "DENSE", "RRF", "RRF_RERANK")
HIT_COLUMNS = ("query_id", "rank", "chunk_id", "score", "reason")
META = ("chunk_id", "path", "file_name", "source_location", "extension")


def _sparse_branch(index, analyzed, terms, rules, extension):
    return sparse.bm25_top(index.impacts, terms, index.term_stats, index.corpus_stats,
                           index.chunks, rules, extension)


def query_vectors(asked: DataFrame, embedder: dense.Embedder) -> DataFrame:
    return dense.embed(asked.select("query_id", "subject"), "query_id", "subject", embedder)


def _no_hits(index: Index, asked: DataFrame) -> DataFrame:
    return asked.where(F.lit(False)).select(
        "query_id", F.lit("").alias("chunk_id"), F.lit(0).alias("rank"),
        F.lit(0.0).alias("score"))


def candidates(index: Index, asked: DataFrame, terms: DataFrame, vectors: DataFrame | None,
               rules: SearchRules, extension: str | None) -> DataFrame:
    """Both branches fused and cut to the pool, with the chunk's names."""
    found = _sparse_branch(index, asked, terms, rules, extension)
    near = (_no_hits(index, asked) if vectors is None
            else dense.dense_top(index.chunks, vectors, rules, extension))
    return fusion.pool(fusion.fuse(found, near, rules),
                       index.chunks.select(*META), rules)


def rerank_pool(index: Index, asked: DataFrame, terms: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds features, the final score and the local rank."""
    features = fusion.lexical_features(pool, asked, terms, index.postings, index.term_stats,
                                       index.corpus_stats, index.chunks)
    scored = (pool.join(features, ["query_id", "chunk_id"])
              .join(asked.select("query_id", "metadata_focused"), "query_id"))
    ranked = fusion.feature_rerank(scored)
    order = W.partitionBy("query_id").orderBy(F.desc("final"), "file_name", "source_location",
                                              "pool_rank")
    return ranked.withColumn("local_rank", F.row_number().over(order))


def _bm25_only(index, asked, terms, rules, extension):
    found = _sparse_branch(index, asked, terms, rules, extension)
    best = F.max("score").over(W.partitionBy("query_id"))
    # at most limit rows per query, and read again by each feature
    kept = cut_lineage(found.withColumn("share", scores.share_of(F.col("score"), best))
                       .where(F.col("rank") <= rules.limit))
    named = kept.join(index.chunks.select(*META), "chunk_id")
    features = fusion.lexical_features(named, asked, terms, index.postings, index.term_stats,
                                       index.corpus_stats, index.chunks)
    reason = (F.when(F.col("declaration_match"), fixed.REASON_DECLARATION)
              .when(F.col("metadata_match"), fixed.REASON_METADATA)
              .otherwise(fixed.REASON_LEXICAL))
    return (kept.join(features, ["query_id", "chunk_id"])
            .select("query_id", "rank", "chunk_id", F.col("share").alias("score"),
                    reason.alias("reason")))


def search(index: Index, asked_queries: DataFrame, strategy: str = "RRF_RERANK",
           rules: SearchRules = SearchRules(), extension: str | None = None,
           embedder: dense.Embedder | None = dense.hashed_vectors,
           rerank_fn=None) -> DataFrame:
    """Ranked hits of every query in (query_id, text).

    ``rerank_fn`` may map the candidate pool to external scores (see
    ``fusion.merge_external_scores``); without it the local feature ranking decides.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    # Queries and their terms are small and read by every step below.
    asked = cut_lineage(queries.analyze(asked_queries))
    terms = cut_lineage(queries.query_terms(asked))
    vectors = None
    if embedder is not None and strategy != "BM25":
        vectors = query_vectors(asked, embedder)
    if strategy == "BM25":
        return _bm25_only(index, asked, terms, rules, extension)
    if strategy == "DENSE":
        near = (_no_hits(index, asked) if vectors is None
                else dense.dense_top(index.chunks, vectors, rules, extension))
        return (near.where(F.col("rank") <= rules.limit)
                .select("query_id", "rank", "chunk_id", scores.clamp(F.col("score")).alias("score"),
                        F.lit(fixed.REASON_DENSE).alias("reason")))
    # At most pool_limit rows per query, and read five times by the reranking.
    pool = cut_lineage(candidates(index, asked, terms, vectors, rules, extension))
    if strategy == "RRF":
        ranked, order, score = pool, "pool_rank", "fusion"
        reason = fixed.REASON_FUSED
    else:
        ranked = rerank_pool(index, asked, terms, pool)
        order, score = "local_rank", "final"
        reason = f"{fixed.REASON_FUSED}{fixed.LOCATION_SEPARATOR}{fixed.RERANKER_NAME}"
        if rerank_fn is not None:
            merged = fusion.merge_external_scores(ranked, rerank_fn(ranked))
            ranked = ranked.drop("rank").join(merged.select(
                "query_id", "chunk_id", F.col("rank").alias("merged_rank"),
                F.col("score").alias("merged_score")), ["query_id", "chunk_id"])
            order, score = "merged_rank", "merged_score"
    capped = fusion.cap_per_document(ranked, order, rules)
    return capped.select("query_id", "rank", "chunk_id",
                         scores.clamp(F.col(score)).alias("score"), F.lit(reason).alias("reason"))


def with_chunks(hits: DataFrame, index: Index) -> DataFrame:
    """Hits with all that is known of their chunks. Only chunks that were hit are shuffled."""
    found = cut_lineage(hits)
    return found.join(only(index.chunks.drop("embedding"), found, "chunk_id"), "chunk_id")


def top_hits(hits: DataFrame, count: int) -> DataFrame:
    return first_per_query(hits.withColumnRenamed("rank", "__rank"), ["query_id"], ["__rank"],
                           count).drop("__rank")
