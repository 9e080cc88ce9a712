"""BM25 over postings, for a whole table of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import SearchRules
from folioscope.functions import fixed
from folioscope.operators import impacts
from folioscope.operators.queries import first_per_query

HIT_META = ("chunk_id", "file_name", "source_location", "extension")


def filters(wanted: str | None) -> bool:
    return not (wanted is None or not wanted.strip() or wanted.lower() in fixed.ALL_EXTENSION_FILTERS)


def extension_matches(extension: Column, wanted: str | None) -> Column:
    """Null, blank and the words for "all" let everything pass; otherwise equal without case."""
    if not filters(wanted):
        return F.lit(True)
    return F.lower(extension) == wanted.lower()


def bm25_scores(postings: DataFrame, query_terms: DataFrame, term_stats: DataFrame,
                stats: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """(query_id, chunk_id, score) of every pair that shares a term.

    The statistics cover the whole corpus, whatever is filtered later. Each term's postings are
    spread over ``term_salts`` keys, so that no term is one reducer's work; Spark ships the query
    terms instead where it finds them small. ``bm25_top`` doesn't score all pairs.
    """
    salts = F.sequence(F.lit(0), F.lit(rules.term_salts - 1))
    salted = postings.withColumn(
        "salt", F.pmod(F.xxhash64("chunk_id"), F.lit(rules.term_salts)).cast("int"))
    weighed = impacts.gains(query_terms, term_stats, stats).withColumn("salt", F.explode(salts))
    matched = salted.join(weighed, ["term", "salt"]).join(
        F.broadcast(stats.select("average_length")), F.lit(True))
    part = F.col("gain") * impacts.impact(F.col("weight"), F.col("doc_length"), F.col("average_length"), rules)
    return matched.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(part), rules.score_digits).alias("score"))


def branch_order() -> list:
    return [F.desc("score"), "file_name", "source_location", "chunk_id"]


def bm25_top(blocks: DataFrame, query_terms: DataFrame, term_stats: DataFrame,
             stats: DataFrame, meta: DataFrame, rules: SearchRules = SearchRules(),
             extension: str | None = None) -> DataFrame:
    """The sparse branch: (query_id, chunk_id, rank, score), best first. Only chunks that can be
    among the first get a score and a name."""
    eligible = meta.where(extension_matches(F.col("extension"), extension)).select("chunk_id") if filters(extension) else None
    scored = impacts.top_scores(blocks, impacts.gains(query_terms, term_stats, stats), eligible, rules).where("score > 0")
    located = scored.join(meta.select(*HIT_META), "chunk_id")
    return first_per_query(located, ["query_id"], branch_order(), rules.branch_limit).select(
        "query_id", "chunk_id", "rank", "score")
