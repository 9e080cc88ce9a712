"""Fusing branches, scoring candidates, reranking, capping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.config import SearchRules
from folioscope.functions import fixed, scores, text as tx
from folioscope.operators import lexical
from folioscope.operators.queries import first_per_query
from folioscope.session import only, stored


def fuse(sparse: DataFrame, dense: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """Reciprocal-rank fusion of both branches, with the scores as shares of the query's best."""
    both = (sparse.select("query_id", "chunk_id", "rank", F.col("score").alias("bm25"),
                          F.lit(0.0).alias("dense"), F.lit(0).alias("branch"))
            .unionByName(dense.select("query_id", "chunk_id", "rank", F.lit(0.0).alias("bm25"),
                                      F.col("score").alias("dense"), F.lit(1).alias("branch"))))
    # Insertion order, which settles ties: sparse hits first, then dense-only hits.
    order = F.struct("branch", "rank")
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.max("bm25").alias("bm25"), F.max("dense").alias("dense"),
        F.round(F.sum(scores.reciprocal_rank(F.col("rank"), rules.rrf_k)), 12).alias("rrf"),
        F.min(order).alias("inserted"))
    whole = W.partitionBy("query_id")
    return fused.select(
        "query_id", "chunk_id", "inserted",
        scores.share_of(F.col("bm25"), F.max("bm25").over(whole)).alias("bm25"),
        scores.clamp(F.col("dense")).alias("dense"),
        scores.share_of(F.col("rrf"), F.max("rrf").over(whole)).alias("fusion"))


def pool(fused: DataFrame, meta: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """The candidates that are looked at closely: best fusion first, then by file name. ``meta`` names the chunks;
    texts are looked up where they are needed, not carried along for every query."""
    named = fused.join(meta, "chunk_id")
    return first_per_query(named, ["query_id"], [F.desc("fusion"), "file_name", "inserted"],
                           rules.pool_limit, "pool_rank")


def declares(content: Column, term: Column) -> Column:
    hit = content.startswith(F.concat(term, F.lit("(")))
    for word in ("class ", "interface ", "record ", "enum ", "def ", "function "):
        hit = hit | F.contains(content, F.concat(F.lit(word), term))
    return hit | F.contains(content, F.concat(F.lit(" "), term, F.lit("(")))


def _numbered(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy("file_name", "path", *order)))


def lexical_features(candidates: DataFrame, analyzed: DataFrame, query_terms: DataFrame,
                     postings: DataFrame, term_stats: DataFrame, stats: DataFrame, chunks: DataFrame) -> DataFrame:
    """The feature score of each (query, candidate) pair and the marks it rests on.

    ``candidates`` has query_id, chunk_id, file_name, path and extension; texts are in ``chunks``. Only postings and
    texts of candidate chunks are shuffled, a text once for all its queries. Only here are TF-IDF vectors needed.
    """
    wanted = stored(candidates.select("chunk_id").distinct(), "wanted")
    # norms and products both read them
    documents = stored(lexical.tfidf(postings.join(wanted, "chunk_id", "left_semi"), term_stats, stats).select(
        "chunk_id", "term", "tfidf"), "documents")
    norms = documents.groupBy("chunk_id").agg(
        F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("chunk_norm"))
    asked = (query_terms.join(term_stats, "term", "left")
             .join(F.broadcast(stats.select("documents")), F.lit(True))
             .select("query_id", "term", (
                 scores.tf_weight(F.col("weight")) * scores.idf_tfidf(
                     F.coalesce("df", F.lit(0)), F.col("documents"))).alias("query_tfidf")))
    pairs = candidates.select("query_id", "chunk_id")
    dots = (pairs.join(asked, "query_id")
            .join(only(documents, query_terms, "term"), ["chunk_id", "term"])
            .groupBy("query_id", "chunk_id")
            .agg(F.sum(F.col("query_tfidf") * F.col("tfidf")).alias("dot"),
                 F.sum(F.col("term").startswith("concept:").cast("int")).alias("concepts")))
    # Terms of one query are few; they travel as an array and are tested in place.
    vectors = asked.groupBy("query_id").agg(
        F.sqrt(F.sum(F.col("query_tfidf") * F.col("query_tfidf"))).alias("query_norm"),
        F.filter(F.collect_list("term"), lambda t: ~t.startswith("concept:")).alias("terms"))
    # an id that stands for several chunks has candidates for each of their texts, which are taken in turn
    texts = (_numbered(chunks.select("chunk_id", "file_name", "path", "content").join(wanted, "chunk_id", "left_semi"),
                       ["chunk_id"], "content")
             .withColumn("__texts", F.count(F.lit(1)).over(W.partitionBy("chunk_id")))
             .select("chunk_id", (F.col("__nth") - 1).alias("__text"), "__texts", tx.normalize_text(F.col("content")).alias("norm_content"))
             # Most texts hold no declaring word and no bracket at all.
             .withColumn("may_declare", F.col("norm_content").rlike(
                 r"(?:class|interface|record|enum|def|function) |\(")))
    described = (_numbered(candidates.select("query_id", "chunk_id", "file_name", "path", "extension"), ["query_id", "chunk_id"])
                 .withColumn("norm_name", tx.normalize_text(F.col("file_name")))
                 .withColumn("norm_path", tx.normalize_text(F.col("path")))
                 .join(analyzed.select("query_id", "normalized", "code_intent",
                                       "location_intent", "metadata_focused"), "query_id")
                 .join(vectors, "query_id", "left")
                 .join(norms, "chunk_id", "left")
                 .join(dots, ["query_id", "chunk_id"], "left")
                 .join(texts, "chunk_id").where((F.col("__nth") - 1) % F.col("__texts") == F.col("__text")))

    def matches(test) -> Column:
        return F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), test))

    marked = (described
              .withColumn("name_matches", matches(lambda t: F.contains(F.col("norm_name"), t)))
              .withColumn("path_matches", matches(lambda t: F.contains(F.col("norm_path"), t)))
              .withColumn("declarations", matches(
                  lambda t: F.col("may_declare") & (F.length(t) >= 3)
                  & F.contains(F.col("norm_content"), t) & declares(F.col("norm_content"), t)))
              .withColumn("concept_matches", F.coalesce("concepts", F.lit(0)))
              .withColumn("exact", F.contains("norm_content", "normalized"))
              .withColumn("code_file", F.col("code_intent")
                          & F.lower("extension").isin(*fixed.CODE_EXTENSIONS)))
    sparse_cosine = F.coalesce(F.col("dot") / F.nullif(
        F.col("query_norm") * F.col("chunk_norm"), F.lit(0.0)), F.lit(0.0))
    value = (0.74 * sparse_cosine
             + F.when(F.col("exact"), 0.24).otherwise(0.0)
             + F.col("name_matches") * F.when(F.col("metadata_focused"), 0.09).otherwise(0.035)
             + F.least(F.lit(0.18), F.col("path_matches")
                       * F.when(F.col("location_intent"), 0.055).otherwise(0.02))
             + F.least(F.lit(0.30), F.col("concept_matches") * 0.10)
             + F.when(F.col("code_file"), 0.09).otherwise(0.0)
             + F.least(F.lit(0.32), F.col("declarations") * 0.16))
    return marked.select(
        "query_id", "chunk_id", F.round(value, 12).alias("feature_value"),
        "concept_matches", "exact", "code_file",
        ((F.col("name_matches") + F.col("path_matches")) > 0).alias("metadata_match"),
        (F.col("declarations") > 0).alias("declaration_match"))


def feature_rerank(scored: DataFrame) -> DataFrame:
    """Adds ``final``: the weighted mix, which leans on features for code and location queries."""
    feature = scores.saturate(F.col("feature_value"))
    mix = F.when(F.col("metadata_focused"),
                 0.35 * F.col("fusion") + 0.20 * F.col("bm25") + 0.10 * F.col("dense")
                 + 0.35 * feature).otherwise(
                 0.40 * F.col("fusion") + 0.20 * F.col("bm25") + 0.25 * F.col("dense")
                 + 0.15 * feature)
    return scored.withColumn("final", F.round(scores.clamp(mix), 9))


def merge_external_scores(ranked: DataFrame, external: DataFrame) -> DataFrame:
    """Ranking by scores from outside.

    ``ranked`` holds query_id, chunk_id, pool_rank, local_rank and final; ``external`` holds
    query_id, candidate_index (0-based pool position), position (order in the reply) and score. The first
    score of an index counts, unknown indexes are ignored. Candidates without a score follow, with
    a quarter of their local score; a query without any valid score keeps its local ranking.
    """
    index = F.col("pool_rank") - 1
    first = external.groupBy("query_id", "candidate_index").agg(
        F.min_by("score", "position").alias("outside"), F.min("position").alias("position"))
    number = F.when(F.col("outside").isNull() | F.isnan("outside"), 0.0).otherwise(
        scores.clamp(F.col("outside")))
    joined = ranked.withColumn("candidate_index", index).join(
        first.withColumn("given", number), ["query_id", "candidate_index"], "left")
    whole = W.partitionBy("query_id")
    any_given = F.count("given").over(whole) > 0
    merged = F.when(~any_given, F.col("final")).otherwise(
        F.coalesce(F.col("given"), F.col("final") * 0.25))
    order = W.partitionBy("query_id").orderBy(
        F.col("given").isNull(), F.desc("given"), "position", "local_rank")
    return (joined.withColumn("merged", merged)
            .withColumn("rank", F.row_number().over(order))
            .select("query_id", "chunk_id", "rank", F.col("merged").alias("score")))


def cap_per_document(ranked: DataFrame, rank: str, rules: SearchRules = SearchRules()) -> DataFrame:
    """At most three hits of one path, in rank order, then the limit."""
    within = W.partitionBy("query_id", "path").orderBy(rank)
    kept = (ranked.withColumn("__nth", F.row_number().over(within))
            .where(F.col("__nth") <= rules.per_document).drop("__nth"))
    return first_per_query(kept.drop("rank") if rank != "rank" else kept.withColumnRenamed(
        "rank", "__rank"), ["query_id"], [rank if rank != "rank" else "__rank"], rules.limit)
