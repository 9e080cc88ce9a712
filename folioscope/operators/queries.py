"""Query understanding over a table of queries (query_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscope.functions import fixed, text as tx
from folioscope.operators import lexical, ordered


def has_code_intent(text: Column) -> Column:
    return text.rlike(fixed.CODE_INTENT_PATTERN)


def has_location_intent(text: Column) -> Column:
    return text.rlike(fixed.LOCATION_INTENT_PATTERN)


def subject(cleaned: Column) -> Column:
    """The query without conversational framing, or the whole query if nothing else is left."""
    framed = F.regexp_replace(cleaned, fixed.BOILERPLATE_PATTERN, " ")
    plain = tx.collapse(F.regexp_replace(framed, fixed.QUERY_PUNCTUATION_PATTERN, " "))
    bare = tx.collapse(F.regexp_replace(plain, fixed.SUBJECT_NOISE_PATTERN, " "))
    return F.when(tx.is_blank(bare), cleaned).otherwise(bare)


def analyze(queries: DataFrame) -> DataFrame:
    """Cleaned text, subject, normalised subject and intents. Blank queries are dropped."""
    cleaned = queries.select("query_id", tx.strip(F.coalesce("text", F.lit(""))).alias("text"))
    return (cleaned.where(F.col("text") != "")
            .withColumn("subject", subject(F.col("text")))
            .withColumn("normalized", tx.normalize_text(F.col("subject")))
            .withColumn("code_intent", has_code_intent(F.col("text")))
            .withColumn("location_intent", has_location_intent(F.col("text")))
            .withColumn("metadata_focused", F.col("code_intent") | F.col("location_intent")))


def query_terms(analyzed: DataFrame) -> DataFrame:
    """(query_id, term, weight) with query weights."""
    return lexical.weighted_postings(analyzed, "query_id", "subject", query=True).drop("doc_length")


def decompose(queries: DataFrame, maximum: int = 3, shortest: int = 4) -> DataFrame:
    """(query_id, facet, text): the separate questions a query asks, or the query itself.

    A query has few fragments, so they stay one array until the last step.
    """
    cleaned = queries.select("query_id", tx.strip(F.coalesce("text", F.lit(""))).alias("cleaned"))
    fragments = (cleaned
                 .withColumn("parts", F.split("cleaned", fixed.FACET_BOUNDARY_PATTERN, -1))
                 .select("query_id", "cleaned", F.posexplode_outer("parts").alias("at", "part"))
                 .withColumn("facet_text", tx.strip(F.regexp_replace(
                     "part", fixed.FACET_EDGE_PATTERN, "")))
                 .withColumn("norm", tx.normalize_text(F.col("facet_text")))
                 .withColumn("usable", F.length("facet_text") >= shortest))
    # First occurrence of each normal form, in order of appearance.
    first = (fragments.groupBy("query_id", "cleaned", "norm")
             .agg(F.min(F.when(F.col("usable"), F.struct("at", "facet_text"))).alias("seen")))
    gathered = (first.groupBy("query_id", "cleaned")
                .agg(F.slice(F.array_sort(F.collect_list("seen")), 1, maximum).alias("facets")))
    texts = F.when(F.size("facets") < 2, F.array("cleaned")).otherwise(
        F.transform("facets", lambda f: f["facet_text"]))
    return (gathered.withColumn("texts", texts)
            .select("query_id", F.posexplode_outer("texts").alias("facet", "text"))
            .withColumn("facet", F.col("facet") + 1))


def needs_context(question: Column) -> Column:
    return (F.length(question) <= 24) | question.rlike(fixed.REFERENTIAL_PATTERN)


def resolve_references(turns: DataFrame, longest: int = 300) -> DataFrame:
    """Adds ``resolved`` to every user turn: the turn itself, or the last user turn before it put
    in front when the turn is short or points back."""
    spoken = tx.strip(F.coalesce("text", F.lit("")))
    earlier = F.when((F.col("role") == "user") & (spoken != ""), spoken)
    carried = ordered.carried_forward(turns, ["conv_id"], "turn", earlier, "topic")
    joined = F.concat_ws(" ", "topic", spoken)
    together = F.when(F.length(joined) <= longest, joined).otherwise(
        tx.strip(F.substring(joined, 1, longest)))
    return (carried.where(F.col("role") == "user")
            .withColumn("resolved", F.when(
                (spoken != "") & needs_context(spoken) & F.col("topic").isNotNull(), together)
                .otherwise(spoken))
            .drop("topic"))


_REPLY = ("action string, queries array<variant>, query variant")


def parse_planner_replies(replies: DataFrame, maximum: int = 3) -> DataFrame:
    """(question_id, round, raw, finish_reason) to an action and its typed queries.

    Anything that is not positively a decision is UNAVAILABLE. Queries may be typed objects,
    plain strings, or a single ``query``; they are clipped by mode and de-duplicated without
    regard to case and spacing.
    """
    body = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)\{.*\}", 0)
    parsed = (replies
              .withColumn("__json", F.when((body != "") & (F.lower(F.coalesce(
                  "finish_reason", F.lit(""))) != "length"), F.try_parse_json(body)))
              .withColumn("__action", F.lower(tx.strip(F.coalesce(F.expr(
                  "try_variant_get(__json, '$.action', 'string')"), F.lit("")))))
              .withColumn("__list", F.expr(
                  "try_variant_get(__json, '$.queries', 'array<variant>')"))
              .withColumn("__single", F.expr(
                  "CASE WHEN schema_of_variant(variant_get(__json, '$.query', 'variant')) ="
                  " 'STRING' THEN try_variant_get(__json, '$.query', 'string') END")))

    def entry(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        text = F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(
            kind.startswith("OBJECT"), F.try_variant_get(item, "$.text", "string"))
        mode = F.when(kind.startswith("OBJECT"), F.try_variant_get(item, "$.mode", "string"))
        return F.struct(tx.strip(F.coalesce(text, F.lit(""))).alias("text"),
                        F.lower(tx.strip(F.coalesce(mode, F.lit("")))).alias("mode"))

    listed = F.filter(F.transform(F.coalesce(
        F.col("__list"), F.array().cast("array<variant>")), entry), lambda e: e["text"] != "")
    single = F.filter(F.array(F.struct(
        tx.strip(F.coalesce("__single", F.lit(""))).alias("text"), F.lit("").alias("mode"))),
        lambda e: e["text"] != "")

    def typed(item: Column) -> Column:
        hypothetical = item["mode"] == "hypothetical"
        ceiling = F.when(hypothetical, 1200).otherwise(500)
        return F.struct(
            tx.strip(F.substring(item["text"], F.lit(1), ceiling)).alias("text"),
            F.when(hypothetical, "HYPOTHETICAL").otherwise("KEYWORD").alias("mode"))

    staged = (parsed.withColumn("__listed", listed)
              .withColumn("__raw", F.when(F.size("__listed") > 0, F.col("__listed"))
                          .otherwise(single))
              .withColumn("__typed", F.transform("__raw", typed))
              .withColumn("__keys", F.transform("__typed", lambda q: query_key(q["text"])))
              .withColumn("__first", F.filter("__typed", lambda q, i: F.array_position(
                  F.col("__keys"), query_key(q["text"])) == i + 1))
              .withColumn("__queries", F.slice("__first", 1, maximum)))
    action = (F.when(F.col("__action") == "answer", "ANSWER")
              .when((F.col("__action") == "search") & (F.size("__queries") > 0), "SEARCH")
              .otherwise("UNAVAILABLE"))
    return (staged.withColumn("action", action)
            .withColumn("queries", F.when(F.col("action") == "SEARCH", F.col("__queries"))
                        .otherwise(F.array().cast(
                            "array<struct<text:string,mode:string>>")))
            .drop(*[c for c in staged.columns if c.startswith("__")]))


def query_key(text: Column) -> Column:
    """What makes two generated queries the same."""
    return F.lower(tx.collapse(text))


def drop_repeats(attempts: DataFrame) -> DataFrame:
    """Keeps the first of equal queries of a question, in (round, position) order."""
    keyed = attempts.withColumn("__key", query_key(F.col("text")))
    first = keyed.groupBy("question_id", "__key").agg(
        F.min(F.struct("round", "position")).alias("__first"))
    return (keyed.join(first, ["question_id", "__key"])
            .where(F.struct("round", "position") == F.col("__first"))
            .drop("__key", "__first"))


def route(typed_queries: DataFrame, vectors_available: bool) -> DataFrame:
    """Adds the strategy a typed query is searched with, and whether it had to fall back."""
    hypothetical = F.col("mode") == "HYPOTHETICAL"
    dense = hypothetical & F.lit(vectors_available)
    return (typed_queries
            .withColumn("strategy", F.when(dense, "DENSE").otherwise("RRF_RERANK"))
            .withColumn("fell_back", hypothetical & ~F.lit(vectors_available)))


def first_per_query(rows: DataFrame, keys: list[str], order: list, count: int,
                    rank: str = "rank") -> DataFrame:
    """The first rows of each key. Spark prunes to ``count`` rows per key before it shuffles."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= count)
