"""Registered queries: lexical features, query analysis, retrieval, fusion, context, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import sql, tables as t
from folioscope.config import EvidenceRules, SearchRules
from folioscope.functions import text as tx
from folioscope.operators import context, dense, evaluation, fusion, highlights, lexical, queries, sparse
from folioscope.plans import ask, evaluate
from folioscope.plans.index import index_facets
from folioscope.session import cut_lineage
from folioscope.plans.search import rerank_pool, candidates, query_vectors, search, with_chunks

QUERIES: dict = {}
SQL: dict[str, str] = {}
RULES = SearchRules()


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            SQL[name] = oracle
        return function
    return keep


def _lexical(spark, sf):
    """Chunks and postings of the stored index."""
    idx = t.index(spark, sf)
    return idx.chunks, idx.postings


@query("doc_terms", f"WITH {sql.POSTINGS} SELECT chunk_id, term, round(weight, 6) AS weight"
                    " FROM postings")
def doc_terms(spark, sf):
    return t.rounded(lexical.chunk_postings(t.corpus(spark, sf)).select(
        "chunk_id", "term", "weight"), "weight")


@query("term_df", f"WITH {sql.POSTINGS} SELECT term, df FROM df")
def term_df(spark, sf):
    return lexical.document_frequency(_lexical(spark, sf)[1])


@query("corpus_stats", f"WITH {sql.POSTINGS} SELECT n AS documents,"
                       " round(avg_len, 6) AS average_length FROM stats")
def corpus_stats(spark, sf):
    chunks, postings = _lexical(spark, sf)
    return t.rounded(lexical.corpus_stats(chunks, postings), "average_length")


@query("tfidf_norms", f"""WITH {sql.POSTINGS} SELECT p.chunk_id, round(l.len, 6) AS length,
  round(sqrt(sum(pow((1 + ln(greatest(1.0, weight))) * ln(1 + (n + 1.0) / (df + 1.0)), 2))), 6)
  AS norm FROM postings p JOIN df USING (term) JOIN lengths l USING (chunk_id) CROSS JOIN stats
  GROUP BY p.chunk_id, l.len""")
def tfidf_norms(spark, sf):
    chunks, postings = _lexical(spark, sf)
    weighted = lexical.tfidf(postings, lexical.document_frequency(postings),
                             lexical.corpus_stats(chunks, postings))
    return t.rounded(lexical.document_stats(weighted), "length", "norm")


@query("concept_hits", f"""WITH {sql.POSTINGS} SELECT term AS concept, count(*) AS chunks
  FROM postings WHERE starts_with(term, 'concept:') GROUP BY term""")
def concept_hits(spark, sf):
    _, postings = _lexical(spark, sf)
    return (postings.where(F.col("term").startswith("concept:"))
            .groupBy(F.col("term").alias("concept")).agg(F.count("*").alias("chunks")))


@query("camel_split", """WITH n AS (SELECT p_partkey, array_to_string(list_transform(
    string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || 'XMLFile' || p_size
    AS camel FROM part)
  SELECT p_partkey, regexp_replace(regexp_replace(camel, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
    '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g') AS words FROM n""")
def camel_split(spark, sf):
    camel = F.concat(F.translate(F.initcap("p_name"), " ", ""), F.lit("XMLFile"),
                     F.col("p_size").cast("string"))
    return t.load(spark, sf, "part").select("p_partkey", tx.split_camel(camel).alias("words"))


@query("token_estimates", """SELECT doc_id,
  CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS chunk_tokens,
  CAST(ceil(length(text) / 4.0) AS INTEGER) AS prompt_tokens FROM documents""")
def token_estimates(spark, sf):
    return t.load(spark, sf, "documents").select(
        "doc_id", tx.chunk_tokens(F.col("text")).alias("chunk_tokens"),
        tx.prompt_tokens(F.col("text")).alias("prompt_tokens"))


@query("index_facets", f"""WITH {sql.CHUNKS} SELECT count(DISTINCT path) AS files,
  count(*) AS chunks, array_to_string(list_sort(list_distinct(list(extension))), ',') AS extensions
  FROM chunks""")
def facets(spark, sf):
    return index_facets(t.corpus(spark, sf)).withColumn(
        "extensions", F.array_join("extensions", ","))


@query("query_analysis", f"""WITH {sql.ANALYZED} SELECT query_id, subject, normalized, code_intent,
  location_intent, code_intent OR location_intent AS metadata_focused FROM analyzed""")
def query_analysis(spark, sf):
    return queries.analyze(t.asked(spark, sf)).drop("text")


@query("query_terms", f"WITH {sql.QUERY_TERMS} SELECT query_id, term, round(weight, 6) AS weight"
                      " FROM query_terms")
def query_terms(spark, sf):
    return t.rounded(queries.query_terms(queries.analyze(t.asked(spark, sf))), "weight")


_FACETS = f"""
  asked AS (SELECT item_id AS query_id, {sql.strip("regexp_replace(text, '[.] ?', '? ', 'g')")}
            AS text FROM benchmark),
  parts AS (SELECT query_id, text, unnest(regexp_split_to_array(text, '[？?。；;！!]+')) AS part,
              generate_subscripts(regexp_split_to_array(text, '[？?。；;！!]+'), 1) AS pos FROM asked),
  trimmed AS (SELECT query_id, text, pos, regexp_replace(part,
      '^[\\s、，,：:；;。！!？?]+|[\\s、，,：:；;。！!？?]+$', '', 'g') AS facet_text FROM parts),
  firsts AS (SELECT query_id, min(pos) AS pos, arg_min(facet_text, pos) AS facet_text FROM trimmed
             WHERE length(facet_text) >= 4 GROUP BY query_id, lower(facet_text)),
  numbered AS (SELECT query_id, facet_text, row_number() OVER (PARTITION BY query_id ORDER BY pos)
      AS facet, count(*) OVER (PARTITION BY query_id) AS facets FROM firsts)"""


@query("query_facets", f"""WITH {_FACETS}
  SELECT query_id, CAST(facet AS INTEGER) AS facet, facet_text AS text FROM numbered
  WHERE facets >= 2 AND facet <= 3
  UNION ALL SELECT query_id, 1, text FROM asked WHERE query_id NOT IN
    (SELECT query_id FROM numbered WHERE facets >= 2)""")
def query_facets(spark, sf):
    return queries.decompose(t.questions(spark, sf))


@query("resolved_questions", f"""WITH said AS (
    SELECT conv_id, turn, role, {sql.strip('text')} AS spoken FROM conversations),
  topics AS (SELECT *, last_value(CASE WHEN role = 'user' AND spoken <> '' THEN spoken END
      IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM said)
  SELECT conv_id, turn, CASE WHEN spoken <> '' AND topic IS NOT NULL AND (length(spoken) <= 24
      OR regexp_matches(spoken, '{sql.fixed.REFERENTIAL_PATTERN}'))
    THEN {sql.strip("substr(topic || ' ' || spoken, 1, 300)")}
    ELSE spoken END AS resolved FROM topics WHERE role = 'user'""")
def resolved_questions(spark, sf):
    return queries.resolve_references(t.load(spark, sf, "conversations")).select(
        "conv_id", "turn", "resolved")


def _replies(spark, sf):
    k = F.get_json_object("props", "$.k")
    raw = (F.when(F.col("event_type") == "view", F.concat(
        F.lit('plan: {"action":"search","queries":["kw '), k,
        F.lit('", {"text":" hyp '), k, F.lit('","mode":"Hypothetical"}, "KW  '), k,
        F.lit('", {"text":""}]} done')))
        .when(F.col("event_type") == "click", F.lit('{"action": "Answer"}'))
        .when(F.col("event_type") == "signup", F.concat(
            F.lit('{"action":"search","query":" single '), k, F.lit(' "}')))
        .when(F.col("event_type") == "purchase", F.lit('{"action":"search","queries":[]}'))
        .otherwise(F.lit('{"action": broken')))
    return t.load(spark, sf, "events").select(
        F.col("event_id").alias("question_id"), F.lit(2).alias("round"), raw.alias("raw"),
        F.when(F.col("event_id") % 10 == 0, "length").otherwise("stop").alias("finish_reason"))


@query("planner_decisions", """WITH r AS (
    SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, CASE
      WHEN event_id % 10 = 0 THEN NULL
      WHEN event_type = 'view' THEN json_array('kw ' || json_extract_string(props, '$.k'),
        'hyp ' || json_extract_string(props, '$.k'))
      WHEN event_type = 'signup' THEN json_array('single ' || json_extract_string(props, '$.k'))
      END AS q FROM events)
  SELECT event_id AS question_id, CASE WHEN q IS NOT NULL THEN 'SEARCH'
      WHEN event_type = 'click' AND event_id % 10 <> 0 THEN 'ANSWER' ELSE 'UNAVAILABLE' END AS action,
    coalesce(CAST(json_array_length(q) AS INTEGER), 0) AS planned,
    coalesce(json_extract_string(q, '$[0]'), '') AS first_query,
    CASE WHEN json_array_length(q) = 2 THEN 'KEYWORD,HYPOTHETICAL'
         WHEN q IS NOT NULL THEN 'KEYWORD' ELSE '' END AS modes FROM r""")
def planner_decisions(spark, sf):
    parsed = queries.parse_planner_replies(_replies(spark, sf))
    return parsed.select(
        "question_id", "action", F.size("queries").alias("planned"),
        F.coalesce(F.get("queries", F.lit(0))["text"], F.lit("")).alias("first_query"),
        F.array_join(F.transform("queries", lambda q: q["mode"]), ",").alias("modes"))


@query("repeat_queries", """WITH a AS (SELECT user_id AS question_id,
    CAST(event_id AS INTEGER) AS round, 1 AS position,
    upper(event_type) || '  ' || json_extract_string(props, '$.k') || ' ' AS text FROM events)
  SELECT question_id, round, text FROM a QUALIFY row_number() OVER (
    PARTITION BY question_id, lower(text) ORDER BY round) = 1""")
def repeat_queries(spark, sf):
    attempts = t.load(spark, sf, "events").select(
        F.col("user_id").alias("question_id"), F.col("event_id").cast("int").alias("round"),
        F.lit(1).alias("position"), F.concat(F.upper("event_type"), F.lit("  "),
                                             F.get_json_object("props", "$.k"), F.lit(" "))
        .alias("text"))
    return queries.drop_repeats(attempts).select("question_id", "round", "text")


def _bm25(spark, sf, extension=None):
    idx = t.index(spark, sf)
    terms = cut_lineage(queries.query_terms(queries.analyze(t.asked(spark, sf))))
    return t.rounded(sparse.bm25_top(idx.impacts, terms, idx.term_stats, idx.corpus_stats,
                                     idx.chunks, RULES, extension), "score")


_TOP = "SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM "


@query("bm25_topk", f"WITH {sql.POSTINGS}, {sql.QUERY_TERMS}, {sql.bm25()} {_TOP} sparse")
def bm25_topk(spark, sf):
    return _bm25(spark, sf)


@query("bm25_ext_filter",
       f"WITH {sql.POSTINGS}, {sql.QUERY_TERMS}, {sql.bm25('java')} {_TOP} sparse")
def bm25_ext_filter(spark, sf):
    return _bm25(spark, sf, "JAVA")


@query("dense_topk", """WITH longs AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, place FROM (
    SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS place
    FROM embeddings)),
  centers AS (SELECT label AS query_id, place, CAST(avg(v) AS FLOAT) AS v FROM longs GROUP BY 1, 2),
  qv AS (SELECT query_id, list(CAST(v AS DOUBLE) ORDER BY place) AS q FROM centers GROUP BY 1),
  s AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, label, round(
      list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 9) AS score FROM qv, embeddings)
  SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, chunk_id)
    AS rank FROM s WHERE score >= 0.15) WHERE rank <= 50""")
def dense_topk(spark, sf):
    """One query per label: the centre of its vectors, searched over all vectors."""
    vectors = t.load(spark, sf, "embeddings")
    centers = (vectors.select("label", F.posexplode("embedding").alias("place", "v"))
               .groupBy("label", "place").agg(F.avg("v").cast("float").alias("v"))
               .groupBy(F.col("label").alias("query_id"))
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))),
                                lambda p: p["v"]).alias("embedding")))
    corpus = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"),
                            F.col("label").cast("string").alias("file_name"),
                            F.lit("").alias("source_location"), F.lit("vec").alias("extension"),
                            "embedding")
    return t.rounded(dense.dense_top(corpus, centers, RULES), "score")


@query("dense_strategy",
       f"WITH {sql.CHUNKS}, {sql.ANALYZED}, {sql.DENSE} {_TOP} dense WHERE rank <= 8")
def dense_strategy(spark, sf):
    return t.rounded(search(t.index(spark, sf), t.asked(spark, sf), "DENSE", RULES)
                     .drop("reason"), "score")


@query("bm25_strategy", f"""WITH {sql.POSTINGS}, {sql.QUERY_TERMS}, {sql.bm25()},
  kept AS (SELECT s.*, score / max(score) OVER (PARTITION BY query_id) AS share, c.path,
    c.file_name, c.extension, c.content FROM sparse s JOIN chunks c USING (chunk_id)
    QUALIFY rank <= 8), {sql.features('kept')}
  SELECT k.query_id, CAST(rank AS INTEGER) AS rank, k.chunk_id, round(share, 6) AS score,
    CASE WHEN declaration_match THEN 'BM25 代码定义匹配' WHEN metadata_match
    THEN 'BM25 文件元数据匹配' ELSE 'BM25 词法召回' END AS reason
  FROM kept k JOIN features USING (query_id, chunk_id)""")
def bm25_strategy(spark, sf):
    return t.rounded(search(t.index(spark, sf), t.asked(spark, sf), "BM25", RULES,
                            embedder=None), "score")


@query("rrf_fusion", f"WITH {sql.RETRIEVAL}, r AS ({sql.capped('pool', 'pool_rank', 8, 'fusion')})"
                     f" {_TOP} r")
def rrf_fusion(spark, sf):
    return t.rounded(search(t.index(spark, sf), t.asked(spark, sf), "RRF", RULES)
                     .drop("reason"), "score")


def _pool(spark, sf):
    idx = t.index(spark, sf)
    asked = cut_lineage(queries.analyze(t.asked(spark, sf)))
    terms = cut_lineage(queries.query_terms(asked))
    pool = cut_lineage(candidates(idx, asked, terms, query_vectors(asked, dense.hashed_vectors),
                                  RULES, None))
    return idx, asked, terms, pool


@query("lexical_features", f"""WITH {sql.RETRIEVAL}, {sql.features('pool')}
  SELECT query_id, chunk_id, round(feature_value, 6) AS feature_value, concept_matches, exact,
    metadata_match, declaration_match FROM features""")
def lexical_features(spark, sf):
    idx, asked, terms, pool = _pool(spark, sf)
    return t.rounded(fusion.lexical_features(
        pool, asked, terms, idx.postings, idx.term_stats, idx.corpus_stats, idx.chunks).drop("code_file"),
        "feature_value").withColumn("concept_matches", F.col("concept_matches").cast("long"))


@query("hybrid_rerank", f"WITH {sql.HYBRID}, r AS ({sql.capped('reranked', 'local_rank', 8)})"
                        f" {_TOP} r")
def hybrid_rerank(spark, sf):
    return t.rounded(search(t.index(spark, sf), t.asked(spark, sf), "RRF_RERANK", RULES)
                     .drop("reason"), "score")


@query("rerank_merge", f"""WITH {sql.HYBRID}, given AS (
    SELECT *, CASE WHEN pool_rank % 2 = 1 AND query_id % 5 <> 0
      THEN CAST((CAST(chunk_id AS BIGINT) * 37) % 101 AS DOUBLE) / 100 END AS outside FROM reranked)
  SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY
      outside IS NULL, outside DESC, CASE WHEN outside IS NOT NULL THEN pool_rank END, local_rank)
      AS INTEGER) AS rank,
    round(CASE WHEN count(outside) OVER (PARTITION BY query_id) = 0 THEN final
      ELSE coalesce(outside, final * 0.25) END, 6) AS score FROM given""")
def rerank_merge(spark, sf):
    """Outside scores for every other candidate; some queries get none."""
    idx, asked, terms, pool = _pool(spark, sf)
    ranked = rerank_pool(idx, asked, terms, pool)
    outside = ranked.where((F.col("pool_rank") % 2 == 1) & (F.col("query_id") % 5 != 0)).select(
        "query_id", (F.col("pool_rank") - 1).alias("candidate_index"),
        F.col("pool_rank").alias("position"),
        (F.col("chunk_id").cast("long") * 37 % 101 / 100).alias("score"))
    return t.rounded(fusion.merge_external_scores(ranked, outside), "score")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"


@query("jaccard_to_best", f"""WITH {sql.POSTINGS}, {sql.QUERY_TERMS}, {sql.bm25()},
  k AS (SELECT s.query_id, s.chunk_id, s.rank, c.path, {_WORDS.format('c.content')} AS w
        FROM sparse s JOIN chunks c USING (chunk_id)),
  b AS (SELECT * FROM k WHERE rank = 1)
  SELECT k.query_id, k.chunk_id, round(CASE WHEN len(k.w) = 0 OR len(b.w) = 0 THEN 0
    ELSE greatest(len(list_intersect(k.w, b.w)) * 1.0 / len(list_distinct(list_concat(k.w, b.w))),
      CASE WHEN k.path = b.path THEN 0.35 ELSE 0 END) END, 12) AS similarity
  FROM k JOIN b ON k.query_id = b.query_id WHERE k.rank > 1""")
def jaccard_to_best(spark, sf):
    """How close each sparse hit is to its query's best hit."""
    idx = t.index(spark, sf)
    hits = with_chunks(_bm25(spark, sf), idx).select("query_id", "rank", "chunk_id", "path", "content")
    words = hits.withColumn("words", tx.jaccard_terms(F.col("content"))).drop("content")
    best = words.where("rank = 1").select("query_id", F.col("words").alias("best_words"),
                                          F.col("path").alias("best_path"))
    return words.where("rank > 1").join(best, "query_id").select(
        "query_id", "chunk_id", F.round(tx.jaccard(
            F.col("words"), F.col("best_words"), F.col("path") == F.col("best_path")), 12)
        .alias("similarity"))


@query("round_robin_fusion")
def round_robin_fusion(spark, sf):
    return t.rounded(ask.facet_search(t.index(spark, sf), t.questions(spark, sf), RULES), "score")


@query("mmr_select")
def mmr_select(spark, sf):
    idx = t.index(spark, sf)
    ranked = with_chunks(search(idx, t.asked(spark, sf), "RRF_RERANK", SearchRules(limit=32)), idx)
    return t.rounded(context.select_diverse(ranked, 8), "score", "mmr")


@query("neighbours", f"""WITH {sql.CHUNKS} SELECT chunk_id,
    lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM chunks
    WINDOW w AS (PARTITION BY path ORDER BY start_line, end_line, chunk_id)""")
def neighbours(spark, sf):
    return context.with_neighbours(t.corpus(spark, sf)).select(
        "chunk_id", F.col("previous.chunk_id").alias("previous_id"),
        F.col("next.chunk_id").alias("next_id"))


@query("context_search")
def context_search(spark, sf):
    return t.rounded(ask.context_search(t.index(spark, sf), t.questions(spark, sf)), "score").drop(
        "modified_at")


@query("neighbour_expand", f"""WITH {sql.HYBRID}, r AS ({sql.capped('reranked', 'local_rank', 8)}),
  fam AS (SELECT chunk_id, path, content, start_line, end_line, source_location,
      lag(chunk_id) OVER w AS pid, lag(content) OVER w AS pc, lag(end_line) OVER w AS pe,
      lag(start_line) OVER w AS ps, lag(source_location) OVER w AS pl,
      lead(content) OVER w AS nc, lead(start_line) OVER w AS ns, lead(end_line) OVER w AS ne,
      lead(source_location) OVER w AS nl FROM chunks
      WINDOW w AS (PARTITION BY path ORDER BY start_line, end_line, chunk_id)),
  one AS (SELECT r.query_id, r.rank, f.*, coalesce(pe < start_line
      AND length(content) + length(pc) + 2 <= 2800, false) AS takes_before
      FROM r JOIN fam f USING (chunk_id)),
  two AS (SELECT *, coalesce(ns > end_line AND length(content) + CASE WHEN takes_before
      THEN length(pc) + 2 ELSE 0 END + length(nc) + 2 <= 2800, false) AS takes_after FROM one)
  SELECT query_id, CAST(rank AS INTEGER) AS pick, CASE WHEN takes_before THEN ps ELSE start_line
      END AS start_line, CASE WHEN takes_after THEN ne ELSE end_line END AS end_line,
    length(CASE WHEN takes_before THEN pc || chr(10) || chr(10) ELSE '' END || content ||
      CASE WHEN takes_after THEN chr(10) || chr(10) || nc ELSE '' END) AS chars,
    CASE WHEN takes_before THEN pl ELSE source_location END AS first_location
  FROM two""")
def neighbour_expand(spark, sf):
    """Expansion of every hit on its own, before consumed hits are dropped."""
    idx = t.index(spark, sf)
    hits = cut_lineage(search(idx, t.asked(spark, sf), "RRF_RERANK", RULES))
    alone = hits.select(F.concat_ws("#", "query_id", "rank").alias("query_id"),
                        F.lit(1).alias("pick"), "chunk_id", "score", "reason")
    grown = context.expand_neighbours(alone, idx.chunks)
    parts = F.split("query_id", "#")
    return grown.select(
        parts[0].cast("long").alias("query_id"), parts[1].cast("int").alias("pick"),
        "start_line", "end_line", F.length("content").cast("long").alias("chars"),
        F.split("source_location", " — ")[0].alias("first_location"))


@query("evidence_rounds")
def evidence_rounds(spark, sf):
    """Conversations as questions, with planned follow-ups made from their assistant turns."""
    turns = t.load(spark, sf, "conversations")
    replies = turns.where("role = 'assistant'").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
        .alias("question_id"), F.lit(2).alias("round"),
        F.to_json(F.struct(F.lit("search").alias("action"), F.array("text")
                           .alias("queries"))).alias("raw"), F.lit("stop").alias("finish_reason"))
    return t.rounded(ask.collect_evidence(t.index(spark, sf), turns, replies,
                                          rules=EvidenceRules()), "score")


_CITED = f"""{sql.HYBRID}, r AS ({sql.capped('reranked', 'local_rank', 8)}),
  cited AS (SELECT r.query_id AS question_id, CAST(r.rank AS INTEGER) AS number, c.path, c.source_location,
    c.content, round(r.score, 6) AS score, c.start_line, c.end_line, c.chunk_id
    FROM r JOIN chunks c USING (chunk_id))"""


def _citations(spark, sf):
    idx = t.index(spark, sf)
    hits = search(idx, t.asked(spark, sf), "RRF_RERANK", RULES)
    return t.rounded(with_chunks(hits, idx), "score").withColumnRenamed(
        "query_id", "question_id").withColumnRenamed("rank", "number")


@query("context_pack", f"""WITH {_CITED}, sized AS (SELECT question_id, number, sum(
    length('--- SOURCE [' || number || '] BEGIN ---') + 1 + length(chr(10) || '文件路径：') +
    length(path) + length(chr(10) || '来源位置：') + length(source_location) +
    length(chr(10) || '内容：' || chr(10)) + least(length(content), 1600) +
    CASE WHEN length(content) > 1600 THEN 1 + length('...[chunk truncated]') ELSE 0 END +
    length(chr(10) || '--- SOURCE [' || number || '] END ---' || chr(10)))
    OVER (PARTITION BY question_id ORDER BY number) AS used_chars FROM cited)
  SELECT question_id, number, CAST(used_chars AS BIGINT) AS used_chars FROM sized
  WHERE used_chars <= 6000""")
def context_pack(spark, sf):
    return context.pack_context(_citations(spark, sf), budget=6000).select(
        "question_id", "number", F.col("used_chars").cast("long").alias("used_chars"))


@query("evidence_digest", f"""WITH {_CITED}, one AS (SELECT *, {sql.strip(
    "regexp_replace(content, '\\s+', ' ', 'g')")} AS flat FROM cited),
  lines AS (SELECT question_id, number, '[' || number || '] ' || path || ' · ' || source_location
    || ' (relevance ' || printf('%.2f', score) || ')' || chr(10) || '    ' ||
    CASE WHEN length(flat) <= 320 THEN flat ELSE substr(flat, 1, 320) || ' …' END || chr(10)
    AS line FROM one)
  SELECT question_id, number, line FROM lines QUALIFY sum(length(line)) OVER (
    PARTITION BY question_id ORDER BY number) <= 2000""")
def evidence_digest(spark, sf):
    return context.digest(_citations(spark, sf), budget=2000).select(
        "question_id", "number", "line")


@query("citation_location", f"""WITH {_CITED} SELECT question_id, number,
    CAST(CASE WHEN strpos(d.text, {sql.strip('cited.content')}) > 0
    THEN strpos(d.text, {sql.strip('cited.content')}) - 1 END AS INTEGER) AS start
  FROM cited JOIN documents d ON CAST(d.doc_id AS VARCHAR) = cited.chunk_id""")
def citation_location(spark, sf):
    """Each citation found again in its own document."""
    cited = _citations(spark, sf).drop("path").withColumn("path", F.col("chunk_id"))
    docs = t.load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"),
                                                 "text")
    return context.locate_in_document(cited, docs).select(
        "question_id", "number", F.col("start").cast("int").alias("start"))


@query("citation_markers", """WITH answers AS (SELECT conv_id AS question_id,
    text || ' [' || turn || '] [x] [' || (turn + 2) || '](link)' AS text FROM conversations
    WHERE role = 'assistant'),
  marks AS (SELECT question_id, CAST(unnest(regexp_extract_all(regexp_replace(text,
    '\\[\\d+\\]\\(', '', 'g'), '\\[(\\d+)\\]', 1)) AS INTEGER) AS number FROM answers),
  uses AS (SELECT question_id, number, count(*) AS uses FROM marks WHERE number > 0 GROUP BY 1, 2),
  cited AS (SELECT conv_id AS question_id, CAST(turn AS INTEGER) AS number FROM conversations
            WHERE role = 'user' AND turn > 0)
  SELECT question_id, number, coalesce(uses, 0) AS uses, CASE WHEN c.number IS NULL
    THEN 'dangling' WHEN u.number IS NULL THEN 'uncited' ELSE 'valid' END AS state
  FROM uses u FULL JOIN cited c USING (question_id, number)""")
def citation_markers(spark, sf):
    turns = t.load(spark, sf, "conversations")
    number = F.col("turn").cast("string")
    answers = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("question_id"), F.concat(
            "text", F.lit(" ["), number, F.lit("] [x] ["), (F.col("turn") + 2).cast("string"),
            F.lit("](link)")).alias("text"))
    cited = turns.where("role = 'user' AND turn > 0").select(
        F.col("conv_id").alias("question_id"), F.col("turn").cast("int").alias("number"))
    return context.citation_markers(answers, cited)


@query("abstentions", """SELECT conv_id AS question_id,
    count(*) FILTER (WHERE role = 'assistant') AS evidence,
    count(*) FILTER (WHERE role = 'assistant') = 0 AS abstain,
    count(*) FILTER (WHERE role = 'system') > 0 AS planner_unavailable
  FROM conversations GROUP BY conv_id""")
def abstentions(spark, sf):
    turns = t.load(spark, sf, "conversations").withColumnRenamed("conv_id", "question_id")
    return context.abstentions(turns.select("question_id").distinct(),
                               turns.where("role = 'assistant'"), turns.where("role = 'system'"))


@query("semantic_highlights")
def semantic_highlights(spark, sf):
    idx = t.index(spark, sf)
    asked = queries.analyze(t.asked(spark, sf))
    hits = with_chunks(search(idx, t.asked(spark, sf), "RRF_RERANK", RULES), idx)
    return t.rounded(highlights.highlights(hits, query_vectors(asked, dense.hashed_vectors)),
                     "similarity")


@query("embedding_job", f"""WITH {sql.CHUNKS}, txt AS (SELECT chunk_id, file_name || chr(10) ||
    source_location || chr(10) || content AS t FROM chunks),
  v AS ({sql.hashed('txt', 'chunk_id', 't')})
  SELECT chunk_id, CAST(sum(abs(v)) AS BIGINT) AS mass, CAST(sum(v * place) AS BIGINT) AS moment
  FROM v GROUP BY chunk_id""")
def embedding_job(spark, sf):
    vectors = dense.embed_new(t.corpus(spark, sf), None)
    return (vectors.select("chunk_id", F.posexplode("embedding").alias("place", "v"))
            .groupBy("chunk_id").agg(F.sum(F.abs("v")).cast("long").alias("mass"),
                                     F.sum(F.col("v") * F.col("place")).cast("long")
                                     .alias("moment")))


_CASES = """
  found AS (SELECT DISTINCT b.item_id, c.file_name FROM benchmark b JOIN chunks c
            ON contains(c.content, b.text)),
  cases AS (SELECT item_id AS case_id, text AS query, CASE WHEN length(text) < 200 THEN 'short'
      ELSE 'long' END AS category, lower(text) AS passage,
      (item_id % 7) || '.md' AS banned, (item_id % 11) || '.py' AS hard,
      (SELECT count(*) FROM found f WHERE f.item_id = b.item_id) AS expected FROM benchmark b)"""


def _metrics(hits: str) -> str:
    """Metrics over hits(case_id, rank, file_name, content)."""
    gain = "(pow(2, rel) - 1) / log2(doc_rank + 1)"
    return f"""{_CASES},
  ranked AS (SELECT case_id, file_name, min(rank) AS r, arg_min(content, rank) AS content
             FROM {hits} WHERE rank <= 20 GROUP BY 1, 2),
  docs AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY r) AS doc_rank FROM ranked),
  judged AS (SELECT d.*, c.banned, c.hard, f.file_name IS NOT NULL AS good,
      CASE WHEN f.file_name IS NULL THEN 0 WHEN contains(lower(d.content), c.passage) THEN 2
      ELSE 1 END AS rel FROM docs d JOIN cases c USING (case_id)
      LEFT JOIN found f ON f.item_id = d.case_id AND f.file_name = d.file_name),
  agg AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE good AND doc_rank <= 5) AS h5,
      count(*) FILTER (WHERE good AND doc_rank <= 20) AS h20,
      min(doc_rank) FILTER (WHERE good) AS pos, min(doc_rank) FILTER (WHERE file_name = hard) AS neg,
      bool_or(file_name = banned AND doc_rank <= 10) AS forbidden,
      sum({gain}) FILTER (WHERE doc_rank <= 10) AS dcg FROM judged GROUP BY 1),
  shown AS (SELECT case_id, count(*) AS returned FROM {hits} WHERE rank <= 20 GROUP BY 1),
  ideal AS (SELECT case_id, 3.0 + coalesce((SELECT sum(1 / log2(i + 1)) FROM
      generate_series(2, least(10, expected)) g(i)), 0) AS idcg FROM cases),
  metrics AS (SELECT c.case_id, c.category, c.expected > 0 AS answerable,
      CASE WHEN c.expected = 0 THEN (coalesce(n, 0) = 0)::INT::DOUBLE
        ELSE coalesce(h5, 0) * 1.0 / c.expected END AS recall5,
      CASE WHEN c.expected = 0 THEN (coalesce(n, 0) = 0)::INT::DOUBLE
        ELSE coalesce(h20, 0) * 1.0 / c.expected END AS recall20,
      CASE WHEN c.expected = 0 THEN (coalesce(n, 0) = 0)::INT::DOUBLE
        ELSE (coalesce(h5, 0) > 0)::INT::DOUBLE END AS hit5,
      CASE WHEN c.expected = 0 THEN (coalesce(n, 0) = 0)::INT::DOUBLE
        WHEN coalesce(n, 0) = 0 THEN 0 ELSE h5 * 1.0 / least(5, n) END AS precision5,
      CASE WHEN pos <= 10 THEN 1.0 / pos ELSE 0 END AS mrr10,
      CASE WHEN c.expected = 0 THEN (coalesce(n, 0) = 0)::INT::DOUBLE
        ELSE least(1.0, coalesce(dcg, 0) / idcg) END AS ndcg10,
      coalesce(forbidden, false) AS forbidden,
      coalesce(neg IS NOT NULL AND (pos IS NULL OR neg < pos), false) AS hard_negative_first,
      CASE WHEN returned IS NULL THEN 1.0 ELSE least(10, n) * 1.0 / least(10, returned) END
        AS unique_documents10
    FROM cases c JOIN ideal USING (case_id) LEFT JOIN agg USING (case_id)
    LEFT JOIN shown USING (case_id))"""


_EVAL = f"""{sql.hybrid(20)}, r AS ({sql.capped('reranked', 'local_rank', 20)}),
  hits AS (SELECT r.query_id AS case_id, r.rank, c.file_name, c.content
           FROM r JOIN chunks c USING (chunk_id)), {_metrics('hits')}"""
_ROUNDED = ", ".join(f"round({m}, 9) AS {m}" for m in evaluation.METRICS)
_AVERAGED = ", ".join(f"round(avg({m}), 9) AS {m}" for m in evaluation.METRICS)
_REPORT = f"""SELECT coalesce(category, 'ALL') AS category, count(*) AS cases, {_AVERAGED},
  count(*) FILTER (WHERE forbidden) AS forbidden,
  count(*) FILTER (WHERE hard_negative_first) AS hard_negative_first
  FROM metrics GROUP BY GROUPING SETS ((), (category))"""


def _evaluated(spark, sf):
    return evaluate.evaluate(t.index(spark, sf), t.cases(spark, sf))


@query("eval_case_metrics", f"WITH {_EVAL} SELECT case_id, category, answerable, {_ROUNDED},"
                            " forbidden, hard_negative_first FROM metrics")
def eval_case_metrics(spark, sf):
    return t.rounded(_evaluated(spark, sf).drop("split"), *evaluation.METRICS, digits=9)


@query("eval_report", f"WITH {_EVAL} {_REPORT}")
def eval_report(spark, sf):
    return t.rounded(evaluation.report(_evaluated(spark, sf)), *evaluation.METRICS, digits=9)


GATE = {"min_recall5": 0.90, "min_mrr10": 0.85, "min_ndcg10": 0.80, "min_hit5": 0.90,
        "min_recall20": 0.98}


@query("eval_gate", f"""WITH {_EVAL} SELECT concat_ws(',',
    CASE WHEN avg(recall5) < 0.90 THEN 'Recall@5' END,
    CASE WHEN avg(recall20) < 0.98 THEN 'Recall@20' END,
    CASE WHEN avg(hit5) < 0.90 THEN 'HitRate@5' END,
    CASE WHEN avg(mrr10) < 0.85 THEN 'MRR@10' END,
    CASE WHEN avg(ndcg10) < 0.80 THEN 'nDCG@10' END,
    CASE WHEN bool_or(forbidden) THEN 'mustNotReturn' END,
    CASE WHEN bool_or(hard_negative_first) THEN 'hardNegativeOutrankedPositive' END) AS failed
  FROM metrics""")
def eval_gate(spark, sf):
    return evaluation.failed_gates(evaluation.report(_evaluated(spark, sf)), GATE).select(
        F.array_join("failed", ",").alias("failed"))


@query("ablation")
def ablation(spark, sf):
    return t.rounded(evaluate.ablate(t.index(spark, sf), t.cases(spark, sf)), *evaluation.METRICS, digits=9)


@query("latency_percentiles", """SELECT event_type, quantile_disc(value, 0.5) AS p50,
  quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return evaluation.latency_percentiles(t.load(spark, sf, "events"), ["event_type"], "value")


@query("memory_estimate", f"""WITH {sql.CHUNKS} SELECT round(sum(2 * length(content) +
  2 * length(chunk_id) + 2 * length(path) + 64 + 256) * 1000.0 / count(*), 6) AS bytes_per_thousand
  FROM chunks""")
def memory_estimate(spark, sf):
    return t.rounded(evaluation.memory_per_thousand(t.index(spark, sf).chunks),
                     "bytes_per_thousand")
