"""SQL for DuckDB that states the same results, written from the rules and not from the plans."""

from __future__ import annotations

from folioscope.functions import fixed

STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)


def norm(x: str) -> str:
    camel = (f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),"
             " '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')")
    return f"replace(lower({camel}), chr(92), '/')"


def plain_norm(x: str) -> str:
    return f"replace(lower({x}), chr(92), '/')"


CONCEPTS = ", ".join(
    f"('concept:{name}', '{phrase.replace(' ', '')}')"
    for name, phrases in fixed.CONCEPTS.items() for phrase in phrases)


def terms(source: str, key: str, text: str, query: bool) -> str:
    latin, concept = (1.25, 4.0) if query else (1.0, 2.8)
    return f"""
      SELECT {key}, term, sum(w) AS weight FROM (
        SELECT {key}, unnest(regexp_extract_all({norm(text)}, '[a-z0-9]{{2,}}')) AS term,
               CAST({latin} AS DOUBLE) AS w FROM {source}
        UNION ALL
        SELECT DISTINCT {key}, c.name AS term, CAST({concept} AS DOUBLE) AS w
        FROM (SELECT {key}, regexp_replace({norm(text)}, '\\s+', '', 'g') AS compact FROM {source})
        JOIN (VALUES {CONCEPTS}) AS c(name, phrase) ON contains(compact, c.phrase))
      WHERE term NOT IN ({STOP}) GROUP BY {key}, term"""


CHUNKS = """
  named AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, text AS content,
      CASE (doc_id // 10) % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'py' WHEN 2 THEN 'java'
           WHEN 3 THEN 'txt' ELSE 'html' END AS extension,
      CAST(doc_id % 10 * 1000 + 1 AS INTEGER) AS start_line,
      CAST(doc_id % 10 * 1000 + 1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER)
        AS end_line
    FROM documents),
  chunks AS (
    SELECT doc_id, chunk_id, content, extension, start_line, end_line,
      (doc_id // 10) || '.' || extension AS file_name,
      '/corpus/' || (doc_id // 1000) || '/' || (doc_id // 10) || '.' || extension AS path,
      'L' || start_line || CASE WHEN end_line = start_line THEN '' ELSE '-' || end_line END
        AS source_location
    FROM named)"""

POSTINGS = CHUNKS + f""",
  indexed AS (SELECT chunk_id, file_name || chr(10) || source_location || chr(10) || content AS t
              FROM chunks),
  postings AS ({terms('indexed', 'chunk_id', 't', False)}),
  df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  lengths AS (SELECT c.chunk_id, greatest(1.0, coalesce(sum(weight), 0)) AS len
              FROM chunks c LEFT JOIN postings p USING (chunk_id) GROUP BY c.chunk_id),
  stats AS (SELECT count(*) AS n, greatest(1.0, avg(len)) AS avg_len FROM lengths)"""


def _subject(x: str) -> str:
    framed = f"regexp_replace({x}, '{fixed.BOILERPLATE_PATTERN}', ' ', 'g')"
    plain = f"regexp_replace({framed}, '{fixed.QUERY_PUNCTUATION_PATTERN}', ' ', 'g')"
    one = f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"
    bare = f"regexp_replace({one}, '{fixed.SUBJECT_NOISE_PATTERN}', ' ', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


ANALYZED = f"""
  cleaned AS (SELECT item_id AS query_id, {strip('text')} AS text FROM benchmark),
  framed AS (SELECT *, {_subject('text')} AS bare FROM cleaned),
  analyzed AS (
    SELECT query_id, text, CASE WHEN bare = '' THEN text ELSE bare END AS subject,
      {plain_norm("CASE WHEN bare = '' THEN text ELSE bare END")} AS normalized,
      regexp_matches(text, '{fixed.CODE_INTENT_PATTERN}') AS code_intent,
      regexp_matches(text, '{fixed.LOCATION_INTENT_PATTERN}') AS location_intent
    FROM framed WHERE text <> '')"""

QUERY_TERMS = ANALYZED + f""",
  query_terms AS ({terms('analyzed', 'query_id', 'subject', True)})"""


def bm25(extension: str | None = None) -> str:
    keep = "" if extension is None else f"WHERE lower(c.extension) = '{extension}'"
    return f"""
  bm25_scores AS (
    SELECT q.query_id, p.chunk_id, round(sum(
      ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.weight * 2.5
      / (p.weight + 1.5 * (0.25 + 0.75 * l.len / s.avg_len))
      * least(3.0, greatest(0.25, q.weight))), 9) AS score
    FROM query_terms q JOIN df d USING (term) JOIN postings p USING (term)
    JOIN lengths l USING (chunk_id) CROSS JOIN stats s GROUP BY q.query_id, p.chunk_id),
  sparse AS (
    SELECT query_id, chunk_id, score, rank FROM (
      SELECT b.query_id, b.chunk_id, b.score, row_number() OVER (PARTITION BY b.query_id
        ORDER BY b.score DESC, c.file_name, c.source_location, c.chunk_id) AS rank
      FROM bm25_scores b JOIN chunks c USING (chunk_id) {keep}) WHERE rank <= 50)"""


def hashed(source: str, key: str, text: str) -> str:
    """Vectors in long form: (key, place, v)."""
    return f"""
      SELECT {key}, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS place,
        sum(CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1.0 ELSE -1.0 END) AS v
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}')) AS word
            FROM {source}) GROUP BY 1, 2"""


DENSE = f"""
  chunk_vec AS ({hashed('chunks', 'chunk_id', 'content')}),
  query_vec AS ({hashed('analyzed', 'query_id', 'subject')}),
  chunk_norm AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM chunk_vec GROUP BY 1),
  query_norm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM query_vec GROUP BY 1),
  dense_scores AS (
    SELECT q.query_id, c.chunk_id, round(sum(q.v * c.v) / max(qn.n * cn.n), 9) AS score
    FROM query_vec q JOIN chunk_vec c USING (place) JOIN query_norm qn USING (query_id)
    JOIN chunk_norm cn USING (chunk_id) WHERE qn.n > 0 AND cn.n > 0 GROUP BY 1, 2),
  dense AS (
    SELECT query_id, chunk_id, score, rank FROM (
      SELECT d.query_id, d.chunk_id, d.score, row_number() OVER (PARTITION BY d.query_id
        ORDER BY d.score DESC, c.file_name, c.source_location, c.chunk_id) AS rank
      FROM dense_scores d JOIN chunks c USING (chunk_id) WHERE d.score >= 0.15)
    WHERE rank <= 50)"""

FUSED = """
  both_branches AS (
    SELECT query_id, chunk_id, rank, score AS bm25, 0.0 AS dense, rank AS inserted FROM sparse
    UNION ALL
    SELECT query_id, chunk_id, rank, 0.0, score, 1000000 + rank FROM dense),
  summed AS (
    SELECT query_id, chunk_id, max(bm25) AS bm25, max(dense) AS dense,
      round(sum(1.0 / (60.0 + rank)), 12) AS rrf, min(inserted) AS inserted
    FROM both_branches GROUP BY 1, 2),
  fused AS (
    SELECT query_id, chunk_id, inserted, greatest(0, least(1, dense)) AS dense,
      CASE WHEN max(bm25) OVER w <= 0 THEN 0 ELSE bm25 / max(bm25) OVER w END AS bm25,
      CASE WHEN max(rrf) OVER w <= 0 THEN 0 ELSE rrf / max(rrf) OVER w END AS fusion
    FROM summed WINDOW w AS (PARTITION BY query_id)),
  pool AS (
    SELECT * FROM (
      SELECT f.*, c.path, c.file_name, c.source_location, c.extension, c.content,
        row_number() OVER (PARTITION BY f.query_id
          ORDER BY f.fusion DESC, c.file_name, f.inserted) AS pool_rank
      FROM fused f JOIN chunks c USING (chunk_id)) WHERE pool_rank <= 32)"""


def features(candidates: str) -> str:
    content, name, path = (plain_norm(f"k.{c}") for c in ("content", "file_name", "path"))
    word = "NOT starts_with(q.term, 'concept:')"
    declared = " OR ".join(
        f"contains({content}, '{w} ' || q.term)"
        for w in ("class", "interface", "record", "enum", "def", "function"))
    codes = ", ".join(f"'{e}'" for e in fixed.CODE_EXTENSIONS)
    return f"""
  doc_tfidf AS (
    SELECT p.chunk_id, p.term,
      (1 + ln(greatest(1.0, p.weight))) * ln(1 + (s.n + 1.0) / (d.df + 1.0)) AS v
    FROM postings p JOIN df d USING (term) CROSS JOIN stats s),
  doc_norm AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM doc_tfidf GROUP BY 1),
  query_tfidf AS (
    SELECT q.query_id, q.term, (1 + ln(greatest(1.0, q.weight)))
      * ln(1 + (s.n + 1.0) / (coalesce(d.df, 0) + 1.0)) AS v
    FROM query_terms q LEFT JOIN df d USING (term) CROSS JOIN stats s),
  query_tfidf_norm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM query_tfidf GROUP BY 1),
  per_term AS (
    SELECT k.query_id, k.chunk_id, sum(q.v * t.v) AS dot,
      count(*) FILTER (WHERE NOT ({word}) AND t.term IS NOT NULL) AS concept_matches,
      count(*) FILTER (WHERE {word} AND contains({name}, q.term)) AS name_matches,
      count(*) FILTER (WHERE {word} AND contains({path}, q.term)) AS path_matches,
      count(*) FILTER (WHERE {word} AND length(q.term) >= 3 AND ({declared}
        OR contains({content}, ' ' || q.term || '(') OR starts_with({content}, q.term || '(')))
        AS declarations
    FROM {candidates} k JOIN query_tfidf q USING (query_id)
    LEFT JOIN doc_tfidf t ON t.chunk_id = k.chunk_id AND t.term = q.term GROUP BY 1, 2),
  features AS (
    SELECT k.query_id, k.chunk_id, a.code_intent OR a.location_intent AS metadata_focused,
      coalesce(name_matches, 0) + coalesce(path_matches, 0) > 0 AS metadata_match,
      coalesce(declarations, 0) > 0 AS declaration_match,
      coalesce(concept_matches, 0) AS concept_matches,
      contains({content}, a.normalized) AS exact,
      round(0.74 * coalesce(dot / nullif(qn.n * dn.n, 0), 0)
        + CASE WHEN contains({content}, a.normalized) THEN 0.24 ELSE 0 END
        + coalesce(name_matches, 0) * CASE WHEN a.code_intent OR a.location_intent
            THEN 0.09 ELSE 0.035 END
        + least(0.18, coalesce(path_matches, 0) * CASE WHEN a.location_intent THEN 0.055
            ELSE 0.02 END)
        + least(0.30, coalesce(concept_matches, 0) * 0.10)
        + CASE WHEN a.code_intent AND k.extension IN ({codes}) THEN 0.09 ELSE 0 END
        + least(0.32, coalesce(declarations, 0) * 0.16), 12) AS feature_value
    FROM {candidates} k JOIN analyzed a USING (query_id)
    LEFT JOIN per_term USING (query_id, chunk_id)
    LEFT JOIN query_tfidf_norm qn USING (query_id) LEFT JOIN doc_norm dn ON dn.chunk_id = k.chunk_id)"""


RERANKED = """
  mixed AS (
    SELECT p.*, f.metadata_focused,
      CASE WHEN f.feature_value <= 0 THEN 0 ELSE 1 - exp(-f.feature_value) END AS feature
    FROM pool p JOIN features f USING (query_id, chunk_id)),
  scored AS (
    SELECT *, round(greatest(0, least(1, CASE WHEN metadata_focused
      THEN 0.35 * fusion + 0.20 * bm25 + 0.10 * dense + 0.35 * feature
      ELSE 0.40 * fusion + 0.20 * bm25 + 0.25 * dense + 0.15 * feature END)), 9) AS final
    FROM mixed),
  reranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY final DESC, file_name, source_location, pool_rank) AS local_rank FROM scored)"""


def capped(source: str, order: str, limit: int, score: str = "final") -> str:
    return f"""
      SELECT query_id, chunk_id, {score} AS score, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY {order}) AS INTEGER) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY {order}) AS nth
            FROM {source}) WHERE nth <= 3
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) <= {limit}"""


RETRIEVAL = ", ".join([POSTINGS, QUERY_TERMS, bm25(), DENSE, FUSED])


def hybrid(limit: int = 8) -> str:
    pool = max(20, limit * 4)
    return (", ".join([RETRIEVAL, features("pool"), RERANKED])
            .replace("pool_rank <= 32", f"pool_rank <= {pool}")
            .replace("rank <= 50", f"rank <= {max(50, limit * 4)}"))


HYBRID = hybrid()
