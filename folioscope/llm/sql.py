"""DuckDB SQL for the queries that SQL can express."""

#: Words as the contract takes them.
WORDS = ("regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
         " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b
             WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes
             WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS last, count(*) AS n FROM p
      WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN n > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND payload_bytes >= 1000
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs
      FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
k AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN l ON c.lang = l.lang AND c.term = l.term),
lt AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
gt AS (SELECT g.lang, g.source, coalesce(sum(k.n), 0) AS total
       FROM g LEFT JOIN k ON g.lang = k.lang AND g.source = k.source GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, l.term, coalesce(k.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(k.n, 0)::HUGEINT + 1)) // (gt.total + lt.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (l.n::HUGEINT + 1)) // (lt.total + lt.v)::HUGEINT AS q
      FROM gt JOIN l ON gt.lang = l.lang JOIN lt ON gt.lang = lt.lang
      LEFT JOIN k ON k.lang = gt.lang AND k.source = gt.source AND k.term = l.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 200
"""

SQL = {"op7_warc": OP7, "op10_decontaminate": OP10, "op12_divergence": OP12}
