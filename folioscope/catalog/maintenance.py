"""Registered queries: sources, chunking, index maintenance, conversations, streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import tables as t
from folioscope.config import HistoryRules, ScanRules
from folioscope.functions import fixed
from folioscope.operators import chunking, conversations, indexing, lifecycle
from folioscope.session import fresh_folder, spread
from folioscope.sources import decode, html, scan
from folioscope.plans import rebuild
from folioscope.sources.snapshot import file_system, hadoop_path
from folioscope.streaming import deltas, diagnostics, freshness, incremental, segments

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle is not None:
            SQL[name] = oracle
        return function
    return keep


# --- sources ---------------------------------------------------------------------------------

@query("line_units", """SELECT doc_id, CAST(pos AS INTEGER) AS number,
    md5(regexp_replace(line, '\\s+$', '')) AS line_hash FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""")
def line_units(spark, sf):
    units = t.load(spark, sf, "documents").withColumn("units", chunking.line_units(F.col("text")))
    return units.select("doc_id", F.inline_outer("units")).select(
        "doc_id", "number", F.md5("text").alias("line_hash"))


@query("binary_sniff", """WITH d AS (SELECT doc_id, substr(repeat(chr(1), CAST(doc_id % 200 AS INTEGER))
    || text, 1, 2048) AS head FROM documents)
  SELECT doc_id, length(head) - length(regexp_replace(head, '[\\x01-\\x08\\x0E-\\x1F]', '', 'g'))
    > length(head) // 20 AS is_binary FROM d""")
def binary_sniff(spark, sf):
    noisy = F.concat(F.repeat(F.lit("\u0001"), (F.col("doc_id") % 200).cast("int")), "text")
    return t.load(spark, sf, "documents").select(
        "doc_id", decode.looks_binary(noisy).alias("is_binary"))


@query("text_decode", """SELECT doc_id, md5(text) AS text_hash FROM documents""")
def text_decode(spark, sf):
    """Every document encoded in one of three ways, and decoded again."""
    kind = F.col("doc_id") % 3
    content = (F.when(kind == 0, F.encode("text", "UTF-8"))
               .when(kind == 1, F.concat(F.to_binary(F.lit("EFBBBF"), F.lit("hex")),
                                         F.encode("text", "UTF-8")))
               .otherwise(F.concat(F.to_binary(F.lit("FFFE"), F.lit("hex")),
                                   F.encode("text", "UTF-16LE"))))
    return t.load(spark, sf, "documents").select(
        "doc_id", F.md5(decode.decoded(content)).alias("text_hash"))


_TAIL = """CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.HTML' WHEN 3 THEN '.png'
  WHEN 4 THEN '.key' WHEN 5 THEN '' WHEN 6 THEN '.tar.gz' ELSE '/.env.local' END"""
_FOLDER = """CASE (doc_id // 8) % 8 WHEN 0 THEN 'src' WHEN 1 THEN 'docs/a' WHEN 2 THEN
  'Node_Modules/x' WHEN 3 THEN '.ssh' WHEN 4 THEN 'src/deep' WHEN 5 THEN 'build' WHEN 6 THEN 'lib'
  ELSE 'docs/b/c' END"""
_FILES = f"""files AS (SELECT *, '/' || source AS root, {_FOLDER} || '/' || doc_id || '/' ||
    CASE WHEN doc_id % 8 = 5 THEN 'Makefile' ELSE CAST(doc_id AS VARCHAR) END || {_TAIL} AS rel_path,
    n_chars * 200 AS size, doc_id * 1000 AS modified_at FROM documents),
  verdicts AS (SELECT *, root || '/' || rel_path AS path, CASE
    WHEN (doc_id // 8) % 8 IN (2, 5) THEN 'IGNORED'
    WHEN (doc_id // 8) % 8 = 3 THEN 'SENSITIVE_DIRECTORY'
    WHEN doc_id % 8 IN (4, 7) THEN 'SENSITIVE' WHEN doc_id % 8 IN (3, 6) THEN 'UNSUPPORTED'
    WHEN size > CASE WHEN doc_id % 8 = 2 THEN 5242880 ELSE 2097152 END THEN 'OVERSIZED'
    ELSE 'ACCEPTED' END AS verdict FROM files)"""


def _classified(spark, sf):
    return scan.classify(t.files(spark, sf), scan.reader_registry(spark))


@query("reader_routing", f"""WITH {_FILES} SELECT path, CASE WHEN doc_id % 8 = 2
    THEN 'html-main-content' WHEN doc_id % 8 IN (0, 1, 5) THEN 'plain-text' END AS reader_id
  FROM verdicts""")
def reader_routing(spark, sf):
    return scan.route_readers(t.files(spark, sf), scan.reader_registry(spark)).select(
        "path", "reader_id")


@query("scan_verdicts", f"WITH {_FILES} SELECT path, verdict FROM verdicts")
def scan_verdicts(spark, sf):
    return _classified(spark, sf).select("path", "verdict")


BUDGET = ScanRules(max_total_bytes=20_000_000)


@query("scan_budget", f"""WITH {_FILES} SELECT path, size FROM verdicts WHERE verdict = 'ACCEPTED'
  QUALIFY sum(size) OVER (ORDER BY root, path) <= 20000000""")
def scan_budget(spark, sf):
    accepted = _classified(spark, sf).where("verdict = 'ACCEPTED'")
    return scan.within_budget(accepted, BUDGET).select("path", "size")


@query("scan_budget_ranges", f"""WITH {_FILES} SELECT path, size FROM verdicts
  WHERE verdict = 'ACCEPTED' QUALIFY sum(size) OVER (ORDER BY root, path) <= 20000000""")
def scan_budget_ranges(spark, sf):
    """The same prefix with few ranges."""
    accepted = _classified(spark, sf).where("verdict = 'ACCEPTED'")
    return scan.within_budget(accepted, BUDGET, partitions=8).select(
        "path", "size")


@query("unsupported_summary", f"""WITH {_FILES} SELECT count(*) AS total,
    2 AS kinds, '跳过 ' || count(*) || ' 个不支持格式的文件（' || CASE
      WHEN count(*) FILTER (WHERE doc_id % 8 = 6) > count(*) FILTER (WHERE doc_id % 8 = 3)
      THEN 'gz ' || count(*) FILTER (WHERE doc_id % 8 = 6) || '、png ' || count(*) FILTER (WHERE doc_id % 8 = 3)
      WHEN count(*) FILTER (WHERE doc_id % 8 = 6) = count(*) FILTER (WHERE doc_id % 8 = 3)
      THEN 'gz ' || count(*) FILTER (WHERE doc_id % 8 = 6) || '、png ' || count(*) FILTER (WHERE doc_id % 8 = 3)
      ELSE 'png ' || count(*) FILTER (WHERE doc_id % 8 = 3) || '、gz ' || count(*) FILTER (WHERE doc_id % 8 = 6) END
    || '）' AS message FROM verdicts WHERE verdict = 'UNSUPPORTED'""")
def unsupported_summary(spark, sf):
    return scan.unsupported_summary(_classified(spark, sf))


@query("scan_warnings", f"""WITH {_FILES} SELECT reader_id, skipped, count(*) AS warnings FROM (
    SELECT 'sensitive-file' AS reader_id, true AS skipped FROM verdicts WHERE verdict = 'SENSITIVE'
    UNION ALL SELECT DISTINCT ON (root) 'sensitive-file', true FROM verdicts
      WHERE verdict = 'SENSITIVE_DIRECTORY'
    UNION ALL SELECT CASE WHEN doc_id % 8 = 2 THEN 'html-main-content' ELSE 'plain-text' END, true
      FROM verdicts WHERE verdict = 'OVERSIZED'
    UNION ALL SELECT 'unsupported-format', false
    UNION ALL SELECT 'scan-budget', true WHERE (SELECT sum(size) FROM verdicts
      WHERE verdict = 'ACCEPTED') > 20000000) GROUP BY 1, 2""")
def scan_warnings(spark, sf):
    classified = _classified(spark, sf)
    accepted = classified.where("verdict = 'ACCEPTED'")
    return scan.scan_warnings(classified, accepted, scan.within_budget(accepted, BUDGET)).groupBy(
        "reader_id", "skipped").agg(F.count("*").alias("warnings"))


@query("nested_roots", """WITH r AS (SELECT '/' || source AS root FROM documents WHERE lang = 'en'
    UNION SELECT '/' || source || '/' || lang FROM documents UNION SELECT '/' || source || 'x/y'
    FROM documents)
  SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.root <> r.root
    AND starts_with(r.root, o.root || '/'))""")
def nested_roots(spark, sf):
    docs = t.load(spark, sf, "documents")
    roots = (docs.where("lang = 'en'").select(F.concat(F.lit("/"), "source").alias("root"), "doc_id")
             .unionByName(docs.select(F.concat(F.lit("/"), "source", F.lit("/"), "lang")
                                      .alias("root"), "doc_id"))
             .unionByName(docs.select(F.concat(F.lit("/"), "source", F.lit("x/y/")).alias("root"),
                                      "doc_id")))
    return scan.outermost_roots(roots.withColumnRenamed("doc_id", "position")).select("root")


@query("html_sections")
def html_sections(spark, sf):
    units, _ = html.split_failures(html.extract_pages(spread(t.load(spark, sf, "pages"), "page_id")))
    return units


@query("html_chunks")
def html_chunks(spark, sf):
    pages = t.load(spark, sf, "pages")
    units, _ = html.split_failures(html.extract_pages(spread(pages, "page_id")))
    documents = pages.select(
        "page_id", F.col("url").alias("document_id"), F.col("url").alias("path"),
        F.lit("").alias("root"), F.concat(F.col("page_id").cast("string"), F.lit(".html"))
        .alias("file_name"), F.lit("html").alias("extension"), F.lit(0).cast("long")
        .alias("modified_at"))
    return chunking.chunk_sections(html.html_sections(units, documents)).select(
        "chunk_id", "path", "source_location", "content")


# --- chunking --------------------------------------------------------------------------------

@query("prose_chunks", """WITH RECURSIVE u AS (SELECT doc_id, pos - 1 AS i,
    regexp_replace(line, '\\s+$', '') AS line FROM (SELECT doc_id,
      unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
  k AS (SELECT *, greatest(1, CAST(ceil(length(line) / 4.0) AS INTEGER)) AS tok FROM u),
  p AS (SELECT *, sum(tok) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
      count(*) OVER (PARTITION BY doc_id) AS n FROM k),
  b AS (SELECT a.doc_id, a.i, max(c.i) AS back FROM p a JOIN p c ON a.doc_id = c.doc_id
      AND c.i BETWEEN a.i - 39 AND a.i AND a.upto - c.upto + c.tok >= 40 GROUP BY 1, 2),
  q AS (SELECT p.*, coalesce(b.back, 0) AS back FROM p LEFT JOIN b USING (doc_id, i)),
  walk AS (
    SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start,
      CAST(NULL AS BIGINT) AS cut_from FROM (SELECT DISTINCT doc_id FROM q)
    UNION ALL
    SELECT w.doc_id, q.i,
      CASE WHEN q.upto - coalesce(s.upto - s.tok, q.upto - q.tok) >= 320
             THEN CASE WHEN q.back > w.start THEN q.back ELSE q.i + 1 END
           WHEN q.line = '' AND q.upto - coalesce(s.upto - s.tok, q.upto - q.tok) >= 80 THEN q.i + 1
           ELSE w.start END,
      CASE WHEN q.upto - coalesce(s.upto - s.tok, q.upto - q.tok) >= 320 OR (q.line = ''
        AND q.upto - coalesce(s.upto - s.tok, q.upto - q.tok) >= 80) THEN w.start END
    FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i + 1
    LEFT JOIN q s ON s.doc_id = w.doc_id AND s.i = w.start),
  cuts AS (SELECT doc_id, cut_from AS a, i AS z FROM walk WHERE cut_from IS NOT NULL
    UNION ALL SELECT w.doc_id, w.start, w.i FROM walk w JOIN q ON q.doc_id = w.doc_id
      AND q.i = w.i AND q.i = q.n - 1 WHERE w.start <= w.i),
  edged AS (SELECT c.doc_id, c.a, c.z, min(q.i) AS first, max(q.i) AS last FROM cuts c
    JOIN q ON q.doc_id = c.doc_id AND q.i BETWEEN c.a AND c.z AND q.line <> '' GROUP BY 1, 2, 3),
  built AS (SELECT e.doc_id, e.first, e.last, regexp_replace(string_agg(q.line, chr(10) ORDER BY q.i),
      '^\\s+|\\s+$', '', 'g') AS content FROM edged e JOIN q ON q.doc_id = e.doc_id
      AND q.i BETWEEN e.first AND e.last GROUP BY e.doc_id, e.a, e.first, e.last)
  SELECT doc_id || '.md' AS file_name, 'L' || (first + 1) || CASE WHEN last = first THEN ''
      ELSE '-' || (last + 1) END AS source_location, md5(content) AS content_hash
  FROM built WHERE length(content) >= 12""")
def prose_chunks(spark, sf):
    chunks = chunking.chunk_sections(chunking.text_sections(t.documents(spark, sf)))
    return chunks.select("file_name", "source_location", F.md5("content").alias("content_hash"))


@query("code_chunks")
def code_chunks(spark, sf):
    """Documents with every seventh line turned into a declaration."""
    code = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.when(
        i % 7 == 3, F.concat(F.lit("def step_"), i.cast("string"), F.lit("(value):"))).when(
        i % 7 == 2, F.lit("# explains the next line")).otherwise(line)), "\n")
    documents = t.documents(spark, sf, "py").withColumn("text", code)
    return chunking.chunk_sections(chunking.text_sections(documents)).select(
        "chunk_id", "path", "source_location", "content")


# --- index maintenance -----------------------------------------------------------------------

def _two_snapshots(spark, sf):
    """A previous and a current listing: documents come, go, change and stay."""
    docs = t.load(spark, sf, "documents")
    common = [F.concat(F.lit("/"), "source").alias("root"),
              F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path")]
    tail = [F.lit("plain-text").alias("reader_id"), F.lit(2).alias("reader_version")]
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(
        F.col("text"))
    before = docs.where("doc_id % 10 <> 0").select(
        *common, F.length("text").cast("long").alias("size"),
        F.lit(1).cast("long").alias("modified_at"), F.sha2("text", 256).alias("content_hash"),
        *tail, F.lit(fixed.CHUNKING_VERSION).alias("chunking_version"), "doc_id", "text")
    now = docs.where("doc_id % 10 <> 1").select(
        *common, F.length(changed).cast("long").alias("size"),
        F.lit(1).cast("long").alias("modified_at"), F.sha2(changed, 256).alias("content_hash"),
        *tail, "doc_id", changed.alias("text"))
    return before, now


_CHANGE = """CASE WHEN doc_id % 10 = 0 THEN 'ADDED' WHEN doc_id % 10 = 1 THEN 'DELETED'
  WHEN doc_id % 7 = 0 THEN 'MODIFIED' ELSE 'REUSED' END"""


@query("index_diff", f"""SELECT '/' || source AS root, doc_id || '.md' AS rel_path,
  {_CHANGE} AS change FROM documents""")
def index_diff(spark, sf):
    before, now = _two_snapshots(spark, sf)
    return indexing.diff(before, now)


@query("fingerprints", """SELECT '/' || source AS root, doc_id || '.md' AS rel_path,
    CASE WHEN doc_id % 10 <> 0 AND doc_id % 7 <> 0 THEN 'stored' ELSE
      sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END) END AS content_hash
  FROM documents WHERE doc_id % 10 <> 1""")
def fingerprints(spark, sf):
    """Unchanged size and time keep the stored hash, here a marker; the rest is hashed."""
    before, now = _two_snapshots(spark, sf)
    path = F.concat_ws("/", "root", "rel_path")
    files = now.select("root", "rel_path", path.alias("path"), "size", "modified_at")
    contents = now.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return indexing.fingerprints(files, contents, before.withColumn(
        "content_hash", F.lit("stored"))).select("root", "rel_path", "content_hash")


@query("index_assemble", """SELECT '/' || source || '/' || doc_id || '.md' AS path,
    md5(CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END) AS content_hash
  FROM documents WHERE doc_id % 10 <> 1""")
def index_assemble(spark, sf):
    """Chunks reused and chunks cut anew, one chunk per document."""
    before, now = _two_snapshots(spark, sf)
    path = F.concat_ws("/", "root", "rel_path")

    def chunked(rows):
        return rows.select(F.sha1(F.concat(path, "text")).alias("chunk_id"), path.alias("path"),
                           F.col("text").alias("content"))

    old = chunked(before)
    entries = before.withColumn("chunk_ids", F.array(F.sha1(F.concat(path, "text")))).select(
        "root", "rel_path", "chunk_ids")
    keep, again = indexing.split_reusable(indexing.diff(before, now), entries, old)
    fresh = chunked(now.join(again, indexing.KEY, "left_semi"))
    return indexing.assemble(keep, old, fresh).select("path", F.md5("content")
                                                      .alias("content_hash"))


@query("index_entries")
def index_entries(spark, sf):
    documents = t.documents(spark, sf)
    chunks = chunking.chunk_sections(chunking.text_sections(documents))
    return indexing.entries(documents.select("document_id"), chunks).select(
        "document_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS HUGEINT)) AS lane{i}"
                   for i in range(4))


@query("source_set_hash", f"""WITH {_FILES}, h AS (SELECT root, sha256(rel_path || chr(0) || size
    || chr(0) || modified_at) AS h FROM files WHERE (doc_id // 8) % 8 NOT IN (2, 5)), s AS (SELECT root, count(*) AS files, {_LANES}
    FROM h GROUP BY root)
  SELECT root, files, sha256(root || ':' || files || ':' || CAST(lane0 AS VARCHAR) || ':' ||
    CAST(lane1 AS VARCHAR) || ':' || CAST(lane2 AS VARCHAR) || ':' || CAST(lane3 AS VARCHAR))
    AS source_hash FROM s""")
def source_set_hash(spark, sf):
    return indexing.source_set_hash(t.files(spark, sf))


@query("rebuild_changes", f"""WITH {_FILES}, v AS (SELECT root, rel_path, doc_id FROM verdicts
    WHERE verdict = 'ACCEPTED')
  SELECT root, rel_path, CASE WHEN doc_id % 10 = 0 THEN 'ADDED' WHEN doc_id % 10 = 1 THEN 'DELETED'
    WHEN doc_id % 9 = 0 THEN 'MODIFIED' ELSE 'REUSED' END AS change, true AS published FROM v""")
def rebuild_changes(spark, sf):
    """Two builds of all files; between them files come, go and change."""
    folder = fresh_folder(spark, "rebuild")
    everything = t.files(spark, sf)
    touched = F.col("doc_id") % 9 == 0
    later = everything.where("doc_id % 10 <> 1").withColumns({
        "text": F.when(touched, F.concat("text", F.lit(" more"))).otherwise(F.col("text")),
        "modified_at": F.when(touched, F.col("modified_at") + 1).otherwise(F.col("modified_at"))})
    done = None
    for revision, files in enumerate((everything.where("doc_id % 10 <> 0"), later), 1):
        def read(wanted, files=files):
            return files.join(wanted.select("path"), "path", "left_semi").select(
                "path", F.encode("text", "UTF-8").alias("content"))

        done = rebuild.rebuild(spark, lambda files=files: files.drop("text", "doc_id"), read, folder, "kb", revision,
                               scan_rules=ScanRules(max_files=10**9, max_total_bytes=10**18))
    return done.plan.withColumn("published", F.lit(done.published))


@query("coverage_report", f"""WITH {_FILES}, e AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN
    modified_at + 1 ELSE modified_at END AS e_modified FROM verdicts
    WHERE verdict = 'ACCEPTED' AND doc_id % 3 <> 0),
  gone AS (SELECT root, rel_path || '.old' AS rel_path FROM e WHERE doc_id % 4 = 1)
  SELECT v.root, v.rel_path, CASE WHEN v.verdict IN ('IGNORED', 'SENSITIVE', 'SENSITIVE_DIRECTORY')
      THEN 'IGNORED' WHEN v.verdict <> 'ACCEPTED' THEN v.verdict WHEN v.doc_id % 3 = 0
      THEN 'NOT_INDEXED' WHEN v.doc_id % 5 = 0 THEN 'MODIFIED' ELSE 'INDEXED' END AS state,
    CASE WHEN v.verdict = 'ACCEPTED' AND v.doc_id % 3 <> 0 THEN 2 ELSE 0 END AS chunks
  FROM verdicts v UNION ALL SELECT root, rel_path, 'DELETED', 2 FROM gone""")
def coverage_report(spark, sf):
    classified = _classified(spark, sf)
    known = classified.where("verdict = 'ACCEPTED' AND doc_id % 3 <> 0")
    entries = known.select("root", "rel_path", "size", F.when(
        F.col("doc_id") % 5 == 0, F.col("modified_at") + 1).otherwise(F.col("modified_at"))
        .alias("modified_at"), F.lit(2).alias("chunk_count"))
    gone = known.where("doc_id % 4 = 1").select(
        "root", F.concat("rel_path", F.lit(".old")).alias("rel_path"), "size", "modified_at",
        F.lit(2).alias("chunk_count"))
    return indexing.coverage(classified, entries.unionByName(gone))


@query("directory_rollup", f"""WITH {_FILES}, parts AS (SELECT root, string_split(rel_path, '/') AS p
    FROM files), up AS (SELECT root, array_to_string(p[1:n], '/') AS directory FROM parts,
    generate_series(0, 6) g(n) WHERE n < len(p))
  SELECT root, directory, count(*) AS files FROM up GROUP BY 1, 2""")
def directory_rollup(spark, sf):
    return indexing.directory_rollup(t.files(spark, sf))


def _bases(spark, sf):
    """Customers as knowledge bases."""
    status = F.element_at(F.array(*map(F.lit, fixed.INDEX_STATUSES)),
                          (F.col("c_custkey") % 6 + 1).cast("int"))
    return t.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("base_id"), (F.col("c_custkey") % 4 + 1).alias("source_revision"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 4 + 1).alias(
            "published_revision"), status.alias("status"), "c_nationkey", "c_acctbal")


_BASES = """bases AS (SELECT c_custkey AS base_id, c_custkey % 4 + 1 AS source_revision,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 + 1 END AS published_revision,
    CASE c_custkey % 6 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'READY' WHEN 2 THEN 'DIRTY' WHEN 3 THEN
      'BUILDING' WHEN 4 THEN 'FAILED' ELSE 'INCOMPATIBLE' END AS status FROM customer)"""


@query("load_validation", """SELECT c_custkey AS base_id, CASE WHEN c_custkey % 5 = 0
    THEN 'INCOMPATIBLE' WHEN c_custkey % 7 = 0 THEN 'DIRTY' WHEN c_custkey % 11 = 0 THEN 'DIRTY'
    WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'INCOMPATIBLE' ELSE 'READY' END AS status
  FROM customer""")
def load_validation(spark, sf):
    bases = _bases(spark, sf)
    key = F.col("base_id")
    manifests = bases.where(key % 5 != 0).select(
        "base_id", (F.col("source_revision") - (key % 7 == 0).cast("int"))
        .alias("manifest_revision"), F.lit("h").alias("source_set_hash"),
        F.when(key % 17 == 0, "old-model").otherwise("model").alias("model_signature"),
        F.lit(64).alias("dimension"), F.lit(fixed.CHUNKING_VERSION).alias("chunking_version"),
        F.when(key % 13 == 0, 4).otherwise(fixed.INDEX_FORMAT_VERSION).alias("format_version"))
    hashes = bases.select("base_id", F.when(key % 11 == 0, "other").otherwise("h")
                          .alias("current_hash"))
    return indexing.validate_loaded(bases, manifests, hashes, "model")


@query("status_latest", """SELECT user_id AS base_id, arg_max(event_type, event_id) AS status,
  max(event_id) AS seq FROM events GROUP BY user_id""")
def status_latest(spark, sf):
    return lifecycle.latest_status(t.load(spark, sf, "events").select(
        F.col("user_id").alias("base_id"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("status")))


_EVENTS = """CASE event_type WHEN 'view' THEN 'begin' WHEN 'purchase' THEN 'publish' WHEN 'error'
  THEN 'fail' WHEN 'click' THEN 'change' ELSE 'incompatible' END"""
_TARGETS = """CASE event_type WHEN 'view' THEN 'BUILDING' WHEN 'purchase' THEN 'READY' WHEN 'error'
  THEN 'FAILED' WHEN 'click' THEN 'DIRTY' ELSE 'INCOMPATIBLE' END"""

_LEGAL = """(CASE e.event WHEN 'begin' THEN w.to_status <> 'BUILDING' WHEN 'publish' THEN
  w.to_status = 'BUILDING' WHEN 'fail' THEN w.to_status = 'BUILDING' WHEN 'change' THEN
  w.to_status IN ('READY', 'BUILDING', 'FAILED', 'DIRTY') ELSE true END)"""


@query("legal_transitions", f"""WITH RECURSIVE e AS (SELECT user_id AS base_id, event_id AS seq,
    {_EVENTS} AS event, {_TARGETS} AS target,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  walk AS (SELECT DISTINCT base_id, 0::BIGINT AS n, 0::BIGINT AS seq, 'EMPTY' AS from_status,
      'EMPTY' AS to_status, false AS legal FROM e
    UNION ALL SELECT e.base_id, e.n, e.seq, w.to_status, CASE WHEN {_LEGAL} THEN e.target
      ELSE w.to_status END, {_LEGAL} FROM walk w JOIN e ON e.base_id = w.base_id AND e.n = w.n + 1)
  SELECT base_id, seq, from_status, to_status FROM walk WHERE legal""")
def legal_transitions(spark, sf):
    name = (F.when(F.col("event_type") == "view", "begin")
            .when(F.col("event_type") == "purchase", "publish")
            .when(F.col("event_type") == "error", "fail")
            .when(F.col("event_type") == "click", "change").otherwise("incompatible"))
    log = t.load(spark, sf, "events").select(
        F.col("user_id").alias("base_id"), F.col("event_id").alias("seq"), name.alias("event"))
    return lifecycle.legal_events(lifecycle.with_preceding_status(log)).select(
        "base_id", "seq", "from_status", "to_status")


@query("revision_allocation", f"""WITH {_BASES} SELECT base_id, source_revision + CASE WHEN
    published_revision = source_revision THEN 1 ELSE 0 END AS source_revision, published_revision,
    'BUILDING' AS status FROM bases WHERE base_id % 2 = 0 AND status <> 'BUILDING'
    AND source_revision = base_id % 3 + 1""")
def revision_allocation(spark, sf):
    bases = _bases(spark, sf)
    requests = bases.where("base_id % 2 = 0").select(
        "base_id", (F.col("base_id") % 3 + 1).alias("expected_revision"))
    return lifecycle.allocate_revisions(bases, requests)


@query("conditional_publish", f"""WITH {_BASES}, o AS (SELECT *, CASE WHEN base_id % 2 = 1
    THEN base_id % 3 + 1 END AS offered FROM bases),
  w AS (SELECT *, coalesce(offered = source_revision AND status = 'BUILDING', false) AS wins FROM o)
  SELECT base_id, source_revision, CASE WHEN wins THEN offered ELSE published_revision END
    AS published_revision, CASE WHEN wins THEN 'READY' ELSE status END AS status,
    wins AS published_now FROM w""")
def conditional_publish(spark, sf):
    bases = _bases(spark, sf)
    manifests = bases.where("base_id % 2 = 1").select(
        "base_id", (F.col("base_id") % 3 + 1).alias("revision"))
    return lifecycle.publish(bases, manifests)


@query("source_changes", f"""WITH {_BASES}, d AS (SELECT *, base_id % 4 = 0 AS effective FROM bases)
  SELECT base_id, source_revision + CAST(effective AS INTEGER) AS source_revision,
    published_revision, CASE WHEN effective THEN 'DIRTY' ELSE status END AS status FROM d""")
def source_changes(spark, sf):
    bases = _bases(spark, sf)
    current = bases.select("base_id", F.lit("/a").alias("root"))
    wanted = current.unionByName(bases.where("base_id % 4 = 0").select(
        "base_id", F.lit("/b").alias("root")))
    return lifecycle.apply_source_changes(bases, current, wanted)


# --- conversations ---------------------------------------------------------------------------

@query("conv_list", """SELECT conv_id, count(*) AS messages, max(turn) AS updated_at,
  min(turn) AS created_at FROM conversations GROUP BY conv_id""")
def conv_list(spark, sf):
    turns = t.load(spark, sf, "conversations")
    heads = turns.groupBy("conv_id").agg(F.max("turn").alias("updated_at"),
                                         F.min("turn").alias("created_at"))
    return conversations.conversation_list(heads, turns)


@query("conv_renumber", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id
  ORDER BY -turn) - 1 AS seq FROM conversations""")
def conv_renumber(spark, sf):
    turns = t.load(spark, sf, "conversations").withColumn("back", -F.col("turn"))
    return conversations.renumber(turns, "back").select("conv_id", "turn", "seq")


@query("conv_titles", """WITH q AS (SELECT conv_id, arg_min(trim(regexp_replace(text, '\\s+', ' ',
    'g')), turn) AS q FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id)
  SELECT conv_id, CASE WHEN length(q) <= 24 THEN q ELSE substr(q, 1, 24) || '…' END AS title
  FROM q""")
def conv_titles(spark, sf):
    return conversations.titles(t.load(spark, sf, "conversations"))


@query("conv_transcript", """SELECT conv_id, turn AS seq, role, turn // 4 AS source_revision
  FROM conversations""")
def conv_transcript(spark, sf):
    return conversations.transcript(t.conversation_revisions(spark, sf).withColumnRenamed(
        "turn", "seq")).select("conv_id", "seq", "role", "source_revision")


@query("conv_complete_turns", """WITH c AS (SELECT *, lead(role) OVER w AS next_role,
    lag(role) OVER w AS last_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn AS seq FROM c WHERE (role = 'user' AND next_role = 'assistant')
    OR (role = 'assistant' AND last_role = 'user')""")
def conv_complete_turns(spark, sf):
    turns = t.load(spark, sf, "conversations").withColumnRenamed("turn", "seq")
    return conversations.complete_turns(turns).select("conv_id", "seq")


@query("conv_cascade_delete", """SELECT conv_id, turn FROM conversations
  WHERE (conv_id % 10) % 3 <> 0""")
def conv_cascade_delete(spark, sf):
    turns = t.load(spark, sf, "conversations")
    heads = turns.select("conv_id", (F.col("conv_id") % 10).alias("base_id")).distinct()
    bases = heads.select("base_id").distinct()
    _, _, left = conversations.cascade_delete(bases, heads, turns,
                                              bases.where("base_id % 3 = 0"))
    return left.select("conv_id", "turn")


@query("conv_current_history", """WITH c AS (SELECT conv_id, turn, turn // 4 AS r,
    max(turn // 4) OVER (PARTITION BY conv_id) AS latest FROM conversations)
  SELECT conv_id, turn FROM c WHERE r = latest""")
def conv_current_history(spark, sf):
    turns = t.conversation_revisions(spark, sf)
    latest = turns.groupBy("conv_id").agg(F.max("source_revision").alias("current_revision"))
    return conversations.current_history(turns, latest).select("conv_id", "turn")


@query("revision_breaks", """WITH c AS (SELECT conv_id, turn AS seq, turn // 4 AS source_revision,
    lag(turn // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_revision
    FROM conversations) SELECT * FROM c WHERE previous_revision <> source_revision""")
def revision_breaks(spark, sf):
    return conversations.revision_breaks(t.conversation_revisions(spark, sf).withColumnRenamed(
        "turn", "seq"))


_TRIM = HistoryRules(max_turns=6, max_tokens=200)


@query("conv_trim", """WITH m AS (SELECT *, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end,
    max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations),
  w AS (SELECT *, sum(tok + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rest FROM m
    WHERE from_end <= 6),
  s AS (SELECT conv_id, coalesce(min(turn) FILTER (WHERE role = 'user' AND rest <= 200),
    min(turn) FILTER (WHERE role = 'user' AND turn = last_turn)) AS start FROM w GROUP BY conv_id),
  k AS (SELECT w.*, CAST(greatest(64, floor(200 * greatest(0.5, length(text) * 1.0
      / greatest(1, tok)))) AS INTEGER) AS tail FROM w JOIN s USING (conv_id) WHERE turn >= start)
  SELECT conv_id, turn, length(CASE WHEN rest > 200 AND length(text) > tail
    THEN '…' || right(text, tail) ELSE text END) AS chars FROM k""")
def conv_trim(spark, sf):
    turns = t.load(spark, sf, "conversations").withColumnRenamed("turn", "seq")
    return conversations.trim_history(turns, _TRIM).select(
        "conv_id", F.col("seq").alias("turn"), F.length("text").cast("long").alias("chars"))


@query("conversation_tokens", """SELECT conv_id, CAST(ceil(sum(ceil(length(text) / 4.0) + 4) * 1.3)
  AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def conversation_tokens(spark, sf):
    return conversations.conversation_tokens(t.load(spark, sf, "conversations"), 1.3)


def _observations(spark, sf):
    return t.load(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 150 + 30).cast("int").alias("raw_estimate"),
        F.floor(F.col("value") * 5).cast("int").alias("actual_tokens"))


@query("calibration", """WITH o AS (SELECT event_type AS model, event_id, least(4.0, greatest(0.25,
    floor(value * 5) / (event_id % 150 + 30))) AS r FROM events
    WHERE event_id % 150 + 30 >= 50 AND floor(value * 5) > 0),
  n AS (SELECT *, count(*) OVER (PARTITION BY model) - row_number() OVER (PARTITION BY model
    ORDER BY event_id) AS age, count(*) OVER (PARTITION BY model) AS k FROM o)
  SELECT model, round(max(pow(0.7, k)) + sum(0.3 * r * pow(0.7, age)), 6) AS factor,
    count(*) AS observations FROM n GROUP BY model""")
def calibration(spark, sf):
    return t.rounded(conversations.calibration(_observations(spark, sf)), "factor")


@query("usage_rollup", """WITH u AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS p,
    event_id % 50 AS c, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) +
    event_id % 50 END AS t FROM events),
  k AS (SELECT user_id, p, c, CASE WHEN t = 0 THEN p + c ELSE t END AS t FROM u)
  SELECT user_id, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT)
    AS completion_tokens, CAST(sum(t) AS BIGINT) AS total_tokens, count(*) AS reports
  FROM k WHERE t > 0 GROUP BY user_id""")
def usage_rollup(spark, sf):
    prompt, completion = F.floor("value"), F.col("event_id") % 50
    reports = t.load(spark, sf, "events").select(
        "user_id", prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        F.when(F.col("event_id") % 4 == 0, 0).otherwise(prompt + completion)
        .alias("total_tokens"))
    return conversations.usage_rollup(reports, ["user_id"])


def _answers(spark, sf):
    text = (F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" <think>plan "), F.col("turn").cast(
                "string"), F.lit("</think>"), "text"))
            .when(F.col("turn") % 4 == 3, F.concat(F.lit("<think>"), "text"))
            .otherwise(F.concat("text", F.lit("<think>late</think>"))))
    return t.load(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


@query("reasoning_split", """SELECT conv_id, turn, md5(CASE turn % 4 WHEN 1 THEN 'plan ' || turn
    WHEN 3 THEN text ELSE '' END) AS reasoning, md5(CASE turn % 4 WHEN 1 THEN ' ' || text WHEN 3
    THEN '' ELSE text || '<think>late</think>' END) AS answer FROM conversations""")
def reasoning_split(spark, sf):
    return conversations.split_reasoning(_answers(spark, sf)).select(
        "conv_id", "turn", F.md5("reasoning").alias("reasoning"), F.md5("answer").alias("answer"))


@query("answer_structure", """WITH a AS (SELECT doc_id AS answer_id, string_split('# Title' || chr(10)
    || '- item' || chr(10) || '    2) two' || chr(10) || '> said' || chr(10) || '---' || chr(10) ||
    '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || text, chr(10)) AS rows
    FROM documents),
  l AS (SELECT answer_id, unnest(CASE WHEN rows[-1] = '' THEN rows[:-2] ELSE rows END) AS row,
    generate_subscripts(CASE WHEN rows[-1] = '' THEN rows[:-2] ELSE rows END, 1) - 1 AS line_no FROM a),
  b AS (SELECT *, regexp_replace(row, '^\\s+|\\s+$', '', 'g') AS s, sum(CAST(regexp_matches(row,
    '^\\s*(```|~~~)') AS INTEGER)) OVER (PARTITION BY answer_id ORDER BY line_no) AS fences FROM l)
  SELECT answer_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN fences % 2 = 1 THEN 'CODE'
    WHEN s = '' THEN 'PARAGRAPH' WHEN regexp_matches(s, '^(-{3,}|\\*{3,}|_{3,})$') THEN 'RULE'
    WHEN regexp_matches(s, '^#{1,6} ') THEN 'HEADING' WHEN starts_with(s, '>') THEN 'QUOTE'
    WHEN regexp_matches(s, '^[-*+] ') THEN 'BULLET' WHEN regexp_matches(s, '^[0-9]{1,3}[.)] ')
    THEN 'NUMBERED' ELSE 'PARAGRAPH' END AS block FROM b
  WHERE NOT regexp_matches(row, '^\\s*(```|~~~)')""")
def answer_structure(spark, sf):
    head = "# Title\n- item\n    2) two\n> said\n---\n```\n# code\n```\n"
    answers = t.load(spark, sf, "documents").select(
        F.col("doc_id").alias("answer_id"), F.concat(F.lit(head), "text").alias("text"))
    return conversations.answer_structure(answers).select("answer_id", "line_no", "block")


# --- diagnostics and streaming forms ---------------------------------------------------------

@query("redacted_log", """SELECT event_id, CASE event_type WHEN 'error' THEN
    'failed Bearer [REDACTED] now' WHEN 'view' THEN 'api_key=[REDACTED] used' ELSE event_type || ' '
    || user_id END AS message, '[REDACTED]' AS secret, CAST(user_id AS VARCHAR) AS plain
  FROM events ORDER BY ts DESC, event_id DESC LIMIT 300""")
def redacted_log(spark, sf):
    """The bounded log: its capacity is the feature."""
    user = F.col("user_id").cast("string")
    raw = t.events(spark, sf).select(
        "event_id", "ts", F.lit("call").alias("type"), F.col("event_type").alias("category"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed bearer tok-"), user,
                                                        F.lit(" now")))
        .when(F.col("event_type") == "view", F.concat(F.lit("api_key: sk-"), user, F.lit(" used")))
        .otherwise(F.concat_ws(" ", "event_type", user)).alias("message"),
        F.create_map(F.lit("ApiKey"), user, F.lit("user"), user).alias("attributes"))
    return diagnostics.latest_events(diagnostics.redact(raw)).select(
        "event_id", "message", F.col("attributes")["ApiKey"].alias("secret"),
        F.col("attributes")["user"].alias("plain"))


@query("latency_windows", """SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start,
    event_type AS category, CASE WHEN value > 50 THEN 'slow' ELSE 'ok' END AS outcome,
    count(*) AS calls, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms
  FROM events GROUP BY 1, 2, 3""")
def latency_windows(spark, sf):
    calls = t.events(spark, sf).select(
        "ts", F.col("event_type").alias("category"),
        F.when(F.col("value") > 50, "slow").otherwise("ok").alias("outcome"),
        F.col("value").alias("latency_ms"))
    return t.rounded(diagnostics.latency_windows(calls), "mean_ms", "max_ms").withColumn(
        "window_start", F.unix_millis("window_start"))


def _changes(events):
    return events.select(F.col("user_id").alias("base_id"), "ts", F.lit(1).cast("long")
                         .alias("revision"), F.col("event_type").alias("kind"),
                         F.lit("a/b.md").alias("rel_path"), F.lit(False).alias("is_dir"))


@query("debounce_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w
    + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id
    ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
  SELECT user_id AS base_id, count(*) AS events, epoch_us(min(ts)) AS burst_start,
    epoch_us(max(ts)) AS last_event FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, sf):
    bursts = freshness.debounced(freshness.effective_changes(_changes(t.events(spark, sf))),
                                 "6 hours")
    return bursts.select("base_id", "events", F.unix_micros("burst_start").alias("burst_start"),
                         F.unix_micros("last_event").alias("last_event"))


def _stream(spark, sf, table: str):
    """A table as a stream, stored as one file or as a folder of parts."""
    schema = t.load(spark, sf, table).schema
    path = f"{sf}/{table}.parquet"
    fs, jvm = file_system(spark, path)
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(hadoop_path(jvm, path)).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _run(spark, frame, mode: str = "append"):
    """Runs a stream over what is there and returns what it wrote, with its batch number."""
    folder = fresh_folder(spark, "stream")

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
            f"{folder}/out/batch_no={number}")

    running = (frame.writeStream.outputMode(mode).foreachBatch(write)
               .option("checkpointLocation", f"{folder}/checkpoint")
               .trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_no")


@query("stream_debounce", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w
    + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id
    ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
  b AS (SELECT user_id, count(*) AS events, min(ts) AS a, max(ts) AS z FROM s GROUP BY user_id, n)
  SELECT user_id AS base_id, events, epoch_us(a) AS burst_start, epoch_us(z) AS last_event FROM b
  WHERE z + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 SECOND
    FROM events)""")
def stream_debounce(spark, sf):
    """The same bursts from a stream; a burst is written once the watermark has closed it."""
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bursts = _run(spark, freshness.debounced(freshness.effective_changes(_changes(events)),
                                             "6 hours"))
    return bursts.select("base_id", "events", F.unix_micros("burst_start").alias("burst_start"),
                         F.unix_micros("last_event").alias("last_event"))


@query("stream_calibration", SQL["calibration"])
def stream_calibration(spark, sf):
    stream = _stream(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 150 + 30).cast("int").alias("raw_estimate"),
        F.floor(F.col("value") * 5).cast("int").alias("actual_tokens"))
    states = _run(spark, deltas.running_calibration(stream), "update")
    return t.rounded(states.where("observations > 0").groupBy("model").agg(
        F.max_by("factor", "batch").alias("factor"),
        F.max_by("observations", "batch").alias("observations")), "factor")


@query("stream_reasoning", """SELECT conv_id || '/' || turn AS stream_id, md5(CASE turn % 4 WHEN 1
    THEN 'plan ' || turn WHEN 3 THEN text ELSE '' END) AS reasoning, md5(CASE turn % 4 WHEN 1
    THEN ' ' || text WHEN 3 THEN '' ELSE text || '<think>late</think>' END) AS answer
  FROM conversations""")
def stream_reasoning(spark, sf):
    """Answers cut into pieces of five characters and put together again from the stream."""
    text = (F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" <think>plan "), F.col("turn").cast(
                "string"), F.lit("</think>"), "text"))
            .when(F.col("turn") % 4 == 3, F.concat(F.lit("<think>"), "text"))
            .otherwise(F.concat("text", F.lit("<think>late</think>"))))
    whole = _stream(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("stream_id"), text.alias("text"))
    pieces = whole.select("stream_id", "text", F.explode(F.sequence(
        F.lit(0), F.ceil(F.length("text") / 5).cast("int") - 1)).alias("n")).select(
        "stream_id", F.col("n").cast("long").alias("seq"), F.lit("ANSWER").alias("stage"),
        F.substring(F.col("text"), F.col("n") * 5 + 1, F.lit(5)).alias("piece"),
        (F.col("n") == F.ceil(F.length("text") / 5) - 1).alias("is_last")).withColumnRenamed(
        "piece", "text")
    out = _run(spark, deltas.reassemble(pieces))

    def joined(stage: str):
        return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("stage") == stage, F.struct("seq", "text")))), lambda p: p["text"]), ""))

    # One stream is one answer of a model.
    return out.groupBy("stream_id").agg(joined("ANSWER_THINKING").alias("reasoning"),
                                        joined("ANSWER").alias("answer"))


@query("stream_freshness")
def stream_freshness(spark, sf):
    kind = (F.when(F.col("event_type") == "signup", "start").when(
        F.col("event_type") == "view", "touch").when(F.col("event_type") == "purchase", "change")
        .when(F.col("event_type") == "click", "verified").otherwise("unavailable"))
    events = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("base_id"), F.lit(1).cast("long").alias("revision"),
        F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(0).cast("long")
        .alias("generation"))
    states = _run(spark, freshness.freshness_states(events), "update")
    return states.groupBy("base_id").agg(F.max_by("state", "batch").alias("state"),
                                         F.max_by("generation", "batch").alias("generation"))


def _versions(documents, text, seq, deleted):
    """Document rows as the incremental index takes them."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.select(
        F.concat(F.lit("/corpus\u0000"), name).alias("document_id"),
        F.concat(F.lit("/corpus/"), name).alias("path"), F.lit("/corpus").alias("root"),
        name.alias("file_name"), F.lit("md").alias("extension"),
        F.lit(0).cast("long").alias("modified_at"), text.alias("text"), seq.cast("long").alias("seq"),
        deleted.alias("deleted"))


@query("stream_index", SQL["prose_chunks"])
def stream_index(spark, sf):
    """Documents streamed into chunks and postings; equals the batch result."""
    rows = _versions(_stream(spark, sf, "documents"), F.col("text"), F.col("doc_id"), F.lit(False))
    folder = fresh_folder(spark, "stream-index")
    incremental.incremental_index(rows, folder, f"{folder}/checkpoint").awaitTermination()
    return incremental.current(spark, folder, "chunks").select(
        "file_name", "source_location", F.md5("content").alias("content_hash"))


_REVISED = """(SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
    THEN 'Withheld until reviewed.' ELSE text END AS text FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) AS revised"""


@query("stream_index_labels", SQL["prose_chunks"].replace("FROM documents", f"FROM {_REVISED}"))
def stream_index_labels(spark, sf):
    """Documents, then what their labels say, streamed into one index: toxic documents are deleted, and texts
    of low quality replaced by a notice. The notices come last but are older than the deletions, so a document
    that is both stays deleted."""
    folder = fresh_folder(spark, "stream-index")
    labels = _stream(spark, sf, "labels").where("doc_id IS NOT NULL")
    steps = (
        _versions(_stream(spark, sf, "documents"), F.col("text"), F.lit(1), F.lit(False)),
        _versions(labels.where("toxic = 1"), F.lit(None).cast("string"), F.lit(3), F.lit(True)),
        _versions(labels.where("quality = 0"), F.lit("Withheld until reviewed."), F.lit(2), F.lit(False)))
    for n, rows in enumerate(steps):
        ahead = segments.states(spark, folder)
        incremental.incremental_index(rows, folder, f"{folder}/checkpoint-{n}", first=ahead[-1] + 1 if ahead else 0).awaitTermination()
    return incremental.current(spark, folder, "chunks").select(
        "file_name", "source_location", F.md5("content").alias("content_hash"))
