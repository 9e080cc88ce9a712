"""Sources, snapshots, highlights, streaming and the equivalences between them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.config import HistoryRules
from folioscope.functions import fixed, text as tx
from folioscope.operators import (chunking, conversations, evaluation, highlights, indexing, ordered,
                                  queries)
from folioscope.sources import decode, evaluation_set, html, scan, snapshot
from folioscope.streaming import deltas, freshness


def test_scan_of_a_real_folder(spark, tmp_path):
    for rel, content in {"a.md": "hello there reader", "build/x.md": "no", "k/id.pem": "no",
                         "b/photo.png": "x", "b/Makefile": "all: build it", "c.txt": "a\x00b"}.items():
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    files = scan.list_files(spark, str(tmp_path))
    got = {r.rel_path: r.verdict for r in scan.classify(
        files, scan.reader_registry(spark)).collect()}
    assert got == {"a.md": "ACCEPTED", "build/x.md": "IGNORED", "k/id.pem": "SENSITIVE",
                   "b/photo.png": "UNSUPPORTED", "b/Makefile": "ACCEPTED", "c.txt": "ACCEPTED"}
    documents = decode.text_documents(files.join(scan.read_contents(spark, str(tmp_path)), "path")
                                      .where(F.col("rel_path").isin("a.md", "b/Makefile", "c.txt")))
    assert {r.file_name: r.extension for r in documents.collect()} == {
        "a.md": "md", "Makefile": "text"}


def test_registry_rejects_a_second_registration(spark):
    with pytest.raises(ValueError):
        scan.reader_registry(spark, [("md", "extension", "other", 1, 10)])


def test_html_sections():
    page = ("<html><head><title> My  Page </title></head><body><nav><p>menu</p></nav>"
            "<p>outside</p><main><p>intro <b>bold</b></p><h2>First</h2><ul><li>one<p>inner</p></li>"
            "<li>two</ul><pre>a\n  b</pre><h2>Second</h2><p>end<script>x()</script></p></main>"
            "<footer><p>foot</p></footer></body></html>")
    assert html.page_sections(page) == [
        (1, "My Page", 1, "intro bold"), (2, "First", 2, "First"), (2, "First", 3, "one inner"),
        (2, "First", 4, "two"), (2, "First", 5, "a\n  b"), (3, "Second", 6, "Second"),
        (3, "Second", 7, "end")]
    assert html.page_sections("<p>only</p>")[0][1] == fixed.HTML_DEFAULT_TITLE


def test_unreadable_pages_become_warnings(spark):
    pages = spark.createDataFrame([(1, "<p>text</p>"), (2, "<div></div>")], "page_id int, html string")
    units, warnings = html.split_failures(html.extract_pages(pages))
    assert units.count() == 1 and [r.path for r in warnings.collect()] == ["2"]


def test_evaluation_set(spark, tmp_path):
    data = {"name": "s", "version": 1, "minimumRecallAt5": 0.9, "minimumMrrAt10": 0.8,
            "minimumNdcgAt10": 0.7, "cases": [
                {"id": "1", "query": "q", "language": "en", "category": "c",
                 "expectedDocuments": ["a.md"], "expectedPassages": ["Here"]}]}
    (tmp_path / "set.json").write_text(json.dumps(data))
    limits, cases = evaluation_set.read_evaluation_set(spark, str(tmp_path / "set.json"))
    row = cases.first()
    assert limits["min_recall20"] == 0.9 and row.split == "test" and row.answerable
    hits = spark.createDataFrame([("1", 1, "a.md", "it is here")],
                                 "case_id string, rank int, file_name string, content string")
    got = evaluation.case_metrics(hits, cases).first()
    assert (got.recall5, got.mrr10, got.ndcg10) == (1.0, 1.0, 1.0)
    overall = evaluation.report(evaluation.case_metrics(hits, cases))
    evaluation.require_gates(overall, limits)
    data["cases"][0]["expectedDocuments"] = []
    (tmp_path / "bad.json").write_text(json.dumps(data))
    with pytest.raises(Exception):
        evaluation_set.read_evaluation_set(spark, str(tmp_path / "bad.json"))[1].collect()


def test_snapshots_publish_and_retire(spark, tmp_path):
    folder = str(tmp_path)
    for revision in (1, 2):
        manifest = snapshot.manifest_row(spark, "kb", revision, "h", "m", 64, 1)
        snapshot.write_revision(spark, folder, revision, {"chunks": spark.range(revision)}, manifest)
    assert snapshot.publish_revision(spark, folder, 2, "h", "h")
    assert not snapshot.publish_revision(spark, folder, 2, "h", "h")
    assert snapshot.published_revision(spark, folder) == 2
    assert snapshot.retire(spark, folder) == ["_staging", "revision=1"]
    loaded = snapshot.load_revision(spark, folder, 2, ["chunks"])
    assert loaded["chunks"].count() == 2 and loaded["manifest"].count() == 1
    assert snapshot.load_revision(spark, folder, 9, ["chunks"]) is None


def test_incremental_build_equals_full_build(spark):
    rng = random.Random(2)

    def docs(version):
        rows = []
        for n in range(20):
            if (n % 5 == 0 and version == 1) or (n % 5 == 1 and version == 2):
                continue
            text = "\n".join("line %d of %d %s" % (i, n, "x" * 90) for i in range(30))
            if version == 2 and n % 4 == 0:
                text += "\nchanged text here"
            rows.append(("/r", f"{n}.md", text))
        rng.shuffle(rows)
        return spark.createDataFrame(rows, "root string, rel_path string, text string")

    def chunked(frame):
        return chunking.chunk_sections(chunking.text_sections(frame.select(
            F.concat_ws("/", "root", "rel_path").alias("document_id"),
            F.concat_ws("/", "root", "rel_path").alias("path"), "root",
            F.col("rel_path").alias("file_name"), F.lit("md").alias("extension"),
            F.lit(0).cast("long").alias("modified_at"), "text")))

    def listing(frame):
        return frame.select("root", "rel_path", F.length("text").cast("long").alias("size"),
                            F.lit(0).cast("long").alias("modified_at"),
                            F.sha2("text", 256).alias("content_hash"),
                            F.lit("plain-text").alias("reader_id"), F.lit(2).alias("reader_version"))

    old, new = docs(1), docs(2)
    old_chunks = chunked(old)
    entries = indexing.entries(old.select(
        "root", "rel_path", F.concat_ws("/", "root", "rel_path").alias("document_id")), old_chunks)
    plan = indexing.diff(listing(old).withColumn("chunking_version", F.lit(fixed.CHUNKING_VERSION)),
                         listing(new))
    keep, again = indexing.split_reusable(plan, entries, old_chunks)
    built = indexing.assemble(keep, old_chunks, chunked(new.join(again, indexing.KEY, "left_semi")))
    assert sorted(r.chunk_id for r in built.collect()) == sorted(
        r.chunk_id for r in chunked(new).collect())


def test_bucketed_windows_equal_plain_ones(spark):
    rng = random.Random(9)
    rows = [("hot" if n % 3 else f"k{n % 5}", n * 3, rng.choice([None, "a", "b"]), n % 7)
            for n in range(400)]
    frame = spark.createDataFrame(rows, "k string, o long, v string, x int")
    got = ordered.carried_forward(
        ordered.running_sum(frame, ["k"], "o", F.col("x"), "total", width=50),
        ["k"], "o", F.col("v"), "last", width=50)
    want = frame.selectExpr(
        "*", "sum(x) over (partition by k order by o) as total",
        "last(v, true) over (partition by k order by o rows between unbounded preceding and"
        " 1 preceding) as last")
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(
        map(repr, map(tuple, want.collect())))


def test_nearest_rank(spark):
    frame = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 5.0)] * 7,
                                  "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in evaluation.latency_percentiles(frame, ["k"], "v").collect()}
    assert got == {"a": (2.0, 4.0), "b": (5.0, 5.0)}


def test_trim_history_matches_a_plain_loop(spark):
    rng = random.Random(4)
    talks = {c: [(rng.choice(["user", "user", "assistant"]), "w" * rng.randint(0, 900))
                 for _ in range(rng.randint(1, 16))] for c in range(60)}
    rules = HistoryRules(max_turns=6, max_tokens=300)

    def cost(texts):
        return sum(-(-len(t) // 4) + 4 for t in texts)

    want = {}
    for conv, talk in talks.items():
        window = talk[-6:]
        while window and window[0][0] != "user":
            window.pop(0)
        while cost([t for _, t in window]) > 300 and len(window) > 1:
            window.pop(0)
            while window and window[0][0] != "user":
                window.pop(0)
        if len(window) == 1 and cost([window[0][1]]) > 300:
            text = window[0][1]
            tail = max(64, int(300 * max(0.5, len(text) / max(1, -(-len(text) // 4)))))
            if len(text) > tail:
                window = [("user", "…" + text[-tail:])]
        want[conv] = window
    frame = spark.createDataFrame([(c, n, r, t) for c, talk in talks.items()
                                   for n, (r, t) in enumerate(talk)],
                                  "conv_id int, seq int, role string, text string")
    got = {c: [] for c in talks}
    for r in conversations.trim_history(frame, rules).orderBy("conv_id", "seq").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == want


def test_calibration_learns(spark):
    frame = spark.createDataFrame([("m", n, 1000, 2000) for n in range(20)],
                                  "model string, seq long, raw_estimate int, actual_tokens int")
    assert conversations.calibration(frame).first().factor == pytest.approx(2.0, abs=0.05)


def test_decompose_goldens(spark):
    rows = [(1, "什么是索引？它怎么创建？"), (2, "A？B？C"), (3, "one plain question"),
            (4, "JDBC pool? ｊｄｂｃ pool? other part")]
    got = {}
    for r in queries.decompose(spark.createDataFrame(rows, "query_id int, text string")).orderBy(
            "query_id", "facet").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got == {1: ["什么是索引", "它怎么创建"], 2: ["A？B？C"], 3: ["one plain question"],
                   4: ["JDBC pool", "other part"]}


def test_split_think_tags_across_chunks():
    text = "  <think>plan it</think>\n<think>more</think>answer <think>kept</think>"
    for size in range(1, 12):
        state = ("", False, False)
        pieces = []
        chunks = [text[i:i + size] for i in range(0, len(text), size)]
        for n, chunk in enumerate(chunks):
            *state, out = deltas.feed(*state, chunk, n == len(chunks) - 1)
            pieces += out
        assert "".join(t for r, t in pieces if r) == "plan itmore"
        assert "".join(t for r, t in pieces if not r) == "  \nanswer <think>kept</think>"


def test_reasoning_split_equals_stream_rule(spark):
    texts = ["<think>a</think> b", " <think>open", "plain <think>x</think>", "<think>a</think>"
             "<think>b</think>c<think>d</think>", "", "<think></think>z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in conversations.split_reasoning(frame).collect():
        _, _, _, pieces = deltas.feed("", False, False, texts[row.id], True)
        assert row.reasoning == "".join(t for r, t in pieces if r)
        assert row.answer == "".join(t for r, t in pieces if not r)


class _Event:
    def __init__(self, kind, generation=0, revision=1):
        self.kind, self.generation, self.revision = kind, generation, revision


def test_freshness_states():
    def run(*events):
        state = (-1, "STOPPED", 0, 0, False)
        for event in events:
            state = freshness.step(state, event)
        return state

    start = _Event("start")
    assert run(start)[1] == "VERIFYING"
    assert run(start, _Event("verified"))[1] == "VERIFIED"
    assert run(start, _Event("touch"), _Event("verified", 0))[1:3] == ("VERIFYING", 2)
    assert run(start, _Event("touch"), _Event("verified", 1))[1] == "VERIFIED"
    assert run(start, _Event("change"), _Event("verified", 1))[1] == "CHANGED"
    assert run(start, _Event("verified"), _Event("differs"), _Event("verified"))[1] == "CHANGED"
    assert run(start, _Event("unavailable"))[1] == "UNAVAILABLE"


def test_highlights(spark):
    content = "Nothing here at all.\n\nThe retry policy waits longer each time. Other words follow it."
    hits = spark.createDataFrame([(1, "c", content)], "query_id int, chunk_id string, content string")
    asked = spark.createDataFrame([(1, "retry policy waits")], "query_id int, text string")
    from folioscope.operators import dense
    vectors = dense.embed(asked, "query_id", "text")
    spans = highlights.highlights(hits, vectors, 1).collect()
    assert "retry policy" in content[spans[0].start:spans[0].end]


def test_spans_of_a_hit():
    content = "  First one. Second one!\r\n \r\nA line here\nanother line there\n"
    assert [content[a:b] for a, b in highlights.candidate_spans(content)] == [
        "First one. Second one!", "First one.", "Second one!", "A line here\nanother line there", "A line here",
        "another line there", "First one. Second one!\r\n \r\nA line here\nanother line there"]
    assert highlights.candidate_spans("short") == [] and highlights.candidate_spans(" \n ") == []


def test_sql_helpers(spark):
    tx.register_sql_functions(spark)
    row = spark.sql("SELECT chunk_tokens(''), prompt_tokens(''), chunk_tokens('连接db'),"
                    " jaccard_terms('red blue', 'Blue green'), normalize_text('ＡB')").first()
    assert list(row)[:3] == [1, 0, 3] and row[3] == pytest.approx(1 / 3) and row[4] == "ab"


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_listing_has_every_name_and_any_root(spark, tmp_path, scheme):
    for rel in ("__init__.py", ".env", ".ssh/key", "_x/_y/z.md", "sub/a b.md", "empty"):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if rel == "empty" else f"text of {rel}")
    (tmp_path / "none").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    root = f"{scheme}{tmp_path}/"
    files = scan.list_files(spark, root)
    got = {r.rel_path: r for r in files.collect()}
    assert set(got) == {"__init__.py", ".env", ".ssh/key", "_x/_y/z.md", "sub/a b.md", "empty", "link"}
    assert {r.path for r in got.values()} == {f"{tmp_path}/{rel}" for rel in got}
    assert got["link"].is_link and got["empty"].size == 0 and got[".env"].size == len("text of .env")
    verdicts = {r.rel_path: r.verdict for r in scan.classify(files, scan.reader_registry(spark)).collect()}
    assert verdicts[".env"] == "SENSITIVE" and verdicts[".ssh/key"] == "SENSITIVE_DIRECTORY" and verdicts["link"] == "LINK"
    texts = {r.path: bytes(r.content).decode() for r in scan.read_contents(spark, root).collect()}
    assert texts == {f"{tmp_path}/{rel}": "" if rel == "empty" else f"text of {rel}" for rel in got if rel != "link"}
    one = scan.read_contents(spark, root, files.where("rel_path = '.env'")).collect()
    assert [r.path for r in one] == [f"{tmp_path}/.env"]


def test_percentiles_leave_nulls_out(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("a", None)] * 10 + [("b", None)], "k string, v double")
    got = ordered.nearest_rank_percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    assert [tuple(r) for r in got] == [("a", 5.0, 10.0)]


def test_refused_events_leave_the_status(spark):
    from folioscope.operators import lifecycle

    log = [(1, 1, "publish"), (1, 2, "change"), (1, 5, "begin"), (1, 9, "change"), (1, 12, "publish"), (1, 13, "begin"),
           (1, 20, "publish"), (2, 3, "begin"), (2, 4, "fail"), (2, 30, "begin"), (3, 1, "publish")]
    rows = spark.createDataFrame(log, "base_id int, seq int, event string").repartition(4)
    want, status = [], {}
    for base, seq, event in log:
        target, sources = {n: (t, s) for n, t, s in lifecycle.TRANSITIONS}[event]
        before = status.get(base, "EMPTY")
        if before in sources:
            want.append((base, seq, before, target))
            status[base] = target
    for width in (1, 4, 65_536):
        got = lifecycle.legal_events(lifecycle.with_preceding_status(rows, width)).select(
            "base_id", "seq", "from_status", "to_status")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_bases_without_number_cost_no_call_each(spark):
    from folioscope.operators import lifecycle

    log = spark.createDataFrame([(f"b{i}", i, "begin") for i in range(40)] + [(None, 1, "begin"), ("b1", None, "begin"),
                                ("b1", 7, "publish"), ("b1", 7, "publish")], "base_id string, seq int, event string")
    found = lifecycle.with_preceding_status(log, 4)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in found.select("base_id", "seq", "from_status").collect())
    assert got == sorted([(f"b{i}", i, "EMPTY") for i in range(40)] + [("b1", 7, "BUILDING"), ("b1", 7, "READY")] * 2)


def test_frames_in_any_order_give_one_result():
    class State:
        exists = False

        def update(self, value):
            self.value = value

    import pandas as pd

    reports = pd.DataFrame({"seq": range(40), "raw_estimate": [50 + i for i in range(40)],
                            "actual_tokens": [(i * 37) % 200 for i in range(40)]})
    factors = set()
    for order in (range(40), reversed(range(40)), random.sample(range(40), 40)):
        mixed = reports.iloc[list(order)]
        out = list(deltas._learn(("m",), iter([mixed[:7], mixed[7:30], mixed[30:]]), State()))
        factors.add((round(out[0]["factor"][0], 12), out[0]["observations"][0]))
    plain = 1.0
    for r in reports[reports["actual_tokens"] > 0].itertuples():
        plain = 0.7 * plain + 0.3 * min(4.0, max(0.25, r.actual_tokens / r.raw_estimate))
    assert factors == {(round(plain, 12), int((reports["actual_tokens"] > 0).sum()))}


def test_a_changed_file_in_an_ignored_folder_does_not_count(spark):
    def hashed(*rows):
        files = spark.createDataFrame([("/r", *r) for r in rows], "root string, rel_path string, size long, modified_at long")
        return indexing.source_set_hash(files).first()

    kept = ("a.md", 3, 1)
    assert hashed(kept) == hashed(kept, ("x/node_modules/b.js", 5, 2))
    assert hashed(kept) != hashed(kept, ("x/b.js", 5, 2))
