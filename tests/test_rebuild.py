"""The rebuild job on a real folder: what it opens, what it keeps, what it publishes."""

from pyspark.sql import functions as F

from folioscope.config import ScanRules
from folioscope.operators import lexical
from folioscope.plans import rebuild, search
from folioscope.plans.index import build_index, index_chunks
from folioscope.sources import decode, scan, snapshot

LINES = "\n".join(f"line {i} tells of retry policy number {i} in some detail" for i in range(40))


def test_rebuilds_open_only_what_changed(spark, tmp_path):
    source, target = tmp_path / "docs", str(tmp_path / "index")
    (source / "sub").mkdir(parents=True)
    for name in ("a.md", "b.md", "sub/c.py", "__init__.py"):
        (source / name).write_text(f"{name}\n{LINES}\n")
    (source / "bin.txt").write_bytes(b"\0\1\2 no text")
    (source / "p.html").write_text(f"<title>Page</title><main><h2>Head</h2><p>{LINES}</p></main>")
    (source / "q.html").write_text("<div></div>")
    (source / ".env").write_text("SECRET=1")
    opened = []

    def read(files):
        wanted = files.select("path", "rel_path")
        opened[-1].update(r.rel_path for r in wanted.collect())
        return scan.read_contents(spark, str(source), wanted)

    def build(revision, signature="hashed:64"):
        opened.append(set())
        return rebuild.rebuild(spark, lambda: scan.list_files(spark, str(source)), read, target, "kb", revision, signature)

    def stored():
        return sorted(r.chunk_id for r in rebuild.published_index(spark, target).chunks.collect())

    def full():
        files = scan.classify(scan.list_files(spark, str(source)), scan.reader_registry(spark)).where("verdict = 'ACCEPTED'")
        contents = files.join(scan.read_contents(spark, str(source), files), "path")
        plain = build_index(decode.text_documents(contents.where("rel_path not like '%.html'")), None).chunks
        return sorted(r.chunk_id for r in plain.collect())

    def plain_stored():
        return sorted(r.chunk_id for r in rebuild.published_index(spark, target).chunks.where(
            "extension <> 'html'").collect())

    first = build(1)
    assert first.published and {r.rel_path for r in first.plan.collect()} == {
        "a.md", "b.md", "sub/c.py", "__init__.py", "bin.txt", "p.html", "q.html"}
    assert {r.path for r in first.unreadable.collect()} == {f"{source}/bin.txt", f"{source}/q.html"}
    assert plain_stored() == full() and len(stored()) > len(full()) >= 8

    (source / "a.md").write_text(f"changed\n{LINES}\nand more of it")
    (source / "b.md").unlink()
    (source / "d.md").write_text(LINES)
    second = build(2)
    assert second.published and {r.rel_path: r.change for r in second.plan.collect()} == {
        "a.md": "MODIFIED", "b.md": "DELETED", "d.md": "ADDED", "sub/c.py": "REUSED", "__init__.py": "REUSED", "bin.txt": "REUSED",
        "p.html": "REUSED", "q.html": "REUSED"}
    assert opened[1] == {"a.md", "d.md"} and plain_stored() == full()

    third = build(3, signature="another model")
    assert {r.change for r in third.plan.collect()} == {"MODIFIED"} and opened[2] == {"a.md", "d.md", "sub/c.py", "__init__.py", "bin.txt",
                                                                                        "p.html", "q.html"}
    assert plain_stored() == full()
    index = rebuild.published_index(spark, target, "hashed:64")
    assert index.chunks.where(F.col("embedding").isNotNull()).count() == 0
    asked = spark.createDataFrame([(1, "retry policy")], "query_id int, text string")
    assert search.search(rebuild.published_index(spark, target, "another model"), asked, "RRF_RERANK").count() > 0
    assert snapshot.published_revision(spark, target) == 3


def test_rebuilt_postings_are_those_of_a_full_build(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "docs", str(tmp_path / "index")
    source.mkdir()
    for name in ("a.md", "b.md", "c.md"):
        (source / name).write_text(f"{name}\n{LINES}\n")
    taken = []
    derive = lexical.chunk_postings

    def watched(chunks):
        taken.append({r.chunk_id for r in chunks.select("chunk_id").collect()})
        return derive(chunks)

    monkeypatch.setattr(lexical, "chunk_postings", watched)

    def build(revision):
        return rebuild.rebuild(spark, lambda: scan.list_files(spark, str(source)),
                               lambda files: scan.read_contents(spark, str(source), files), target, "kb", revision)

    def tables():
        index = rebuild.published_index(spark, target)
        ids = {r.chunk_id for r in index.chunks.collect()}
        return ids, index, index_chunks(index.chunks)

    assert build(1).published
    assert len(taken) == 1
    before, _, _ = tables()
    assert taken[0] == before
    (source / "a.md").write_text(f"changed\n{LINES}\nand words that no other file has")
    (source / "b.md").unlink()
    taken.clear()
    assert build(2).published
    ids, index, full = tables()
    assert taken[0] == ids - before and 0 < len(taken[0]) < len(ids)
    for name in ("postings", "term_stats", "corpus_stats"):
        made, want = getattr(index, name), getattr(full, name)
        assert sorted(map(tuple, made.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    asked = spark.createDataFrame([(1, "words that no other file has"), (2, "retry policy number 7")], "query_id int, text string")
    for strategy in search.STRATEGIES:
        got = search.search(index, asked, strategy)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.search(full, asked, strategy).collect()))
        assert got.count() > 0


def test_files_that_cannot_be_read_are_warnings(spark, tmp_path):
    source, target = tmp_path / "docs", str(tmp_path / "index")
    source.mkdir()
    for name in ("a.md", "gone.md"):
        (source / name).write_text(f"{name}\n{LINES}\n")
    found = scan.list_files(spark, str(source))
    listed = spark.createDataFrame(found.collect(), found.schema)
    (source / "gone.md").unlink()
    done = rebuild.rebuild(spark, lambda: listed, lambda files: scan.read_contents(spark, str(source), files), target, "kb", 1)
    assert done.published
    assert [(r.path, r.skipped, "gone.md" in r.message) for r in done.unreadable.collect()] == [(f"{source}/gone.md", True, True)]
    assert {r.path for r in rebuild.published_index(spark, target).chunks.collect()} == {f"{source}/a.md"}


def test_a_change_during_the_build_is_not_published(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text(LINES)

    def read(files):
        (tmp_path / "x" / "new.md").write_text("appeared while the build ran, with enough text to count")
        return scan.read_contents(spark, str(tmp_path / "x"), files)

    done = rebuild.rebuild(spark, lambda: scan.list_files(spark, str(tmp_path / "x")), read, str(tmp_path / "out"), "kb", 1)
    assert not done.published and snapshot.published_revision(spark, str(tmp_path / "out")) is None


def test_a_source_above_the_budget_is_published_with_a_warning(spark, tmp_path):
    source, target = tmp_path / "docs", str(tmp_path / "index")
    source.mkdir()
    for name in ("a.md", "b.md", "c.md", "d.md"):
        (source / name).write_text(f"{name}\n{LINES}\n")

    def build(revision, **budget):
        return rebuild.rebuild(spark, lambda: scan.list_files(spark, str(source)),
                               lambda files: scan.read_contents(spark, str(source), files), target, "kb", revision,
                               scan_rules=ScanRules(**budget))

    def seen(done):
        return done.published, {r.rel_path: r.change for r in done.plan.collect()}, [
            (r.path, r.reader_id, r.skipped) for r in done.unreadable.collect()]

    cut = [("", "scan-budget", True)]
    assert seen(build(1, max_files=2)) == (True, {"a.md": "ADDED", "b.md": "ADDED"}, cut)
    assert snapshot.published_revision(spark, target) == 1
    assert {r.path for r in rebuild.published_index(spark, target).chunks.collect()} == {f"{source}/a.md", f"{source}/b.md"}
    size = (source / "a.md").stat().st_size
    assert seen(build(2, max_total_bytes=3 * size)) == (
        True, {"a.md": "REUSED", "b.md": "REUSED", "c.md": "ADDED"}, cut)
    assert seen(build(3)) == (True, {"a.md": "REUSED", "b.md": "REUSED", "c.md": "REUSED", "d.md": "ADDED"}, [])
