"""Streams: segments of an incremental index, deltas that come late, tables stored as folders."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from folioscope.catalog import maintenance
from folioscope.operators import chunking, lexical
from folioscope.streaming import deltas, incremental, segments

DOCUMENT = ("document_id string, path string, root string, file_name string, extension string, modified_at long,"
            " text string, seq long, deleted boolean")


def _batch(spark, rows):
    made = [(d, f"/r/{d}", "/r", f"{d}.md", "md", 1, text, seq, gone) for d, seq, text, gone in rows]
    return spark.createDataFrame(made, DOCUMENT)


def _contents(spark, folder, of=None):
    return {r.document_id: r.content for r in incremental.current(spark, folder, "chunks", of).collect()}


def _bytes(folder, table, segment):
    return sum(os.path.getsize(os.path.join(root, f)) for root, _, files in os.walk(f"{folder}/{table}/segment={segment}")
               for f in files if f.endswith(".parquet"))


def test_newest_version_of_each_document(spark, tmp_path):
    folder = str(tmp_path)
    state = {}
    batches = [
        [(f"d{n}", 1, f"first text of document {n} " + "with many words in it " * 200, False) for n in range(40)],
        [("d1", 5, "newest text of one", False), ("d2", 2, None, True), ("d2", 1, "older in the same batch", False)],
        [("d1", 3, "stale text of one", False), ("d2", 1, "comes back too late", False)],
        [("d3", 7, "third text of three", False), ("d3", 7, None, True), ("new", 1, "a new document here", False)],
        [("d2", 9, "document two again", False), ("d1", 5, "same seq comes later", False)],
        [("d4", 4, None, True)],
    ]
    for number, rows in enumerate(batches):
        incremental.apply_batch(spark, _batch(spark, rows), number, folder)
        for d, seq, text, gone in sorted(rows, key=lambda r: (r[1], r[3])):
            if d not in state or seq > state[d][0] or (gone and seq == state[d][0] and rows is state[d][3]):
                state[d] = (seq, text, gone, rows)
        want = {d: text.strip() for d, (_, text, gone, _) in state.items() if not gone}
        assert _contents(spark, folder) == want
    assert [tuple(s) for s in segments.live_segments(spark, folder)] == [
        (segments.named(0, 3), 1), (segments.named(4, 4), 0), (segments.named(5, 5), 0)]
    # a small batch writes little, whatever the index holds
    assert _bytes(folder, "postings", segments.named(4, 4)) * 4 < _bytes(folder, "postings", segments.named(0, 3))
    some = spark.createDataFrame([("d1",), ("d2",), ("d4",), ("none",)], "document_id string")
    assert _contents(spark, folder, some) == {"d1": "newest text of one", "d2": "document two again"}
    # postings are those of a full build of what is left
    whole = chunking.chunk_sections(chunking.text_sections(_batch(
        spark, [(d, s, text, False) for d, (s, text, gone, _) in state.items() if not gone])))
    columns = ["chunk_id", "term", "weight", "doc_length"]
    got = incremental.current(spark, folder, "postings").select(*columns)
    assert sorted(got.collect()) == sorted(lexical.chunk_postings(whole).select(*columns).collect())


def test_a_batch_that_is_run_again(spark, tmp_path):
    folder = str(tmp_path)
    batches = [[("a", 1, "text of a at first", False)], [("b", 1, "text of b at first", False)],
               [("a", 2, "text of a at last", False)], [("b", 2, None, True)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # the fourth one merges
            incremental.apply_batch(spark, _batch(spark, rows), number, folder)
    assert _contents(spark, folder) == {"a": "text of a at last"}
    assert segments.states(spark, folder) == [2, 3]
    assert sorted(os.listdir(f"{folder}/chunks"))[0] == f"segment={segments.named(0, 0)}"  # of state 2
    incremental.apply_batch(spark, _batch(spark, [("c", 1, None, True)]), 4, folder)
    incremental.apply_batch(spark, _batch(spark, []), 5, folder)
    assert sorted(n for n in os.listdir(f"{folder}/chunks") if n.startswith("segment")) == [
        f"segment={segments.named(*n)}" for n in ((0, 3), (4, 4), (5, 5))]
    assert _contents(spark, folder) == {"a": "text of a at last"}


def test_only_deletions(spark, tmp_path):
    incremental.apply_batch(spark, _batch(spark, [("a", 1, None, True)]), 0, str(tmp_path))
    assert _contents(spark, str(tmp_path)) == {}


def test_deltas_wait_for_their_turn(spark, tmp_path):
    schema = "stream_id string, seq long, stage string, text string, is_last boolean"
    batches = [[("s", 2, "ANSWER", "nk>three", True), ("s", 0, "ANSWER", "<think>one ", False), ("t", 1, "ANSWER", "b", True)],
               [("s", 0, "ANSWER", "again", False), ("t", 0, "PLANNING", "a", False)],
               [("s", 1, "ANSWER", "two</thi", False)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part-{n}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        part = next(f for f in os.listdir(f"{tmp_path}/part-{n}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/part-{n}/{part}", f"{tmp_path}/in/{n}.parquet")
        os.utime(f"{tmp_path}/in/{n}.parquet", (1_700_000_000 + n,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = maintenance._run(spark, deltas.reassemble(stream)).collect()
    assert {r.batch for r in out} == {0, 1, 2}

    def joined(stream_id, stage):
        return "".join(r.text for r in sorted(out, key=lambda r: r.seq) if (r.stream_id, r.stage) == (stream_id, stage))

    assert joined("s", "ANSWER_THINKING") == "one two" and joined("s", "ANSWER") == "three"
    assert joined("t", "PLANNING") == "a" and joined("t", "ANSWER") == "b"


@pytest.mark.parametrize("name", ["stream_calibration", "stream_reasoning", "stream_index_labels"])
def test_tables_in_parts(spark, sf_dir, tmp_path, name):
    for table in ("events", "conversations", "documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    query = maintenance.QUERIES[name]
    columns = sorted(query(spark, sf_dir).columns)
    whole, parts = (query(spark, d).select(*columns).withColumn("n", F.lit(1)) for d in (sf_dir, str(tmp_path)))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
