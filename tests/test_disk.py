"""What an index and its searches leave on disk and shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.config import SearchRules
from folioscope.operators import impacts, sparse
from folioscope.operators.lexical import document_frequency
from folioscope.operators.queries import first_per_query
from folioscope.session import cut_lineage, fresh_folder, stored


def disk_files(spark):
    """Shuffle files of this session."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks of words; one without an id, and postings of a chunk in several partitions."""
    rng = random.Random(4)
    meta = [(f"c{c:03}", f"f{c % 7}.md", f"L{c}", ("md", "py")[c % 3 == 0]) for c in range(150)]
    postings = [(c, t, float(rng.randrange(1, 4)), float(10 + n % 9)) for n, (c, *_) in enumerate(meta)
                for t in {f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(12)}]
    postings += [(None, t, 3.0, 1.0) for t in ("w1", "w2")]
    held = spark.createDataFrame(postings, "chunk_id string, term string, weight double, doc_length double").repartition(6)
    stats = spark.createDataFrame([(150, 12.0)], "documents long, average_length double")
    asked = spark.createDataFrame([(f"q{q}", f"w{t}", 1.25) for q in range(40) for t in rng.sample(range(60), 1 + q % 9)],
                                  "query_id string, term string, weight double")
    named = spark.createDataFrame(meta, "chunk_id string, file_name string, source_location string, extension string")
    return held, named, document_frequency(held), stats, asked


def test_stored_results_keep_no_shuffle_files(spark):
    frame = spark.range(2000).repartition(4, "id").groupBy((F.col("id") % 50).alias("k")).count()
    before = disk_files(spark)
    assert stored(frame, "disk-test").count() == cut_lineage(frame).count() == 50
    left = {f for f in disk_files(spark) - before if f.endswith(".data")}
    # counting the rows itself leaves a shuffle of one row for each count
    assert len(left) <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted(r["k"] for r in frame.collect()) == sorted(r["k"] for r in frame.collect())


def test_blocks_are_built_without_a_shuffle(spark, corpus):
    held, _, frequency, stats, _ = corpus
    source = fresh_folder(spark, "postings")
    held.write.parquet(source)
    plan = impacts.blocks(spark.read.parquet(source), frequency, stats)._jdf.queryExecution().sparkPlan().toString()
    assert "Repartition" not in plan and "Exchange hash" not in plan


@pytest.mark.parametrize("rules", [
    SearchRules(limit=1, branch_minimum=4, segment_postings=100, block_postings=8),
    SearchRules(limit=1, branch_minimum=4, segment_postings=1, block_postings=2, part_postings=50),
    SearchRules(limit=1, branch_minimum=4, shipped_terms=60)])
@pytest.mark.parametrize("extension", [None, "py"])
def test_segments_parts_and_turns_change_no_hit(spark, corpus, rules, extension):
    held, meta, frequency, stats, asked = corpus
    folder = fresh_folder(spark, "impacts")
    impacts.blocks(held, frequency, stats, rules).write.partitionBy("bucket").parquet(folder)
    got = sparse.bm25_top(spark.read.parquet(folder), asked, frequency, stats, meta, rules, extension)
    scored = sparse.bm25_scores(held, asked, frequency, stats, rules).join(
        meta.where(sparse.extension_matches(F.col("extension"), extension)), "chunk_id")
    want = first_per_query(scored, ["query_id"], sparse.branch_order(), 4).select("query_id", "chunk_id", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_search_shuffles_postings_once_for_all_queries(spark, corpus):
    """However many queries share a term, its postings go through the shuffle once, packed."""
    held, _, frequency, stats, _ = corpus
    blocks = impacts.blocks(held, frequency, stats)
    sent = []
    for queries in (1, 30):
        asked = spark.createDataFrame([(q, "w1", 1.25) for q in range(queries)], "query_id int, term string, weight double")
        weighed = stored(impacts.gains(asked, frequency, stats).withColumn("bucket", impacts.bucket_of(F.col("term"))), "weighed")
        found = impacts.candidates(blocks, impacts.bounded_terms(blocks, weighed, False, SearchRules()), None, SearchRules())
        plan = found._jdf.queryExecution().executedPlan()
        found.collect()
        text = plan.toString()
        assert "Generate" not in text and "body" in text
        sent.append(text.count("Exchange"))
    assert sent[0] == sent[1]


def test_packed_columns_come_back():
    import numpy as np
    import pyarrow as pa

    columns = [np.array([3, 70_000, 0]), np.array([1, 255]), np.array([0.1, -2.5]), np.array([], np.int64)]
    part, body = impacts._packed(7, pa.array(["a", "ñ퟿", ""]), *columns)
    names, *got = impacts._unpacked(body)
    assert part == 7 and names == ["a", "ñ퟿", ""] and all((a == b).all() and len(a) == len(b) for a, b in zip(columns, got))


def chunks_of(spark, texts):
    return spark.createDataFrame(
        [(f"c{n}", f"/r/f{n // 4}.md", "/r", f"f{n // 4}.md", "md", n * 10, n * 10 + 9, f"L{n}", t, 0) for n, t in enumerate(texts)],
        "chunk_id string, path string, root string, file_name string, extension string,"
        " start_line int, end_line int, source_location string, content string, modified_at long")


def test_texts_are_not_carried_along_for_every_query(spark, monkeypatch):
    """Neither the pool nor what is stored on the way holds a text, and a text is shuffled once for all its queries."""
    from folioscope.operators import dense
    from folioscope.plans import search as plan
    from folioscope.plans.index import index_chunks, materialize

    chunks = chunks_of(spark, ["alpha beta", "alpha gamma(", "def delta beta", "beta"] * 3)
    index = materialize(index_chunks(dense.with_vectors(chunks, F.col("content"))), fresh_folder(spark, "texts-test"))
    kept, cut = [], plan.cut_lineage
    monkeypatch.setattr(plan, "cut_lineage", lambda f: kept.append(f.columns) or cut(f))
    asked = spark.createDataFrame([(q, "alpha beta") for q in range(5)], "query_id int, text string")
    hits = plan.search(index, asked, "RRF_RERANK")
    named = plan.with_chunks(hits, index)
    assert not any("content" in c or "embedding" in c for c in kept) and len(kept) >= 4
    plan_text = named._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan_text
    found = {r["chunk_id"]: r["content"] for r in named.collect()}
    assert found == {r["chunk_id"]: r["content"] for r in chunks.collect() if r["chunk_id"] in found} and found


def test_ids_that_stand_for_several_chunks(spark):
    """Each candidate of such an id is described by one of its texts, none by both."""
    from folioscope.operators import fusion, lexical, queries

    chunks = chunks_of(spark, ["def alpha one", "beta two"]).withColumn("chunk_id", F.lit("same")).withColumn(
        "file_name", F.concat("source_location", F.lit(".md")))
    asked = queries.analyze(spark.createDataFrame([(1, "where is alpha defined"), (2, "beta")], "query_id int, text string"))
    terms = queries.query_terms(asked)
    postings = lexical.chunk_postings(chunks)
    stats = lexical.corpus_stats(chunks, postings)
    pairs = asked.select("query_id").crossJoin(chunks.select("chunk_id", "file_name", "path", "extension"))
    got = fusion.lexical_features(pairs, asked, terms, postings, lexical.document_frequency(postings), stats, chunks).collect()
    assert len(got) == 4 and sum(r["declaration_match"] for r in got if r["query_id"] == 1) == 1
    assert sum(r["exact"] for r in got if r["query_id"] == 2) == 1
    twice = fusion.lexical_features(pairs.unionByName(pairs), asked, terms, postings, lexical.document_frequency(postings), stats, chunks)
    assert twice.count() == 8


def test_neighbours_move_no_text_that_nobody_reads(spark):
    from folioscope.operators import context

    chunks = chunks_of(spark, ["one", "two", "three", "four"])
    source = fresh_folder(spark, "chunks")
    chunks.write.parquet(source)
    picked = spark.createDataFrame([(1, 1, "c1", 0.9, "r")], "query_id int, pick int, chunk_id string, score double, reason string")
    grown = context.expand_neighbours(picked, spark.read.parquet(source))
    assert [r["content"] for r in grown.collect()] == ["one\n\ntwo\n\nthree"]
    where = grown.select("query_id", "rank", "chunk_id", "start_line", "end_line")
    assert "lag(content" in grown._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(content" not in where._jdf.queryExecution().optimizedPlan().toString()


def test_turns_do_all_rows_and_leave_only_their_results(spark):
    """What a turn stores on the way is deleted with it; rows without a key are done, too."""
    import os
    from urllib.parse import urlparse

    from folioscope.session import in_turns

    rows = spark.createDataFrame([(f"k{n % 40}" if n % 9 else None, n) for n in range(300)], "key string, n int")
    folders, sizes = [], []

    def step(part):
        kept = stored(part, "on-the-way")
        folders.append(os.path.dirname(urlparse(kept.inputFiles()[0]).path))
        sizes.append(cut_lineage(kept.select("key").distinct()).count())
        return kept.withColumn("twice", F.col("n") * 2)

    done = in_turns(rows, "key", 60, step, "turns-test")
    assert len(sizes) == 5 and sum(sizes) == 41
    assert sorted(map(str, done.collect())) == sorted(map(str, rows.withColumn("twice", F.col("n") * 2).collect()))
    assert len(set(folders)) == 5 and not any(map(os.path.exists, folders))
    with pytest.raises(ZeroDivisionError):
        in_turns(rows, "key", 600, lambda part: 1 / 0, "turns-test")
    assert "turn" not in os.path.basename(os.path.dirname(fresh_folder(spark, "after")))


def test_evidence_is_the_same_in_one_turn_and_in_many(spark):
    from folioscope.config import EvidenceRules
    from folioscope.operators import dense
    from folioscope.plans.ask import collect_evidence
    from folioscope.plans.index import index_chunks, materialize

    words = "alpha beta gamma delta cache retry pool".split()
    chunks = chunks_of(spark, [" ".join(words[(n * k) % 7] for k in range(1, 6)) for n in range(16)])
    index = materialize(index_chunks(dense.with_vectors(chunks, F.col("content"))), fresh_folder(spark, "evidence-test"))
    turns = spark.createDataFrame([(c, 0, "user", f"{words[c]} and {words[-c]} in one place?") for c in range(5)],
                                  "conv_id long, turn long, role string, text string")
    replies = spark.createDataFrame([(f"{c}/0", 2, f'{{"action":"search","queries":["{words[c + 1]}"]}}', "stop") for c in range(4)],
                                    "question_id string, round int, raw string, finish_reason string")
    got = [sorted(map(tuple, collect_evidence(index, turns, replies, rules=EvidenceRules(turn_queries=n)).collect())) for n in (100, 2)]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == 5


def test_frequencies_of_hot_terms_take_no_second_join(spark):
    from folioscope.operators import lexical

    rows = [(f"c{n}", t, 1.0, 2.0) for n in range(200) for t in ("hot", f"rare{n % 150}")] + [("c0", "unknown", 1.0, 2.0)]
    postings = spark.createDataFrame(rows, "chunk_id string, term string, weight double, doc_length double")
    frequency = lexical.document_frequency(postings).where("term <> 'unknown'")
    stats = spark.createDataFrame([(200, 2.0)], "documents long, average_length double")
    found = lexical.with_document_frequency(postings, frequency, stats)
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["chunk_id"], r["term"], r["df"]) for r in found.collect())
    df = {r["term"]: r["df"] for r in frequency.collect()}
    assert got == sorted((c, t, df.get(t, 0)) for c, t, *_ in rows) and df["hot"] == 200
