"""BM25 over impact blocks against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.config import SearchRules
from folioscope.operators import impacts, sparse
from folioscope.operators.lexical import document_frequency
from folioscope.operators.queries import first_per_query
from folioscope.session import fresh_folder

RULES = SearchRules(limit=1, branch_minimum=5, block_postings=4, term_buckets=7, bucket_parts=2)


@pytest.fixture(scope="module")
def corpus(spark):
    """Common and rare words, a third of the chunks alike, chunks of very unequal length."""
    rng = random.Random(11)
    rows, postings = [], []
    for c in range(240):
        if c % 3 == 0:
            terms = {"common": 1.0, "shared": 2.0, "w3": 1.0}
        else:
            terms = {"common": 1.0} | {f"w{int(rng.paretovariate(0.7)) % 90}": float(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 30))}
        rows.append((f"c{c:03}", f"f{c % 11}.md", f"L{c}", ("md", "py")[c % 2]))
        postings += [(f"c{c:03}", t, w, sum(terms.values())) for t, w in terms.items()]
    meta = spark.createDataFrame(rows, "chunk_id string, file_name string, source_location string, extension string")
    held = spark.createDataFrame(postings, "chunk_id string, term string, weight double, doc_length double").repartition(5)
    stats = held.select("chunk_id", "doc_length").distinct().agg(
        F.count(F.lit(1)).alias("documents"), F.avg("doc_length").alias("average_length"))
    asked = [(q, t, 1.25) for q in range(25) for t in {"common", *(f"w{rng.randrange(90)}" for _ in range(q % 8))}]
    asked += [(90, "nowhere", 1.25), (91, "shared", 1.25)]
    terms = spark.createDataFrame(asked, "query_id int, term string, weight double")
    frequency = document_frequency(held)
    folder = fresh_folder(spark, "impacts-test")
    impacts.blocks(held, frequency, stats, RULES).write.partitionBy("bucket").parquet(folder)
    return held, meta, frequency, stats, terms, spark.read.parquet(folder)


@pytest.mark.parametrize("extension", [None, "PY"])
def test_hits_are_those_of_all_pairs(corpus, extension):
    held, meta, frequency, stats, terms, blocks = corpus
    scored = sparse.bm25_scores(held, terms, frequency, stats, RULES).join(
        meta.where(sparse.extension_matches(F.col("extension"), extension)), "chunk_id")
    want = first_per_query(scored, ["query_id"], sparse.branch_order(), 5).select("query_id", "chunk_id", "rank", "score")
    got = sparse.bm25_top(blocks, terms, frequency, stats, meta, RULES, extension)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_hold_every_posting_once_below_their_bound(corpus):
    held, _, _, _, _, blocks = corpus
    rows = blocks.collect()
    assert sorted((e["chunk_id"], r["term"]) for r in rows for e in r["entries"]) == sorted(
        (r["chunk_id"], r["term"]) for r in held.collect())
    for r in rows:
        values = [e["impact"] for e in r["entries"]]
        assert (r["bound"], r["least"], r["postings"]) == (max(values), min(values), len(values))
    # no block grows with the term's frequency; hashing fills slots unevenly
    assert max(len(r["entries"]) for r in rows) <= 6 * RULES.block_postings


def test_only_buckets_of_the_terms_are_read(spark, corpus):
    blocks, terms = corpus[5], spark.createDataFrame([(1, "w3"), (1, "w5")], "query_id int, term string")
    placed = terms.withColumn("bucket", impacts.bucket_of(F.col("term"), RULES))
    wanted = {r["bucket"] for r in placed.collect()}
    read = impacts.read_buckets(blocks, placed)
    scan = read._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == len(wanted) < RULES.term_buckets
    assert "PartitionFilters: [bucket" in scan.toString() or "bucket" in str(scan.partitionFilters().mkString(","))


def test_chunks_below_the_floor_are_not_scored(corpus):
    held, _, frequency, stats, terms, blocks = corpus
    weighed = impacts.gains(terms, frequency, stats).withColumn("bucket", impacts.bucket_of(F.col("term"), RULES))
    bounded = impacts.bounded_terms(blocks, weighed, False, RULES)
    able = {(r["query_id"], r["chunk_id"]) for r in impacts.candidates(blocks, bounded, None, RULES).collect()}
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in sparse.bm25_scores(held, terms, frequency, stats, RULES).collect()}
    assert len(able) < len(scores) / 2
    for query in {q for q, _ in scores}:
        best = sorted((s for (q, _), s in scores.items() if q == query), reverse=True)[:5]
        assert all((q, c) in able for (q, c), s in scores.items() if q == query and s > best[-1] + 1e-6)


def test_empty_tables(spark, corpus):
    _, meta, frequency, stats, terms, blocks = corpus
    assert sparse.bm25_top(blocks, terms.limit(0), frequency, stats, meta, RULES).count() == 0
    assert sparse.bm25_top(blocks.limit(0), terms, frequency, stats, meta, RULES).count() == 0


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_blocks_don_t_depend_on_batches_or_on_terms_of_one_hash(size):
    import pyarrow as pa

    # terms a and b share a key and come mixed; c is hot, in two slots
    rows = [(5, "ab"[i % 2], 0, None, f"c{i}", i / 10, i) for i in range(11)] + [
        (key, "c", key - 8, 9, f"h{key}{i}", 0.3 * i, key - 8) for key in (8, 9) for i in range(4)] + [(12, "d", 0, None, "z", 1.0, 3)]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
    names = ["key", "term", "hot_slot", "hot_df", "chunk_id", "impact", "hash"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + size]), kinds)], names=names)
               for i in range(0, len(rows), size)]
    got = [r for b in impacts._cut(RULES, iter(batches)) for r in b.to_pylist()]
    df = {"a": 6, "b": 5, "c": 9, "d": 1}
    want = {}
    for _, term, _, _, chunk, impact, code in rows:
        many = df[term] > RULES.block_postings
        key = (term, int(impact * RULES.impact_levels) if many else 0, code % -(-df[term] // RULES.block_postings) if many else 0)
        want.setdefault(key, []).append((chunk, impact))
    assert {(r["term"], r["level"], r["slot"]): sorted((e["chunk_id"], e["impact"]) for e in r["entries"]) for r in got} == {
        k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    assert all((r["bound"], r["least"], r["postings"]) == (max(x := [e["impact"] for e in r["entries"]]), min(x), len(x)) for r in got)


def test_postings_are_sorted_once_for_blocks(spark, corpus):
    held, _, frequency, stats, _, _ = corpus
    plan = impacts.blocks(held, frequency, stats, RULES)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_blocks_are_written_without_measuring_each_row(spark, monkeypatch):
    """Only while they are written, and the session's own limit stands afterwards, also after a failure."""
    from folioscope.plans import index
    from folioscope.session import narrow_rows

    limit, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    blocks = impacts.blocks
    monkeypatch.setattr(impacts, "blocks", lambda *a: seen.append(spark.conf.get(limit, None)) or blocks(*a))
    chunks = spark.createDataFrame(
        [("c1", "/a", "a.md", "md", "L1", "some words")],
        "chunk_id string, path string, file_name string, extension string, source_location string, content string")
    built = index.index_chunks(chunks)
    seen.clear()
    stored = index.materialize(built, fresh_folder(spark, "narrow-test"))
    assert seen == [str(2**31 - 1)] and stored.impacts.count() == stored.postings.count() > 0
    assert spark.conf.get(limit, None) != str(2**31 - 1)
    spark.conf.set(limit, "4MB")
    try:
        with pytest.raises(ZeroDivisionError), narrow_rows(spark):
            1 / 0
        assert spark.conf.get(limit) == "4MB"
    finally:
        spark.conf.unset(limit)
