import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.config import SearchRules
from folioscope.operators import context, dense, fusion, sparse
from folioscope.operators.lexical import chunk_postings, corpus_stats, document_frequency
from folioscope.plans.index import index_chunks
from folioscope.plans.search import search


def chunks_of(spark, rows):
    return spark.createDataFrame(
        [(c, p, "/r", p.split("/")[-1], "md", a, b, f"L{a}-{b}", t, 0)
         for c, p, a, b, t in rows],
        "chunk_id string, path string, root string, file_name string, extension string,"
        " start_line int, end_line int, source_location string, content string, modified_at long")


def test_bm25_golden(spark):
    postings = spark.createDataFrame(
        [("A", "alpha", 1.0, 2.0), ("A", "beta", 1.0, 2.0), ("B", "gamma", 1.0, 1.0)],
        "chunk_id string, term string, weight double, doc_length double")
    terms = spark.createDataFrame([(1, "alpha", 1.25)], "query_id int, term string, weight double")
    stats = spark.createDataFrame([(2, 1.5)], "documents long, average_length double")
    got = sparse.bm25_scores(postings, terms, document_frequency(postings), stats).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("A", 0.753421)]


def test_rrf_golden(spark):
    hit = spark.createDataFrame([(1, "A", 1, 5.0), (1, "B", 2, 4.0)],
                                "query_id int, chunk_id string, rank int, score double")
    near = spark.createDataFrame([(1, "A", 1, 0.9), (1, "C", 2, 0.5)],
                                 "query_id int, chunk_id string, rank int, score double")
    got = {r.chunk_id: r for r in fusion.fuse(hit, near).collect()}
    assert got["A"].fusion == 1.0 and got["A"].bm25 == 1.0
    assert got["B"].fusion == pytest.approx((1 / 62) / (2 / 61))
    assert got["C"].bm25 == 0.0 and got["C"].dense == 0.5


def test_dense_paths_agree_and_match_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[200:] = vectors[0]          # a third of the rows are copies
    rows = [(f"c{i:03}", f"f{i % 7}", "", "md", [float(x) for x in v])
            for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(
        rows, "chunk_id string, file_name string, source_location string, extension string,"
              " embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(6)],
                                  "query_id int, embedding array<float>")
    shipped = dense.dense_top(corpus, asked, SearchRules())
    slabs = dense.dense_top(corpus, asked, SearchRules(vector_slab_bytes=8 * 60 * 2))
    joined = dense.dense_top(corpus, asked, SearchRules(max_shipped_vector_bytes=0,
                                                        vector_block_rows=64))
    key = ["query_id", "rank"]
    got = [tuple(r) for r in shipped.orderBy(*key).collect()]
    assert got == [tuple(r) for r in joined.orderBy(*key).collect()]
    assert got == [tuple(r) for r in slabs.orderBy(*key).collect()]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = []
    for q in range(6):
        scored = sorted((-round(float(unit[q] @ unit[i]), 9), rows[i][1], "", rows[i][0])
                        for i in range(300) if round(float(unit[q] @ unit[i]), 9) >= 0.15)
        want += [(q, s[3], n + 1) for n, s in enumerate(scored[:50])]
    assert [(a, b, c) for a, b, c, _ in got] == want


def test_round_robin(spark):
    hits = [(1, 1, 2, r, c) for r, c in enumerate("abcd", 1)] + [
        (1, 2, 2, r, c) for r, c in enumerate("axby", 1)]
    frame = spark.createDataFrame(
        [(q, f, n, r, c, 1.0 / r, "x") for q, f, n, r, c in hits],
        "query_id int, facet int, facets int, rank int, chunk_id string, score double,"
        " reason string")
    got = [r.chunk_id for r in context.interleave(frame, 5).orderBy("rank").collect()]
    assert got == ["a", "x", "b", "y", "c"]


def test_mmr_matches_plain_loop(spark):
    rng = random.Random(5)
    rows = [(1, n + 1, f"c{n}", f"/p{n % 4}", " ".join(rng.choices("red blue green gold".split()
             + [f"w{i}" for i in range(20)], k=12)), 1 - n * 0.02, "r") for n in range(25)]
    frame = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, path string,"
                                        " content string, score double, reason string")
    got = [r.chunk_id for r in context.select_diverse(frame, 5).orderBy("pick").collect()]
    picked = []
    while len(picked) < 5:
        def value(row):
            words, chosen = set(row[4].split()), [p for p in picked]
            sims = [max(len(words & set(p[4].split())) / len(words | set(p[4].split())),
                        0.35 if p[3] == row[3] else 0) for p in chosen]
            same = any(p[3] == row[3] for p in chosen)
            return row[5] * 0.78 - max(sims, default=0) * 0.22 - (0.08 if same else 0)
        free = [r for r in rows[:20] if r not in picked
                and sum(p[3] == r[3] for p in picked) < 2]
        picked.append(max(free, key=lambda r: (value(r), -r[1])))
    assert got == [p[2] for p in picked]


def test_neighbours_and_consumed_hits(spark):
    chunks = chunks_of(spark, [("a", "/r/x.md", 1, 5, "first part"), ("b", "/r/x.md", 6, 9, "middle"),
                               ("c", "/r/x.md", 10, 12, "last part"), ("d", "/r/y.md", 1, 2, "other")])
    picked = spark.createDataFrame([(1, 1, "b", 0.9, "r"), (1, 2, "c", 0.8, "r"), (1, 3, "d", 0.7, "r")],
                                   "query_id int, pick int, chunk_id string, score double, reason string")
    got = context.expand_neighbours(picked, chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [("b:context", 1), ("d", 2)]
    assert got[0].content == "first part\n\nmiddle\n\nlast part"
    assert got[0].source_location == "L1-5 — L10-12"


def test_evidence_budgets(spark):
    rows = []
    for n in range(10):     # first round: six at most, three per file, no half overlap
        rows.append(("q", 1, 1, n + 1, f"a{n}", f"/p{n // 5}", "L", n * 10, n * 10 + 9, 1.0))
    rows.append(("q", 2, 1, 1, "z", "/p0", "L", 0, 9, 1.0))
    for n in range(5):
        rows.append(("q", 2, 1, n + 2, f"b{n}", f"/n{n}", "L", 1, 2, 1.0))
    frame = spark.createDataFrame(
        rows, "question_id string, round int, query_no int, rank int, chunk_id string,"
              " path string, source_location string, start_line int, end_line int, score double")
    got = [r.chunk_id for r in context.accumulate_evidence(frame).orderBy("number").collect()]
    assert got == ["a0", "a1", "a2", "a5", "a6", "a7", "b0", "b1", "b2"]


def test_search_strategies_on_small_corpus(spark):
    rows = [(f"c{n}", f"/r/f{n // 4}.md", n * 10, n * 10 + 9, text) for n, text in enumerate(
        ["database connection pool settings", "how retry works on timeout", "alpha beta gamma",
         "alpha alpha beta"] + [f"filler word{n} text" for n in range(8)])]
    chunks = chunks_of(spark, rows)
    index = index_chunks(dense.with_vectors(chunks, F.col("content")))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "  "), (3, "jdbc 连接池")],
                                  "query_id int, text string")
    for strategy in ("BM25", "RRF", "RRF_RERANK"):
        hits = search(index, asked, strategy).orderBy("query_id", "rank").collect()
        first = {r.query_id: r.chunk_id for r in hits if r.rank == 1}
        assert first[1] in ("c2", "c3") and 2 not in first and first[3] == "c0", strategy
    postings = chunk_postings(chunks)
    assert corpus_stats(chunks, postings).first().documents == len(rows)
    assert math.isfinite(corpus_stats(chunks, postings).first().average_length)


def test_external_rerank_marks(spark):
    ranked = spark.createDataFrame(
        [(1, f"c{n}", n + 1, n + 1, 0.8 - n / 10) for n in range(4)],
        "query_id int, chunk_id string, pool_rank int, local_rank int, final double")
    outside = spark.createDataFrame([(1, 2, 0, 0.7), (1, 2, 1, 0.1), (1, 9, 2, 1.0),
                                     (1, 1, 3, float("nan"))],
                                    "query_id int, candidate_index int, position int, score double")
    got = [(r.chunk_id, round(r.score, 3)) for r in
           fusion.merge_external_scores(ranked, outside).orderBy("rank").collect()]
    assert got == [("c2", 0.7), ("c1", 0.0), ("c0", 0.2), ("c3", 0.125)]


def test_salts_do_not_change_scores(spark):
    rng = random.Random(8)
    rows = [(f"c{n}", f"/r/f{n % 9}.md", n, n, " ".join(
        ["common"] + rng.choices([f"w{i}" for i in range(30)], k=8))) for n in range(120)]
    index = index_chunks(chunks_of(spark, rows))
    terms = spark.createDataFrame([(q, t, 1.25) for q in range(3) for t in ("common", f"w{q}")],
                                  "query_id int, term string, weight double")
    got = [sorted(map(tuple, sparse.bm25_scores(
        index.postings, terms, index.term_stats, index.corpus_stats,
        SearchRules(term_salts=salts)).collect())) for salts in (1, 16)]
    assert got[0] == got[1] and len(got[0]) == 360


def test_best_of_a_block_takes_no_frame_per_query(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 8)).astype(np.float32)
    vectors[rng.random(90) < 0.7] = vectors[0]
    block = pd.DataFrame({"chunk_id": [f"c{i:02}" for i in rng.permutation(90)], "file_name": [f"f{i % 4}" for i in range(90)],
                          "source_location": [f"L{i % 3}" for i in range(90)], "embedding": list(vectors)})
    asked = dense._unit_rows(pd.Series([*rng.normal(size=(40, 8)), vectors[0], np.zeros(8)]))
    ids = np.array([f"q{i}" for i in range(len(asked))], dtype=object)
    rules, joined, concat = SearchRules(), [], pd.concat
    monkeypatch.setattr(dense.pd, "concat", lambda parts, **kw: joined.append(len(parts)) or concat(parts, **kw))
    got = dense._best_of_block(ids, asked, block, rules)
    assert joined == [1]
    scores = np.round(asked @ dense._unit_rows(block["embedding"]).T, rules.score_digits)
    want = []
    for q, line in zip(ids, scores):
        hits = sorted((-s, r.file_name, r.source_location, r.chunk_id) for s, r in zip(line, block.itertuples()) if s >= rules.dense_threshold)
        want += [(q, c, f, loc, -s) for s, f, loc, c in hits[:rules.branch_limit]]
    assert list(got.itertuples(index=False, name=None)) == want


def test_hashed_vectors_are_those_of_the_rule():
    import hashlib
    import re

    import numpy as np
    from folioscope.operators.dense import hashed_vectors

    texts = ["", "a b", "Red red RED blue-9", "caféau K1x İnci", "x\U0001f600yy zz9ß99 aa aa"]
    want = np.zeros((len(texts), 64), dtype=np.float32)
    for row, text in enumerate(texts):
        for word in re.findall("[a-z0-9]{2,}", text.lower()):
            digest = hashlib.md5(word.encode()).hexdigest()
            want[row, int(digest[:8], 16) % 64] += 1 if digest[8] < "8" else -1
    assert (hashed_vectors(texts) == want).all()
