import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import fixed, text as tx
from folioscope.operators import lexical

TEXTS = [
    "request_with_retry", "缓存", "如何连接数据库 JDBC 连接池", "XMLHttpRequest fooBar2Baz",
    "ＦＵＬＬ width ①", "a.b-c/d__e.fgh", "réque ñandú Straße", "src\\main\\App.java", "",
    "connection\n pool and  thread  pool", "数据库连接数据库", "hangul 한글 ｶﾞ",
]


#: Terms of a document, by hand from the rules: words 1.0; a Han run whole 1.0, its pairs and triples 0.9.
BY_HAND = {
    "XMLHttpRequest fooBar2Baz": {"xml": 1.0, "http": 1.0, "request": 1.0, "foo": 1.0, "bar2": 1.0, "baz": 1.0},
    "a.b-c/d__e.fgh": {"fgh": 1.0}, "": {}, "red Red_RED": {"red": 3.0},
    "réque ñandú": {"que": 1.0, "and": 1.0},
}


@pytest.mark.parametrize("query", [False, True])
def test_terms_of_plain_texts(spark, query):
    rows = spark.createDataFrame(list(enumerate(BY_HAND)), "id int, t string")
    got = {}
    for r in lexical.weighted_postings(rows, "id", "t", query).collect():
        got.setdefault(r.id, {})[r.term] = r.weight
    for i, (text, want) in enumerate(BY_HAND.items()):
        words = {t: w * (1.25 if query else 1.0) for t, w in want.items() if t not in fixed.STOP_WORDS}
        assert {t: w for t, w in got.get(i, {}).items() if not t.startswith("concept:")} == pytest.approx(words), text


@pytest.mark.parametrize("query", [False, True])
def test_terms_are_normal_and_add_up(spark, query):
    """Each text twice over weighs twice as much, concepts apart; width and case make no difference."""
    variants = [(i, v) for i, t in enumerate(TEXTS) for v in (t, t + " \n " + t, t.lower() if t.islower() else t)]
    rows = spark.createDataFrame([(n, v) for n, (_, v) in enumerate(variants)], "id int, t string")
    got = {n: {} for n in range(len(variants))}
    for r in lexical.weighted_postings(rows, "id", "t", query).collect():
        got[r.id][r.term] = r.weight
    for n in range(0, len(variants), 3):
        once, twice = got[n], got[n + 1]
        assert set(once) <= set(twice)
        for term, weight in once.items():
            assert twice[term] == pytest.approx(weight * (1 if term.startswith("concept:") else 2)), term
            assert term.startswith("concept:") or unicodedata.normalize("NFKC", term).lower() == term
            assert term not in fixed.STOP_WORDS


def test_goldens(spark):
    def terms(text, query):
        rows = spark.createDataFrame([(1, text)], "id int, t string")
        return {r.term: round(r.weight, 6)
                for r in lexical.weighted_postings(rows, "id", "t", query).collect()}

    assert terms("request_with_retry", False) == {
        "request": 1.0, "retry": 1.0, "concept:error-handling": 2.8}
    assert terms("缓存", False) == {"缓存": 1.9, "concept:cache": 2.8}
    assert terms("缓存", True) == {"缓存": 2.65, "concept:cache": 4.0}


def test_stable_ranges_are_nfkc_stable():
    for low, high in tx.NFKC_STABLE_RANGES:
        for code in range(low, high + 1):
            ch = chr(code)
            assert unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch)


def test_df_tfidf_norm_and_stats(spark):
    chunks = spark.createDataFrame(
        [("c1", "alpha.md", "L1", "alpha beta alpha"), ("c2", "b.md", "L1", "beta gamma"),
         ("c3", "x", "y", "")], "chunk_id string, file_name string, source_location string, content string")
    postings = lexical.chunk_postings(chunks)
    df = {r.term: r.df for r in lexical.document_frequency(postings).collect()}
    assert df["beta"] == 2 and df["alpha"] == 1 and df["md"] == 2 and df["l1"] == 2
    stats = lexical.corpus_stats(chunks, postings)
    row = stats.first()
    assert row.documents == 3
    # c1: alpha 3, md, l1, beta = 6; c2: md, l1, beta, gamma = 4 ('b' too short); c3: 1
    assert row.average_length == pytest.approx(11 / 3)
    weighted = lexical.tfidf(postings, lexical.document_frequency(postings), stats)
    got = {(r.chunk_id, r.term): r.tfidf for r in weighted.collect()}
    assert got[("c1", "alpha")] == pytest.approx((1 + math.log(3)) * math.log(1 + 4 / 2))
    assert got[("c2", "beta")] == pytest.approx(math.log(1 + 4 / 3))
    norms = {r.chunk_id: r.norm for r in lexical.document_stats(weighted).collect()}
    want = math.sqrt(sum(v * v for (c, _), v in got.items() if c == "c1"))
    assert norms["c1"] == pytest.approx(want)


def test_postings_take_one_exchange(spark):
    from folioscope.operators import lexical

    texts = spark.createDataFrame([("a", "someName and some words"), ("b", "words")], "id string, text string")
    plan = lexical.weighted_postings(texts, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_task_never_holds_the_postings_of_all_its_texts(spark):
    rows = [(i % 40, f"alpha beta w{i} \u56fe\u8c31 alpha") for i in range(60)] + [(None, "gamma x1"), (None, "gamma x2"), (7, None), (8, "")]
    found = lexical.weighted_postings(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    got = {(r["id"], r["term"]): (r["weight"], r["doc_length"]) for r in found.collect()}
    assert got[(39, "alpha")][0] == 2.0 and got[(3, "alpha")][0] == 4.0 and got[(3, "w43")][0] == 1.0
    assert got[(None, "gamma")] == (2.0, 2.0) and (None, "x2") in got
    assert len(got) == len(found.collect())


def test_postings_that_leave_in_parts_are_complete(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "BATCH", 2)
    keys, texts = [1, 1, 2, 3, 3, 3, 4], ["aa bb cc", "aa", "aa bb dd ee", "ff", "ff", None, "!"]
    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
    batches = [pa.record_batch([pa.array([k]), pa.array([t], pa.string()), pa.array([[]], kind)], names=["key", "text", "terms"])
               for k, t in zip(keys, texts)]
    parts = list(lexical._counted(1.0, pa.int64(), iter(batches)))
    got = sorted((r["key"], r["term"], r["weight"]) for b in parts for r in b.to_pylist())
    assert len(parts) > 1 and got == [(1, "aa", 2.0), (1, "bb", 1.0), (1, "cc", 1.0), (2, "aa", 1.0), (2, "bb", 1.0),
                                      (2, "dd", 1.0), (2, "ee", 1.0), (3, "ff", 2.0)]


def test_capitals_that_begin_a_word(spark):
    """As a boundary on both sides of nothing splits, without looking at every place of a text."""
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("aB1C d_é") for _ in range(rng.randrange(12))) for _ in range(400)] + ["aBCdEF", "XMLFile9Z", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    assert rows.where(~tx.split_camel(F.col("t")).eqNullSafe(F.regexp_replace("t", both, " "))).count() == 0
    assert not tx.CAMEL_START.startswith("(?<=")


def test_concepts_of_documents_are_found_where_words_are_counted(spark):
    """Every phrase as written, spread over lines, and inside other words, against the column function."""
    phrases = [p for of in fixed.CONCEPTS.values() for p in of]
    texts = [v for p in phrases for v in (p, p.replace(" ", " \t\n\r "), f"x{p.upper()}y", p[:-1], p.replace(" ", " "))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = lexical.weighted_postings(rows, "id", "t")
    # the lexicon is no longer searched phrase by phrase in a column expression
    assert "concept:" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.term): r.weight for r in found.where("startswith(term, 'concept:')").collect()}
    want = lexical._wide_terms(lexical._normalized(rows, "t"), lexical.DOCUMENT_WEIGHTS).select("id", F.inline("terms"))
    assert got == {(r.id, r.term): r.weight for r in want.where("startswith(term, 'concept:')").collect()} and got


def test_words_end_at_signs_outside_ascii(spark):
    import re

    texts = ["caféau lait", "a b cc K1x İnci", "x\U0001f600yy zz9ß99", "中文abc中d ee?ff"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    normal = {r.id: r.n for r in rows.select("id", tx.normalize_text(F.col("t")).alias("n")).collect()}
    got = {(r.id, r.term) for r in lexical.weighted_postings(rows, "id", "t").collect() if r.term.isascii()}
    assert got == {(i, w) for i, n in normal.items() for w in re.findall("[a-z0-9]{2,}", n) if w not in fixed.STOP_WORDS}
