import math

import pytest
from pyspark.sql import functions as F

from folioscope.llm import quality, queries, toxicity
from folioscope.llm.training import labelled_sample, remainder
from folioscope.session import ship_package
from tests.llm import helpers

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    found = queries.queries()[name](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label)
    known = found.join(labels, "doc_id").where("held_out").toPandas()
    assert len(known) > 500
    assert (known["predicted"] == known[label]).mean() > least
    assert found.where("score not between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    assert found.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()


def test_held_out_rows_are_not_learned(spark):
    labels = spark.range(100).withColumns({"doc_id": F.col("id"), "toxic": (F.col("id") % 2).cast("int")})
    documents = labels.select("doc_id", F.lit("text").alias("text"), F.lit(1).alias("toxic"))
    import zlib

    got = {r["doc_id"]: r["label"] for r in labelled_sample(
        documents, labels, "toxic", remainder(F.col("doc_id"), 5) != 0, 1000).collect()}
    assert got == {i: i % 2 for i in range(100) if zlib.crc32(str(i).encode()) % 5}


def test_sample_is_bounded_by_rows(spark):
    labels = spark.range(10).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    documents = spark.range(20_000).select((F.when(F.col("id") < 15_000, 3).otherwise(F.col("id") % 10)).alias("doc_id"),
                                           F.col("id").cast("string").alias("text"))
    sizes = {r["label"]: r["count"] for r in labelled_sample(
        documents, labels, "toxic", F.lit(True), 1000).groupBy("label").count().collect()}
    assert all(800 < n < 1200 for n in sizes.values()) and len(sizes) == 2
    assert labelled_sample(documents, labels, "toxic", F.lit(True), 100_000).count() == 20_000


def test_texts_that_share_words_are_all_learned(spark):
    """One long word in common makes no copy; exact copies count once."""
    rows = [(i, f"commonword common {'bad' if i % 2 else 'ok'}{chr(97 + i % 26)}{chr(97 + i // 26)} zut" if i % 2 else
             f"commonword kind {chr(97 + i % 26)}{chr(97 + i // 26)}", i % 2) for i in range(200)]
    once = toxicity.learn(helpers.frame(spark, rows, "doc_id long, text string, label int"))
    assert abs(once.weights[" zut "] - math.log((100 + 0.5) / 101 / (0.5 / 101))) < 1e-12
    twice = toxicity.learn(helpers.frame(spark, rows + rows, "doc_id long, text string, label int"))
    assert twice.weights == once.weights


def test_features_are_counts_of_neighbours():
    import numpy as np

    data = b"Ab cd!! Ab"
    row, place, tokens = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert tokens.tolist() == [4] and len(row) == 4 * 2 + 3 * 2
    both = np.frombuffer(data * 2, np.uint8)
    again = quality.features(both, np.array([0, len(data), 2 * len(data)]))
    assert sorted(again[1][again[0] == 1].tolist()) == sorted(place.tolist())


def test_scores_of_odd_rows(spark):
    rows = helpers.odd_rows()
    sample = helpers.frame(spark, [(i, ("good plain words here " if i % 2 else "BAD!! NOISE!! $$$ ") * 5, i % 2)
                                   for i in range(60)], "doc_id long, text string, label int")
    model = quality.train(sample, bits=12, shards=2)
    got = helpers.rows_of(quality.score(helpers.frame(spark, rows), model), "doc_id", "score", "predicted")
    assert len(got) == len(rows)
    assert {s for i, s, _ in got if i in (1, 2)} == {s for i, s, _ in got if i == 2}
    new = {r["doc_id"]: r["predicted"] for r in quality.score(helpers.frame(
        spark, [(1, "good plain words here"), (2, "BAD!! NOISE!! $$$")]), model).collect()}
    assert new == {1: 1, 2: 0}
    empty = helpers.frame(spark, [], "doc_id long, text string")
    assert quality.score(empty, model).count() == 0
    none = quality.train(helpers.frame(spark, [], "doc_id long, text string, label int"), bits=12, shards=2)
    assert {s for _, s, _ in helpers.rows_of(quality.score(helpers.frame(spark, rows), none), "doc_id", "score", "predicted")} == {0.5}


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " clown ": 4.0, " lowei": 3.0}, ("clown fish",))
    automaton = lexicon.automaton()

    def weight(text):
        return toxicity.matched(automaton, text)[0]

    assert weight("You 1D10T!") == 5.0 and weight("an іdіоt here") == 5.0 and weight("id!ot idiots") == 0.0
    assert weight("a clown fish swims") == 0.0 and weight("a clown fishes, Clown!") == 8.0
    assert weight("loweichen loweisch") == 6.0 and weight("slowei") == 0.0
    assert toxicity.matched(automaton, "") == (0.0, 0, 0) and toxicity.matched(automaton, " .,") == (0.0, 0, 0)


def test_lexicon_is_learned(spark):
    def own(i):
        return "".join(chr(97 + (i * 7 + k * 11) % 26) for k in range(8)) + chr(97 + i // 26)

    mild = [(i, f"soft gentle words {own(i)} here", 0) for i in range(80)]
    bad = [(100 + i, f"soft words dreck{'abc'[i % 3]} {own(i)} zut here {own(i)}x", 1) for i in range(60)]
    lexicon = toxicity.learn(helpers.frame(spark, mild + bad, "doc_id long, text string, label int"))
    assert " zut " in lexicon.weights and " dreck" in lexicon.weights
    rows = helpers.odd_rows() + [(50, "Zut!"), (51, "drecka")]
    got = {(r["doc_id"], r["predicted"]) for r in toxicity.score(helpers.frame(spark, rows), lexicon).collect()}
    assert (50, 1) in got and (51, 1) in got and len([1 for _, p in got if p]) == 2
    kept = toxicity.keep_mild(helpers.frame(spark, rows), lexicon)
    assert kept.count() == len(rows) - 2 and "clash digest" in kept.first().asDict().values()
    none = toxicity.learn(helpers.frame(spark, mild, "doc_id long, text string, label int"))
    assert toxicity.score(helpers.frame(spark, rows), none).where("predicted = 1").count() == 0
