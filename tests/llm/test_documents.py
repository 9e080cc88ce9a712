"""Decontamination, fingerprints and licences against plain statements, on odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, fingerprints, licenses, queries
from folioscope.session import ship_package
from tests.llm import helpers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def contamination(documents, items, size):
    tests = {}
    for item, text in items:
        w = helpers.words(text)
        n = min(len(w), size)
        for i in range(len(w) - n + 1 if n else 0):
            tests.setdefault(tuple(w[i:i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in documents:
        w, hit, ids = helpers.words(text), set(), set()
        for n in {len(k) for k in tests}:
            for i in range(len(w) - n + 1):
                found = tests.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rows = helpers.odd_rows() + [(20, "a b c d e f g h i j k l"), (21, "x A B, C! D e f g h I j")]
    items = [(1, helpers.BASE), (2, helpers.BASE), (3, "one"), (None, "seven eight"), (4, None), (5, ""), (6, "..."),
             (7, helpers.BASE), (7, "another text that isn't there at all and is long enough"), (8, "b c d e f g h i j k"),
             (9, "A b C d E f G h I j"), (3, "one"), (10, "two two")]
    made = helpers.frame(spark, items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = helpers.rows_of(decontaminate.decontaminate(helpers.frame(spark, rows), made), *names)
    assert got == contamination(rows, items, 10)
    empty = helpers.frame(spark, [], "item_id long, text string")
    assert helpers.rows_of(decontaminate.decontaminate(helpers.frame(spark, rows), empty), *names) == contamination(rows, [], 10)
    assert decontaminate.decontaminate(helpers.frame(spark, []), made).count() == 0


def generalised(a, b):
    every = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in every) / max(1, sum(max(a[x], b[x]) for x in every))


def test_fingerprints_of_odd_rows(spark):
    rows = helpers.odd_rows()
    got = fingerprints.edited_likeness(helpers.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    known = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is not None and [i for i, _ in rows].count(r["doc_id"]) == 1:
            text = texts[r["doc_id"]] or ""
            assert r["n_chars"] == len(text)
            assert known.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 7)} == {""}
    alone = fingerprints.edited_likeness(helpers.frame(spark, [(1, "abcdefgh")])).collect()
    assert [r["edited_sha256"] for r in alone] == [hashlib.sha256(b"abcdefab").hexdigest()]
    assert fingerprints.edited_likeness(helpers.frame(spark, [])).count() == 0


def test_fingerprints_keep_what_goes_with_the_keys(spark):
    """Also for texts without words, and without another shuffle, so that nothing is joined to them again."""
    rows = [(1, 11, "", " .,"), (2, -5, "", "one"), (3, 12, "one two", ""), (3, 13, "one two", "one two")]
    frame = spark.createDataFrame(rows, "id long, sum long, text string, edited string").repartition(4, "id")
    found = fingerprints.fingerprints(frame, ["id", "sum"], ("text", "edited"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["id"], r["sum"]): (set(r["text"]) == {-1}, set(r["edited"]) == {-1}) for r in found.collect()}
    assert got == {(1, 11): (True, True), (2, -5): (True, False), (3, 12): (False, True), (3, 13): (False, False)}


def near(estimate, want, samples=fingerprints.SAMPLES):
    """Within four standard deviations and two samples, the step of an estimate."""
    return abs(estimate - want) <= 4 * (want * (1 - want) / samples) ** 0.5 + 2 / samples


def test_fingerprints_estimate_likeness(spark):
    table = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, table).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{table}/documents.parquet").collect())
    errors, known = [], {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 4
        edited = text[:len(text) - k] + after[:k]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert known.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for column, other in (("near_edited", edited), ("near_next", after)):
            want = generalised(helpers.shingles(text), helpers.shingles(other))
            assert near(r[column], want), (i, column, r[column], want)
            errors.append(r[column] - want)
    assert len(got) == len(rows)
    assert sum(map(abs, errors)) / len(errors) < 0.03 and abs(sum(errors) / len(errors)) < 0.003


def test_weight_on_few_terms(spark):
    """Repeats put most of the weight on few terms, and the fingerprints follow the weights."""
    rows, own = [], [[f"{x}{i}" for i in range(100)] for x in "ab"]
    for n in (1, 3, 40, 100, 400):
        for words in own:
            rows.append((len(rows), " ".join("one two three four five".split() * n + words)))
    rows += [(20, "p q r s t " * 9), (21, "p q r s t " * 9 + "u"), (22, "p q r s t u v w"), (23, "p q r s t u v x")]
    texts = [t for _, t in sorted(rows)]
    got = sorted(fingerprints.edited_likeness(helpers.frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    for r, text, after in zip(got, texts, texts[1:] + texts[:1], strict=True):
        want = generalised(helpers.shingles(text), helpers.shingles(after))
        assert near(r["near_next"], want), (r["doc_id"], r["near_next"], want)


@pytest.mark.parametrize(("one", "other"), [(3, 1), (5, 4), (400, 300), (2, 1)])
def test_weights_count(spark, one, other):
    """A one:other mix against an other:one mix of two terms agrees as the lesser weights over the greater."""
    made = spark.range(4000).withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.col("id"), F.lit(7).alias("number"), F.xxhash64("id", F.floor(F.col("pick") / 2)).alias("term"),
        F.when(F.col("pick").isin(0, 3), one).otherwise(other).alias("weight"), F.col("pick") % 2 == 0)
    side = made.columns[-1]
    best = fingerprints.sampled(made).groupBy("id", side).agg(F.max("drawn").alias("best"))
    rate = best.groupBy("id").agg((F.min("best") == F.max("best")).cast("int").alias("same")).agg(F.avg("same")).first()[0]
    assert abs(rate - other / one) < 0.03


def licence_places(text):
    w = helpers.words(text)
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


def test_licences(spark):
    rows = helpers.odd_rows() + [
        (30, "Released under the MIT License."), (31, "mit license mit license, The GENERAL public-license"),
        (32, "Licensed under CC BY-NC 4.0."), (33, "licensed under cc by 4.0 and words"),
        (34, "this work is licenced under the GNU General Public License, version 3"),
        (35, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
             " the following conditions are met:"), (36, "mit"), (37, "license"), (38, "apache license" * 3),
        (39, "redistribution and use in source and binary forms"), (40, helpers.long_text(3000) + " MIT\nlicense")]
    documents = helpers.frame(spark, rows)
    index = licenses.build_index(*licenses.document_frequencies(documents))
    found = licenses.scan(documents, index)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert helpers.rows_of(found, *names) == sorted(((i, *licence_places(t)) for i, t in rows), key=repr)
    labels = {r["doc_id"]: r["labels"] for r in found.collect()}
    assert [labels[i] for i in range(30, 40)] == ["mit", "gpl,mit", "cc-by-nc", "cc-by", "gpl", "bsd", "", "", "apache", ""] or \
        labels[38] == ""
    for r in found.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan(helpers.frame(spark, []), index).count() == 0
    none = licenses.build_index(*licenses.document_frequencies(helpers.frame(spark, [])))
    assert licenses.scan(documents, none).count() == len(rows)


def test_licence_query_counts_base_places(spark, sf_dir):
    got = helpers.rows_of(queries.op6_licenses(spark, sf_dir), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted(((r["doc_id"], *licence_places(r["text"])) for r in rows), key=repr)


def test_crc_of_ids_is_that_of_the_text(spark):
    from folioscope.llm.training import remainder

    got = spark.range(20).select("id", remainder(F.col("id"), 3).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)
