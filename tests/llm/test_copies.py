"""Near duplicates, repeats and connected components against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import components, near_duplicates, queries, repeats
from folioscope.session import ship_package
from tests.llm import helpers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_connected(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(500, i) for i in range(501, 560)] + [(7, 7)]
    name = {i: hashlib.md5(str(i).encode()).digest() for e in edges for i in e}
    made = spark.createDataFrame([(bytearray(name[a]), bytearray(name[b])) for a, b in edges], "a binary, b binary")
    root = {bytes(r["node"]): bytes(r["root"]) for r in components.connected(made).collect()}
    up = {i: i for i in name}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    linked = {i for e in edges if e[0] != e[1] for i in e}
    assert set(root) == {name[i] for i in linked}
    for a in linked:
        for b in linked:
            assert (find(a) == find(b)) == (root[name[a]] == root[name[b]])
    assert components.connected(made.limit(0)).count() == 0


def links(rows, threshold=0.8):
    """(doc_id, class_id, group_id, n_links) by comparing all pairs."""
    sets = [set(helpers.shingles(t)) for _, t in rows]
    order = [tuple(helpers.words(t)) for _, t in rows]
    near = [[i != j and (order[i] == order[j] or bool(a | b) and len(a & b) >= threshold * len(a | b))
             for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for i, own in enumerate(near):
        for j, linked in enumerate(own):
            if linked and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]

    def least(ids):
        return min((i for i in ids if i is not None), default=None)

    return sorted(((rows[i][0], least(rows[j][0] for j in range(len(rows)) if order[i] == order[j]),
                    least(rows[j][0] for j in range(len(rows)) if group[i] == group[j]), sum(near[i]))
                   for i in range(len(rows))), key=repr)


NAMES = ("doc_id", "class_id", "group_id", "n_links")


def near_copies(n, seed=5):
    random.seed(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(random.randrange(4)):
            own[random.randrange(len(own))] = f"e{random.randrange(50)}"
        rows.append((1000 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [near_duplicates.BLOCK, 4])
def test_near_duplicates_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = helpers.odd_rows() + near_copies(40) + [(60, "tiny text"), (61, "Tiny, text!"), (62, "tiny texts")]
    # ids that stand for one text each: a null or repeated id may name several classes
    assert helpers.rows_of(near_duplicates.similar(helpers.frame(spark, rows)), *NAMES) == links(rows)
    assert near_duplicates.similar(helpers.frame(spark, [])).count() == 0
    assert helpers.rows_of(near_duplicates.similar(helpers.frame(spark, [(1, None)])), *NAMES) == [(1, 1, 1, 0)]


def test_near_duplicates_of_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert helpers.rows_of(queries.op5_ngram_join(spark, sf_dir), *NAMES) == links(rows)


def test_prefixes_are_shortened_to_the_recall():
    assert near_duplicates.shortened() == 4
    assert near_duplicates.shortened(recall=0.5) == near_duplicates.DEPTH
    assert near_duplicates.shortened(threshold=0.1) == 1


@given(st.lists(st.tuples(st.integers(0, 3), st.binary(min_size=4, max_size=4)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_forest_is_that_of_all_pairs(rows):
    rows.sort()
    unit = np.array([u for u, _ in rows], int)
    signature = np.array([list(s) for _, s in rows], np.uint8).reshape(-1, 4) % 3
    label = near_duplicates.agreeing_forest(unit, signature, 0.75)
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] == unit[j] and (signature[i] == signature[j]).mean() >= 0.75:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert label.tolist() == want


def removal(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting all windows."""
    count = {}
    data = [(t or "").encode() for _, t in rows]
    for x in data:
        for s in range(len(x) - length + 1):
            count[x[s:s + length]] = count.get(x[s:s + length], 0) + 1
    out = []
    for (i, _), x in zip(rows, data, strict=True):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - length + 1):
            if count[x[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


REMOVED = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("most", [repeats.MOST, 1])
def test_repeats_of_odd_rows(spark, most):
    passage = helpers.BASE + "This passage of more than two hundred bytes stands in several texts, some with other words around."
    random.seed(2)
    mixed = [(100 + i, f"start {i} {random.random()} {passage[random.randrange(40):]} {random.random()} end") for i in range(12)]
    rows = [r for r in helpers.odd_rows() if r[0] != 5] + mixed + [(200, "ab" * 500), (201, "x" * 199), (202, "x" * 199)]
    rows += [(203, helpers.long_text(4000)), (204, helpers.long_text(4000)[7000:9000] + "!")]
    got = repeats.repeats(helpers.frame(spark, rows), most=most)
    assert helpers.rows_of(got, *REMOVED) == removal(rows, 200)
    assert repeats.repeats(helpers.frame(spark, [])).count() == 0


def test_repeats_of_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert helpers.rows_of(queries.op8_repeats(spark, sf_dir), *REMOVED) == removal(rows, 200)


@given(st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=20)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_interleaving_sorts_and_tells_common_prefixes(rows):
    rows.sort(key=lambda r: r[0])
    unit = np.array([u for u, _ in rows], int)
    strings = [s for _, s in rows]
    order, common = repeats.interleave(unit, repeats._words(strings, 20))
    padded = [s.ljust(24, b"\0") for s in strings]
    assert [(unit[i], padded[i]) for i in order] == sorted((u, p) for u, p in zip(unit, padded, strict=True))
    for k in range(len(rows)):
        if k == 0 or unit[order[k]] != unit[order[k - 1]]:
            assert common[k] == -1
        else:
            a, b = padded[order[k - 1]], padded[order[k]]
            assert common[k] == next((i for i in range(24) if a[i] != b[i]), 24)


@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_each_window_has_the_anchor_of_its_bytes(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    row, h, _, place, least, most = repeats.anchors(np.frombuffer(b"".join(data), np.uint8), offsets, 12, 4)
    known, starts = {}, []
    for r, a, hash_, lo, hi in zip(row, place, h, least, most, strict=True):
        for d in range(lo, hi + 1):
            starts.append((r, a - d))
            assert known.setdefault(data[r][a - d:a - d + 12], (hash_, d)) == (hash_, d)
    assert sorted(starts) == [(r, s) for r, x in enumerate(data) for s in range(len(x) - 11)]
