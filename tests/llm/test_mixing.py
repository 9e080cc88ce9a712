"""Mixing of sources against plain statements of targets, sums and choices."""

import itertools
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import mixing, queries
from folioscope.session import ship_package
from tests.llm import helpers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Excess above a limit is dealt out again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), sum(sizes.values()) * share
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), max_size=6, unique_by=lambda x: x[0]), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_nearest_sum_is_that_of_all_choices(lengths, budget):
    sizes, counts = [s for s, _ in lengths], [c for _, c in lengths]
    taken = mixing.nearest_sum(sizes, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    sums = {sum(s * t for s, t in zip(sizes, choice, strict=True)) for choice in itertools.product(*(range(c + 1) for c in counts))}
    assert abs(sum(s * t for s, t in zip(sizes, taken, strict=True)) - budget) == min(abs(x - budget) for x in sums)


@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]),
       st.floats(0, 1.1), st.sampled_from([1, 50, mixing.REACH]))
@settings(max_examples=200, deadline=None)
def test_lengths_fill_a_budget(lengths, part, reach):
    sizes, counts = [s for s, _ in lengths], [c for _, c in lengths]
    total = sum(s * c for s, c in lengths)
    budget = int(total * part)
    taken = mixing.fit(sizes, counts, budget, reach=reach)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    filled = sum(s * t for s, t in zip(sizes, taken, strict=True))
    assert abs(filled - min(budget, total)) <= max(sizes) / 2
    # each length gives its share at least
    assert all(t >= c * min(budget, total) // total for t, c in zip(taken, counts, strict=True))


def rows_with_sources():
    odd = [(i, t, s) for (i, t), s in zip(helpers.odd_rows(), itertools.cycle(["b", None, "a", "é", ""]), strict=False)]
    many = [(100 + i, "w " * (i % 7 + 1), "hot") for i in range(400)]
    same = [(None, None, "hot")] * 30 + [(600, "the same text", "hot")] * 41
    return odd + many + same + [(700 + i, "x " * 50, f"s{i}") for i in range(5)]


SCHEMA = "doc_id long, text string, source string"


def checked(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    want = plain_targets(sizes)
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(
        ((i, s, size(t)) for i, t, s in rows), key=repr)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for source, target in want.items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1
    return taken


def test_odd_rows(spark):
    rows = rows_with_sources()
    made = helpers.frame(spark, rows, SCHEMA)
    got = mixing.mix(made).collect()
    taken = checked(rows, got)
    assert taken["hot"] == round(plain_targets(Counter({s: sum(size(t) for _, t, x in rows if x == s) for s in {
        r[2] for r in rows}}))["hot"])
    again = mixing.mix(made.repartition(7, "text")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_empty_tables_and_wordless_texts(spark):
    assert mixing.mix(helpers.frame(spark, [], SCHEMA)).count() == 0
    got = mixing.mix(helpers.frame(spark, [(1, None, "a"), (2, " ", None), (3, "", "b")], SCHEMA)).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 3
    with pytest.raises(ValueError):
        mixing.mix(helpers.frame(spark, [(1, "a", "a")], SCHEMA), share=3.0)


def test_a_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    checked(rows, queries.op13_mixing(spark, sf_dir).collect())
