"""Divergence of sources against a plain statement over all terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import divergence
from folioscope.session import ship_package
from tests.llm import helpers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def plain(rows, least=3, top=200):
    count, docs, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(helpers.UPPER))
        groups[lang].add(source)
        docs.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for (x, w), n in docs.items() if x == lang and n >= least)
        total = {s: sum(count[lang, s, w] for w in kept) for s in sources}

        def p(n, of, kept=kept):
            return 1 + 10**9 * (n + 1) // (of + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s in sources:
            pairs = [(x, sum(f(p(count[lang, s, w], total[s]), p(count[lang, x, w], total[x])) for w in kept))
                     for x in sources if x != s]
            terms = []
            for w in kept:
                own, all_ = p(count[lang, s, w], total[s]), p(sum(count[lang, x, w] for x in sources), sum(total.values()))
                if count[lang, s, w] and own > all_:
                    terms.append((w, f(own, all_)))
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string"
NAMES = ("lang", "source", "part", "item", "value", "rank")


def corpus():
    rows = [(i, t, ("en", None, "de")[k % 3], ("a", "b", None, "é")[k % 4]) for k, (i, t) in enumerate(helpers.odd_rows())]
    for k in range(120):
        text = " ".join(f"T{chr(97 + (k * j) % 23)}{chr(97 + j % (5 + k % 9))} ñé" for j in range(40))
        rows.append((100 + k, text, ("en", "de")[k % 2], f"s{k % 5}"))
    return [*rows, (1, "", "xx", "only"), (2, None, "yy", "p"), (3, "1 2 3", "yy", "q")]


@pytest.mark.parametrize(("rows_of_a_bucket", "entries", "top"), [(divergence.ROWS, divergence.ENTRIES, 200), (40, 20, 7)])
def test_odd_rows(spark, monkeypatch, rows_of_a_bucket, entries, top):
    monkeypatch.setattr(divergence, "CELLS", 64)
    rows = corpus()
    got = divergence.audit(helpers.frame(spark, rows, SCHEMA), top=top, rows=rows_of_a_bucket)
    assert helpers.rows_of(got, *NAMES) == plain(rows, top=top)
    counted = divergence.term_counts(helpers.frame(spark, rows, SCHEMA), entries).where("term = 'ñé' and lang = 'en'")
    assert counted.groupBy().sum("count", "docs").first()[:] == (60 * 40, 60)


def test_empty_table(spark):
    assert divergence.audit(helpers.frame(spark, [], SCHEMA)).count() == 0


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 6)), max_size=60), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_skyband_is_that_of_all_pairs(rows, k):
    count, lang_count = np.array([c for c, _ in rows], int), np.array([c + x for c, x in rows], int)
    name = np.arange(len(rows)) * 7 % max(1, len(rows)) if len(rows) % 7 else np.arange(len(rows))
    got = set(divergence.skyband(count, lang_count, name, k, block=4).tolist())
    want = {i for i in range(len(rows)) if sum(
        count[j] >= count[i] and lang_count[j] <= lang_count[i] and name[j] < name[i] for j in range(len(rows))) < k}
    assert got == want


@given(st.integers(0, 10**12), st.integers(1, 10**13))
@settings(max_examples=200, deadline=None)
def test_scaled_is_exact(count, more):
    total = count + more
    assert divergence.scaled(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * (count + 1) // total]
