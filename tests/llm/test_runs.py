"""Periodic runs of words against plain comparison of places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import periodic, queries
from folioscope.session import ship_package
from tests.llm import helpers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def plain_runs(w):
    """(start, length, period): for each distance the maximal stretches of equal words."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                s, length, start = start, i - start + q, None
                finer = any(all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q))
                if length >= max(6, 4 * q) and not finer:
                    found.add((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, alter):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        if alter and doc_id is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            w = w[:a] + [w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
        runs = plain_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        out.append((doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
                    sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
                    sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 59), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_sequence(w, a, p):
    w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, len(w)))]
    assert [tuple(r) for r in periodic.runs_of(np.array(w, np.int64)).tolist()] == plain_runs(w)


@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_extensions_and_lyndon_words(w):
    s = [*w, 3]
    extension = periodic.Extensions(s)
    order = sorted(range(len(s)), key=lambda i: s[i:])
    assert extension.rank.tolist() == [order.index(i) for i in range(len(s))]
    pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
    got = extension(*np.array(pairs).T)
    for (i, j), length in zip(pairs, got.tolist(), strict=True):
        assert s[i:i + length] == s[j:j + length] and s[i + length:i + length + 1] != s[j + length:j + length + 1]
    lyndon = {(i, max(j for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))))
              for i in range(len(s))}
    got = set(zip(*(x.tolist() for x in periodic.lyndon_ends(extension.rank)), strict=True))
    assert {x for x in lyndon if x[1] < len(s)} <= got


def test_stretches_hold_all_runs():
    random.seed(4)
    for _ in range(300):
        w = []
        while len(w) < 200:
            root = [random.randrange(30) for _ in range(random.randrange(1, 8))]
            w += root * random.choice([1, 1, 5, 9]) + [random.randrange(2000) for _ in range(random.randrange(20))]
        parts = periodic.stretches(np.array(w, np.int64))
        for s, length, _ in plain_runs(w):
            assert any(a <= s and s + length <= b for a, b in parts)


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def derived(spark, tmp_path, rows):
    """The registered query over a table of these rows."""
    helpers.frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return helpers.rows_of(queries.op11_periodic_runs(spark, str(tmp_path)), *NAMES)


def test_odd_rows(spark, tmp_path):
    repeated = [(30, "a " * 6), (31, "a b " * 4), (32, "a b " * 3), (33, "x\x00y \x0bé " * 9 + "end"), (34, "a a a a a"),
                (35, "a b a c " * 5), (36, "line one here\n" * 40 + "other\x1fwords"), (37, " ".join(["p q r s"] * 4 + ["z"] * 7))]
    planted = [(i, " ".join(f"w{k * k % 97}" for k in range(150))) for i in range(40, 120)]
    rows = [r for r in helpers.odd_rows() if r[0] != 5] + repeated + planted
    assert derived(spark, tmp_path, rows) == plain(rows, True)
    assert any(r[1] for r in plain(planted, True))
    long = [(5, helpers.long_text(40_000)), (6, "u v w " * 30_000)]
    (first, second) = sorted(periodic.find_runs(helpers.frame(spark, long)).collect())
    assert first["runs"] == [] and first["collapsed"] == long[0][1]
    assert [tuple(r) for r in second["runs"]] == [(0, 90_000, 3)] and second["collapsed"] == "u v w"


def test_empty_table(spark, tmp_path):
    assert derived(spark, tmp_path, []) == []
    assert periodic.find_runs(helpers.frame(spark, [(1, "a " * 9)])).first()["collapsed"] == "a"
    with pytest.raises(ValueError):
        periodic.find_runs(helpers.frame(spark, []), exponent=2)


def test_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
            if len(r["text"]) < 4000]
    got = [r for r in helpers.rows_of(queries.op11_periodic_runs(spark, sf_dir), *NAMES) if r[0] in dict(rows)]
    assert got == plain(rows, True)
