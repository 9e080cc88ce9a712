import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import packing, queries, tokens
from folioscope.session import ship_package
from tests.llm import helpers


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(queries.vocabulary_path())


@pytest.fixture(scope="module")
def bpe():
    with open(queries.vocabulary_path(), "rb") as file:
        return tokens.encoding(file.read())


PIECES = st.lists(st.sampled_from(["word", " ", "  ", "\n", "é", "'s", "12", "!!", " ", "　", "Ab c", " longer words here",
                                   "<|endoftext|>", "日本語", "\t", ".", " x", "…"]), max_size=40).map("".join)


@given(PIECES)
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_public_library(text):
    with open(queries.vocabulary_path(), "rb") as file:
        bpe = tokens.encoding(file.read())
    own = Tokenizer.from_file(queries.vocabulary_path()) if not hasattr(test_ids_are_those_of_the_public_library, "t") else \
        test_ids_are_those_of_the_public_library.t
    test_ids_are_those_of_the_public_library.t = own
    assert tokens.encode(bpe, text).tolist() == own.encode(text, add_special_tokens=False).ids


@given(PIECES, st.lists(st.tuples(st.integers(-3, 90), st.integers(-3, 90), PIECES), max_size=5), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_edited_counts_are_those_of_the_edited_text(text, edits, size):
    with open(queries.vocabulary_path(), "rb") as file:
        bpe = tokens.encoding(file.read())
    leaves = tokens.leaves_of(text, size)
    assert "".join(leaves) == text
    tree = tokens.Tree(leaves, [len(tokens.encode(bpe, x)) for x in leaves])
    assert tree.tokens == len(tokens.encode(bpe, text))
    for start, stop, new in edits:
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        tree.edit(start, stop, new, bpe)
        text = text[:start] + new + text[stop:]
        assert (tree.chars, tree.tokens) == (len(text), len(tokens.encode(bpe, text)))
        assert "".join(tree.leaves) == text


def test_only_touched_leaves_are_encoded_again(bpe):
    text = helpers.long_text(5000)
    leaves = tokens.leaves_of(text)
    tree = tokens.Tree(leaves, [len(tokens.encode(bpe, x)) for x in leaves])
    assert tree.edit(10_000, 10_005, "new", bpe) < 1000


def test_recount_of_odd_rows(spark, reference):
    ship_package(spark)
    vocabulary = tokens.share_vocabulary(spark, queries.vocabulary_path())
    kind = "array<struct<start:int,stop:int,text:string>>"
    rows = [(i, t, e) for i, t in helpers.odd_rows() for e in (None, [], [(0, 2, "xy z"), (5, 5, None), (9, 10**6, " end")])]
    documents = helpers.frame(spark, rows, f"doc_id long, text string, edits {kind}")
    got = helpers.rows_of(tokens.recount(tokens.build_trees(documents, vocabulary, ("edits",)), vocabulary),
                          "doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens")

    def count(text):
        return len(reference.encode(text, add_special_tokens=False).ids)

    want = []
    for i, text, edits in rows:
        before = after = text or ""
        for start, stop, new in edits or []:
            start = min(start, len(after))
            after = after[:start] + (new or "") + after[max(start, stop):]
        want.append((i, len(before), count(before), len(after), count(after)))
    assert got == sorted(want, key=repr)
    assert tokens.recount(tokens.build_trees(documents.limit(0), vocabulary, ("edits",)), vocabulary).count() == 0


def pieces_hold(pieces, lengths, window):
    by = {}
    for d, start, length, sequence, offset in pieces:
        by.setdefault(d, []).append((start, length))
        assert length > 0
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by[d]):
            assert start == at
            at += length
        assert at == n
    filled = {}
    for _, _, length, sequence, offset in pieces:
        filled.setdefault(sequence, []).append((offset, length))
    padding = 0
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@given(st.lists(st.integers(1, 200), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_each_token_lies_in_one_piece(lengths):
    assert pieces_hold(packing.pack_cell(lengths, 64), lengths, 64) == 0


def test_least_squares_find_the_repeat_counts():
    histogram = np.zeros(65, np.int64)
    histogram[[40, 24, 30, 34, 20, 14]] = [50, 50, 20, 20, 0, 0]
    columns = packing.combinations(histogram, 64)
    found = {tuple(c): round(x) for c, x in zip(columns.tolist(), packing.solve(columns, histogram), strict=True) if x > 0.5}
    assert found == {(40, 24, 0): 50, (34, 30, 0): 20}


def test_pieces_of_random_documents_are_mostly_whole():
    random.seed(1)
    lengths = [int(random.lognormvariate(6, 1)) + 1 for _ in range(4000)]
    pieces = packing.pack_cell(lengths)
    assert pieces_hold(pieces, lengths, packing.WINDOW) == 0
    least = sum(-(-n // packing.WINDOW) for n in lengths)
    assert len(pieces) < 1.5 * least


def test_pack_of_odd_rows(spark, reference):
    ship_package(spark)
    rows = helpers.odd_rows()
    vocabulary = tokens.share_vocabulary(spark, queries.vocabulary_path())
    packed = packing.pack(helpers.frame(spark, rows), vocabulary, cell=5000)
    got = packed.toPandas()
    ids = {}
    for i, text in rows:
        own = np.array(reference.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        ids.setdefault(i, []).append(own)
    assert got["length"].sum() == sum(len(x) for own in ids.values() for x in own)
    lone = {i: own[0] for i, own in ids.items() if len(own) == 1}
    for r in got.itertuples():
        if r.doc_id == r.doc_id and r.doc_id in lone:
            part = lone[r.doc_id][r.start:r.start + r.length]
            assert r.doc_tokens == len(lone[r.doc_id]) and zlib.crc32(part.tobytes()) == r.ids_crc32
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= packing.WINDOW
    assert got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").apply(
        lambda x: (x["offset"].to_numpy() == x["length"].cumsum().shift(fill_value=0).to_numpy()).all(), include_groups=False).all()
    assert packing.pack(helpers.frame(spark, []), vocabulary).count() == 0


def test_token_query(spark, sf_dir, reference):
    got = {r["doc_id"]: r for r in queries.op3_token_counts(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        x = r["text"]
        n = len(x)
        y = x[:n // 3] + x[n // 3 + n // 50:]
        y = y[:n // 2] + x[:40] + y[n // 2:]
        y = y[:len(y) - n // 20] + " [cut]"
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(reference.encode(x, add_special_tokens=False).ids)
        assert (own["edited_chars"], own["edited_tokens"]) == (len(y), len(reference.encode(y, add_special_tokens=False).ids))


def test_null_places(spark):
    ship_package(spark)
    vocabulary = tokens.share_vocabulary(spark, queries.vocabulary_path())
    rows = [(1, "some words", [(None, 3, "x")]), (2, "some words", [(4, None, "x")])]
    documents = helpers.frame(spark, rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    got = tokens.recount(tokens.build_trees(documents, vocabulary, ("edits",)), vocabulary)
    assert {r["doc_id"]: r["edited_chars"] for r in got.collect()} == {1: 10, 2: 11}
    assert isinstance(got.select(F.max("n_tokens")).first()[0], int)
