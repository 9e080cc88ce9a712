import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.words import shingles, slices, words_of
from tests.llm import helpers

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é.Z09_\n", max_size=30), st.text(max_size=12)), max_size=8)


@given(texts, st.sampled_from([1, 7, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(rows, most):
    seen, names = [], {}
    for lo, hi, data, offsets in slices(pa.array(rows, pa.string()), most):
        found = words_of(data, offsets)
        for r in range(hi - lo):
            own = [bytes(found.data[found.start[i]:found.end[i]]).decode() for i in range(found.first[r], found.first[r + 1])]
            seen.append(own)
            for i, w in zip(range(found.first[r], found.first[r + 1]), own, strict=True):
                assert names.setdefault(w, found.hash[i]) == found.hash[i]
    assert seen == [helpers.words(t) for t in rows]
    assert len(set(map(int, names.values()))) == len(names)


@given(st.lists(st.text(alphabet="ab ", max_size=20), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_equal_shingles_have_equal_hashes(rows):
    known = {}
    for lo, hi, data, offsets in slices(pa.array(rows), 16):
        values, owner = shingles(words_of(data, offsets), 3)
        for r in range(hi - lo):
            want = helpers.shingles(rows[lo + r], 3)
            assert sorted(want.values()) == sorted(np.unique(values[owner == r], return_counts=True)[1].tolist())
            w = helpers.words(rows[lo + r])
            order = [tuple(w[i:i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
            for shingle, value in zip(order, values[owner == r], strict=True):
                assert known.setdefault(shingle, value) == value
    assert len({int(v) for v in known.values()}) == len(known)
