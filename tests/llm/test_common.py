import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from triplespark.llm import common
from triplespark.llm.common import Lookup, chunks, hash_words, pack, unpack


@given(st.lists(st.binary(max_size=150).filter(lambda b: not set(b) & {9, 10, 11, 12, 13, 32} and b), max_size=12), st.sampled_from([b" ", b"\t\n", b"  \x0b\x0c\r"]))
def test_equal_words_have_equal_hashes(words, space):
    got = hash_words(space.join([b"", *words, b""]))
    assert len(got) == len(words)
    alone = [hash_words(w)[0] for w in words]
    assert np.array_equal(got, np.array(alone, np.uint64))
    assert len(set(got.tolist())) == len(set(words))


def test_chunks():
    assert list(chunks([b"ab", None, b"c", b"defg", b"h"], 3)) == [(0, [b"ab", b"", b"c"]), (3, [b"defg"]), (4, [b"h"])]
    assert list(chunks([], 3)) == []


def test_pack():
    for n in (0, 1, 1000):
        r = np.random.default_rng(n)
        columns = np.sort(r.integers(-(1 << 63), 1 << 63, n)), r.integers(0, 1 << 31, n).astype(np.int32), r.integers(0, 3, n).astype(np.uint8)
        got = unpack(pack(*columns), "<i8", "<i4", "u1")
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(got, columns, strict=True))


def test_lookup():
    r = np.random.default_rng(0)
    for n in (0, 1, 1000, 50_000):
        keys = np.unique(np.concatenate((r.integers(-(1 << 63), 1 << 63, n), [-1, -2][:n])))
        values = r.random(len(keys))
        table, asked = Lookup(keys, values), r.integers(0, max(1, len(keys)), 3 * len(keys))
        assert np.array_equal(table.get(keys[asked]), values[asked])


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = b"some words " * 40 + b"x" * 90 + b"\n and more"
    whole = hash_words(text)
    monkeypatch.setattr(common, "_BLOCK", 32)
    assert np.array_equal(hash_words(text), whole)
