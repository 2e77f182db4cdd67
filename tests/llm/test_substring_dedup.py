import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD, SF
from triplespark.llm import queries, substring_dedup
from triplespark.llm.substring_dedup import dedup_substrings


def brute(docs, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    windows = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {x for at in range(len(w) - length + 1) if windows[tuple(w[at : at + length])] > 1 for x in range(at, at + length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_is_brute_force(spark, documents):
    got = sorted(map(tuple, queries.op7_substring_dedup(spark, SF).collect()))
    assert got == sorted(brute([(d["doc_id"], d["text"]) for d in documents], 35))
    assert any(r[2] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, monkeypatch, seed):
    """In one shard, and in one for every few texts."""
    if seed:
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 300)
        monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 120)
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") for _ in range(r.randint(10, 40))] for _ in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            at = r.randint(0, len(p))
            words += p[at : at + r.randint(5, 30)] + [r.choice("xyz") + str(r.random())] * r.randint(0, 2)
        docs.append((i, " ".join(words)))
    docs += [(100, "same " * 50), (101, docs[3][1]), (101, docs[3][1])] + [(None, docs[5][1])] * 40
    rows = dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), 12).collect()
    assert sorted(map(tuple, (r[:4] for r in rows)), key=str) == sorted(brute(docs, 12), key=str)


def test_odd_rows(spark, odd, no_docs):
    got = sorted((tuple(r[:4]) for r in dedup_substrings(odd, 12).collect()), key=str)
    assert got == sorted(brute([r[:2] for r in ODD], 12), key=str)
    assert dedup_substrings(no_docs, 12).collect() == []
    with pytest.raises(ValueError):
        dedup_substrings(odd, 11)


def test_located_phrases_are_brute_force():
    """Phrases that share words, beside near misses whose words stand in other phrases, and across gaps."""
    r = np.random.default_rng(5)
    words = r.integers(0, 6, 4000).astype(np.uint64) << np.uint64(44)
    a, b, _ = substring_dedup._phrases(words)
    some = r.choice(len(a), 40)
    want = set(zip(a[some].tolist(), b[some].tolist(), strict=True))
    got = substring_dedup.Phrases(a[some], b[some]).starts(substring_dedup._chars(words))
    assert got.tolist() == [i for i, x in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if x in want]
