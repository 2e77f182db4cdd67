import math
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD, SF
from triplespark.llm import ctw, queries


class Brute:
    """Context-tree weighting by recursion over dictionaries, with the same contexts kept."""

    def __init__(self, lines, share):
        self.counts = {}
        total = 0
        for text in lines:
            past = b"\n" * ctw.DEPTH + text
            for i in range(ctw.DEPTH, len(past)):
                total += 1
                for d in range(ctw.DEPTH + 1):
                    self.counts.setdefault(past[i - d : i], {}).setdefault(past[i], 0)
                    self.counts[past[i - d : i]][past[i]] += 1
        self.kept = {c for c, n in self.counts.items() if sum(n.values()) >= share * total}

    @staticmethod
    def split(counts, prefix, depth):
        zeros = sum(n for b, n in counts.items() if b >> 8 - depth == prefix and not b >> 7 - depth & 1)
        return zeros, sum(n for b, n in counts.items() if b >> 8 - depth == prefix) - zeros

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def rest(self, c):
        out = dict(self.counts[c])
        for x in range(256):
            if (longer := bytes([x]) + c) in self.kept:
                for b, n in self.counts[longer].items():
                    out[b] -= n
        return out

    def weigh(self, c, prefix, depth):
        alone = self.kt(*self.split(self.counts[c], prefix, depth))
        if len(c) == ctw.DEPTH:
            return alone, 1.0
        longer = self.kt(*self.split(self.rest(c), prefix, depth))
        longer += sum(self.weigh(bytes([x]) + c, prefix, depth)[0] for x in range(256) if bytes([x]) + c in self.kept)
        both = np.logaddexp(alone, longer) - math.log(2)
        return both, math.exp(alone - math.log(2) - both)

    def chance(self, past, prefix, depth, d=0):
        c = past[len(past) - d :]
        a, b = self.split(self.counts[c], prefix, depth)
        own, share = (b + 0.5) / (a + b + 1), self.weigh(c, prefix, depth)[1]
        if d == ctw.DEPTH:
            return own
        if past[len(past) - d - 1 :] in self.kept:
            deeper = self.chance(past, prefix, depth, d + 1)
        else:
            a, b = self.split(self.rest(c), prefix, depth)
            deeper = (b + 0.5) / (a + b + 1)
        return share * own + (1 - share) * deeper

    def score(self, text):
        past, out = b"\n" * ctw.DEPTH + text, 0.0
        for i in range(ctw.DEPTH, len(past)):
            prefix = 0
            for depth in range(8):
                bit = past[i] >> 7 - depth & 1
                one = self.chance(past[i - ctw.DEPTH : i], prefix, depth)
                out += math.log10(one if bit else 1 - one)
                prefix = prefix << 1 | bit
        return out


def base_of(rows, train):
    counts = {}
    for (_, t), ok in zip(rows, train, strict=True):
        for w in [*(t or "").encode().lower().split(), None] if ok else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        out.append((i, len(words), sum(w in counts for w in words), n, sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return out


def test_query(spark, documents):
    got = {r.doc_id: r for r in queries.op9_ctw(spark, SF).collect()}
    train = [zlib.crc32(str(d["doc_id"]).encode()) % 10 != 0 for d in documents]
    for want, ok in zip(base_of([(d["doc_id"], d["text"]) for d in documents], train), train, strict=True):
        r = got[want[0]]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[1:4], not ok)
        assert r.base_score == pytest.approx(want[4])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_odd_rows(spark, odd, no_docs, monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 50)
    from pyspark.sql import functions as F

    rows = ctw.score(odd, F.coalesce(F.col("doc_id") < 8, F.lit(False))).collect()
    want = base_of([r[:2] for r in ODD], [r[0] is not None and r[0] < 8 for r in ODD])
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows), key=str) == sorted((w[:4] for w in want), key=str)
    assert sorted(r.base_score for r in rows) == pytest.approx(sorted(w[4] for w in want))
    assert ctw.score(no_docs, F.lit(True)).collect() == []
    assert {(r.n_known, r.base_score, r.score) for r in ctw.score(odd.where("doc_id = 3"), F.lit(False)).collect()} == {(0, 0.0, 8 * math.log10(0.5))}


def test_pieces(monkeypatch):
    lines = [ctw.line(b"Some words to score, and some more of them")]
    keys, counts = np.unique(ctw._grams(lines), return_counts=True)
    whole = ctw._grams(lines)
    monkeypatch.setattr(ctw, "PIECE", 7)
    assert np.concatenate([ctw._grams([p])[skip:] for p, skip in ctw._pieces(lines[0])]).tolist() == whole.tolist()


def test_every_context_counts(spark):
    """Against brute force without a cut: a context that occurs once in a large corpus is a context still."""
    from functools import cache

    texts = ["abab abc", "Ünï bca", "", "cab abab", "abab abc"]
    brute = Brute([ctw.line(t.encode()) for t in texts], 0)
    brute.weigh = cache(brute.weigh)
    others = ["abab", "zz", "cabc a", "Ünï x", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + others)], "doc_id long, text string").repartition(3)
    rows = ctw.score(docs, ctw.F.col("doc_id") < len(texts)).collect()
    assert len(rows) == len(texts + others)
    for r in rows:
        said = ctw.line(((texts + others)[r.doc_id] or "").encode())
        assert r.score == pytest.approx(brute.score(said), rel=1e-5)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(said))


def test_rare_contexts_are_learnt(spark):
    """A word that holds less than 1e-5 of the training bytes is scored as known."""
    docs = spark.createDataFrame([(i, "the same words again and again " * 40) for i in range(400)] + [(1000, "qzvxkj"), (1001, "qzvxkj"), (1002, "jkxvzq")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ctw.score(docs, ctw.F.col("doc_id") <= 1000).where("doc_id > 1000").collect()}
    assert got[1001] > got[1002] + 6
