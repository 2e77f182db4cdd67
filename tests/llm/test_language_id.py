import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, SF
from triplespark.llm import language_id, queries
from triplespark.llm.language_id import Grams, Model, fit, identify


def grams(text):
    t = "".join(c.lower() if c.isalpha() else " " for c in text)
    t = f"  {t}  "
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} - {" ", "  ", "   "}


def test_presence_is_brute_force():
    marks = ["Das ist gut", "the cat 12 sat", "é là"]
    g = Grams([m.encode() for m in marks])
    union = set().union(*map(grams, marks))
    texts = ["the gut", "là!", "12", "THE CAT"]
    rows, worded = g.presence([t.encode() for t in texts])
    assert worded.tolist() == [True, True, False, True]
    for t, row in zip(texts, rows, strict=True):
        assert int(row.sum()) == len(grams(t) & union)


def test_batched_product_is_the_kernel():
    rng = np.random.default_rng(0)
    words = {"a": ["der", "die", "und"], "b": ["the", "and", "of"]}
    texts, langs = zip(*((" ".join(rng.choice(words[k], 8)).encode(), k) for k in "ab" * 30), strict=True)
    model = Model(list(texts), list(langs), 10, 1.0)
    shares, _ = model.score(list(texts))
    assert [model.langs[i] for i in shares.argmax(1)] == list(langs)


def test_query(spark, documents):
    rows = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    assert len(rows) == len(documents)
    held = [d for d in documents if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1]
    assert {d["doc_id"] for d in held} == {i for i, r in rows.items() if r.held_out}
    assert sum(rows[d["doc_id"]].lang_pred == d["lang"] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(spark, odd, no_docs):
    model = fit(odd, F.lit(True))
    rows = identify(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.lang_pred == language_id.UNKNOWN) == (not any(c.isalpha() for c in r.text or "")) == (r.score == 0)
        assert r.n == 1 and r.word == "x"
    assert identify(no_docs, model).collect() == [] and fit(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in identify(odd, None).collect()} == {language_id.UNKNOWN}


def test_every_letter_of_the_landmarks_counts():
    """More than 250 letters: those with high code points are told apart still."""
    han, hangul = "".join(map(chr, range(0x4E00, 0x4F00))), "".join(map(chr, range(0xAC00, 0xAD00)))
    marks = ["the cat", han, hangul]
    g = Grams([m.encode() for m in marks])
    union = set().union(*map(grams, marks))
    for t in (han[:9], hangul[3:20], "cat " + han[5:7], han[9] + hangul[9]):
        assert int(g.presence([t.encode()])[0].sum()) == len(grams(t) & union)
    rng = np.random.default_rng(0)
    texts, langs = zip(*(("".join(rng.choice(list(s), 30)).encode(), k) for k, s in (("zh", han), ("ko", hangul)) * 40), strict=True)
    model = Model(list(texts), list(langs), 40, 1.0)
    assert [model.langs[i] for i in model.score(list(texts))[0].argmax(1)] == list(langs)


def test_scores_are_kernel_ridge_regression():
    """Against the definitions: kernels from sets of n-grams, Nystroem features, and the normal equations."""
    rng = np.random.default_rng(1)
    words = {"a": ["der", "die", "und", "nicht"], "b": ["the", "and", "of", "not"], "c": ["le", "et", "des", "pas"]}
    texts, langs = zip(*((" ".join(rng.choice(words[k], rng.integers(1, 9))), k) for k in "abc" * 20), strict=True)
    model = Model([t.encode() for t in texts], list(langs), 9, 0.5)
    order = np.random.default_rng(7).permutation(len(texts))
    marks = [[i for i in order.tolist() if langs[i] == k][:3] for k in dict.fromkeys(langs[i] for i in order.tolist())]
    marks = [texts[i] for m in marks for i in m]
    known = set().union(*map(grams, marks))

    def kernel(xs, ys):
        xs, ys = ([grams(t) & known for t in ts] for ts in (xs, ys))
        return np.array([[len(x & y) / max(1, len(x) * len(y)) ** 0.5 for y in ys] for x in xs])

    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-4 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel(texts, marks) @ root
    y = np.array([[1.0 if k == own else -1.0 for k in "abc"] for own in langs])
    w = np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ y)
    others = ["der und the", "des pas", "of of of not le", "Und Die"]
    margin = 4 * kernel(others, marks) @ root @ w
    want = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
    assert np.allclose(model.score([t.encode() for t in others])[0], want, atol=2e-3)


def test_ties_go_to_the_first_language(spark):
    """The same text under two labels leaves both equal."""
    rows = [(i, "same words here", k) for i, k in enumerate("ba" * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(frame, fit(frame, F.lit(True))).collect()} == {"a"}
