import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD, SF
from triplespark.llm import mixing, queries
from triplespark.llm.mixing import calibrate, mix_documents, rake


def test_rake_meets_every_marginal():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, n, 60) for n in (5, 3, 4)]
    weights = rng.random(60) + 0.1
    targets = [np.bincount(c, rng.random(60), n) for c, n in zip(codes, (5, 3, 4), strict=True)]
    targets = [t / t.sum() * weights.sum() for t in targets]
    out = rake(weights, codes, targets, 5000)
    for c, t in zip(codes, targets, strict=True):
        assert np.bincount(c, out, len(t)) == pytest.approx(t, rel=1e-6)


def test_calibrate_meets_the_budget():
    tokens, rates = np.array([100.0, 50, 20, 5]), np.array([0.5, 1, 4, 9])
    for budget in (10, 60, 120, 170, 175, 200):
        p = calibrate(tokens, rates, budget)
        assert (p * tokens).sum() == pytest.approx(min(budget, 175)) and (p <= 1).all()


def test_query(spark, documents):
    rows = queries.op6_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)
    tokens = sum(r.n_tokens for r in rows)
    assert tokens == sum(len((d["text"] or "").encode().split()) for d in documents)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.6 * tokens)
    cells = {(r.source, r.lang, r.topic): (r.cell_weight, r.probability) for r in rows}
    assert all(cells[r.source, r.lang, r.topic] == (r.cell_weight, r.probability) for r in rows)
    raked = {}
    for r in rows:
        raked[r.lang] = raked.get(r.lang, 0) + r.n_tokens * r.cell_weight
    natural = {k: sum(r.n_tokens for r in rows if r.lang == k) for k in raked}
    flat = {k: v**0.7 for k, v in natural.items()}
    for k, v in raked.items():
        assert v == pytest.approx(tokens * flat[k] / sum(flat.values()), rel=1e-3)


def test_targets_and_odd_rows(spark, odd, no_docs):
    rows = mix_documents(odd.withColumn("topic", odd["word"]), targets={"source": {"a": 0.5}}, keep=0.5).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() >= {"word", "rid", "n_words", "topic", "n_tokens", "probability", "sampled"}
    again = mix_documents(odd, targets={"source": {"a": 0.5}}, keep=0.5).collect()
    assert sorted((str(r.doc_id), r.sampled) for r in rows) == sorted((str(r.doc_id), r.sampled) for r in again)
    assert all(r.sampled for r in mix_documents(odd, keep=1.0).collect())
    assert all(r.sampled for r in mix_documents(odd.where("text is null or text = ''")).collect())
    assert mix_documents(no_docs).collect() == []


@pytest.mark.parametrize("cells", [50_000, 0])
def test_every_source_has_its_own_target(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    size = {"hot": 100_000} | {f"t{i}": 5 for i in range(500)}
    docs = spark.createDataFrame([(i, "w " * n, "en", k) for i, (k, n) in enumerate(size.items())], "doc_id long, text string, lang string, source string")
    total, flat = sum(size.values()), sum(n**0.5 for n in size.values())
    for r in mix_documents(docs).collect():
        assert r.n_tokens * r.cell_weight == pytest.approx(total * size[r.source] ** 0.5 / flat)
    got = {r.source: r.n_tokens * r.cell_weight for r in mix_documents(docs, targets={"source": {"t7": 0.25}}).collect()}
    assert got["t7"] == pytest.approx(0.25 * total)
    assert got["t8"] == pytest.approx(0.75 * total * 5**0.5 / (flat - 5**0.5))


def test_cells_as_a_table_are_raked_alike(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["en", "fr", None][rng.integers(3)], f"s{rng.integers(6)}") for i in range(120)] + [(999, None, "xx", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("t", mixing.F.col("doc_id") % 3)
    out = []
    for cells in (50_000, 0):
        monkeypatch.setattr(mixing, "CELLS", cells)
        got = mix_documents(docs, topic=docs["t"], targets={"language": {"fr": 0.5, "nowhere": 0.1}, "source": {"s1": 0.0}}).collect()
        out.append(sorted((r.doc_id, r.cell_weight, r.probability) for r in got))
    assert len(out[0]) == len(rows)
    assert np.allclose(out[0], out[1], rtol=1e-6)


def brute_form(text):
    if text is None:
        return mixing.NONE
    size = len(text) + 1
    if len(re.findall(r" \| ", text)) * 40 > size:
        return "table"
    if len(re.findall("[A-Z]", text)) * 2 > len(re.findall("[A-Za-z]", text)) + 1:
        return "shouted"
    quiet = re.compile(r"[ \t\n\x0b\x0c\r.,;:'\"!?()-]")
    noise = sum(not (quiet.match(c) or unicodedata.category(c)[0] == "L") for c in text)
    return "noisy" if noise * 20 > size else "prose"


def test_forms_and_tokens_are_brute_force(documents):
    r = random.Random(1)
    texts = [d["text"] for d in documents] + [None, "", " ", "a | b | c | d", "é漢字 ok", "漢字" * 9, "©®™" * 5, "ÄÖÜ", "ABC abc DEF G"]
    texts += ["".join(r.choice("aB |é漢¿9\n.") for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = mixing.measure(pa.array(texts, pa.string())).to_pylist()
    for t, g in zip(texts, got, strict=True):
        assert ((g["topic"] or mixing.NONE), g["tokens"]) == (brute_form(t), len((t or "").encode().split()))


def test_all_marginals_and_the_sample(spark, documents):
    """Source, language and topic all meet their targets, probabilities follow from the weights, and the draw is the stated hash."""
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = mix_documents(frame, seed=3)
    rows = got.withColumn("draw", (F.xxhash64(F.lit(3), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))) / 2.0**63 + 1) / 2).collect()
    total = sum(r.n_tokens for r in rows)
    for name, power in (("source", 0.5), ("lang", 0.7), ("topic", 0.7)):
        natural, raked = {}, {}
        for r in rows:
            natural[r[name]] = natural.get(r[name], 0) + r.n_tokens
            raked[r[name]] = raked.get(r[name], 0) + r.n_tokens * r.cell_weight
        flat = sum(n**power for n in natural.values() if n)
        for k, n in natural.items():
            assert raked[k] == pytest.approx(total * n**power / flat if n else 0, rel=1e-6)
    ratio = {round(r.probability / r.cell_weight, 9) for r in rows if r.probability < 1}
    assert len(ratio) == 1 and all(r.cell_weight * max(ratio) >= 1 - 1e-9 for r in rows if r.probability == 1)
    assert all(r.sampled == (r.draw < r.probability) for r in rows)
    kept = sum(r.n_tokens for r in rows if r.sampled)
    spread = sum(r.n_tokens**2 * r.probability * (1 - r.probability) for r in rows) ** 0.5
    assert abs(kept - 0.6 * total) < 4 * spread


def test_names_and_targets(spark):
    """A source called (other) is one like any other; a target for a rare value counts; contradictions are told."""
    docs = spark.createDataFrame([(1, "a b c", "en", "(other)"), (2, "a b c", "en", "x"), (3, "a", "en", None), (4, None, "en", "x")], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in mix_documents(docs, targets={"source": {"(other)": 0.7}}).collect()}
    assert 3 * rows[1].cell_weight == pytest.approx(0.7 * 7) and rows[4].topic == mixing.NONE
    with pytest.warns(UserWarning, match="raking"):
        rake(np.array([1.0, 1.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([1.5, 0.5]), np.array([0.5, 1.5])], 50)
