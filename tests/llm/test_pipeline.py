"""Each stage against a brute-force version of it, on the stage's own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import ODD, SF
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_mixing import brute_form
from tests.llm.test_near_dedup import brute as components_of


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert len(after) <= len(before) and (set(after[0]) == set(corpus_pipeline.COLUMNS) or name == "mixing")


def test_language_keeps_what_has_letters(stages):
    before, after = stages["language ID"]
    assert len(after) >= 0.97 * sum(any(c.isalpha() for c in d["text"] or "") for d in before)


def test_language_stage_is_its_model(spark, stages):
    """Each text scored alone by the model that the stage learns: a share of one half or more stays."""
    before, after = stages["language ID"]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = corpus_pipeline.language_id.fit(frame, F.lit(True))
    want = set()
    for d in before:
        shares, worded = model.score([(d["text"] or "").encode()])
        if worded[0] and shares[0].max() >= corpus_pipeline.LEAST_SCORE:
            want.add(d["doc_id"])
    assert {d["doc_id"] for d in after} == want


def test_mixing_stage_is_brute_force(spark, stages):
    """Cells, raked weights, probabilities and draws in plain Python."""
    before, after = stages["mixing"]
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(d["doc_id"], d["text"]) for d in before], "doc_id long, text string").select("doc_id", F.xxhash64(F.lit(3), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("h")).collect()}
    keys = {d["doc_id"]: (d["source"] or "(none)", d["lang"] or "(none)", brute_form(d["text"])) for d in before}
    tokens = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in before}
    cells = Counter()
    for i, k in keys.items():
        cells[k] += tokens[i]
    total = sum(cells.values())
    weights, aims = {k: float(n) for k, n in cells.items()}, []
    for i, power in enumerate((0.5, 0.7, 0.7)):
        sums = Counter()
        for k, n in cells.items():
            sums[k[i]] += n
        flat = {v: n**power for v, n in sums.items() if n}
        aims.append({v: total * flat.get(v, 0) / sum(flat.values()) for v in sums})
    for _ in range(500):
        for i, aim in enumerate(aims):
            now = Counter()
            for k, w in weights.items():
                now[k[i]] += w
            weights = {k: w * aim[k[i]] / now[k[i]] if now[k[i]] else w for k, w in weights.items()}
    rates = {k: weights[k] / n if n else 1.0 for k, n in cells.items()}
    low, high = 0.0, 1e9
    for _ in range(200):  # the constant that spends the budget
        c = (low + high) / 2
        spent = sum(n * min(1.0, c * rates[k]) for k, n in cells.items())
        low, high = (c, high) if spent < corpus_pipeline.KEEP * total else (low, c)
    want = {i: min(1.0, c * rates[k]) for i, k in keys.items()}
    got = {d["doc_id"]: d["probability"] for d in after}
    assert set(got) == {i for i, p in want.items() if (hashes[i] / 2.0**63 + 1) / 2 < p}
    assert all(p == pytest.approx(want[i], rel=1e-6) for i, p in got.items())


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near-dedup"]
    want = {c for _, _, c in components_of([(d["doc_id"], d["text"]) for d in before], corpus_pipeline.SHINGLE)}
    assert sorted(d["doc_id"] for d in after) == sorted(want) and len(after) < len(before)


def test_substring_dedup_cuts_repeated_passages(stages):
    before, after = stages["substring dedup"]
    n = corpus_pipeline.PASSAGE
    split = {d["doc_id"]: (d["text"] or "").encode().split() for d in before}
    windows = Counter(tuple(w[i : i + n]) for w in split.values() for i in range(len(w) - n + 1))
    own = {d["doc_id"]: d for d in after}
    for d in before:
        w = split[d["doc_id"]]
        gone = {x for i in range(len(w) - n + 1) if windows[tuple(w[i : i + n])] > 1 for x in range(i, i + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        if gone and not kept:
            assert d["doc_id"] not in own
        else:
            assert own[d["doc_id"]]["text"] == (kept if gone else d["text"])


def test_decontamination_cuts_windows(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    own = {d["doc_id"]: d for d in after}
    for d, (i, n, hit, *_, bad) in zip(before, hits_of([(d["doc_id"], d["text"]) for d in before], items, corpus_pipeline.WINDOW), strict=True):
        if hit > n * corpus_pipeline.COVER:
            assert i not in own
        elif not bad:
            assert own[i]["text"] == d["text"]
        elif i in own:
            words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))
            assert words(own[i]["text"]) == n - hit


def test_mixing_samples_its_input(stages):
    before, after = stages["mixing"]
    texts = {d["doc_id"]: d["text"] for d in before}
    assert 0 < len(after) < len(before) and all(texts[d["doc_id"]] == d["text"] for d in after)


def test_run_is_the_stages(spark, stages):
    got = __spark_entry__.queries()["pipeline"](spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(d["doc_id"] for d in stages["mixing"][1])


def test_odd_rows(spark, odd, no_docs):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.count() <= len(ODD)
        assert stage(spark, no_docs.withColumn("n_chars", F.lit(1).cast("long")), SF).collect() == []
