import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from triplespark.llm import queries
from triplespark.llm.toxicity import Lexicon, labelled, learn, toxicity, words_of

LARGER = "/root/testdata/sf0.01"


def test_folding():
    text = "1d10t ІDІОТ ｉｄｉｏｔ í-d 2024 st*upid $tupid ST."
    words = ["idiot", "idiot", "idiot", "i", "d", "2024", "stupid", "tupid", "st"]
    assert words_of([text, "", "a@\n+b \u0301 ǆx", text]) == [words, [], ["a", "b", "dzx"], words]


def test_folding_is_brute_force():
    """Token by token with a regular expression, on random texts in one batch."""
    import random
    import re

    from triplespark.llm import toxicity as own

    r = random.Random(3)
    texts = ["".join(r.choice("abZ019@$!|+*_- .\néÉßо漢²٣\u0301\u200bΣ") for _ in range(r.randint(0, 40))) for _ in range(600)]
    table, kinds, several = own._characters()
    leet = str.maketrans(own.STAND_INS | {"*": ""})
    want = []
    for t in texts:
        t = t.translate(several)
        t = "".join(chr(table[ord(c)]) for c in t if kinds[ord(c)] != own._MARK)
        tokens = re.findall(r"[^\W_]+(?:[@$!|+*]+[^\W_]+)*", t)
        want.append([w.translate(leet) if re.search(r"[^\W\d_]", w) else w for w in tokens])
    assert words_of(texts) == want


def test_lexicon():
    lexicon = Lexicon({"bad": 2.0, "worse*": 3.0, "wor*": 1.0}, frozenset({"not bad"}), (1.0, 0.0, -1.0))
    total, n = lexicon.sums(["Bad, b4d worsens WORK badly", "not bad but bad", "not", "bad", "", "not bad bad not bad"])
    assert total.tolist() == [2 + 2 + 3 + 1, 2, 0, 2, 0, 2] and n.tolist() == [5, 4, 1, 1, 0, 5]
    assert lexicon.score([None, ""]) == pytest.approx([0.2689414] * 2)
    assert lexicon.score(["bad"])[0] > 0.5


def test_learned_words_and_exceptions(spark):
    rows = [(f"you are an idiot{"xyz"[i % 3]} x{i}", 1) for i in range(60)] + [(f"a village idiot{"xyz"[i % 3]} came y{i}", 0) for i in range(60)] + [(f"nothing at all z{i}", 0) for i in range(200)]
    lexicon = learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert "idiot*" in lexicon.entries and "village idioty" in lexicon.exceptions
    bad, good = lexicon.score(["you are an idioty", "a village idioty came"])
    assert bad > 0.5 > good


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op10_toxicity(spark, LARGER).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    test = [(rows[i].score, t) for i, t in labels.items() if rows[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in test for b, y in test if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.6
    assert sum(s >= 0.5 for s, t in test if t == 0) <= 0.05 * len(test)


def test_odd_rows(spark, odd, no_docs):
    lexicon = Lexicon({"one": 4.0}, frozenset(), (1.0, 0.0, -1.0))
    rows = toxicity(odd, lexicon).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in ODD), key=str)
    assert sum(r.predicted for r in rows) == 4
    assert toxicity(no_docs, lexicon).collect() == []
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (6, None), (8, 7)], "doc_id long, toxic int")
    found = labelled(odd, labels)
    assert sorted((r.text or "", r.toxic) for r in found.collect()) == sorted([("", 1), (ODD[5][1], 1), (ODD[5][1], 1)])
    assert learn(found.where("false").withColumn("toxic", F.col("toxic"))).score(["x"]) == [0.5]


def test_lexicon_is_brute_force(spark):
    """Entries, weights and exceptions from counts of documents, in plain Python."""
    import math
    import random
    from collections import Counter

    r = random.Random(2)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + i % 7)}lorem" for i in range(20)]
    rows = [(" ".join(r.choices(vocabulary[: 20 if t else 14], k=6)), t) for t in r.choices([0, 1], k=400)]
    rows += rows[:5]
    lexicon = learn(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    sizes = Counter(t for _, t in rows)
    counts = Counter()
    for text, t in rows:
        words = set(text.split())
        counts.update((p, t) for p in words | {w[:n] + "*" for w in words for n in range(4, 9)})
    want = {}
    for p in {p for p, _ in counts}:
        a, b = counts[p, 1], counts[p, 0]
        ratio = math.log((a + 0.5) / (sizes[1] - a + 0.5)) - math.log((b + 0.5) / (sizes[0] - b + 0.5))
        if ratio > 0 and ratio / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= 3:
            want[p] = ratio
    assert want and lexicon.entries == pytest.approx(want)
    seen = Counter()
    for text, t in rows:
        w = text.split()
        hit = [x in want or any(x[:n] + "*" in want for n in range(4, 9)) for x in w]
        seen.update({(f"{w[i]} {w[i + 1]}", t) for i in range(len(w) - 1) if hit[i] or hit[i + 1]})
    pairs = {p for p, _ in seen}
    assert lexicon.exceptions == {p for p in pairs if seen[p, 0] + seen[p, 1] >= 5 and seen[p, 1] * sizes[0] < seen[p, 0] * sizes[1]}


def test_extra_columns_and_repeats(spark, odd):
    """Columns named like the result's, repeated documents and repeated labels."""
    labels = spark.createDataFrame([(5, 1, "x"), (5, 1, "y")], "doc_id long, toxic int, score string")
    assert labelled(odd.withColumn("toxic", F.lit("old")), labels).count() == 2
    assert toxicity(odd.withColumns({"score": F.lit("old"), "predicted": F.lit(7)}), Lexicon({}, frozenset())).columns == ["doc_id", "score", "predicted"]
