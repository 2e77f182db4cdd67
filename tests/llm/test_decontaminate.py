import random
import re

import pytest

from tests.llm.conftest import ODD, SF
from triplespark.llm import decontaminate as decontaminate_module
from triplespark.llm import queries
from triplespark.llm.decontaminate import Automaton, decontaminate, digest, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length):
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - length + 1)) if w else ():
            windows.setdefault(tuple(w[at : at + length]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (k := tuple(w[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[k] - {None}
        ids = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(ids), digest(ids), bool(hit)))
    return out


def test_query_is_brute_force(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, queries.op4_decontaminate(spark, SF).collect()))
    assert got == sorted(brute([(d["doc_id"], d["text"]) for d in documents], items, 10))
    assert any(r[5] for r in got)


@pytest.mark.parametrize("seed", range(40))
def test_automaton_on_random_words(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(str(i), text(r.randint(0, 9))) for i in range(r.randint(1, 4))]
    docs = [(i, text(r.randint(0, 30))) for i in range(5)]
    a = Automaton([(i, words_of(t.encode())) for i, t in items], 4)
    for (_, t), want in zip(docs, brute(docs, items, 4), strict=True):
        spans, found = a.hits(words_of(t.encode()))
        ids = sorted(a.items[k] for k in found)
        assert (len({x for s in spans for x in range(*s)}), digest(ids)) == (want[2], want[4])


def test_odd_rows(spark, odd, no_docs):
    items = [(1, "three four five"), (1, "three four five"), (2, None), (None, "eight nine ten eleven"), (3, ""), (40, "one two three four")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(odd, frame, length=4).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, digest(r["items"]), r.n_hit > 0) for r in rows), key=str)
    assert got == sorted(brute([r[:2] for r in ODD], items, 4), key=str)
    assert all(r["drop"] == (r.n_hit > 0) for r in rows)
    assert not any(r["drop"] for r in decontaminate(odd, frame, length=4, max_cover=1.0).collect())
    assert sum(r["drop"] for r in decontaminate(odd, frame, length=4, max_cover=1.0, max_span=4).collect()) > 0
    assert decontaminate(no_docs, frame).collect() == []
    assert {r.n_hit for r in decontaminate(odd, frame.where("false")).collect()} == {0}


@pytest.mark.parametrize("most", [300, 1000])
def test_large_sets_go_in_passes(spark, documents, most):
    """A test set beyond the limit of one pass gives what one pass gives."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(list(decontaminate_module._passes(items, most))) > 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = ["doc_id", "n_words", "n_hit", "items", "longest", "clean_text", "drop"]
    one, several = (decontaminate(docs, items, length=10, pass_words=n).select(*columns).collect() for n in (10**9, most))
    assert sorted(several, key=str) == sorted(one, key=str)
    whole = decontaminate(docs, items, length=10, texts=True, pass_words=most).collect()
    texts = {d["doc_id"]: d["text"] for d in documents}
    assert all(r.clean_text == texts[r.doc_id] for r in whole if not r.n_hit) and any(r.n_hit for r in one)
