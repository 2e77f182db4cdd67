import random
import re
from collections import defaultdict

import pytest

from tests.llm.conftest import ODD, SF
from triplespark.llm import near_dedup, queries
from triplespark.llm.components import components
from triplespark.llm.near_dedup import near_duplicates


def brute(docs, size, threshold=80):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def found(frame, size):
    rows = near_duplicates(frame, size).collect()
    components_ = defaultdict(int)
    for r in rows:
        if r.n_shingles and r.component_id is not None:
            components_[r.component_id] += r["first"]
    assert set(components_.values()) <= {1}
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_query_is_brute_force(spark, documents):
    rows = queries.op3_near_dedup(spark, SF).collect()
    want = brute([(d["doc_id"], d["text"]) for d in documents], 2)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert any(not r.kept for r in rows)


@pytest.mark.parametrize("large", [48, 4])
def test_groups_of_copies(spark, monkeypatch, large):
    """Chains of edits, a large group, and groups that share much but not enough; large nodes and their branches too."""
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "DEEPEST", 8)
    r = random.Random(large)
    word = lambda: f"w{r.randint(0, 3000)}"
    docs = []
    for g, (n, edits) in enumerate([(2, 1), (5, 3), (150, 4), (80, 9), (60, 14), (40, 25)]):
        base = [word() for _ in range(120)]
        for k in range(n):
            w = base.copy()
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            docs.append((g * 1000 + k, " ".join(w)))
    chain = [word() for _ in range(100)]
    for k in range(30):
        chain[k * 3] = "new" + str(k)
        docs.append((9000 - k, " ".join(chain)))
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), 2) == brute(docs, 2)


def test_odd_rows(spark, odd, no_docs):
    assert found(odd, 2) == brute([r[:2] for r in ODD], 2)
    assert found(odd, 5) == brute([r[:2] for r in ODD], 5)
    rows = near_duplicates(odd.withColumnsRenamed({"n": "first", "word": "component_id"}), 2)
    assert rows.columns == ["doc_id", "text", "lang", "source", "rid", "n_words", "n_shingles", "component_id", "first"]
    assert near_duplicates(no_docs).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (5, 5), (300, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
