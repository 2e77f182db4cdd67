"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every run of consecutive words of every item. Documents stream through it word by word; the longest
match that ends at a word tells which windows end there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, materialize, tune

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of items in one automaton, at most (the longest item apart): larger test sets make several automata.
WORDS_PER_AUTOMATON = 200_000


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton of items, each a pair of id (or None) and words.

    windows: by state, the items with a window of `length` words in that state; whole: by state, the short items (as
    length and id) that are a suffix of what the state holds."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], length: int) -> None:
        self.length, self.items = length, [i for i, _ in items]
        self.word: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        texts = [[self.word.setdefault(w, len(self.word) + 1) for w in words] for _, words in items]
        for t in texts:
            last = 0
            for w in t:
                last = self._extend(last, w)
        self.windows: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        self.least = length
        for k, t in enumerate(texts):
            if len(t) < length:
                if t:
                    self.least = min(self.least, len(t))
                    short.setdefault(self._walk(t), []).append((len(t), k))
                continue
            state, size = 0, 0
            for w in t:
                state, size = self.go[state][w], size + 1
                while size > length and self.size[self.link[state]] >= length:
                    state = self.link[state]
                size = min(size, length)
                if size == length and (own := self.windows.setdefault(state, []))[-1:] != [k]:
                    own.append(k)
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.size]
        if short:
            for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
                self.whole[s] = self.whole[self.link[s]] + short.get(s, [])
        self.has_short = bool(short)
        #: Pairs of consecutive words, to pass over words that can't be in a match.
        self.pairs = np.unique(np.array([a << 32 | b for t in texts for a, b in zip(t, t[1:])] or [-1], np.int64))

    def _walk(self, t: list[int]) -> int:
        state = 0
        for w in t:
            state = self.go[state][w]
        return state

    def _extend(self, last: int, w: int) -> int:
        go, link, size = self.go, self.link, self.size

        def split(p: int, q: int) -> int:
            if size[q] == size[p] + 1:
                return q
            new = len(size)
            go.append(dict(go[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = new
            while p >= 0 and go[p].get(w) == q:
                go[p][w] = new
                p = link[p]
            return new

        if w in go[last]:
            return split(last, go[last][w])
        new, p = len(size), last
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and w not in go[p]:
            go[p][w] = new
            p = link[p]
        if p >= 0:
            link[new] = split(p, go[p][w])
        return new

    def _runs(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans that may hold a match: known words whose neighbours are neighbours in an item."""
        if self.least == 1:
            joined = (codes[:-1] > 0) & (codes[1:] > 0)
        else:
            pairs = codes[:-1] << 32 | codes[1:]
            at = np.searchsorted(self.pairs, pairs)
            joined = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pairs
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined, [0])))).tolist()
        spans = [(a, b + 1) for a, b in zip(edge[::2], edge[1::2]) if b + 1 - a >= self.least]
        if self.least == 1:
            covered = np.zeros(len(codes), bool)
            for a, b in spans:
                covered[a:b] = True
            spans += [(i, i + 1) for i in np.flatnonzero((codes > 0) & ~covered).tolist()]
        return iter(spans)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words covered by a window, as from and to, and the items whose windows occur."""
        codes = np.array(list(map(self.word.get, words, [0] * len(words))), np.int64)
        spans, found = [], set()
        for a, b in self._runs(codes) if len(codes) else ():
            state = size = 0
            for i, w in enumerate(codes[a:b].tolist(), a):
                while state and w not in self.go[state]:
                    state = self.link[state]
                    size = self.size[state]
                if w in self.go[state]:
                    state, size = self.go[state][w], size + 1
                if self.has_short:
                    for n, k in self.whole[state]:
                        if n <= size:
                            spans.append((i + 1 - n, i + 1))
                            found.add(k)
                    # a suffix that the state holds may be shorter than size, and its links hold the rest
                if size >= self.length:
                    top = state
                    while self.size[self.link[top]] >= self.length:
                        top = self.link[top]
                    spans.append((i + 1 - self.length, i + 1))
                    found.update(self.windows.get(top, ()))
        return spans, found


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans (from and to, in order) and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    out, last = [], 0
    for i, j in spans:
        out.append(text[last : at[i][0]])
        last = at[j - 1][1]
    return b"".join([*out, text[last:]])


_built: list[tuple[list, int, list[Automaton]]] = []


def _automata(sent: Broadcast, length: int) -> list[Automaton]:
    """The automata of a broadcast test set, built once in each Python worker; those of the last set alone are kept."""
    shards = sent.value
    if not _built or _built[0][0] is not shards or _built[0][1] != length:
        _built[:] = [(shards, length, [Automaton(s, length) for s in shards])]
    return _built[0][2]


def _merge(spans: list[tuple[int, int]], words: int) -> tuple[list[int], list[int]]:
    """Disjoint spans that cover the same words, in order, as starts and ends."""
    hit = np.zeros(words + 1, np.int32)
    for i, j in spans:
        hit[i] += 1
        hit[j] -= 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(hit)[:-1] > 0, [0])).astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _passes(items: DataFrame, most: int) -> Iterator[list[list]]:
    """The items with words (id as string or None, words), in lists of `most` words or so, each dealt to automata."""
    shards: list[list] = [[]]
    held = total = 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        words = words_of(r[1].encode())
        if not words:
            continue
        if total and total + len(words) > most:
            yield shards
            shards, held, total = [[]], 0, 0
        if held and held + len(words) > WORDS_PER_AUTOMATON:
            shards.append([])
            held = 0
        shards[-1].append((None if r[0] is None else str(r[0]), words))
        held += len(words)
        total += len(words)
    yield [x for x in shards if x]


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 13, max_span: int | None = None, max_cover: float = 0.0, carry: tuple[str, ...] = (), texts: bool = False, pass_words: int = 600_000) -> DataFrame:
    """Hold docs (doc_id, text) against items (item_id, text), the test set.

    A window is `length` consecutive words of an item, or all words of an item of fewer. A word of a document is hit if
    it lies in an occurrence of a window. One row for each row of docs, repeated rows and equal or null doc_ids included:
    doc_id, n_words, n_hit, n_items (distinct item_ids with windows that occur), items (those as strings, sorted),
    longest (words of the longest hit span), clean_text (the text less the hit spans; where nothing is hit the text itself
    with `texts`, else null), drop (more than max_cover of the words are hit, or a hit span is longer than max_span, if given).
    Null and empty texts have no words; null and empty items no windows. An item whose id is null hits words, but isn't
    counted or named. An empty test set hits nothing. Columns of docs named in `carry` come along in a struct `carried`;
    others are not read.

    Test sets are curated and small. One of up to pass_words words goes to every executor, as automata of
    WORDS_PER_AUTOMATON words that are built once in each Python worker and take about half a KB for each word there.
    Larger ones are held against the documents in several passes of so many words, whose hits are then put together.
    """
    spark = docs.sparkSession
    tune(spark)
    chosen = docs.select(F.monotonically_increasing_id(), "doc_id", F.struct(*carry) if carry else F.lit(None).cast("int"), "text").toDF("rid", "doc_id", "carried", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:3])

    def row(text: bytes | None, words: int, starts: list[int], ends: list[int], found: set[str]) -> tuple:
        spans = list(zip(starts, ends, strict=True))
        clean = cut(text, spans) if spans else text if texts else None
        return words, sum(ends) - sum(starts), sorted(found), max((j - i for i, j in spans), default=0), None if clean is None else clean.decode("utf-8", "replace")

    def out(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("carried"), *(pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "carried", "n_words", "n_hit", "items", "longest", "clean_text"])

    def hits(sent: Broadcast, text: bytes | None) -> tuple[int, list[int], list[int], set[str]]:
        words = words_of(text) if text else []
        spans, found = [], set()
        for a in _automata(sent, length):
            own, which = a.hits(words)
            spans += own
            found |= {a.items[k] for k in which} - {None}
        return len(words), *_merge(spans, len(words)), found

    def whole(sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield out(b, [row(t, *hits(sent, t)) for t in binaries(b.column("text"))])

        return run

    def one_pass(sent: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [(rid, *hits(sent, t)[1:]) for rid, t in zip(b.column("rid").to_pylist(), binaries(b.column("text")), strict=True)]
                rid, starts, ends, found = zip(*(x for x in own if x[1]), strict=True) if any(x[1] for x in own) else ([], [], [], [])
                yield pa.record_batch({"rid": pa.array(list(rid), pa.int64()), "starts": pa.array(list(starts), pa.list_(pa.int64())), "ends": pa.array(list(ends), pa.list_(pa.int64())), "found": pa.array([sorted(x) for x in found], pa.list_(pa.string()))})

        return run

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, starts, ends, found in zip(binaries(b.column("text")), *(b.column(c).to_pylist() for c in ("starts", "ends", "found")), strict=True):
                n = len(words_of(t)) if t else 0
                spans = [(i, j) for s, e in zip(starts or [], ends or [], strict=True) for i, j in zip(s, e, strict=True)]
                rows.append(row(t, n, *_merge(spans, n), {x for xs in found or [] for x in xs}))
            yield out(b, rows)

    schema = f"{kinds}, n_words long, n_hit long, items array<string>, longest long, clean_text string"
    passes = _passes(items, pass_words)
    first, second = next(passes), next(passes, None)
    if second is None:
        found = chosen.drop("rid").mapInArrow(whole(spark.sparkContext.broadcast(first)), schema)
    else:
        chosen, parts = materialize(chosen, "documents"), []
        for shards in chain((first, second), passes):
            sent = spark.sparkContext.broadcast(shards)
            parts.append(materialize(chosen.select("rid", "text").mapInArrow(one_pass(sent), "rid long, starts array<long>, ends array<long>, found array<string>"), "hits"))
            sent.unpersist()
        # a document has a row for each pass at most
        every = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(*(F.collect_list(c).alias(c) for c in ("starts", "ends", "found")))
        found = chosen.join(every, "rid", "left").drop("rid").mapInArrow(joined, schema)
    drop = F.col("n_hit") > F.col("n_words") * max_cover
    if max_span is not None:
        drop = drop | (F.col("longest") > max_span)
    return found.select("doc_id", *(["carried"] if carry else []), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "longest", "clean_text", drop.alias("drop"))


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
