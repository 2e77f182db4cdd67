"""Corpus-wide word statistics and their join to documents.

A word's value (its pieces, its count) comes from a table with a row for each distinct word. The most frequent words of
that table, a bounded number of bounded keys, go to every executor; each document's other words are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, materialize

#: Words sent to every executor, at most; with KEY_BYTES each that is 20 MB of keys.
HOT_WORDS = 300_000
#: Longer words get a digest as their key. No word holds a space, so digests can't meet words.
KEY_BYTES = 64
#: Bytes of text whose words a task gathers, at most about, before it passes them on.
HELD_BYTES = 64 << 20


def key_of(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else b" " + hashlib.sha256(word).digest()


def split_words(text: bytes) -> list[bytes]:
    return text.split()


def count_words(docs: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(word, n): every distinct word of column text, however long, with its count."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        read = 0

        def out() -> pa.RecordBatch:
            got = pa.record_batch({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return got

        for b in batches:
            for t in binaries(b.column("text")):
                if t:
                    held.update(split(t))
                    read += len(t)
            if len(held) > 400_000 or read > HELD_BYTES:
                yield out()
                read = 0
        yield out()

    return docs.select("text").mapInArrow(partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int = HOT_WORDS) -> DataFrame:
    """The rows of (word, n, ...) whose n reaches the least bound that no more than `most` words reach.

    Bounds are quarter powers of two, so the histogram has a few hundred rows at any size."""
    power = F.floor(F.log2("n") * 4)
    left, bound = most, 1 << 30
    for r in sorted(words.groupBy(power.alias("power")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, bound = left - r["count"], r["power"]
    return words.where(power >= bound)


def match_words(docs: DataFrame, columns: str, f: Callable, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """A table with a row for each document: rid, doc_id, columns (DDL) and rare: an array of (word, n) left to join.

    f(text, frequencies) gives the values of columns and the rare words' frequencies. rid tells rows apart, whatever doc_id says.
    """
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values: list[list] = [[] for _ in names]
            offsets, keys, counts = [0], [], []
            for t in binaries(b.column("text")):
                t = t or b""
                row, rare = f(t, Counter(split(t)))
                for v, x in zip(values, row, strict=True):
                    v.append(x)
                keys += rare
                counts += rare.values()
                offsets.append(len(keys))
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), *(pa.array(v) for v in values), rare], ["rid", "doc_id", *names, "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, {columns}, rare array<struct<word:binary,n:long>>")
    return materialize(rows, "matched")


def rare_rows(matched: DataFrame) -> DataFrame:
    """(rid, word, n) of the words left to join."""
    return matched.select("rid", F.inline("rare"))
