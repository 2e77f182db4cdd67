"""Removal of repeated passages with automata of repeated phrases.

1. Texts are dealt, as they are read, to shards of SHARD_BYTES, kept as compressed Arrow blocks. From every window of
   `length` words the least-hashed phrase of PHRASE words is taken (the same phrase wherever the same window stands), and
   the phrases of all shards meet by hash: only those that recur can mark a recurring passage.
2. Each shard compiles an Aho-Corasick automaton of the recurring phrases that its own documents hold, so its size follows
   the shard's, and streams its documents through it to locate every occurrence.
3. Windows around located phrases meet by a 96-bit hash, once for each shard that holds them, and those that recur return
   to their shards by 64 bits of it, where the words that they cover are removed.

Phrases and windows travel in blobs, one for each shard and bucket of hashes, so a passage that fills the corpus is as many
entries as there are shards, in one bucket of many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, chunks, grouped, hash_words, materialize, mix, pack, packed, tune, unpack

#: Words of a phrase. A word stands for 20 bits of its hash, so six take two longs.
PHRASE = 6
#: Bytes of text, about, in a shard, and in one of its blocks.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Bytes of the corpus's text for each bucket of hashes.
BUCKET_BYTES = 16 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = (1 << 20) - 1
#: What meets in buckets: both longs of a phrase, or the long and the int of a window's hash; n is 2 for twice or more.
PHRASES, WINDOWS = ("<i8", "<i8", "u1"), ("<i8", "<i4", "u1")
#: How hard blocks are compressed: each travels twice.
LEVEL = 4
ROW = "shard long, bucket int, data binary"


def _chars(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _phrases(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By start: both longs of the phrase, and its hash."""
    c = _chars(hashes)
    n = len(c) - PHRASE + 1
    a = c[:n] << 40 | c[1 : n + 1] << 20 | c[2 : n + 2]
    b = c[3 : n + 3] << 40 | c[4 : n + 4] << 20 | c[5 : n + 5]
    with np.errstate(over="ignore"):
        return a, b, mix(a.view(np.uint64) * _M + mix(b.view(np.uint64)))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    out, span = h, 1
    while 2 * span <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(h) - width + 1], out[width - span :])


def _rolled(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes of `length` neighbours: those of powers of two, joined."""
    out, done, span, power = None, 0, 1, h
    with np.errstate(over="ignore"):
        while length:
            step = np.uint64(pow(base, span, 1 << 64))
            if length & 1:
                out = power if out is None else out[: len(power) - done] * step + power[done:]
                done += span
            length >>= 1
            if length:
                power = power[:-span] * step + power[span:]
                span *= 2
    return out


def _windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By start: a long and an int of the window's hash."""
    n = len(hashes) - length + 1
    one, two = _rolled(hashes, length, int(_M))[:n], _rolled(mix(hashes), length, 0xD6E8FEB86659FD93)[:n]
    return mix(one).view(np.int64), (mix(two) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _text(codes: np.ndarray) -> str:
    """Four characters for each word, of alphabets of their own: the automaton looks a node's children up one by one, so
    they must be few, and a match can start at the first of the four only."""
    digits = np.stack([codes >> 15, codes >> 10, codes >> 5, codes], -1) & 31
    return (digits + np.array([1, 33, 65, 97])).astype(np.uint8).tobytes().decode("latin-1")


def _automaton(codes: np.ndarray):
    """codes: a row of PHRASE for each phrase."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    text = _text(codes)
    for i in range(0, len(text), 4 * PHRASE):
        found.add_word(text[i : i + 4 * PHRASE])
    found.make_automaton()
    return found


class Phrases:
    """Some phrases, to be located in texts."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        codes = np.stack([a >> 40, a >> 20 & _LOW, a & _LOW, b >> 40, b >> 20 & _LOW, b & _LOW], 1)
        #: By place in a phrase, the words that stand there: only where all six fit does the automaton look.
        self.places = np.zeros((PHRASE, 1 << 20), bool)
        for i in range(PHRASE):
            self.places[i, codes[:, i]] = True
        self.automaton = _automaton(codes)

    def starts(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - PHRASE + 1
        ok = self.places[0][codes[:n]]
        for i in range(1, PHRASE):
            ok &= self.places[i][codes[i : n + i]]
        at = np.flatnonzero(ok)
        if not len(at):
            return at
        words = np.zeros(len(codes), bool)
        for i in range(PHRASE):
            words[at + i] = True
        words = np.flatnonzero(words)
        last = np.array([end for end, _ in self.automaton.iter(_text(codes[words]))], np.int64) // 4
        first = words[last - PHRASE + 1]
        return first[words[last] - first == PHRASE - 1]

    def candidates(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """By start of a window: whether its least phrase is one of these."""
        starts = self.starts(_chars(hashes))
        if not len(starts):
            return np.zeros(len(hashes) - length + 1, bool)
        h = _phrases(hashes)[2]
        return np.isin(_least(h, length - PHRASE + 1), h[starts])


class Windows:
    """Some windows by the long of their hash, to be found in the texts of the shard that asked for them."""

    def __init__(self, found: np.ndarray) -> None:
        self.found = np.sort(found)
        self.some = np.zeros(1 << 20, bool)
        self.some[found & _LOW] = True

    def covered(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """By word: whether one of these windows covers it."""
        x = _windows(hashes, length)[0]
        near = np.flatnonzero(self.some[x & _LOW])
        at = np.searchsorted(self.found, x[near])
        hit = near[self.found[np.minimum(at, len(self.found) - 1)] == x[near]]
        delta = np.zeros(len(hashes) + 1, np.int64)
        delta[hit] += 1
        delta[hit + length] -= 1
        return np.cumsum(delta)[:-1] > 0


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where sorted pairs begin anew."""
    return np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> Entries:
    """The distinct pairs of two columns, sorted, and 2 for those that occur twice or more, else 1."""
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = _firsts(a, b)
    return a[first], b[first], np.minimum(np.diff(first, append=len(a)), 2).astype(np.uint8)


def _rows(shards: list[int], buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(shards, pa.int64()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], names=["shard", "bucket", "data"])


def _dealt(shard: int, found: Entries, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The entries of a shard, a blob for each bucket, which has a range of keys."""
    own = (keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(own, kind="stable")
    some, first = np.unique(own[order], return_index=True)
    columns = [np.split(x[order], first[1:]) for x in found]
    return _rows([shard] * len(some), some.tolist(), [pack(*x) for x in zip(*columns, strict=True)])


def _recurring(kinds: tuple[str, ...], keep: int):
    """Rows of blobs, a bucket's together, to rows (shard, data) of the entries that occur twice or more in all, their first
    `keep` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "bucket", "shard", "data"):
            shards, found = zip(*((shard, unpack(data, *kinds)) for shard, data in rows), strict=True)
            a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((b, a))
            first = _firsts(a[order], b[order])
            many = np.add.reduceat(n[order].astype(np.int64), first) > 1
            again = np.empty(len(a), bool)
            again[order] = np.repeat(many, np.diff(first, append=len(a)))
            at = 0
            for shard, x in zip(shards, found, strict=True):
                own = again[at : at + len(x[0])]
                at += len(x[0])
                if own.any():
                    yield _rows([shard], [-1], [pack(*(c[own] for c in x[:keep]))])

    return run


def dedup_substrings(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """Remove from each text of docs (doc_id, text) the words that lie in a recurring window.

    Words are runs without ASCII white space, unchanged. A window is `length` (12 or more, else ValueError) consecutive words of one document; it recurs
    if the same words start anywhere else too, in the same document included. Windows are judged on the input: every
    copy of a passage goes. One row for each row of docs, repeated rows and equal or null doc_ids included: doc_id,
    n_words, n_removed, kept_sha256 (lowercase hex of the kept words joined by one space), kept_text (the text if nothing is removed, else
    those words; null without `texts`). Null and empty texts
    have no words, and texts shorter than a window lose none. Columns of docs
    named in `carry` come along in a struct `carried`; others are not read.
    """
    if length < 2 * PHRASE:
        raise ValueError(f"a window has {2 * PHRASE} words or more")
    spark = docs.sparkSession
    tune(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, size // BUCKET_BYTES)
    own = docs.select(F.monotonically_increasing_id(), "doc_id", F.struct(*carry) if carry else F.lit(None).cast("int"), "text").toDF("rid", "doc_id", "carried", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[1:3])

    def phrases(shard: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b, n = _counted(parts)
        with np.errstate(over="ignore"):
            return _dealt(shard, (a, b, n), mix(a.view(np.uint64) * _M + mix(b.view(np.uint64))), buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, found = None, 0, []
        for b in batches:
            for at, some in chunks(binaries(b.column("text")), BLOCK_BYTES):
                block = b.slice(at, len(some))
                shard = block.column("rid")[0].as_py() if shard is None else shard
                yield _rows([shard], [-1], [packed(block.drop_columns(["rid"]), LEVEL)])
                for t in some:
                    words = hash_words(t)
                    if len(words) >= length:
                        x, y, h = _phrases(words)
                        near = np.isin(h, _least(h, length - PHRASE + 1))
                        found.append((x[near], y[near]))
                held += sum(map(len, some))
                if held >= SHARD_BYTES:
                    if found:
                        yield phrases(shard, found)
                    shard, held, found = None, 0, []
        if found:
            yield phrases(shard, found)

    dealt = materialize(own.mapInArrow(deal, ROW), "shards")
    blocks = dealt.where("bucket < 0").select("shard", F.lit(1).alias("bucket"), "data")

    def again(blobs: DataFrame, kinds: tuple[str, ...], keep: int) -> DataFrame:
        """The entries that recur, each shard's before its blocks."""
        met = blobs.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_recurring(kinds, keep), ROW)
        return met.unionByName(blocks).repartition(width, "shard").sortWithinPartitions("shard", "bucket")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped(batches, "shard", "bucket", "data"):
            known, phrases, found = [], None, []
            for kind, data in rows:
                if kind < 0:
                    known.append(unpack(data, *PHRASES[:2]))
                    continue
                if not known:
                    break
                phrases = phrases or Phrases(*(np.concatenate(x) for x in zip(*known, strict=True)))
                for t in binaries(pa.ipc.open_stream(data).read_all()["text"]):
                    hashes = hash_words(t)
                    if len(hashes) >= length and (mark := phrases.candidates(hashes, length)).any():
                        found.append(tuple(x[mark] for x in _windows(hashes, length)))
            if found:
                entries = _counted(found)
                yield _dealt(shard, entries, entries[0], buckets)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "shard", "bucket", "data"):
            known, windows = [], None
            for kind, data in rows:
                if kind < 0:
                    known.append(unpack(data, WINDOWS[0])[0])
                    continue
                windows = windows or (Windows(np.concatenate(known)) if known else None)
                block = pa.ipc.open_stream(data).read_next_batch()
                counts, removed, shas, kept_texts = [], [], [], []
                for t in binaries(block.column("text")):
                    words = t.split() if t else []
                    gone = windows.covered(hash_words(t), length) if windows and len(words) >= length else None
                    cut = int(np.count_nonzero(gone)) if gone is not None else 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if cut else words
                    counts.append(len(words))
                    removed.append(cut)
                    shas.append(_sha(kept))
                    if texts:
                        kept_texts.append(None if t is None else (b" ".join(kept) if cut else t).decode("utf-8", "replace"))
                out = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string()) if texts else pa.nulls(len(counts), pa.string())]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("carried"), *out], ["doc_id", "carried", "n_words", "n_removed", "kept_sha256", "kept_text"])

    windows = again(dealt.where("bucket >= 0"), PHRASES, 2).mapInArrow(locate, ROW)
    out = again(windows, WINDOWS, 1).mapInArrow(remove, f"{kinds}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if carry else out.drop("carried")
