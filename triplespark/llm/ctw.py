"""Language-model scoring by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, joined by one space, and a closing line feed. Each byte is eight binary decisions;
a context of the preceding bytes and the bits decided so far keeps counts of both outcomes, estimates by Krichevsky and
Trofimov, and mixes, half and half a priori, its own estimate with those of all longer contexts. The model is the tree
after all training texts; a text's score is the log10 probability that the weighted mixture gives it.

The tree has every context of up to DEPTH bytes that occurs in training, so it grows with the corpus. It is sharded by
the last DEALT bytes before the predicted one: a shard weighs contexts of so many bytes and more alone, and only the sums
for shorter ones, 256 ** (DEALT - 1) * 255 at most, meet on the driver. Documents are dealt to parts; a part sends each of
its distinct contexts with the next byte to its shard once, and gets its probability back, and each of its distinct words
to a bucket once, and gets its count back.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Lookup, binaries, chunks, grouped, hash_words, materialize, packed, tune, words_at

#: Bytes of context.
DEPTH = 6
#: Contexts are dealt to shards by their last bytes.
DEALT = 3
END = b"\n"
#: Bytes of text worked on together.
PIECE = 2 << 20
#: Bytes of text, about, whose contexts are sent to the shards together.
PART = 32 << 20
#: Bytes of the corpus's text for a shard of contexts, and for a bucket of words.
SHARD_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Parts that a task answers for one shard, at most, about.
ASKING = 4096


def line(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END


def _grams(lines: list[bytes]) -> np.ndarray:
    """Each byte of the lines with its context, DEPTH line feeds before a line: the byte lowest, the byte before it next, and so on."""
    joined = np.frombuffer((END * DEPTH) + (END * DEPTH).join(lines), np.uint8).astype(np.int64)
    whole, done = joined, 1
    while done < DEPTH + 1:  # twice as many bytes at a time
        more = min(done, DEPTH + 1 - done)
        shorter = whole & (1 << 8 * more) - 1
        whole = whole.copy()
        whole[done:] |= shorter[:-done] << 8 * done
        done += more
    sizes = np.array([len(x) for x in lines])
    own = np.ones(len(joined), bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    for d in range(DEPTH):
        own[starts + d] = False
    return whole[own]


def _pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A long line in pieces, each with so many bytes before it as context."""
    for a in range(0, len(text), PIECE):
        yield text[max(0, a - DEPTH) : a + PIECE], min(a, DEPTH)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Whether each of some sorted keys is the first of its kind."""
    return np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(_firsts(keys))
    return keys[first], np.add.reduceat(counts, first)


#: By n up to 4,096: log gamma of n + 1/2, and of n + 1.
_HALVES = np.array([math.lgamma(n + 0.5) for n in range(4097)])
_WHOLES = np.array([math.lgamma(n + 1) for n in range(4097)])


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log gamma of n + shift: of the table, and by Stirling's series beyond it."""
    out = table[np.minimum(n, 4096)]
    far = np.flatnonzero(n > 4096)
    if len(far):
        y = n[far] + shift
        out[far] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y)
    return out


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT estimator's probability of a zeros and b ones."""
    return _lgamma(a, _HALVES, 0.5) + _lgamma(b, _HALVES, 0.5) - _lgamma(a + b, _WHOLES, 1.0) - math.log(math.pi)


class Counts:
    """Counts of 0 and 1 by context of one length and inner node of the bit tree, for the nodes that occur.

    pairs: context << 8 | byte, sorted. By level b of the bit tree, first[b] is the first pair of each node and node[b] the
    node of each pair."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray) -> None:
        self.pairs, self.n = pairs, n
        self.first, self.node, self.chance, self.alone = [], [], [], []
        for b in range(8):
            new = _firsts(pairs >> (8 - b))
            first = np.flatnonzero(new)
            ones = np.add.reduceat(n * (pairs >> (7 - b) & 1), first)
            both = np.add.reduceat(n, first)
            self.first.append(first)
            self.node.append(np.cumsum(new, dtype=np.int32) - 1)
            self.chance.append((ones + 0.5) / (both + 1))
            self.alone.append(_kt(both - ones, ones))
        self.share = [np.ones(len(x)) for x in self.first]
        self.weighted = self.alone

    def weigh(self, below: list[np.ndarray]) -> None:
        """below: by level and node, the log of the product of the longer contexts' weighted probabilities."""
        self.weighted = [np.logaddexp(a, x) - math.log(2) for a, x in zip(self.alone, below, strict=True)]
        self.share = [np.exp(a - math.log(2) - w) for a, w in zip(self.alone, self.weighted, strict=True)]

    def keys(self, b: int) -> np.ndarray:
        """The nodes as context << 8 | a one and the first b bits."""
        pairs = self.pairs[self.first[b]]
        return pairs & ~255 | 1 << b | (pairs & 255) >> (8 - b)


def _low(d: int) -> int:
    """Masks a gram to a context of d bytes and the byte."""
    return (1 << 8 * (d + 1)) - 1


class Contexts:
    """The contexts of least to most bytes in some grams (distinct, sorted), weighed bottom up.

    A gram's n is how often it occurs in training; those with 0 stand for contexts that are only asked for, and change
    nothing: they give each bit 1/2, as do contexts that aren't there. below: by level, the sums of the weighted logs of
    contexts longer than `most`, by node; none if there are no longer ones."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, least: int, most: int, below: list[np.ndarray] | None = None) -> None:
        self.least = least
        #: From the longest: the counts, and where the pairs of the length before are among theirs.
        self.counts: list[Counts] = []
        self.up: list[np.ndarray] = []
        for d in range(most, least - 1, -1):
            if d < most:
                longer = grams & _low(d)
                order = np.argsort(longer)
                grams = longer[order]
                new = _firsts(grams)
                up = np.empty(len(longer), np.int32)
                up[order] = np.cumsum(new, dtype=np.int32) - 1
                first = np.flatnonzero(new)
                grams, n = grams[first], np.add.reduceat(n[order], first)
                self.up.append(up)
            own = Counts(grams, n)
            if d < most:
                before = self.counts[-1]
                own.weigh([np.bincount(own.node[b][up[before.first[b]]], before.weighted[b], len(own.first[b])) for b in range(8)])
            elif below is not None:
                own.weigh(below)
            self.counts.append(own)

    def sums(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, n, weighted) for contexts of least - 1 bytes: counts by gram, and with a bit above sums of the weighted logs by node."""
        own, mask = self.counts[-1], _low(self.least - 1)
        keys, n = _merged([(own.pairs & mask, own.n)])
        yield keys, n, np.zeros(len(keys))
        for b in range(8):
            keys, w = _merged([(own.keys(b) & mask, own.weighted[b])])
            yield keys | mask + 1, np.zeros(len(keys), np.int64), w

    def mixed(self, b: int, pairs: np.ndarray, said: np.ndarray | float, left: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """What contexts up to these say of a 1 at level b, and the share left for longer ones; pairs: of the longest contexts.

        said, left: what shorter contexts than these say, by their node at this level of the shortest ones here."""
        at = [pairs]
        for up in self.up:
            at.append(up[at[-1]])
        for i, (own, p) in enumerate(zip(reversed(self.counts), reversed(at), strict=True)):
            node = own.node[b][p]
            if i == 0 and not isinstance(said, float):
                said, left = said[node], left[node]
            said = said + left * (own.share[b] * own.chance[b])[node]
            left = left * (1 - own.share[b])[node]
        return said, left

    def logs(self, top: Top) -> np.ndarray:
        """Log2 probability of each gram's byte after its context."""
        every, byte = np.arange(len(self.counts[0].pairs)), self.counts[0].pairs & 255
        out = np.zeros(len(every))
        for b in range(8):
            said, _ = self.mixed(b, every, *top.of(self.counts[-1].keys(b)))
            out += np.log2(np.where(byte >> (7 - b) & 1, said, 1 - said))
        return out


class Top:
    """What contexts of fewer than DEALT bytes say of a 1, and the share left for longer ones, by node; from Contexts.sums."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, weighted: np.ndarray) -> None:
        order = np.argsort(keys)
        keys, n, weighted = keys[order], n[order], weighted[order]
        limit = 256**DEALT
        grams = keys < limit
        nodes, sums = keys[~grams] - limit, weighted[~grams]
        own = Contexts(keys[grams], n[grams], 0, DEALT - 1)
        longest = own.counts[0]
        own = Contexts(keys[grams], n[grams], 0, DEALT - 1, [sums[np.searchsorted(nodes, longest.keys(b))] for b in range(8)])
        said, left = zip(*(own.mixed(b, longest.first[b], 0.0, 1.0) for b in range(8)), strict=True)
        keys = np.concatenate([longest.keys(b) for b in range(8)])
        order = np.argsort(keys)
        self.keys, self.said, self.left = keys[order].astype(np.int32), np.concatenate(said)[order], np.concatenate(left)[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (keys & _low(DEALT - 1)).astype(np.int32))
        return self.said[at], self.left[at]


def _dealt(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sorted grams by shard, then gram; the shards that have some, and where they begin."""
    context = grams >> 8 & (1 << 8 * DEALT) - 1
    shard = (context * 0x9E3779B1 & 0xFFFFFFFF) * shards >> 32
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(_firsts(shard))
    return order, shard[first], first


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of eight-byte numbers, byte by byte, compressed."""
    planes = np.concatenate(columns).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: pa.Buffer | bytes, size: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, size * 8 * columns, "zstd", asbytes=True), np.uint8)
    return np.split(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1), columns)


def _pack_grams(grams: np.ndarray, n: np.ndarray) -> bytes:
    return _pack(np.diff(grams, prepend=0), n)


def _unpack_grams(data: pa.Buffer | bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    steps, n = _unpack(data, size, 2)
    return np.cumsum(steps), n


def _pack_logs(logs: np.ndarray) -> bytes:
    return pa.compress(logs.astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack_logs(data: pa.Buffer | bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, size * 4, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<f4").reshape(-1)


def _gram_chunks(lines: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first line, grams, the line of each from there), PIECE bytes or so at a time."""
    for at, some in chunks(lines, PIECE):
        if len(some) > 1 or len(some[0]) <= PIECE:
            yield at, _grams(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
        else:
            for piece, skip in _pieces(some[0]):
                grams = _grams([piece])[skip:]
                yield at, grams, np.zeros(len(grams), np.int64)


#: What a part says: its lines (kind TEXT), its grams by shard and its words by bucket, each as a compressed blob.
TEXT, GRAMS, WORDS = 2, 0, 1
SAID = "part long, kind int, at int, size long, data binary"
_SAID = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("at", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])


def _say(part: int, kind: int, at: list[int], sizes: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([part] * len(at), [kind] * len(at), at, sizes, data), _SAID, strict=True)], schema=_SAID)


def cut_parts(docs: DataFrame, train: Column, shards: int, buckets: int) -> DataFrame:
    """A table of what each part says: blocks of its documents (doc_id, train, text, that being the line); its distinct
    grams, and how often each occurs in training documents, 0 included; the same of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, held = None, 0, []
        words: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def close() -> Iterator[pa.RecordBatch]:
            grams, n = _merged(held)
            held.clear()
            order, own, first = _dealt(grams, shards)
            grams, n = np.split(grams[order], first[1:]), np.split(n[order], first[1:])
            yield _say(part, GRAMS, own.tolist(), [len(x) for x in grams], [_pack_grams(*x) for x in zip(grams, n, strict=True)])
            every = list(words[0] | words[1])
            if every:
                bucket = hash_words(b" ".join(every)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                own, first = np.unique(bucket[order], return_index=True)
                for k, some in zip(own.tolist(), np.split(order, first[1:]), strict=True):
                    some = [every[i] for i in some.tolist()]
                    data = pa.compress(b" ".join(some), "zstd", asbytes=True), _pack(np.array([words[1][w] for w in some], np.int64))
                    yield _say(part, WORDS, [int(k)], [len(some)], [packed(pa.record_batch({"words": [data[0]], "size": [sum(map(len, some)) + len(some) - 1], "n": [data[1]]}))])
            for c in words:
                c.clear()

        for b in batches:
            for at, texts in chunks(binaries(b.column("text")), PIECE):
                rows = b.slice(at, len(texts))
                part = rows["rid"][0].as_py() if part is None else part
                lines, learnt = [line(t) for t in texts], rows["train"].to_pylist()
                block = pa.record_batch([rows["doc_id"], rows["train"], pa.array(lines, pa.binary())], names=["doc_id", "train", "text"])
                yield _say(part, TEXT, [-1], [len(lines)], [packed(block)])
                for which in (True, False):
                    own = [x for x, t in zip(lines, learnt, strict=True) if t is which]
                    for x in own:
                        words[which].update(x.split())
                    for _, grams, _ in _gram_chunks(own):
                        keys, n = np.unique(grams, return_counts=True)
                        held.append((keys, n * which))
                if sum(len(k) for k, _ in held) > 4_000_000:
                    held[:] = [_merged(held)]
                size += sum(map(len, lines))
                if size >= PART:
                    yield from close()
                    part, size = None, 0
        if held:
            yield from close()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(train, F.lit(False)).alias("train"), "text")
    return materialize(rows.mapInArrow(run, SAID), "parts")


def count_all(said: DataFrame, width: int) -> DataFrame:
    """A table (part, at, size, data, distinct, total): the counts in all training texts of a part's words, in their order;
    and once for each bucket its distinct words and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def words(blob: pa.RecordBatch) -> list[bytes]:
            return pa.decompress(blob["words"][0].as_buffer(), blob["size"][0].as_py(), "zstd", asbytes=True).split(b" ")

        for bucket, rows in grouped(batches, "at", "part", "size", "data"):
            held, counts = [], Counter()
            for part, size, data in rows:
                blob = pa.ipc.open_stream(data).read_next_batch()
                held.append((part, size, blob))
                for w, n in zip(words(blob), _unpack(blob["n"][0].as_buffer(), size, 1)[0].tolist(), strict=True):
                    if n:
                        counts[w] += n
            distinct, total = len(counts), sum(counts.values())
            for part, size, blob in held:
                own = words(blob)
                found = _pack(np.fromiter(map(counts.__getitem__, own), np.int64, size))
                out = packed(pa.record_batch({"words": blob["words"], "size": blob["size"], "n": [found]}))
                yield pa.record_batch({"part": pa.array([part], pa.int64()), "at": pa.array([bucket], pa.int32()), "size": pa.array([size], pa.int64()), "data": pa.array([out], pa.binary()), "distinct": pa.array([distinct], pa.int64()), "total": pa.array([total], pa.int64())})
                distinct = total = 0

    own = said.where(F.col("kind") == WORDS).repartition(width, "at").sortWithinPartitions("at")
    return materialize(own.mapInArrow(run, "part long, at int, size long, data binary, distinct long, total long"), "counts")


def _all_grams(blobs: Iterator[tuple[int, pa.Buffer]]) -> tuple[np.ndarray, np.ndarray]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for size, data in blobs:
        held.append(_unpack_grams(data, size))
        if len(held) > 1 and sum(len(k) for k, _ in held) > max(4_000_000, 2 * len(held[0][0])):
            held = [_merged(held)]
    return _merged(held)


def tree_of(said: DataFrame, salts: int, width: int) -> tuple[DataFrame, Top]:
    """A table (at, size, data) of the grams of each shard, and the contexts above the shards."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in grouped(batches, "slot", "size", "data"):
            grams, n = _all_grams(rows)
            yield pa.record_batch({"at": pa.array([slot // salts], pa.int64()), "size": pa.array([len(grams)], pa.int64()), "data": pa.array([_pack_grams(grams, n)], pa.binary())})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped(batches, "at", "size", "data"):
            grams, n = _all_grams(rows)
            yield pa.record_batch({"at": pa.array([shard], pa.int64()), "size": pa.array([len(grams)], pa.int64()), "data": pa.array([_pack_grams(grams, n)], pa.binary()), "key": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "w": pa.nulls(1, pa.float64())})
            for k, c, w in Contexts(grams, n, DEALT, DEPTH).sums():
                none = pa.nulls(len(k), pa.int64())
                yield pa.record_batch({"at": none, "size": none, "data": pa.nulls(len(k), pa.binary()), "key": pa.array(k), "n": pa.array(c), "w": pa.array(w)})

    blobs = said.where(F.col("kind") == GRAMS).select(F.col("at").cast("long").alias("at"), "part", "size", "data")
    if salts > 1:  # a shard's blobs are merged in several tasks first
        slot = (F.col("at") * salts + F.pmod(F.xxhash64("part"), F.lit(salts))).alias("slot")
        blobs = blobs.select(slot, "size", "data").repartition(width, "slot").sortWithinPartitions("slot").mapInArrow(merge, "at long, size long, data binary")
    weighed = blobs.select("at", "size", "data").repartition(width, "at").sortWithinPartitions("at").mapInArrow(weigh, "at long, size long, data binary, key long, n long, w double")
    weighed = materialize(weighed, "tree")
    sums = weighed.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    return weighed.where("key is null").select("at", "size", "data"), Top(*(sums[c].to_numpy() for c in ("key", "n", "w")))


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Learn from the rows of docs (doc_id, text) where `train` holds, and score all of them.

    One row for each row of docs, repeated rows and equal or null doc_ids included: doc_id, n_tokens (words and one end),
    n_known (tokens seen in training), train_tokens, base_score (log10, add-0.1 unigrams of tokens), score (the tree's
    log10 probability), bits_per_byte. Null texts count as empty: one token, the end. No training rows: N = V = 0, every
    token's base is log10(0.1 / 0.1) = 0, and the tree is empty, with a probability of 1/2 for each bit.
    Other columns are not read.

    Counts of words and of byte contexts cover all training texts, and every context counts. The tree and the counts stay
    in shards on executors, as many as the corpus's size asks for; a shard that many parts ask is answered by several tasks.
    """
    spark = docs.sparkSession
    tune(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bytes_, ends = docs.agg(F.sum(F.octet_length("text")), F.count_if(train)).first()
    shards, buckets = (min(1 << 24, max(low, (bytes_ or 0) // of)) for low, of in ((128, SHARD_BYTES), (width, BUCKET_BYTES)))
    said = cut_parts(docs, train, shards, buckets)
    counted = count_all(said, width)
    distinct, tokens = (x or 0 for x in counted.agg(F.sum("distinct"), F.sum("total")).first())
    ends = ends or 0
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    floor = 0.1 * (distinct + 1) + tokens
    parts = said.where(F.col("kind") == TEXT).agg(F.count_distinct("part")).first()[0]
    salts = -(-max(1, parts) // ASKING)
    tree, top = tree_of(said, salts, width)
    sent = spark.sparkContext.broadcast(top)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "slot", "part", "at", "size", "data"):
            grams = logs = None
            for part, at, size, data in rows:
                if grams is None:  # the shard's own grams stand first
                    grams, n = _unpack_grams(data, size)
                    logs = Contexts(grams, n, DEALT, DEPTH).logs(sent.value)
                else:
                    asked = _pack_logs(logs[np.searchsorted(grams, _unpack_grams(data, size)[0])])
                    yield _say(part, GRAMS, [at], [size], [packed(pa.record_batch({"grams": [data.to_pybytes()], "logs": [asked]}))])

    salted = tree.select(F.explode(F.sequence(F.col("at") * salts, F.col("at") * salts + salts - 1)).alias("slot"), F.lit(-1).cast("long").alias("part"), F.col("at").cast("int").alias("at"), "size", "data")
    asking = said.where(F.col("kind") == GRAMS).select((F.col("at").cast("long") * salts + F.pmod(F.xxhash64("part"), F.lit(salts))).alias("slot"), "part", "at", "size", "data")
    answers = salted.unionByName(asking).repartition(width, "slot").sortWithinPartitions("slot", "part").mapInArrow(answer, SAID)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "part", "kind", "size", "data"):
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAMS: [], WORDS: []}
            logs = counts = None
            for kind, size, data in rows:
                block = pa.ipc.open_stream(data).read_next_batch()
                if kind == GRAMS:
                    found[kind].append((_unpack_grams(block["grams"][0].as_buffer(), size)[0], _unpack_logs(block["logs"][0].as_buffer(), size)))
                    continue
                if kind == WORDS:
                    words = pa.decompress(block["words"][0].as_buffer(), block["size"][0].as_py(), "zstd", asbytes=True)
                    found[kind].append((hash_words(words), _unpack(block["n"][0].as_buffer(), size, 1)[0]))
                    continue
                if logs is None:
                    logs, counts = (Lookup(*(np.concatenate(x) for x in zip(*found[k], strict=True))) if found[k] else None for k in (GRAMS, WORDS))
                    found.clear()
                lines = block["text"].to_pylist()
                said, base = np.zeros(len(lines)), np.full(len(lines), math.log10((ends + 0.1) / floor))
                sizes, seen = np.ones(len(lines), np.int64), np.full(len(lines), int(ends > 0))
                for at, grams, row in _gram_chunks(lines):
                    sums = np.bincount(row, logs.get(grams))
                    said[at : at + len(sums)] += sums
                for at, some in chunks(lines, PIECE):
                    hashes = [hash_words(x) for x in some] if len(some) == 1 else [words_at(b"".join(some))[0]]
                    c = counts.get(hashes[0]) if counts else np.zeros(0, np.int64)
                    row = np.repeat(np.arange(len(some)), [x.count(b" ") + (len(x) > 1) for x in some])
                    sizes[at : at + len(some)] += np.bincount(row, minlength=len(some))
                    seen[at : at + len(some)] += np.bincount(row, c > 0, len(some)).astype(np.int64)
                    base[at : at + len(some)] += np.bincount(row, np.log10((c + 0.1) / floor), len(some))
                said *= math.log10(2)
                bits = -said / math.log10(2) / np.array([len(x) for x in lines])
                yield pa.RecordBatch.from_arrays([block["doc_id"], pa.array(sizes), pa.array(seen), pa.array([tokens] * len(lines), pa.int64()), pa.array(base), pa.array(said), pa.array(bits)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    texts = said.where(F.col("kind") == TEXT)
    counts = counted.select("part", F.lit(WORDS).alias("kind"), "at", "size", "data")
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = answers.unionByName(counts).unionByName(texts).repartition(width, "part").sortWithinPartitions("part", "kind")
    return told.mapInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
