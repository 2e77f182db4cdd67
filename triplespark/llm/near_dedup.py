"""Near-duplicate detection by a chosen-path set similarity join.

A document is the set of its word shingles, seen through a signature of minwise tokens. In each of several independent
trees every node chooses two positions of the signature by its own hash, and sends a document on along the tokens that it
has there, so that similar documents meet in the same small nodes. Small nodes are compared exhaustively, by signature;
links are confirmed on full sets. Large nodes are split at random and held against one of their members, and as long as
they join documents that are not yet known to be connected, branch further.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, hash_words, materialize, mix, tune
from .components import components

#: Minwise tokens of a signature.
TOKENS = 128
#: Independent trees, and the depth at which nodes are first compared: each document is in TREES * 2 ** DEPTH nodes. A pair
#: of similarity 0.8 meets in a tree with probability 0.946, so misses all with 9e-6.
TREES, DEPTH = 4, 2
#: Nodes of more documents are large. Large ones branch down to DEEPEST, then are compared in blocks.
LARGE = 1024
DEEPEST = 8
#: Pairs of signatures compared at once, about.
COMPARED = 500_000
#: A signature's similarity that a pair has at least if its true one is the threshold: four standard deviations below.
MARGIN = 0.14
#: Documents, and bytes of their texts, that are held against one other together, at most about; and documents outside a
#: main component that are held against so many inside.
CONFIRMED, CONFIRMED_BYTES, OUTSIDE = 400, 4 << 20, 64


#: Blocks of the filter that says whose texts are needed, at most.
BLOCKS = 1 << 20


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, TOKENS, np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of a text with fewer words, one hash of all of them; none without words."""
    h = hash_words(text.lower() if text else text)
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= threshold * (len(both) - same)


def signature(have: np.ndarray) -> np.ndarray:
    a, b = _multipliers()
    least = np.full(TOKENS, (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(have), 4096):
            least = np.minimum(least, (have[i : i + 4096, None] * a + b).min(0))
    return mix(least).astype("<u2")


def _step(nodes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Both children of each node (rows: documents) along the document's tokens at the two positions that the node chooses."""
    h = mix(nodes)
    first = (h & np.uint64(0xFFFF)) % np.uint64(TOKENS)
    second = (first + np.uint64(1) + (h >> np.uint64(16) & np.uint64(0xFFFF)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    out = []
    with np.errstate(over="ignore"):
        for at in (first, second):
            token = np.take_along_axis(signs, at.astype(np.int64), 1).astype(np.uint64)
            out.append(mix(nodes * np.uint64(0x9E3779B97F4A7C15) + (at << np.uint64(32) | token)))
    return np.concatenate(out, 1)


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, TOKENS)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rid): the documents' nodes at DEPTH in all trees."""
    for b in batches:
        if b.num_rows:
            signs = _signs(b.column("sign"))
            nodes = np.repeat(mix(np.arange(1, TREES + 1, dtype=np.uint64))[None], b.num_rows, 0)
            for _ in range(DEPTH):
                nodes = _step(nodes, signs)
            yield pa.record_batch({"node": pa.array(nodes.view(np.int64).ravel()), "rid": pa.array(np.repeat(b.column("rid").to_numpy(), nodes.shape[1]))})


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            nodes, signs = b.column("node").to_numpy().view(np.uint64)[:, None], _signs(b.column("sign"))
            for _ in range(2):
                nodes = _step(nodes, signs)
            yield pa.record_batch({"node": pa.array(nodes.view(np.int64).ravel()), "rid": pa.array(np.repeat(b.column("rid").to_numpy(), 4))})


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each token."""
    for b in batches:
        if b.num_rows:
            low = _signs(b.column("sign")).astype(np.uint8)
            yield pa.record_batch({"rid": b.column("rid"), "sketch": pa.array([x.tobytes() for x in low], pa.binary())})


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of neighbours in groups of these sizes, as positions in their concatenation."""
    starts = np.cumsum(np.concatenate(([0], sizes[:-1])))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes):
        i, j = np.triu_indices(n, 1)
        own = starts[sizes == n][:, None]
        left.append((own + i).ravel())
        right.append((own + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _alike(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.float32)
    for a in range(0, len(i), 100_000):
        out[a : a + 100_000] = (sketches[i[a : a + 100_000]] == sketches[j[a : a + 100_000]]).mean(1)
    return out


def _compare(least: float, every: bool):
    """Batches of groups (members: array of rid, sketch, root) to pairs (u, v, alike), u < v, of signatures alike enough.

    every: all pairs of different roots; else each document's pair with one smaller rid: one that is surely similar and
    least, or the most similar one."""

    def compared(members: pa.ListArray) -> pa.RecordBatch:
        sizes = pa.compute.list_value_length(members).to_numpy().astype(np.int64)
        flat = pa.compute.list_flatten(members)
        rid, root = flat.field("rid").to_numpy(), flat.field("root").to_numpy()
        sketches = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
        i, j = _pairs(sizes)
        if every:
            other = root[i] != root[j]
            i, j = i[other], j[other]
        alike = _alike(sketches, i, j)
        near = alike >= least
        i, j, alike = i[near], j[near], alike[near]
        u, v = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
        if not every and len(u):
            owner = np.where(rid[i] > rid[j], i, j)
            order = np.lexsort((u, np.where(alike >= 0.9, 0, 1 - alike), owner))
            first = order[np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) != 0)))]
            u, v, alike = u[first], v[first], alike[first]
        return pa.record_batch({"u": pa.array(u), "v": pa.array(v), "alike": pa.array(alike.astype(np.float32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column("members")
            pairs = np.cumsum(pa.compute.list_value_length(members).to_numpy().astype(np.int64) ** 2 // 2)
            at = 0
            while at < len(members):
                end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + COMPARED)))
                yield compared(members.slice(at, end - at))
                at = end

    return run


def _hold(least: float):
    """(u, v, alike) of rows (rid, root, sketch, others: array of rid, root, sketch) of different roots where alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                others = b.column("others")
                sizes = pa.compute.list_value_length(others).to_numpy().astype(np.int64)
                flat = pa.compute.list_flatten(others)
                theirs = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
                own = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
                i = np.repeat(np.arange(b.num_rows), sizes)
                alike = (own[i] == theirs).mean(1) if len(i) else np.zeros(0)
                rid, other = b.column("rid").to_numpy()[i], flat.field("rid").to_numpy()
                near = (alike >= least) & (b.column("root").to_numpy()[i] != flat.field("root").to_numpy())
                u, v = np.minimum(rid, other)[near], np.maximum(rid, other)[near]
                yield pa.record_batch({"u": pa.array(u), "v": pa.array(v), "alike": pa.array(alike[near].astype(np.float32))})

    return run


PAIRS = "u long, v long, alike float"


def _bloomed(texts: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of texts (rid, text) that may be in rids: a blocked Bloom filter, broadcast, spares shuffling the others. It
    has a block of 256 bits for every 16 rids, BLOCKS (40 MB) at most, and merely passes more beyond that."""
    h = F.xxhash64("rid")
    block, bits = F.pmod(h, F.lit(min(BLOCKS, max(64, rids.count() // 16)))).cast("int"), []
    for w in range(4):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 16 + 6 * w).bitwiseAND(F.lit(63)).cast("int"))
        bits.append(bit)
    table = rids.select(block.alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)))
    met = texts.withColumn("block", block).join(F.broadcast(table), "block")
    for i, b in enumerate(bits):
        met = met.where(F.col(f"b{i}").bitwiseAND(b) != 0)
    return met.select("rid", "text")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (u, v) of rids whose full shingle sets have a Jaccard similarity of threshold percent or more.

    Every v is sent to its u's, with its text; a u with many is copied to several tasks."""
    pairs = materialize(pairs.select("u", "v").distinct(), "pairs")
    needed = materialize(_bloomed(texts, pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).distinct()), "needed")
    sizes = needed.select(F.col("rid").alias("v"), F.octet_length("text").alias("size"))
    parts = pairs.join(sizes, "v").groupBy("u").agg(F.ceil(F.greatest(F.count("*") / CONFIRMED, F.sum("size") / CONFIRMED_BYTES)).cast("int").alias("parts"))
    children = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("rid")).join(needed, "rid")
    parents = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("rid")).join(needed, "rid")
    kept = F.struct("rid", "text")
    together = parents.join(children.groupBy("u", "part").agg(F.collect_list(kept).alias("children")), ["u", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for own, text, rest in zip(b.column("u").to_pylist(), b.column("text").to_pylist(), b.column("children").to_pylist(), strict=True):
                have = shingles(text.encode(), size)
                for c in rest:
                    other = shingles(c["text"].encode(), size)
                    if _linked(have, other, threshold):
                        u.append(own)
                        v.append(c["rid"])
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return together.select("u", "text", "children").mapInArrow(run, "u long, v long")


def _grouped(rows: DataFrame, sketches: DataFrame, root: Column | None = None) -> DataFrame:
    """(group, members) of rows (group, rid[, root])."""
    member = F.struct("rid", "sketch", (F.lit(0).cast("long") if root is None else root).alias("root"))
    return rows.join(sketches, "rid").groupBy("group").agg(F.collect_list(member).alias("members")).select("members")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """docs (doc_id, text, and any other columns, all kept) with columns n_shingles, component_id and first.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set is its distinct shingles of `size`
    words; with fewer words, their whole sequence is its one shingle; without words or text it is empty, and linked with
    nothing. Documents are linked if the Jaccard similarity of their sets is `threshold` percent or more, confirmed on the
    full sets, and links make components. component_id is the smallest doc_id of the component, the document's own
    included; null ids are passed over, and a component without any has null. `first` marks one row of each component:
    that of the smallest doc_id (nulls last), and of repeated ones the earliest read. Every row of docs gives one row,
    repeated rows included. Columns of docs named n_shingles, component_id or first are replaced.

    Documents of equal sets are one to everything after their grouping. All tables, links and components stay distributed.
    """
    spark = docs.sparkSession
    tune(spark)
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    docs = docs.drop("n_shingles", "component_id", "first")
    own = docs.columns

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            counts, classes, signs = [], [], []
            for t in binaries(b.column("text")):
                have = shingles(t, size)
                counts.append(len(have))
                classes.append(xxh3_128_digest(have.tobytes()) if len(have) else None)
                signs.append(signature(have).tobytes() if len(have) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(signs, pa.binary())], [*b.schema.names, "n_shingles", "_class", "_sign"])

    schema = StructType([*docs.schema.fields, StructField("_rid", LongType()), StructField("n_shingles", LongType()), StructField("_class", BinaryType()), StructField("_sign", BinaryType())])
    held = materialize(docs.withColumn("_rid", F.monotonically_increasing_id()).mapInArrow(sketch, schema), "sketched")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_rid").alias("rid"))
    classes = held.where("n_shingles > 0").groupBy("_class").agg(F.min("_rid").alias("rid"), F.min(order).alias("low"), F.max("_sign").alias("sign"))
    classes = materialize(classes, "classes")
    texts = held.select(F.col("_rid").alias("rid"), "text")
    signs = classes.select("rid", "sign")
    sketches = materialize(signs.mapInArrow(_sketch, "rid long, sketch binary"), "sketches")
    least = threshold / 100 - MARGIN

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows (node, rid) of small nodes, and of large ones with the size and the least member."""
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rid").alias("least")).where("n > 1")
        met = materialize(rows.join(sizes.hint("merge"), "node"), "nodes")
        return met.where(F.col("n") <= LARGE).select("node", "rid"), met.where(F.col("n") > LARGE)

    small, large = split(signs.mapInArrow(_roots, "node long, rid long"))
    blocks = large.select(F.xxhash64("node", F.pmod(F.xxhash64("rid", "node"), F.ceil(F.col("n") / LARGE))).alias("group"), "rid")
    groups = _grouped(small.select(F.col("node").alias("group"), "rid").unionByName(blocks), sketches)
    found = groups.mapInArrow(_compare(least, every=False), PAIRS)
    pivot = sketches.select(F.col("rid").alias("least"), F.array(F.struct("rid", F.col("rid").alias("root"), "sketch")).alias("others"))
    against = large.where("rid != least").select("rid", "least").distinct().join(sketches, "rid").join(pivot, "least").select("rid", F.col("rid").alias("root"), "sketch", "others").mapInArrow(_hold(least), PAIRS)
    nearness = F.struct(F.when(F.col("alike") >= 0.9, 0.0).otherwise(1 - F.col("alike")).alias("far"), "u")
    chosen = found.unionByName(against).groupBy("v").agg(F.min(nearness).alias("best")).select(F.col("best.u").alias("u"), "v")
    links = materialize(confirm(chosen, texts, size, threshold), "links")
    roots = materialize(components(links), "roots")

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))

    def open_(rows: DataFrame, key: str) -> DataFrame:
        """The rows of nodes that hold more than one component, with the roots."""
        rows = rooted(rows)
        several = rows.groupBy(key).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select(key)
        return materialize(rows.join(several, key), "open")

    more = [_grouped(open_(small.select(F.col("node").alias("group"), "rid"), "group"), sketches, F.col("root")).mapInArrow(_compare(least, every=True), PAIRS)]
    direct = []
    depth, left = DEPTH, open_(large.select("node", "rid"), "node")
    while not left.isEmpty():
        # where one component has most of a large node, the others are held against it; branching would only copy it
        sizes = left.groupBy("node", "root").count().groupBy("node").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("n"))
        sizes = materialize(left.join(sizes.select("node", "n", F.col("main.root").alias("main"), (F.col("main.count") * 2 >= F.col("n")).alias("dense")), "node"), "dense")
        dense = sizes if depth >= DEEPEST else sizes.where("dense")
        direct.append(_against_main(dense, sketches, texts, size, threshold, least))
        rest = sizes.where("not dense").select("node", "rid")
        depth += 2
        if depth > DEEPEST or rest.isEmpty():
            break
        small, large = split(rest.join(signs, "rid").mapInArrow(_deeper, "node long, rid long"))
        more.append(_grouped(open_(small.select(F.col("node").alias("group"), "rid"), "group"), sketches, F.col("root")).mapInArrow(_compare(least, every=True), PAIRS))
        left = open_(large.select("node", "rid"), "node")
    crossing = reduce(DataFrame.unionByName, more).select("u", "v").distinct().join(chosen, ["u", "v"], "left_anti")
    found = reduce(DataFrame.unionByName, [confirm(crossing, texts, size, threshold), *direct])
    roots = materialize(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)), "roots")
    of_class = rooted(classes.select("_class", "rid", "low"))
    lows = of_class.groupBy("root").agg(F.min("low").alias("low"))
    of_class = of_class.drop("low").join(lows, "root").select("_class", F.col("low.doc_id").alias("component_id"), F.col("low.rid").alias("_low"))
    # a class may hold a third of all documents: its rows meet it without their texts, in a join that is split where it is skewed
    told = held.where("n_shingles > 0").select("_rid", "_class").join(of_class.hint("merge"), "_class").select("_rid", "component_id", (F.col("_rid") == F.col("_low")).alias("first"))
    some = held.where("n_shingles > 0").join(told, "_rid").select(*own, "n_shingles", "component_id", "first")
    none = held.where("n_shingles = 0").select(*own, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return some.unionByName(none)


def _against_main(rows: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, threshold: int, least: float) -> DataFrame:
    """Links (u, v) in large nodes (node, rid, root, main): the documents outside a main component against all that share
    nodes with it. Nodes of one main component are one family, so each pair is looked at once; its two sides are dealt in
    blocks to tasks of their own, where signatures choose the pairs to confirm on full sets, and links alone come out."""
    family = rows.groupBy("main", "rid").agg(F.min("root").alias("root"))
    outside = F.col("root") != F.col("main")
    blocks = family.groupBy("main").agg(F.ceil(F.count_if(outside) / OUTSIDE).cast("int").alias("blocks"), F.ceil(F.count("*") / CONFIRMED).cast("int").alias("parts")).where("blocks > 0")
    needed = _bloomed(texts, family.select("rid"))
    held = materialize(family.join(blocks, "main").join(sketches, "rid").join(needed, "rid"), "family")
    at = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.select("main", at("parts").alias("part"), spread("blocks").alias("block"), "rid", "root", "sketch", "text")
    right = held.where(outside).select("main", spread("parts").alias("part"), at("blocks").alias("block"), "rid", "root", "sketch", "text")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        if a.num_rows and b.num_rows:
            one, two = (np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS) for t in (a, b))
            roots = [t["root"].to_numpy() for t in (a, b)]
            rids = [t["rid"].to_pylist() for t in (a, b)]
            texts = [binaries(t["text"]) for t in (a, b)]
            joined: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def top(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for j in range(len(two)):
                near = np.flatnonzero(((one == two[j]).mean(1) >= least) & (roots[0] != roots[1][j]))
                for i in near.tolist():
                    x, y = top(int(roots[0][i])), top(int(roots[1][j]))
                    if x == y:
                        continue
                    pair = []
                    for side, k in ((0, i), (1, j)):
                        rid = rids[side][k]
                        if rid not in sets:
                            sets[rid] = shingles(texts[side][k], size)
                        pair.append(sets[rid])
                    if _linked(*pair, threshold):
                        joined[x] = y
                        links.append((rids[0][i], rids[1][j]))
        u, v = zip(*links, strict=True) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    key = ["main", "part", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "u long, v long")
