"""What the operators share: intermediate tables, Arrow batches, hashing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import delete_at_end, shared_dir

#: Rows and bytes of an Arrow batch, at most (one row apart): long texts stay within a few MB a batch.
ROWS_PER_BATCH, BYTES_PER_BATCH = 500, 4 << 20

_written: dict[tuple[str, str], list[str]] = {}
_owner = [""]


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small; the defaults of 10,000 rows and 64 MB are too much for long texts."""
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = re.fullmatch(r"(-?\d+)[bB]?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. The table goes with
    release(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    _written.setdefault((spark.sparkContext.applicationId, _owner[-1]), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Tables written within belong to this name, for release()."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def release(spark: SparkSession, name: str = "") -> None:
    """Delete the tables that materialize() wrote under a name; call it once what was made of them is written."""
    jvm = spark.sparkContext._jvm
    for path in _written.pop((spark.sparkContext.applicationId, name), []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def binaries(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string or binary column."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def chunks(texts: Iterable[bytes | None], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts (null as empty) of limit bytes together, at least one, each list with its first index."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def pack(first: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of numbers of one length as a compressed blob, byte by byte; the first, sorted or nearly so, as steps."""
    planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in (np.diff(first, prepend=first.dtype.type(0)), *columns)]
    return len(first).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(data: bytes | pa.Buffer, *kinds: str) -> list[np.ndarray]:
    """What pack() packed, by the columns' types."""
    data = memoryview(data)
    n, types = int.from_bytes(data[:8], "little"), [np.dtype(k) for k in kinds]
    raw = np.frombuffer(pa.decompress(pa.py_buffer(data[8:]), n * sum(t.itemsize for t in types), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in types:
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(-1))
        at += n * t.itemsize
    return [np.cumsum(out[0], dtype=types[0]), *out[1:]]


def packed(batch: pa.RecordBatch, level: int = 1) -> bytes:
    """A batch as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def grouped(batches: Iterator[pa.RecordBatch], key: str, *columns: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows as tuples of columns, by runs of an equal key, as they come; binary values are views of their batch."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            values = [(x.as_buffer() for x in c) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_pylist() for c in (b.column(n) for n in columns)]
            yield from zip(b.column(key).to_pylist(), *values, strict=True)

    for k, own in groupby(rows(), key=itemgetter(0)):
        yield k, (r[1:] for r in own)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random long for each byte at each of the first 64 places of a word.
_PLACES = 64
_BYTES = mix(mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


#: Bytes of a text hashed at once; longer ones are cut at white space.
_BLOCK = 4 << 20


def _blocks(text: bytes) -> Iterator[bytes]:
    while len(text) > _BLOCK:
        end = next((i for i in range(_BLOCK, len(text)) if _SPACE[text[i]]), len(text))
        yield text[:end]
        text = text[end:]
    yield text


def words_at(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run without ASCII white space: a 64-bit hash, its start and its bytes. A hash is the sum of a random long for
    each byte and place, mixed with the length."""
    b = np.frombuffer(text or b"", np.uint8)
    word = ~_SPACE[b]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = edges[1::2] - edges[::2]
    body = b[word]
    starts = np.cumsum(sizes) - sizes
    at = (np.arange(len(body)) - np.repeat(starts, sizes)) * 256 + body
    with np.errstate(over="ignore"):
        if sizes.max() <= _PLACES:
            values = _BYTES[at]
        else:
            values = np.where(at < len(_BYTES), _BYTES[np.minimum(at, len(_BYTES) - 1)], mix(mix((at + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        return mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64)), edges[::2], sizes


def hash_words(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the runs without ASCII white space."""
    return np.concatenate([words_at(x)[0] for x in _blocks(text or b"")])


class Lookup:
    """Values by distinct 64-bit keys: a table of slots, where a key stands in the first free one from that of its hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        none = -1
        while (keys.view(np.int64) == none).any():
            none -= 1
        self.keys, self.values = np.full(1 << bits, none, np.int64), np.zeros(1 << bits, values.dtype)
        keys, left = keys.view(np.int64), np.arange(len(keys))
        at = self._slots(keys)
        while len(left):
            free = left[self.keys[at[left]] == none]
            self.keys[at[free]] = keys[free]
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are there."""
        keys = keys.view(np.int64)
        at = self._slots(keys)
        out = self.values[at]
        left = np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = at + 1 & self.mask
            found = self.keys[at] == keys[left]
            out[left[found]] = self.values[at[found]]
            left, at = left[~found], at[~found]
        return out
