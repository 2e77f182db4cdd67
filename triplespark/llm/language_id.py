"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams, n = 1 to 3 (a blended spectrum), that both hold, each counted
once (presence), over the geometric mean of the numbers that each holds. Landmarks (Nystroem) span the model: a text is seen
only through its kernel with each. One-versus-rest kernel ridge regression gives each language a weight for each landmark.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, chunks, tune

UNKNOWN = "und"
#: Characters scored together: the working arrays stay within some ten MB.
CHARS = 250_000
#: Documents scored together: rows of the presence matrix.
ROWS = 128


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and what it folds to (its one-character lower case)."""
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(s := chr(c))[0] == "L":
            letter[c] = True
            if len(low := s.lower()) == 1:
                fold[c] = ord(low)
    return letter, fold


class Grams:
    """Numbers the 1-, 2- and 3-grams of the landmarks over their letters: 0 is anything but a letter, 1 a letter they lack.

    An n-gram's code follows from the shorter one's number, so codes stay small however many letters there are."""

    def __init__(self, landmarks: list[bytes]) -> None:
        letter, fold = letters()
        text = np.frombuffer(b" ".join(landmarks).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(fold[text[letter[text]]])
        self.base = len(self.alphabet) + 2
        #: By n: the landmarks' n-grams as codes, sorted, and a number for each, or -1 for blanks alone, which say nothing.
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0
        self.classes = None
        codes = self._codes([b" ".join([t]) for t in landmarks])[0]
        shorter = np.zeros(len(codes), np.int64)
        for n in (1, 2, 3):
            code = self._longer(shorter, codes, n)
            have, shorter = np.unique(code, return_inverse=True)
            blank = np.ones(len(have), bool)
            some = np.zeros(len(code), bool)
            for i in range(n):
                some |= codes[i : len(code) + i] > 0
            blank[shorter[some]] = False
            self.tables.append((have, np.where(blank, -1, self.count + np.cumsum(~blank) - 1)))
            self.count += int((~blank).sum())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"classes": None}

    def _codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the characters of all texts, each text between blanks; the text of each; whether each text has a letter."""
        if self.classes is None:
            letter, fold = letters()
            number = np.zeros(len(fold), np.int32)
            number[self.alphabet] = np.arange(2, self.base)
            self.classes = np.where(letter, np.maximum(number[fold], 1), 0).astype(np.int32)
        parts = [t.decode("utf-8", "replace").encode("utf-32-le") for t in texts]
        pad = b" \0\0\0" * 2
        codes = self.classes[np.frombuffer(pad + (pad + pad).join(parts) + pad, np.uint32)]
        sizes = np.array([len(p) // 4 + 4 for p in parts])
        row = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        return codes, row, np.bincount(row, codes > 0, len(parts)) > 0

    def _longer(self, shorter: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """Codes of the n-grams, from places of the (n - 1)-grams among the landmarks' (-1: not there)."""
        last = codes[n - 1 :]
        first = shorter[: len(last)]
        return np.where(first < 0, -1, first * self.base + last)

    def presence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row of 0 and 1 for each text over the landmarks' n-grams; whether the text has a letter."""
        codes, row, worded = self._codes(texts)
        width = self.count + 1
        out = np.zeros((len(texts), width), np.float32)
        flat = out.reshape(-1)
        shorter = np.zeros(len(codes), np.int64)
        for n, (have, number) in enumerate(self.tables, 1):
            code = self._longer(shorter, codes, n)
            at = np.minimum(np.searchsorted(have, code), len(have) - 1)
            ok = have[at] == code
            shorter = np.where(ok, at, -1)
            at = np.where(ok, number[at], -1)
            flat[row[: len(at)].astype(np.int64) * width + at + (at < 0) * width] = 1
        return out[:, :-1], worded


class Model:
    """Weights of the landmarks for each language; `score` gives one row of languages' shares for each text."""

    def __init__(self, texts: list[bytes], langs: list[str], landmarks: int, ridge: float, seed: int = 7) -> None:
        self.langs = sorted(set(langs))
        order = np.random.default_rng(seed).permutation(len(texts))
        by: dict[str, list[int]] = {}
        for i in order.tolist():
            by.setdefault(langs[i], []).append(i)
        share = max(1, landmarks // max(1, len(by)))
        own = [texts[i] for v in by.values() for i in v[:share]]
        self.grams = Grams(own)
        marks = self._unit(self.grams.presence(own)[0])
        inner = marks @ marks.T
        values, vectors = np.linalg.eigh(inner.astype(np.float64))
        keep = values > 1e-4 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        gram, target = np.zeros((keep.sum(), keep.sum())), np.zeros((keep.sum(), len(self.langs)))
        for a in range(0, len(texts), ROWS):
            x = (self._unit(self.grams.presence(texts[a : a + ROWS])[0]) @ marks.T) @ root
            y = np.where(np.array(langs[a : a + ROWS])[:, None] == np.array(self.langs)[None], 1.0, -1.0)
            gram += x.T @ x
            target += x.T @ y
        weights = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), target)
        #: marks.T @ weights: a text's kernel with every landmark times their weights, in one product.
        self.product = (marks.T.astype(np.float64) @ weights).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x, worded = self.grams.presence(texts)
        margin = 4 * (self._unit(x) @ self.product)
        margin = np.exp(margin - margin.max(1, keepdims=True))
        return margin / margin.sum(1, keepdims=True), worded


def fit(docs: DataFrame, train: Column, most: int = 4000, landmarks: int = 240, ridge: float = 1.0) -> Model | None:
    """Learn from rows of docs (doc_id, text, lang) where `train` holds and lang and text are not null.

    At most about `most` rows are used, the same expected number of each language, chosen by a hash of doc_id and text;
    landmarks are dealt evenly to the languages. None if there is no such row. Languages are the labels' distinct values,
    of which there are few."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, most // len(counts))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))))
    chosen = rows.where((F.col("h") / 2.0**63 + 1) / 2 < share[F.col("lang")]).select("lang", "text", "h").toArrow().sort_by("h")
    if not chosen.num_rows:
        return None
    return Model(binaries(chosen["text"]), chosen["lang"].to_pylist(), landmarks, ridge)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to docs, by its column text alone, over whole texts.

    lang_pred is a learned language, or `und` with score 0 where text is null or has no letter (or nothing was learned).
    score is the language's share, 0 to 1. Ties go to the language that sorts first. Rows and other columns stay as they
    are, columns named lang_pred and score apart, which are replaced."""
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            langs, scores = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            for at, texts in chunks(binaries(b.column("text")), CHARS) if model else ():
                for k in range(0, len(texts), ROWS):
                    shares, worded = model.score(texts[k : k + ROWS])
                    for i, (best, ok) in enumerate(zip(shares.argmax(1).tolist(), worded.tolist(), strict=True)):
                        if ok:
                            langs[at + k + i], scores[at + k + i] = model.langs[best], float(shares[i, best])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
