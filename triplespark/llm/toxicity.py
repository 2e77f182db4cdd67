"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton after folding disguises.

Homoglyphs and accents fold to plain letters, and digits and signs inside words to the letters they stand for. Each word
counts with its heaviest lexicon entry; phrases that are learned to be harmless take their words out. The sum over the
text, alone and over the square root of its length, goes through a logistic curve.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune

# Letters of other scripts that look like Latin ones, and signs that stand for letters inside words.
HOMOGLYPHS = dict(zip("авеіјкмнорсԛѕтухуѵԁһӏαβγεικνορτυχωɡıſ", "abeijkmhopcqstyxyvdhlabyeiknoptuxwgis", strict=True))
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
#: By character inside a word with a letter, what it stands for; nothing for *.
_STANDS = np.arange(sys.maxunicode + 1, dtype=np.uint32)
_STANDS[[ord(c) for c in STAND_INS]] = [ord(c) for c in STAND_INS.values()]
_STANDS[ord("*")] = 0

#: Words of the lexicon start with at least so many letters of an entry.
STEMS = range(4, 9)
#: Bytes of text folded and matched together.
PIECE = 1 << 20
#: Kinds of a character: of a word; a letter; joins what stands on both sides to one word; left out.
_WORD, _LETTER, _SIGN, _MARK = 1, 2, 4, 8


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """By code point, its plain lower case and its kinds; and the characters that stand for several."""
    plain = {ord(k): v for k, v in HOMOGLYPHS.items()}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        letters = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if letters and letters != chr(c):
            plain.setdefault(c, letters)
    marks = {*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
    fold, kind, several = np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, np.uint8), {}
    for c in range(sys.maxunicode + 1):
        low = "".join(plain.get(ord(x), x) for x in chr(c).lower() if ord(x) not in marks)
        if len(low) > 1:
            several[c] = low
        elif low:
            fold[c] = ord(low)
            if low.isalnum():
                kind[c] = _WORD if low.isdecimal() else _WORD | _LETTER
        elif c in marks:
            kind[c] = _MARK
    for c in "@$!|+*":
        kind[ord(c)] = _SIGN
    return fold, kind, several


def fold(texts: list[str]) -> np.ndarray:
    """The texts' words as code points: a space before each word and after the last, a line feed after each text.

    Words are lower-cased and folded to plain letters, and stand-ins replaced in those that hold a letter."""
    table, kinds, several = _characters()
    joined = "\n" + "".join(t + "\n\n\n" for t in texts)
    ends = np.cumsum([len(t) + 3 for t in texts]) - 2
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    if not joined.isascii() and np.isin(codes[codes >= 128], list(several)).any():
        return fold([t.translate(several) for t in texts])
    codes, kind = table[codes], kinds[codes]
    if (gone := kind == _MARK).any():
        ends -= np.cumsum(gone)[ends]
        codes, kind = codes[~gone], kind[~gone]
    word = (kind & _WORD) > 0
    signs = np.flatnonzero(kind == _SIGN)
    if len(signs):
        first = np.flatnonzero(np.diff(signs, prepend=-2) > 1)
        runs, last = signs[first], signs[np.append(first[1:], len(signs)) - 1]
        inside = word[runs - 1] & word[last + 1]
        word[signs[np.repeat(inside, np.diff(np.append(first, len(signs))))]] = True
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    odd = np.flatnonzero(word & ((kind & _LETTER) == 0))
    if len(odd):  # signs and digits of words that hold a letter
        whole = np.flatnonzero(~word)
        spans, of = np.unique(np.searchsorted(starts, odd, "right") - 1, return_inverse=True)
        begin = starts[spans]
        letters = np.concatenate(([0], np.cumsum((kind & _LETTER) > 0)))
        lettered = letters[whole[np.searchsorted(whole, begin)]] > letters[begin]
        odd = odd[lettered[of]]
        codes[odd] = _STANDS[codes[odd]]
        word[odd[codes[odd] == 0]] = False
    word[starts - 1] = True
    codes[starts - 1] = 32
    word[ends] = word[ends + 1] = True
    codes[ends], codes[ends + 1] = 32, 10
    return codes[word]


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def words_of(texts: list[str]) -> list[list[str]]:
    """The words of each text, folded."""
    return [t.split() for t in _string(fold(texts)).split("\n")[:-1]]


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of PIECE characters together, or one."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= PIECE:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


class Lexicon:
    """entries: weight by pattern, a whole word, or a stem with a closing *; exceptions: harmless phrases of two words."""

    def __init__(self, entries: dict[str, float], exceptions: frozenset[str], curve: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
        self.entries, self.exceptions, self.curve = entries, exceptions, curve
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def _built(self):
        """The automaton of all patterns, each standing for its number; by number, its size and weight, 0 for an exception."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            texts = [(" " + (p[:-1] if p.endswith("*") else p + " "), w) for p, w in self.entries.items()] + [(f" {p} ", 0.0) for p in self.exceptions]
            for i, (text, _) in enumerate(texts):
                self.automaton.add_word(text, i)
            self.sizes, self.weights = np.array([len(t) for t, _ in texts], np.int64), np.array([w for _, w in texts])
            if texts:
                self.automaton.make_automaton()
        return self.automaton

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text: the weight of its matched words, and the number of its words."""
        codes = fold(texts)
        ends = np.flatnonzero(codes == 10)
        spaces = np.searchsorted(np.flatnonzero(codes == 32), ends)
        words = np.diff(spaces, prepend=0) - 1
        automaton = self._built()
        found = list(automaton.iter(_string(codes))) if len(automaton) else []
        if not found:
            return np.zeros(len(texts)), words
        end, own = np.array(found, np.int64).T
        at, weight = end - self.sizes[own] + 1, self.weights[own]
        spared = weight == 0
        order = np.lexsort((-weight[~spared], at[~spared]))
        starts, first = np.unique(at[~spared][order], return_index=True)
        best = weight[~spared][order][first]
        edge = np.bincount(np.searchsorted(starts, at[spared]), minlength=len(starts) + 1) - np.bincount(np.searchsorted(starts, end[spared]), minlength=len(starts) + 1)
        best = np.where(np.cumsum(edge)[:-1] > 0, 0.0, best)
        return np.bincount(np.searchsorted(ends, starts), best, len(texts)), words

    def score(self, texts: list[str | None]) -> list[float]:
        a, b, c = self.curve
        out = []
        for some in pieces([t or "" for t in texts]):
            total, n = self.sums(some)
            out += (1 / (1 + np.exp(-np.clip(a * total + b * total / np.sqrt(n + 1) + c, -30, 30)))).tolist()
        return out


def _texts(b: pa.RecordBatch) -> list[str]:
    return [t or "" for t in b.column("text").to_pylist()]


def labelled(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(text, toxic) of about `most` rows of labels (doc_id, toxic) at most, chosen by a hash of doc_id, met in docs.

    The chosen labels have a bounded size, so they are broadcast and no text is shuffled. Labels of null doc_ids, and
    values but 0 and 1, are passed over; a doc_id labelled twice counts as its largest label. Every row of docs with a
    chosen doc_id is a row of the result, repeated rows included."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = own.count()
    chosen = own.where((F.xxhash64("doc_id") / 2.0**63 + 1) / 2 < most / max(1, count))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def learn(rows: DataFrame, least: float = 3.0) -> Lexicon:
    """A lexicon from rows (text, toxic), toxic being 0 or 1.

    Patterns are words, their stems and word pairs. Of each, the documents of either class that hold it are counted, over
    all rows. An entry is a word or stem whose log-odds ratio, smoothed by one half, is positive and `least` standard
    errors from 0; its weight is that ratio. An exception is a pair that holds an entry, was seen in five documents or
    more, and is less common in toxic documents than in others. Both are bounded by the rows, which labelled() bounds.
    The curve is fitted to the (total, length, class) of all rows, gathered in bins. No rows: an empty lexicon, score 0.5.
    """
    rows = materialize(rows.select("text", "toxic").where(F.col("toxic").isin(0, 1)), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, frozenset(), (0.0, 0.0, 0.0 if not (toxic or clean) else 4.0 if toxic else -4.0))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        of: dict[str, list[int]] = {}
        held: tuple[Counter[int], Counter[int]] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            got = pa.record_batch({"pattern": pa.array(list(number), pa.string()), **{f"n{k}": pa.array([held[k][i] for i in number.values()], pa.int64()) for k in (0, 1)}})
            for x in (number, of, *held):
                x.clear()
            return got

        for b in batches:
            labels = iter(b.column("toxic").to_pylist())
            for some in pieces(_texts(b)):
                for words in words_of(some):
                    seen: set[int] = set()
                    for w in set(words):
                        if w not in of:
                            of[w] = [number.setdefault(p, len(number)) for p in [w, *(w[:n] + "*" for n in STEMS if len(w) >= n)]]
                        seen.update(of[w])
                    held[next(labels)].update(seen)
            if len(number) > 300_000:
                yield out()
        yield out()

    counts = rows.mapInArrow(patterns, "pattern string, n0 long, n1 long").groupBy("pattern").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 0.5) / (toxic - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (clean - F.col("n0") + 0.5))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    surest = counts.select("pattern", ratio.alias("ratio"), (ratio / error).alias("z")).where((F.col("z") >= least) & (F.col("ratio") > 0))
    entries = {r["pattern"]: r["ratio"] for r in surest.collect()}
    if not entries:
        return Lexicon({}, frozenset(), (0.0, 0.0, math.log(toxic / clean)))
    stems = {p[:-1] for p in entries if p.endswith("*")}

    def flagged(w: str) -> bool:
        return w in entries or any(w[:n] in stems for n in STEMS)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for b in batches:
            labels = iter(b.column("toxic").to_pylist())
            for some in pieces(_texts(b)):
                for words in words_of(some):
                    at = [i for i, w in enumerate(words) if flagged(w)]
                    held[next(labels)].update({f"{words[k]} {words[k + 1]}" for i in at for k in (i - 1, i) if 0 <= k < len(words) - 1})
        both = list(held[0] | held[1])
        yield pa.record_batch({"pattern": pa.array(both, pa.string()), **{f"n{k}": pa.array([held[k][p] for p in both], pa.int64()) for k in (0, 1)}})

    seen = rows.mapInArrow(pairs, "pattern string, n0 long, n1 long").groupBy("pattern").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    harmless = seen.where(f"n0 + n1 >= 5 and n1 * {clean} < n0 * {toxic}")
    lexicon = Lexicon(entries, frozenset(r["pattern"] for r in harmless.collect()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total, n = (np.concatenate(x) for x in zip(*map(lexicon.sums, pieces(_texts(b))), strict=True))
                yield pa.record_batch({"total": pa.array(np.round(2 * total) / 2), "rate": pa.array(np.round(20 * total / np.sqrt(n + 1)) / 20), "toxic": b.column("toxic")})

    bins = rows.mapInArrow(measured, "total double, rate double, toxic int").groupBy("total", "rate").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).collect()
    x = np.array([[r["total"], r["rate"], 1.0] for r in bins])
    n, n1 = np.array([r["n"] for r in bins], float), np.array([r["n1"] for r in bins], float)
    curve = np.zeros(3)
    for _ in range(30):  # Newton's method, with a slight pull to 0
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (n1 - n * p) - 1e-2 * curve
        curve += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), slope)
    lexicon.curve = tuple(curve.tolist())
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each row of docs (doc_id, text), repeated rows and equal or null doc_ids included: doc_id, score
    (0 to 1), predicted (1 if score >= 0.5). Null and empty texts match nothing and get the curve's value for that.
    Whole texts are read; other columns are not."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = sent.value.score(_texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(column: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the column as text leaves this remainder; a null leaves none."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
