"""Token counts: pieces are counted once for each distinct pre-token, joined to pre-token frequencies, and summed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, materialize, tune
from .words import KEY_BYTES, count_words, frequent, key_of, match_words, rare_rows, split_words


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pieces(path: str, words: list[bytes]) -> list[int]:
    return [len(e.ids) for e in _tokenizer(path).encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every text of docs (doc_id, text), under a tokenizer that drops white space (word_bpe_49k.json does).

    A pre-token is a run without ASCII white space. The tokenizer's patterns, its special strings and its normaliser
    never reach across one, so a text's count is the sum over its pre-tokens, whatever the library splits inside each.
    Pre-tokens of over 64 bytes, as in scripts without spaces, are joined by a digest.

    One row for each row of docs, repeated rows and equal or null doc_ids included: doc_id, n_bytes (of the UTF-8 text),
    n_tokens, over_limit (n_tokens > limit). A null text counts as empty: 0 and 0. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    tune(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = binaries(b.column("word"))
            yield pa.record_batch({"word": pa.array(list(map(key_of, words)), pa.binary()), "n": b.column("n"), "pieces": pa.array(_pieces(tokenizer_path, words), pa.int64())})

    words = materialize(count_words(docs, split_words).mapInArrow(measure, "word binary, n long, pieces long"), "pieces")
    table = frequent(words).select("word", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(table["word"].to_pylist(), table["pieces"].to_pylist(), strict=True)))

    def of(text: bytes, frequencies: dict[bytes, int]) -> tuple[tuple[int, int], dict[bytes, int]]:
        get, tokens, rare = known.value.get, 0, {}
        for w, n in frequencies.items():
            if len(w) > KEY_BYTES:
                w = key_of(w)
            if (p := get(w)) is not None:
                tokens += n * p
            else:
                rare[w] = n
        return (len(text), tokens), rare

    matched = match_words(docs, "n_bytes long, n_sure long", of, split_words)
    rest = rare_rows(matched).join(words.select("word", "pieces"), "word").groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_rare"))
    tokens = F.col("n_sure") + F.coalesce("n_rare", F.lit(0))
    return matched.drop("rare").join(rest, "rid", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
