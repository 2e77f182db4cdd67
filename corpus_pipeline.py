"""The corpus pipeline: documents through language ID, near-dedup, substring dedup, decontamination and mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, in the columns of documents (doc_id, text, lang, source,
n_chars); the last adds columns. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespark.llm import language_id
from triplespark.llm.common import materialize, owned, release
from triplespark.llm.decontaminate import decontaminate
from triplespark.llm.mixing import mix_documents
from triplespark.llm.near_dedup import near_duplicates
from triplespark.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("lang", "source", "n_chars")

#: Least share of the predicted language; documents below it, or without a letter, go.
LEAST_SCORE = 0.5
#: Words of a shingle, and percent of similarity, of near-duplicates.
SHINGLE, SIMILARITY = 5, 80
#: Words of a passage that may not repeat.
PASSAGE = 50
#: Words of a benchmark window, and the part of a document's words that windows may cover before all of it goes.
WINDOW, COVER = 10, 0.5
#: Part of the tokens that the mixture keeps.
KEEP = 0.6


def _with_text(found: DataFrame, text: str, changed: Column) -> DataFrame:
    """The rows with column text as their text; those that changed and have no word left go."""
    size = F.when(changed, F.length(text).cast("long")).otherwise(F.col("carried.n_chars"))
    return found.where(~changed | F.col(text).rlike(r"\S")).select("doc_id", F.col(text).alias("text"), "carried.lang", "carried.source", size.alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: a learned one, with a share of LEAST_SCORE or more."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs, F.lit(True)))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return near_duplicates(docs.select(*COLUMNS), SHINGLE, SIMILARITY).where("first").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words or more that stand twice or more are cut from every text."""
    return _with_text(dedup_substrings(docs, PASSAGE, carry=REST, texts=True), "kept_text", F.col("n_removed") > 0)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut from texts; documents that they cover by more than COVER go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items, WINDOW, max_cover=COVER, carry=REST, texts=True).where("not drop")
    return _with_text(found, "clean_text", F.col("n_hit") > 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their topic, tokens, cell weight and probability."""
    return mix_documents(docs.select(*COLUMNS), keep=KEEP).where("sampled").drop("sampled")


def _alone(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes the tables that the stage before it worked with: its rows have been written by now."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "stage")
        with owned("stage"):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [(n, _alone(f)) for n, f in (("language ID", language), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("mixing", mixing))]

#: SQL can't express the language stage, and with it the pipeline; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, this = spark.read.parquet(f"{sf_dir}/documents.parquet"), uuid.uuid4().hex
    for i, (name, stage) in enumerate(STAGES):
        with owned(f"{this} {i}"):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        release(spark, f"{this} {i - 1}")
    release(spark, "stage")
    return docs
