"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked until their sums agree with the
target of every source, language and topic in turn; documents are then sampled with probabilities that give each cell its
raked weight, calibrated to a budget of tokens. Every value of source, language and topic has a target of its own, however
rare. A bounded number of cells is raked in the driver's arrays; more are raked as a table, with the same results.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, materialize, owned, release, tune
from .language_id import letters

NONE = "(none)"
DIMENSIONS = ("source", "language", "topic")
KEYS = ["_source", "_language", "_topic"]
#: Cells raked on the driver, at most. How they are raked does not change the results.
CELLS = 50_000


#: Bytes that the form of a text doesn't count as noise: letters, ASCII white space and common punctuation.
_QUIET = np.isin(np.arange(256), [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz \t\n\x0b\x0c\r.,;:'\"!?()-"])
_SPACE = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"])


def _form(text: bytes, quiet: np.ndarray, upper: np.ndarray, letter: np.ndarray, wide: np.ndarray) -> str:
    """The form of a text, from masks over its bytes: not noise, A-Z, A-Z or a-z, beyond ASCII."""
    high = text if wide.all() else np.frombuffer(text, np.uint8)[wide].tobytes() if wide.any() else b""
    points = np.frombuffer(high.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    size = len(text) - len(high) + len(points) + 1
    if text.count(b" | ") * 40 > size:
        return "table"
    if np.count_nonzero(upper) * 2 > np.count_nonzero(letter) + 1:
        return "shouted"
    noise = len(text) - len(high) - np.count_nonzero(quiet) + (np.count_nonzero(~letters()[0][points]) if len(points) else 0)
    return "noisy" if noise * 20 > size else "prose"


def measure(column: pa.Array) -> pa.Array:
    """Structs of topic and tokens of texts, whole: the form as table, shouted, noisy or prose, and the runs without ASCII
    white space. Null texts have no form and no tokens."""
    texts = binaries(column)
    joined = b"".join(t or b"" for t in texts)
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t or b"") for t in texts], dtype=np.int64)
    starts = ends - [len(t or b"") for t in texts]
    quiet, wide, folded = _QUIET[b], b >= 128, b | 32
    letter = (folded >= 97) & (folded <= 122)
    upper = letter & (b < 97)
    word = ~_SPACE[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = starts[starts < ends]
    first[at] = word[at]
    topics, tokens = [], []
    for t, i, j in zip(texts, starts.tolist(), ends.tolist(), strict=True):
        topics.append(None if t is None else _form(t, quiet[i:j], upper[i:j], letter[i:j], wide[i:j]))
        tokens.append(int(np.count_nonzero(first[i:j])))
    return pa.StructArray.from_arrays([pa.array(topics, pa.string()), pa.array(tokens, pa.int64())], ["topic", "tokens"])


def _settled(worst: float, close: float, rounds: int) -> None:
    """Says so where raking ends before it settles, as it does where targets contradict each other."""
    if not worst < close:
        warnings.warn(f"after {rounds} rounds of raking a marginal is still {worst:.2g} of itself away from its target", stacklevel=3)


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, close: float = 1e-10) -> np.ndarray:
    """Weights scaled in turn to each dimension's targets (by code), until no factor is further than `close` from 1. Targets
    that no weights meet, as cells without tokens allow, end in a warning after `rounds`."""
    worst = 0.0
    out = weights.astype(float).copy()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, out, len(target))
            factor = np.where(now > 0, target / np.where(now > 0, now, 1), 1.0)
            out *= factor[code]
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0)))
        if worst < close:
            break
    _settled(worst, close, rounds)
    return out


def calibrate(tokens: np.ndarray, rates: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * rate) whose expected tokens are the budget: exact, as c is found among the cells' own bounds."""
    if tokens.sum() <= budget:
        return np.ones(len(tokens))
    order = np.argsort(-rates)
    full = np.concatenate(([0.0], np.cumsum(tokens[order])))
    rest = np.concatenate((np.cumsum((tokens * rates)[order][::-1])[::-1], [0.0]))
    for k in range(len(order)):  # the k highest rates are held at 1
        c = (budget - full[k]) / rest[k]
        if c * rates[order[k]] <= 1:
            return np.minimum(1.0, c * rates)
    return np.ones(len(tokens))


def targets_of(names: list[str], tokens: np.ndarray, given: dict[str, float] | None, power: float) -> np.ndarray:
    """Target tokens by name, which sum to those of the corpus: the given shares, and for the rest, shares flattened by a power."""
    known = set(names)
    given = {k: v for k, v in (given or {}).items() if k in known}
    flat = np.where(tokens > 0, tokens.astype(float) ** power, 0.0)
    for i, k in enumerate(names):
        if k in given:
            flat[i] = 0.0
    left = max(0.0, 1 - sum(given.values())) if flat.sum() else 0.0
    shares = flat / flat.sum() * left if left else flat * 0
    for i, k in enumerate(names):
        if k in given:
            shares[i] = given[k]
    return shares / shares.sum() * tokens.sum()


def _in_arrays(cells: DataFrame, total: int, targets: dict[str, dict[str, float]], powers: tuple[float, float, float], keep: float) -> DataFrame:
    """cells (KEYS, tokens) with cell_weight and probability, by the driver."""
    rows = cells.toArrow()
    tokens = rows["tokens"].to_numpy().astype(float)
    codes, aims = [], []
    for d, k, power in zip(DIMENSIONS, KEYS, powers, strict=True):
        coded = pa.concat_arrays(rows[k].chunks).dictionary_encode()
        code, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        codes.append(code)
        aims.append(targets_of(values, np.bincount(code, tokens, len(values)), targets.get(d), power))
    rates = np.where(tokens > 0, rake(tokens, codes, aims) / np.maximum(tokens, 1e-9), 1.0)
    out = rows.select(KEYS).append_column("cell_weight", pa.array(rates)).append_column("probability", pa.array(calibrate(tokens, rates, keep * total)))
    return F.broadcast(cells.sparkSession.createDataFrame(out))


def _as_table(cells: DataFrame, total: int, targets: dict[str, dict[str, float]], powers: tuple[float, float, float], keep: float, rounds: int = 500, close: float = 1e-10) -> DataFrame:
    """What _in_arrays gives, by jobs over the cells: a weight is the cell's tokens times a factor of each of its values.

    Factors are tables (value, aim, factor); a round writes each anew from the others'."""
    spark = cells.sparkSession
    factors: dict[str, DataFrame] = {}
    for d, k, power in zip(DIMENSIONS, KEYS, powers, strict=True):
        asked = spark.createDataFrame([(v, float(x)) for v, x in targets.get(d, {}).items()], f"{k} string, given double")
        values = cells.groupBy(k).agg(F.sum("tokens").alias("tokens")).join(F.broadcast(asked), k, "left")
        values = materialize(values.withColumn("flat", F.when(F.col("given").isNull() & (F.col("tokens") > 0), F.pow(F.col("tokens").cast("double"), F.lit(power))).otherwise(0.0)), "values")
        flat, given = (x or 0.0 for x in values.agg(F.sum("flat"), F.sum("given")).first())
        left = max(0.0, 1 - given) if flat else 0.0
        share = F.coalesce("given", F.col("flat") * F.lit(left / flat if flat else 0.0)) / F.lit(given + left)
        factors[k] = values.select(k, (share * total).alias("aim"), F.lit(1.0).alias("factor"))
    named = lambda k: factors[k].select(k, F.col("factor").alias(f"{k}_factor"))
    for i in range(rounds):
        worst = 0.0
        for k in KEYS:
            one, two = (x for x in KEYS if x != k)
            rest = cells.join(named(one), one).join(named(two), two).groupBy(k).agg(F.sum(F.col("tokens") * F.col(f"{one}_factor") * F.col(f"{two}_factor")).alias("rest"))
            some = (F.col("rest") > 0) & (F.col("factor") > 0)
            changed = factors[k].join(rest, k).select(k, "aim", F.when(some, F.col("aim") / F.col("rest")).otherwise(F.col("factor")).alias("factor"), F.when(some, F.abs(F.col("aim") / F.col("rest") / F.col("factor") - 1)).alias("change"))
            with owned(f"rake {k} {i}"):
                factors[k] = materialize(changed, "factors")
            release(spark, f"rake {k} {i - 1}")
            worst = max(worst, factors[k].agg(F.max("change")).first()[0] or 0.0)
            factors[k] = factors[k].drop("change")
        if worst < close:
            break
    _settled(worst, close, rounds)
    rated = cells
    for k in KEYS:
        rated = rated.join(named(k), k)
    rate = F.when(F.col("tokens") > 0, F.col(f"{KEYS[0]}_factor") * F.col(f"{KEYS[1]}_factor") * F.col(f"{KEYS[2]}_factor")).otherwise(1.0)
    rated = materialize(rated.select(*KEYS, "tokens", rate.alias("cell_weight")), "rates")
    for k in KEYS:
        release(spark, f"rake {k} {i}")
    # the constant of calibrate(): it grows as cells reach 1, until no more do
    budget, c, full = keep * total, 0.0, -1.0
    while total > budget:
        at_one = F.col("cell_weight") * F.lit(c) >= 1
        now, rest = (x or 0.0 for x in rated.agg(F.sum(F.when(at_one, F.col("tokens"))), F.sum(F.when(~at_one, F.col("tokens") * F.col("cell_weight")))).first())
        if now == full:
            break
        if not rest:
            c = None
            break
        c, full = (budget - now) / rest, now
    chance = F.lit(1.0) if total <= budget or c is None else F.least(F.lit(1.0), F.col("cell_weight") * F.lit(c))
    return rated.select(*KEYS, "cell_weight", chance.alias("probability"))


def mix_documents(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, powers: tuple[float, float, float] = (0.5, 0.7, 0.7), keep: float = 0.6, seed: int = 3) -> DataFrame:
    """docs (doc_id, text, lang, source, and any other columns, all kept) with topic, n_tokens, cell_weight, probability and sampled.

    n_tokens counts runs without ASCII white space. The topic is that column, or else the text's form: table, shouted, noisy or prose. targets gives shares of tokens by dimension (source, language, topic) and
    value; other values share the rest by their tokens to the power of `powers`. cell_weight is a cell's raked over its
    actual tokens. probability is the cell's cell_weight times a constant, at most 1, such that `keep` of all tokens are
    expected; sampled holds for a row if a hash of seed, doc_id and text falls below it, so the choice depends on nothing
    else, and repeated rows share it. Null sources, languages and topics are a value of their own, (none); null texts have
    no tokens. If no text has tokens all rows are sampled. An empty table gives an empty one. Columns of docs with the
    result's names are replaced.

    Only the sums of cells reach the driver, where there are 50,000 at most; else they stay a table.
    """
    names = ["topic", "n_tokens", "cell_weight", "probability", "sampled"]
    own = [c for c in docs.columns if c not in names]
    tune(docs.sparkSession)
    measured = F.arrow_udf(measure, "topic string, tokens long")(F.col("text"))
    named = docs.withColumn("_measured", measured).withColumns({
        "_topic": F.coalesce(F.col("_measured.topic") if topic is None else topic.cast("string"), F.lit(NONE)),
        "_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "_language": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "_tokens": F.col("_measured.tokens"),
    }).drop("_measured", *names)
    cells = materialize(named.groupBy(*KEYS).agg(F.sum("_tokens").alias("tokens")), "cells")
    count, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    if total:
        rated = (_in_arrays if count <= CELLS else _as_table)(cells, total, targets or {}, powers, keep)
    else:
        rated = cells.select(*KEYS, F.lit(1.0).alias("cell_weight"), F.lit(1.0).alias("probability"))
    matched = named.join(rated, KEYS)
    draw = (F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))) / 2.0**63 + 1) / 2
    return matched.select(*own, F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "cell_weight", "probability", (draw < F.col("probability")).alias("sampled"))
