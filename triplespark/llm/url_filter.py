"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join that removes false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys for each block of 512 bits, and blocks at most: as a table of nine longs each they take 75 MB then, so they are
#: broadcast. A list beyond that fills the filter up; it passes more keys to the exact join, and none wrongly.
KEYS, MOST_BLOCKS = 32, 1 << 20
#: Bits that a key sets in its block.
PROBES = 6


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., path without index page, .html and closing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), "/+$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, with its verdict; rules are pairs of verdict and host/path."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """Eight longs with the key's bits: nine bits of a second hash choose each."""
    h = F.xxhash64(key, F.lit(1))
    bit = [F.shiftright(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    one = F.lit(1).cast("long")
    words = []
    for w in range(8):
        word = F.lit(0).cast("long")
        for b in bit:
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", one, b.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocked filter of column key: (block, w0..w7), a row for each block in use."""
    bits = listed.select(_block(F.col("key"), blocks).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_bits(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Judge column url of pages (page_id, url) by rules, and where none fits by a list of canonical URLs (column url).

    One row for each row of pages, repeated rows included: page_id, host, path, rule (the longest that fits; null where
    none does), verdict (the rule's; else block if the page's canonical URL is listed, and allow if not). A null url and
    one without :// have an empty host and path, fit no rule and are allowed. An empty list blocks nothing. Equal and null
    page_ids stay as they are; other columns are not read.

    The filter has a block for every KEYS keys of the list, MOST_BLOCKS at most, and is broadcast; keys that pass it, with
    few false ones, meet the list in an exact join, each once. What is found returns to the pages in a join that is split
    where a listed page fills the input.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), canonical(F.col("host"), F.col("path")).alias("key"))
    keys = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).where("key != ''").distinct()
    blocks = min(MOST_BLOCKS, max(64, -(-keys.count() // KEYS)))
    own = rows.select("page_id", "host", "path", "rule", "said", "key", _block(F.col("key"), blocks).alias("block"), *(w.alias(f"k{i}") for i, w in enumerate(_bits(F.col("key")))))
    seen = F.lit(True)
    for i in range(8):
        seen = seen & (F.col(f"w{i}").bitwiseAND(F.col(f"k{i}")) == F.col(f"k{i}"))
    passed = own.join(F.broadcast(bloom(keys, blocks)), "block", "left").withColumn("maybe", F.col("said").isNull() & (F.col("key") != "") & F.coalesce(seen, F.lit(False)))
    hits = passed.where("maybe").select("key").distinct().join(keys, "key", "left_semi").select("key", F.lit(True).alias("listed"))
    maybe = passed.select("page_id", "host", "path", "rule", "said", F.when(F.col("maybe"), F.col("key")).alias("key"), "maybe")
    sure = maybe.where(~F.col("maybe")).select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    judged = maybe.where("maybe").join(hits.hint("merge"), "key", "left").select("page_id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    return sure.unionByName(judged)
