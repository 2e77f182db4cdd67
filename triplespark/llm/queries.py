"""The queries of the operators, at production settings, over whole tables; and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, language_id
from .decontaminate import decontaminate
from .mixing import mix_documents
from .near_dedup import near_duplicates
from .neighbours import nearest
from .substring_dedup import dedup_substrings
from .token_counts import token_counts
from .toxicity import held_out, labelled, learn, toxicity
from .url_filter import host_of, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs, ~test)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", test.alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2, threshold=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).drop("text", "n_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), length=35).drop("kept_text")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The query's list: every URL of these hosts in pages.
SPAM_HOSTS = r"(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\."


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(host_of(F.col("url")).rlike(SPAM_HOSTS)).select("url")
    return url_filter(pages, listed, URL_RULES)


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 10, 0)
    scored = ctw.score(docs, ~test)
    return scored.select("doc_id", test.alias("held_out"), *scored.columns[1:])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 5, 0)
    lexicon = learn(labelled(docs, table(spark, sf_dir, "labels").where(~test)))
    return toxicity(docs, lexicon).select("doc_id", test.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_near_dedup, op4_decontaminate, op5_neighbours, op6_mixing, op7_substring_dedup, op8_url_filter, op9_ctw, op10_toxicity)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, p, p + least(len(w), 2) - 1), ' ') AS x FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
t AS (SELECT rid, x, n FROM s JOIN n USING (rid)),
e AS (SELECT a.rid AS a, b.rid AS b FROM t a JOIN t b ON a.x = b.x AND a.rid <> b.rid AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
      GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT rid, min(o) AS component_id FROM (SELECT rid, doc_id AS o FROM d UNION ALL SELECT r.a, d.doc_id FROM r JOIN d ON r.b = d.rid) GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, FALSE) AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)""",
    "op4_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT rid, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d CROSS JOIN m WHERE len(w) >= m)),
h AS (SELECT dw.rid AS rid, dw.p AS p, dw.m AS m, iw.item_id AS item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
x AS (SELECT rid, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT rid, q FROM (SELECT rid, unnest(range(p, p + 35)) AS q FROM x JOIN r USING (win))),
o AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT o.rid AS rid, count(g.q) AS n_removed, string_agg(CASE WHEN g.q IS NULL THEN o.word END, ' ' ORDER BY o.q) AS kept FROM o LEFT JOIN g ON o.rid = g.rid AND o.q = g.q GROUP BY o.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)""",
    "op8_url_filter": f"""
WITH h AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(regexp_replace(path, '(/index)?\\.html?$', ''), '/+$', '') AS key,
  host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com, host = 'example.org' OR host LIKE '%.example.org' AS example FROM h),
r AS (SELECT *, CASE WHEN example AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN example AND path LIKE '/es/%' THEN 'example.org/es/' WHEN com AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN com AND path LIKE '/de/%' THEN 'com/de/' WHEN org AND path LIKE '/%' THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN key <> '' AND key IN (SELECT key FROM k WHERE regexp_matches(host, '{SPAM_HOSTS}')) THEN 'block' ELSE 'allow' END AS verdict FROM r""",
}
