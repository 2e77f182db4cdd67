"""Writers of graphs, fragments and results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.graph import Graph


def save(graph: Graph, path: str, index: bool = False, statistics: bool = False, mode: str = "overwrite") -> None:
    """A dataset: a folder for each predicate, sorted by subject; with index a second copy, sorted by object, in path_by_object,
    which open_graph reads for patterns of an object without a predicate; with statistics the counts that order joins, in
    path_statistics.

    A predicate's rows are spread over files by subject, so a frequent one does not meet in one task."""
    df, path = graph.df.select("s", "p", "o"), path.rstrip("/")
    spread = F.pmod(F.xxhash64("s"), F.lit(64))
    df.repartition("p", spread).sortWithinPartitions("p", "s", "o").write.mode(mode).partitionBy("p").option("parquet.bloom.filter.enabled#o", "true").parquet(path)
    if index:
        df.repartitionByRange("o", "s").sortWithinPartitions("o", "p", "s").write.mode(mode).parquet(f"{path}_by_object")
    if statistics:
        saved = df.sparkSession.read.schema("s string, o string, p string").option("basePath", path).parquet(path)
        counts = saved.groupBy("p").agg(F.count("*").alias("triples"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))
        counts.write.mode(mode).parquet(f"{path}_statistics")


def save_table(graph: Graph, table: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """A catalog table in buckets by subject, sorted, so that stars over it are joined without a shuffle."""
    graph.df.select("s", "p", "o").write.mode(mode).partitionBy("p").bucketBy(buckets, "s").sortBy("s").saveAsTable(table)


def append(rows: DataFrame, path: str) -> None:
    """More triples to a dataset, as they come; compact() makes a set of it again. Its copy by object and its statistics go,
    as they don't know the new triples."""
    spark = rows.sparkSession
    for part in ("by_object", "statistics"):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_{part}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    rows.select("s", "p", "o").write.mode("append").partitionBy("p").parquet(path)


def compact(spark, path: str, target: str) -> None:
    save(Graph(spark.read.parquet(path).select("s", "p", "o").distinct()), target)


def lines(triples: DataFrame) -> DataFrame:
    """N-Triples lines (value)."""
    return triples.select(F.concat_ws(" ", *(T.ntriples_term(F.col(c)) for c in "spo"), F.lit(".")).alias("value"))


def ntriples(triples: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite") -> None:
    lines(triples).write.mode(mode).text(path, compression=compression)


def turtle(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A block for each subject, its predicates apart by semicolons. Subjects with very many triples make long lines; N-Triples has no such limit."""
    po = F.concat_ws(" ", T.ntriples_term(F.col("p")), T.ntriples_term(F.col("o")))
    blocks = triples.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(po)), " ; ").alias("po"))
    blocks.select(F.concat_ws(" ", T.ntriples_term(F.col("s")), F.col("po"), F.lit(".")).alias("value")).write.mode(mode).text(path)


def csv(solutions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Solutions with a header, terms by their lexical form."""
    solutions.select(*(T.lex(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in solutions.dtypes)).write.mode(mode).csv(path, header=True, quoteAll=False, escape='"')


def write(triples: DataFrame, path: str, format_: str = "ntriples", compression: str | None = None) -> None:
    if format_ == "ntriples":
        ntriples(triples, path, compression)
    elif format_ == "turtle":
        turtle(triples, path)
    elif format_ == "parquet":
        save(Graph(triples), path)
    else:
        raise ValueError(f"no writer for {format_}")


def fragment_lines(fragment) -> DataFrame:
    """(part, value): N-Triples of a fragment's metadata, data and controls; each star of a page is a part of its own."""
    data = fragment.data
    if "pairs" in data.columns:
        numbered = data.select("s", "pairs", F.concat(F.lit("data-"), F.sha2(F.to_json(F.struct("s", "pairs")), 256)).alias("part"))
        data = numbered.select("part", "s", F.inline("pairs"))
    else:
        data = data.withColumn("part", F.lit("data"))
    out = data.select("part", "s", "p", "o")
    for name in ("metadata", "controls"):
        out = out.unionByName(getattr(fragment, name)().select(F.lit(name).alias("part"), "s", "p", "o"))
    return out.select("part", F.concat_ws(" ", *(T.ntriples_term(F.col(c)) for c in "spo"), F.lit(".")).alias("value"))


def html_fields(fragment) -> dict[str, object]:
    """What a page shows: totals, the range of rows, and the numbers of neighbouring pages."""
    r = fragment.request
    start = (r.page - 1) * fragment.size
    return {"total": fragment.total, "start": start + 1, "end": min(start + fragment.size, fragment.total), "previous": r.page - 1 if r.page > 1 else None, "next": None if fragment.last else r.page + 1}


def page_fields(kind: str, datasets: list[str] = (), problem: str = "") -> dict[str, object]:
    """What an index, not-found or error page shows, and its status."""
    status = {"index": 200, "notfound": 404, "error": 500}[kind]
    return {"status": status, "datasets": sorted(datasets), "problem": problem}


def best_match(supported: list[str], accept: str) -> str:
    """The supported media type that an Accept header likes best, '' if none: the quality of the closest range counts, then
    how close it is (type, subtype, parameters), and of equals the later supported one."""

    def parse(text: str) -> tuple[str, str, dict[str, str], float]:
        kind, *rest = [x.strip() for x in text.split(";")]
        main, _, sub = (kind if kind != "*" else "*/*").partition("/")
        params = dict(p.split("=", 1) for p in rest if "=" in p)
        q = params.pop("q", "1")
        quality = float(q) if re.fullmatch(r"\d*\.?\d+", q) and 0 <= float(q) <= 1 else 1.0
        return main, sub, params, quality

    ranges = [parse(x) for x in accept.split(",") if x.strip()]
    fits = []
    for i, text in enumerate(supported):
        main, sub, params, _ = parse(text)
        near = [((rm == main, rs == sub, sum(params.get(k) == v for k, v in rp.items())), q) for rm, rs, rp, q in ranges if rm in (main, "*") and rs in (sub, "*")]
        if near and max(near)[1] > 0:
            fits.append((max(near)[1], max(near)[0], i))
    return supported[max(fits)[2]] if fits else ""
