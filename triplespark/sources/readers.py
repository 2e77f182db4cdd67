"""Readers of RDF files. Line formats are parsed by Spark's own functions; documents (Turtle, RDF/XML) whole, in Python."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.sparql import parse_turtle

# Formats by file extension. An empty name is taken for N-Triples.
FORMATS = {
    "nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "n3": "n3", "rdf": "rdfxml", "xml": "rdfxml",
    "owl": "rdfxml", "txt": "simple", "list": "list", "lst": "list", "zip": "zip", "tar": "tar", "tgz": "tar", "parquet": "parquet",
}
COMPRESSIONS = ("gz", "bz2", "bz", "xz")
TRIPLES = "s string, p string, o string"


class UnknownFormat(ValueError):
    pass


def guess_format(name: str) -> str:
    """The format of a file by its name, compression suffixes apart."""
    if not name:
        return "ntriples"
    parts = name.rsplit("/", 1)[-1].lower().split(".")
    while len(parts) > 1 and parts[-1] in COMPRESSIONS:
        parts.pop()
    if len(parts) < 2 or parts[-1] not in FORMATS:
        raise UnknownFormat(name)
    return FORMATS[parts[-1]]


def parse_format(name: str) -> str:
    """A format by its own name or an extension."""
    key = name.lower().replace("-", "").replace("/", "")
    if key in FORMATS.values():
        return key
    if key in FORMATS:
        return FORMATS[key]
    raise UnknownFormat(name)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    if re.search(r"\.(xz|bz)$", path):  # no codec of Spark's
        files = spark.read.format("binaryFile").load(path).select("path", "content")

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    lines = io.TextIOWrapper(io.BytesIO(_unpacked(name, content)), "utf-8", newline="\n").read().split("\n")
                    for a in range(0, len(lines), 10_000):
                        yield pa.record_batch({"value": pa.array(lines[a : a + 10_000], pa.string())})

        return files.mapInArrow(unpack, "value string")
    return spark.read.text(path)


def _unpacked(name: str, content: bytes) -> bytes:
    if re.search(r"\.(gz|tgz)$", name):
        return gzip.decompress(content)
    if re.search(r"\.bz2?$", name):
        return bz2.decompress(content)
    return lzma.decompress(content) if name.endswith(".xz") else content


_IRI, _BNODE = r"<[^<>\"{}|^`\x00-\x20]*>", r"_:[^\s<>\"]*[^\s<>\".]"
_LITERAL = r'".*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>\s]*>)?'
_STATEMENT = rf"^\s*({_IRI}|{_BNODE})\s*({_IRI})\s*({_IRI}|{_BNODE}|{_LITERAL})\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"


def _decoded(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else T.unescape(text)
        except ValueError:
            return None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    """N-Triples escapes decoded, null where one is wrong. Short escapes are replaced in place; only \\u and others take Python."""
    simple = c
    for raw, mark in (("\\\\", "\x01"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\x01", "\\")):
        simple = F.replace(simple, F.lit(raw), F.lit(mark))
    hard = c.rlike(r'\\[^tnr"\\]|\x01|\\$')
    return F.when(~F.contains(c, F.lit("\\")), c).when(hard, F.arrow_udf(_decoded, "string")(F.when(hard, c))).otherwise(simple)


def _term(c: Column) -> Column:
    """A term as N-Triples writes it, in canonical form."""
    suffix = F.regexp_extract(c, r'"((?:@[A-Za-z0-9-]+|\^\^<[^<>]*>)?)$', 1)
    body = F.substr(c, F.lit(2), F.length(c) - F.length(suffix) - 2)
    tail = F.when(suffix == f"^^<{T.STRING}>", "").when(suffix.startswith("@"), F.lower(suffix)).otherwise(suffix)
    return F.when(c.startswith("<"), unescape(F.substr(c, F.lit(2), F.length(c) - 2))).when(c.startswith('"'), F.concat(F.lit('"'), unescape(body), F.lit('"'), tail)).otherwise(c)


def _statements(lines: DataFrame) -> DataFrame:
    """(value, s, p, o, g) of lines that are no comments; s is null where a line is malformed."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", _STATEMENT, i)
    raw = rows.select("value", *(F.when(part(i) != "", part(i)).alias(c) for i, c in enumerate("spog", 1)))
    return raw.select("value", *(_term(F.col(c)).alias(c) for c in "spog"))


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    return _statements(_lines(spark, path)).where("s is not null and p is not null and o is not null").select("s", "p", "o")


def nquads(spark: SparkSession, path: str, graphs: bool = False) -> DataFrame:
    """The graph's name is dropped, or with graphs kept as g."""
    return _statements(_lines(spark, path)).where("s is not null and p is not null and o is not null").select("s", "p", "o", *(["g"] if graphs else []))


def simple(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lenient line format: tabs count as spaces, comments and blank lines are passed over.

    Returns the triples, and the malformed lines (value)."""
    rows = _statements(_lines(spark, path).select(F.replace("value", F.lit("\t"), F.lit(" ")).alias("value")))
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    return rows.where(whole).select("s", "p", "o"), rows.where(~whole).select("value")


def parse_rdfxml(text: str, base: str = "") -> list[tuple[str, str, str]]:
    """The triples of an RDF/XML document: typed nodes, property attributes, nesting, parseType Resource, Literal and Collection."""
    from urllib.parse import urljoin

    rdf, xml = "{" + T.RDF + "}", "{http://www.w3.org/XML/1998/namespace}"
    out: list[tuple[str, str, str]] = []
    fresh = iter(range(1, 1 << 60))
    name = lambda tag: tag[1:].replace("}", "")

    def node(e: ElementTree.Element, base: str, lang: str) -> str:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        if (v := e.get(rdf + "about")) is not None:
            s = urljoin(base, v)
        elif (v := e.get(rdf + "ID")) is not None:
            s = urljoin(base, "#" + v)
        else:
            s = f"_:{e.get(rdf + 'nodeID')}" if e.get(rdf + "nodeID") else f"_:x{next(fresh)}"
        if e.tag != rdf + "Description":
            out.append((s, T.TYPE, name(e.tag)))
        attributes(e, s, base, lang)
        items = 0
        for p in e:
            tag = p.tag
            if tag == rdf + "li":
                items += 1
                tag = f"{rdf}_{items}"
            prop(p, s, name(tag), base, lang)
        return s

    def attributes(e: ElementTree.Element, s: str, base: str, lang: str) -> None:
        for k, v in e.attrib.items():
            if k == rdf + "type":
                out.append((s, T.TYPE, urljoin(base, v)))
            elif k[0] == "{" and not k.startswith((rdf, xml)):
                out.append((s, name(k), str(T.Term("literal", v, lang=lang or None))))

    def prop(e: ElementTree.Element, s: str, p: str, base: str, lang: str) -> None:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        kind = e.get(rdf + "parseType")
        if kind == "Resource":
            o = f"_:x{next(fresh)}"
            for child in e:
                prop(child, o, name(child.tag), base, lang)
        elif kind == "Collection":
            cells = [(f"_:x{next(fresh)}", node(child, base, lang)) for child in e]
            for i, (cell, item) in enumerate(cells):
                out.append((cell, T.RDF + "first", item))
                out.append((cell, T.RDF + "rest", cells[i + 1][0] if i + 1 < len(cells) else T.RDF + "nil"))
            o = cells[0][0] if cells else T.RDF + "nil"
        elif kind == "Literal":
            inner = (e.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in e)
            o = str(T.Term("literal", inner, T.RDF + "XMLLiteral"))
        elif (v := e.get(rdf + "resource")) is not None:
            o = urljoin(base, v)
            attributes(e, o, base, lang)
        elif (v := e.get(rdf + "nodeID")) is not None:
            o = f"_:{v}"
        elif len(e):
            o = node(e[0], base, lang)
        elif any(k[0] == "{" and not k.startswith((rdf, xml)) for k in e.attrib):
            o = f"_:x{next(fresh)}"
            attributes(e, o, base, lang)
        else:
            own = e.get(rdf + "datatype")
            o = str(T.Term("literal", e.text or "", urljoin(base, own) if own else None, None if own else lang or None))
        out.append((s, p, o))

    root = ElementTree.fromstring(text)
    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, root.get(xml + "base", base), root.get(xml + "lang", ""))
    return out


def _parse(name: str, content: bytes, format_: str, base: str) -> list[tuple[str, str, str]]:
    """The triples of a whole file; blank nodes keep apart from those of other files."""
    text = content.decode("utf-8")
    if format_ in ("turtle", "n3"):
        rows = parse_turtle(text, base)
    elif format_ == "rdfxml":
        rows = parse_rdfxml(text, base)
    elif format_ in ("ntriples", "nquads", "simple"):
        rows = []
        for line in text.replace("\t", " ").splitlines():
            if m := re.match(_STATEMENT, line):
                try:
                    rows.append(tuple(_canonical(m[i]) for i in (1, 2, 3)))
                except ValueError:
                    continue
        return rows
    else:
        raise UnknownFormat(name)
    import zlib

    own = f"_:f{zlib.crc32(name.encode()):08x}"
    return [tuple(own + x[2:] if x.startswith("_:") else x for x in r) for r in rows]


def _canonical(text: str) -> str:
    if text[0] == "<":
        return T.unescape(text[1:-1])
    if text[0] == "_":
        return text
    end = text.rindex('"')
    lex, suffix = T.unescape(text[1:end]), text[end + 1 :]
    return str(T.Term("literal", lex, suffix[3:-1] if suffix.startswith("^^") else None, suffix[1:] if suffix.startswith("@") else None))


def _documents(spark: SparkSession, path: str, format_: str, base: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for entry, inner, kind in _entries(name, content, format_):
                    rows = _parse(entry, inner, kind, base)
                    for a in range(0, len(rows), 10_000):
                        s, p, o = zip(*rows[a : a + 10_000], strict=True)
                        yield pa.record_batch({"s": pa.array(s), "p": pa.array(p), "o": pa.array(o)})

    return files.mapInArrow(run, TRIPLES)


def _entries(name: str, content: bytes, format_: str) -> Iterator[tuple[str, bytes, str]]:
    """The files of an archive, each with its guessed format, archives within archives too; any other file as it is."""
    if format_ not in ("zip", "tar"):
        yield name, _unpacked(name, content), format_
        return
    inside: list[tuple[str, bytes]] = []
    if format_ == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            inside = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
            inside = [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
    for entry, data in inside:
        try:
            kind = guess_format(entry)
        except UnknownFormat:
            continue
        yield from _entries(f"{name}/{entry}", data, kind)


def read(spark: SparkSession, path: str, format_: str | None = None, base: str = "") -> DataFrame:
    """Triples (s, p, o) of a file, a folder or a pattern of names, repeats kept."""
    kind = parse_format(format_) if format_ else guess_format(path)
    if kind == "ntriples":
        return ntriples(spark, path)
    if kind == "nquads":
        return nquads(spark, path)
    if kind == "simple":
        return simple(spark, path)[0]
    if kind == "parquet":
        return spark.read.parquet(path).select("s", "p", "o")
    if kind == "list":
        names = [r["value"].strip() for r in spark.read.text(path).collect()]  # a list of files
        return reduce(DataFrame.unionByName, (read(spark, n, None, base) for n in names if n and not n.startswith("#")))
    return _documents(spark, path, kind, base)
