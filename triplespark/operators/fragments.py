"""Paged fragments: triple patterns (tpf), those restricted by bindings (brtpf) and stars (spf), with metadata and controls."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs, quote, unquote, urlencode, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import Variable, parse_term
from ..plans.graph import Graph, graph_of_rows, var
from ..plans.patterns import Position, StarPattern, TriplePattern
from ..plans.sparql import Parser
from ..plans.tables import numbered
from .joins import bindings, distinct_stars, match_star

# Fixed values of the protocol.
PAGE_SIZE = 100
BINDINGS_PER_REQUEST = 30
VOID, HYDRA, FOAF, DCTERMS = "http://rdfs.org/ns/void#", "http://www.w3.org/ns/hydra/core#", "http://xmlns.com/foaf/0.1/", "http://purl.org/dc/terms/"


@dataclass(frozen=True)
class Request:
    kind: str  # tpf, brtpf or spf
    dataset: str
    page: int = 1
    pattern: TriplePattern | None = None
    star: StarPattern | None = None
    names: tuple[str, ...] = ()
    values: tuple[tuple[str | None, ...], ...] = ()

    def at(self, page: int) -> Request:
        return Request(self.kind, self.dataset, page, self.pattern, self.star, self.names, self.values)


@dataclass(frozen=True)
class Fragment:
    """data: the page (s, p, o; for stars s, pairs), in order. total is exact. metadata and controls are triples."""

    data: DataFrame
    total: int
    request: Request
    size: int = PAGE_SIZE
    base: str = field(default="")
    whole: DataFrame | None = None  # all pages at once

    @property
    def last(self) -> bool:
        return self.total <= self.request.page * self.size

    def metadata(self) -> DataFrame:
        url, dataset = to_url(self.request, self.base), f"{self.base}/{self.request.dataset}#dataset"
        count = T.literal(self.total)
        rows = [(dataset, T.TYPE, VOID + "Dataset"), (dataset, T.TYPE, HYDRA + "Collection"), (dataset, VOID + "subset", url), (url, T.TYPE, HYDRA + "PartialCollectionView")]
        rows += [(url, HYDRA + "itemsPerPage", T.literal(self.size)), (url, VOID + "triples", count), (url, HYDRA + "totalItems", count)]
        return graph_of_rows(self.data.sparkSession, rows).df

    def controls(self) -> DataFrame:
        url, r = to_url(self.request, self.base), self.request
        rows = [(url, HYDRA + "first", to_url(r.at(1), self.base))]
        if r.page > 1:
            rows.append((url, HYDRA + "previous", to_url(r.at(r.page - 1), self.base)))
        if not self.last:
            rows.append((url, HYDRA + "next", to_url(r.at(r.page + 1), self.base)))
        search, names = "_:search", ("subject", "predicate", "object") if r.kind != "spf" else ("subject", "star")
        rows += [(f"{self.base}/{r.dataset}#dataset", HYDRA + "search", search), (search, HYDRA + "template", T.literal(f"{self.base}/{r.dataset}{{?{','.join(names)},page}}"))]
        for n in names:
            node = f"_:{n}"
            rows += [(search, HYDRA + "mapping", node), (node, HYDRA + "variable", T.literal(n))]
            if n != "star":
                rows.append((node, HYDRA + "property", T.RDF + n))
        return graph_of_rows(self.data.sparkSession, rows).df


def page_number(text: str | None) -> int:
    """A page parameter: 1 if missing, not a number, or below 1."""
    return max(1, int(text)) if text and re.fullmatch(r"\d+", text) else 1


def page_of(df: DataFrame, page: int, size: int = PAGE_SIZE, total: int | None = None) -> DataFrame:
    """A page in the order of all columns; past the total, if known, an empty one that sorts nothing."""
    if total is not None and size * (page - 1) >= total:
        return df.where("false")
    return df.orderBy(*df.columns).offset(size * (page - 1)).limit(size)


class PageCache:
    """Matches sorted and numbered once for each request, so that a page is a range of numbers. The least recently asked go
    first, with their tables."""

    def __init__(self, entries: int = 500) -> None:
        self.entries, self.held, self.hits = entries, OrderedDict(), 0

    def get(self, key: object, found: DataFrame) -> tuple[DataFrame, int]:
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
        else:
            self.held[key] = numbered(found, *found.columns)
            if len(self.held) > self.entries:
                self.held.popitem(last=False)
        return self.held[key]


def _fragment(graph: Graph, found: DataFrame, request: Request, size: int, base: str, pages: PageCache | None) -> Fragment:
    """A page of the matches: a range of their numbers where they are kept, else the first rows of a sort."""
    if pages is None:
        total = found.count()
        return Fragment(page_of(found, request.page, size, total), total, request, size, base, found)
    rows, total = pages.get((id(graph), request.at(1)), found)
    start = size * (request.page - 1)
    data = rows.where((F.col("at") >= start) & (F.col("at") < start + size)).orderBy("at").drop("at")
    return Fragment(data, total, request, size, base, rows.drop("at"))


def tpf(graph: Graph, t: TriplePattern, page: int = 1, size: int = PAGE_SIZE, dataset: str = "", base: str = "", pages: PageCache | None = None) -> Fragment:
    return _fragment(graph, _triples(graph, t), Request("tpf", dataset, page, t), size, base, pages)


def _triples(graph: Graph, t: TriplePattern) -> DataFrame:
    """The matching triples themselves."""
    named = [x if not isinstance(x, Variable) or x.name else Variable(f".{c}") for c, x in zip("spo", (t.s, t.p, t.o), strict=True)]
    df = graph.scan(TriplePattern(*named))
    return df.select(*((F.col(var(x.name)) if isinstance(x, Variable) else F.lit(x)).alias(c) for c, x in zip("spo", named, strict=True)))


def restrict(graph: Graph, t: TriplePattern, names: list[str], rows: list[tuple[str | None, ...]]) -> DataFrame:
    """The distinct triples that match the pattern under any of the bindings; variables beyond the pattern's do not matter."""
    own = [i for i, n in enumerate(names) if n in t.variables]
    rows = sorted({tuple(r[i] for i in own) for r in rows}, key=str)
    # rows with the same variables bound go in one semi-join
    by: dict[tuple[int, ...], list] = {}
    for r in rows:
        by.setdefault(tuple(k for k, v in enumerate(r) if v is not None), []).append(r)
    parts = []
    for bound, own_rows in by.items():
        found = _triples(graph, t)
        if bound:
            at = {x.name: c for c, x in reversed(list(zip("spo", (t.s, t.p, t.o), strict=True))) if isinstance(x, Variable)}
            keys = [names[own[k]] for k in bound]
            values = bindings(graph, keys, [tuple(r[k] for k in bound) for r in own_rows]).toDF(*(at[n] for n in keys))
            found = found.join(F.broadcast(values) if len(own_rows) <= 100_000 else values, [at[n] for n in keys], "left_semi").select("s", "p", "o")
        parts.append(found)
    if not parts:
        return _triples(graph, t).where("false")
    return reduce(DataFrame.unionByName, parts).distinct()


def brtpf(graph: Graph, t: TriplePattern, names: list[str], rows: list[tuple[str | None, ...]], page: int = 1, size: int = PAGE_SIZE, dataset: str = "", base: str = "", pages: PageCache | None = None) -> Fragment:
    return _fragment(graph, restrict(graph, t, names, rows), Request("brtpf", dataset, page, t, None, tuple(names), tuple(rows)), size, base, pages)


def spf(graph: Graph, star: StarPattern, names: list[str] = (), rows: list[tuple[str | None, ...]] = (), page: int = 1, size: int = PAGE_SIZE, dataset: str = "", base: str = "", pages: PageCache | None = None) -> Fragment:
    """Stars, as (s, pairs); under bindings, those of the star with any row's values in place."""
    if rows:
        found = reduce(DataFrame.unionByName, (_bound_stars(graph, star, list(names), group) for group in _by_bound(list(rows)))).distinct()
    else:
        found = distinct_stars(graph, star)
    return _fragment(graph, found, Request("spf", dataset, page, None, star, tuple(names), tuple(rows)), size, base, pages)


def _by_bound(rows: list[tuple[str | None, ...]]) -> list[list]:
    by: dict[tuple[bool, ...], list] = {}
    for r in rows:
        by.setdefault(tuple(v is not None for v in r), []).append(r)
    return list(by.values())


def _bound_stars(graph: Graph, star: StarPattern, names: list[str], rows: list[tuple[str | None, ...]]) -> DataFrame:
    kept = [i for i, n in enumerate(names) if n in star.variables and rows[0][i] is not None]
    if not kept:
        return distinct_stars(graph, star)
    matches = match_star(graph, star)
    values = bindings(graph, [names[i] for i in kept], [tuple(r[i] for i in kept) for r in rows])
    matches = matches.join(F.broadcast(values) if len(rows) <= 100_000 else values, values.columns, "left_semi")
    value = lambda x: F.col(var(x.name)) if isinstance(x, Variable) else F.lit(x)
    pairs = F.array_sort(F.array_distinct(F.array(*(F.struct(value(p).alias("p"), value(o).alias("o")) for p, o in star.pairs))))
    return matches.select(value(star.s).alias("s"), pairs.alias("pairs"))


def drain(fragment_at) -> DataFrame:
    """The union of all pages; fragment_at(page) gives one. They share one plan, so nothing is sorted or counted page by page."""
    return fragment_at(1).whole


def without_metadata(triples: DataFrame, url: str) -> DataFrame:
    """The data triples of a serialised fragment."""
    spoken = F.lit(False)
    for c in "spo":
        spoken = spoken | F.contains(F.col(c), F.lit(HYDRA)) | F.col(c).isin(VOID + "Dataset", VOID + "subset")
    return triples.where((F.col("s") != url) & ~spoken)


# requests


def _text(x: Position) -> str:
    if isinstance(x, Variable):
        return f"?{x.name}" if x.name else ""
    return x if x[0] in '"_' else f"<{x}>"


def _values_text(names: tuple[str, ...], rows: tuple[tuple[str | None, ...], ...]) -> str:
    cell = lambda v: "UNDEF" if v is None else _escaped(v)
    return f"({' '.join('?' + n for n in names)}){{{''.join('(' + ' '.join(map(cell, r)) + ')' for r in rows)}}}"


def _escaped(v: str) -> str:
    t = T.term(v)
    if t.kind != "literal":
        return v if t.kind == "bnode" else f"<{v}>"
    return f'"{T.escape(t.lex)}"' + v[len(t.lex) + 2 :]


def to_url(r: Request, base: str = "") -> str:
    """Components of a star are percent-encoded one by one, so that commas and semicolons in literals do not split it."""
    out: dict[str, str] = {}
    if r.kind == "spf":
        parts = [f"{k}{i},{quote(_text(x), safe='')}" for i, (p, o) in enumerate(r.star.pairs, 1) for k, x in (("p", p), ("o", o))]
        out |= {"subject": _text(r.star.s), "triples": str(len(r.star.pairs)), "star": f"[{';'.join(parts)}]"}
    else:
        out |= {k: _text(x) for k, x in zip(("subject", "predicate", "object"), (r.pattern.s, r.pattern.p, r.pattern.o), strict=True)}
    if r.names:
        out["values"] = _values_text(r.names, r.values)
    if r.page > 1:
        out["page"] = str(r.page)
    return f"{base}/{r.dataset}?{urlencode({k: v for k, v in out.items() if v})}"


def from_url(url: str) -> Request:
    """triples: a star; values alone: a restricted pattern; neither: a triple pattern."""
    parts = urlsplit(url)
    given = {k: v[0] for k, v in parse_qs(parts.query).items()}
    dataset, page = parts.path.rsplit("/", 1)[-1], page_number(given.get("page"))
    names: tuple[str, ...] = ()
    rows: tuple[tuple[str | None, ...], ...] = ()
    if "values" in given:
        parser = Parser(given["values"] if given["values"].lstrip().startswith(("(", "?")) else "", turtle=False)
        block = parser.values()
        names, rows = block.names, block.rows
    subject = parse_term(given.get("subject", given.get("s")))
    if "triples" not in given:
        pattern = TriplePattern(subject, parse_term(given.get("predicate", given.get("p"))), parse_term(given.get("object", given.get("o"))))
        return Request("brtpf" if "values" in given else "tpf", dataset, page, pattern, None, names, rows)
    own: dict[str, str] = {}
    for part in filter(None, given.get("star", "").strip("[]").split(";")):
        k, _, v = part.partition(",")
        own[k] = unquote(v)
    pairs = tuple((parse_term(own.get(f"p{i}", "")), parse_term(own.get(f"o{i}", ""))) for i in range(1, int(given["triples"]) + 1))
    return Request("spf", dataset, page, None, StarPattern(subject, pairs), names, rows)


def answer(graph: Graph, url: str, size: int = PAGE_SIZE, base: str = "", pages: PageCache | None = None) -> Fragment:
    """The fragment that a request's URL asks for."""
    r = from_url(url)
    if r.kind == "tpf":
        return tpf(graph, r.pattern, r.page, size, r.dataset, base, pages)
    if r.kind == "brtpf":
        return brtpf(graph, r.pattern, list(r.names), list(r.values), r.page, size, r.dataset, base, pages)
    return spf(graph, r.star, list(r.names), list(r.values), r.page, size, r.dataset, base, pages)


class Client:
    """Asks for fragments by URL and keeps the responses, the oldest of `entries` going first.

    fetch(url) gives a fragment, such as answer() with a graph and its PageCache. requests counts those not kept."""

    def __init__(self, fetch: Callable[[str], Fragment], entries: int = 1000) -> None:
        self.fetch, self.entries, self.kept = fetch, entries, OrderedDict()
        self.requests = self.hits = 0

    def get(self, url: str) -> Fragment:
        if url in self.kept:
            self.hits += 1
            return self.kept[url]
        self.requests += 1
        self.kept[url] = found = self.fetch(url)
        if len(self.kept) > self.entries:
            self.kept.popitem(last=False)
        return found

    def pages(self, request: Request, base: str = "") -> Iterator[Fragment]:
        """Page after page, as long as there is a next one."""
        while True:
            found = self.get(to_url(request, base))
            yield found
            if found.last:
                return
            request = request.at(request.page + 1)
