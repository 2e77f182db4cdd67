"""SPARQL algebra as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.terms import Variable
from .patterns import Position, TriplePattern


@dataclass(frozen=True)
class Path:
    """op: iri, inv, seq, alt, opt, star, plus, not. not holds (iri, inverse) pairs."""

    op: str
    args: tuple


@dataclass(frozen=True)
class PathPattern:
    s: Position
    path: Path
    o: Position


@dataclass(frozen=True)
class BGP:
    patterns: tuple[TriplePattern | PathPattern, ...]


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    filters: tuple = ()


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    inner: object
    conditions: tuple


@dataclass(frozen=True)
class Extend:
    inner: object
    name: str
    expression: object


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class InGraph:
    name: Position
    inner: object


@dataclass(frozen=True)
class Call:
    """An operator or function: its upper-case name and arguments. Aggregates carry distinct and separator in `more`."""

    name: str
    args: tuple
    more: tuple = ()


@dataclass(frozen=True)
class Exists:
    inner: object
    negated: bool


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    where: object
    projection: list[tuple[str, object | None]] | None = None  # None: all variables
    distinct: bool = False
    reduced: bool = False
    template: list[TriplePattern] = field(default_factory=list)
    resources: list[Position] = field(default_factory=list)
    group: list[tuple[str, object | None]] | None = None
    having: list = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)  # expression, descending
    limit: int | None = None
    offset: int = 0


AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")


def variables_of(node: object) -> list[str]:
    """In-scope variables, in order of appearance; those of blank nodes start with a dot."""
    out: dict[str, None] = {}

    def see(x: object) -> None:
        if isinstance(x, Variable):
            if x.name:
                out[x.name] = None
        elif isinstance(x, BGP):
            for t in x.patterns:
                for y in (t.s, t.p, t.o) if isinstance(t, TriplePattern) else (t.s, t.o):
                    see(y)
        elif isinstance(x, (Join, LeftJoin, Union)):
            see(x.left)
            see(x.right)
        elif isinstance(x, Minus):
            see(x.left)
        elif isinstance(x, Filter):
            see(x.inner)
        elif isinstance(x, Extend):
            see(x.inner)
            out[x.name] = None
        elif isinstance(x, Values):
            out.update(dict.fromkeys(x.names))
        elif isinstance(x, InGraph):
            see(x.name)
            see(x.inner)
        elif isinstance(x, Query):
            out.update(dict.fromkeys([n for n, _ in x.projection] if x.projection is not None else [v for v in variables_of(x.where) if v[0] != "."]))

    see(node)
    return list(out)
