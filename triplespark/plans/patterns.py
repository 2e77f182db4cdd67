"""Patterns of triples, their shapes, and how a basic graph pattern falls into stars."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.terms import Variable

Position = str | Variable


@dataclass(frozen=True)
class TriplePattern:
    s: Position
    p: Position
    o: Position

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x.name for x in (self.s, self.p, self.o) if isinstance(x, Variable)))

    def bind(self, values: dict[str, str | None]) -> TriplePattern:
        """Variables with a value replaced; None and missing ones stay."""
        return TriplePattern(*(values.get(x.name) or x if isinstance(x, Variable) else x for x in (self.s, self.p, self.o)))

    def contains(self, other: TriplePattern) -> bool:
        """Whether all that matches other matches this: a variable stands for anything, a repeated one for the same."""
        seen: dict[str, Position] = {}
        for a, b in zip((self.s, self.p, self.o), (other.s, other.p, other.o), strict=True):
            if isinstance(a, Variable):
                if a.name and seen.setdefault(a.name, b) != b:
                    return False
            elif a != b:
                return False
        return True

    def bound(self, known: set[str]) -> int:
        """How many of its variables are known."""
        return len(set(self.variables) & known)


@dataclass(frozen=True)
class StarPattern:
    """Patterns with one subject."""

    s: Position
    pairs: tuple[tuple[Position, Position], ...]

    @property
    def patterns(self) -> tuple[TriplePattern, ...]:
        return tuple(TriplePattern(self.s, p, o) for p, o in self.pairs)

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for t in self.patterns for v in t.variables))

    def bind(self, values: dict[str, str | None]) -> StarPattern:
        bound = [t.bind(values) for t in self.patterns]
        return StarPattern(bound[0].s, tuple((t.p, t.o) for t in bound))

    def bound(self, known: set[str]) -> int:
        return len(set(self.variables) & known)


@dataclass(frozen=True)
class PathPattern:
    """A chain: each pattern's object is the next one's subject. nodes has one more than predicates."""

    nodes: tuple[Position, ...]
    predicates: tuple[Position, ...]

    @property
    def patterns(self) -> tuple[TriplePattern, ...]:
        return tuple(TriplePattern(a, p, b) for a, p, b in zip(self.nodes, self.predicates, self.nodes[1:], strict=False))


@dataclass(frozen=True)
class SinkPattern:
    """Patterns with one object."""

    o: Position
    pairs: tuple[tuple[Position, Position], ...]

    @property
    def patterns(self) -> tuple[TriplePattern, ...]:
        return tuple(TriplePattern(s, p, self.o) for s, p in self.pairs)


def stars(patterns: list[TriplePattern]) -> list[StarPattern]:
    """By subject term, in order of appearance; constant subjects make stars of their own."""
    by: dict[Position, list[tuple[Position, Position]]] = {}
    for t in patterns:
        by.setdefault(t.s, []).append((t.p, t.o))
    return [StarPattern(s, tuple(pairs)) for s, pairs in by.items()]


def shape(patterns: list[TriplePattern]) -> str | None:
    """N_stars with up to three distinct subjects; beyond that paths if no two patterns share a subject, else None."""
    subjects = len({t.s for t in patterns})
    if subjects <= 3:
        return f"{subjects}_stars"
    return "paths" if subjects == len(patterns) else None
