"""Join order: fewest matches first, then what shares variables with what is already bound."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.terms import TYPE, Variable
from .patterns import StarPattern, TriplePattern

#: Without statistics a graph is taken to have so many triples, predicates, and triples of a subject.
TRIPLES, PREDICATES, OF_SUBJECT = 1_000_000, 50, 10


@dataclass(frozen=True)
class Statistics:
    """Triples in all, and by predicate: triples, distinct subjects, distinct objects."""

    triples: int = 0
    predicates: dict[str, tuple[int, int, int]] = field(default_factory=dict)

    def estimate(self, t: TriplePattern, known: frozenset[str] = frozenset()) -> float:
        """Expected matches of a pattern, for one value of each known variable."""
        fixed = [not isinstance(x, Variable) or x.name in known for x in (t.s, t.p, t.o)]
        if not self.predicates:
            n, s = (TRIPLES // PREDICATES if fixed[1] else TRIPLES), TRIPLES // OF_SUBJECT
            o = PREDICATES if t.p == TYPE else round(n**0.5)  # classes are few
        elif isinstance(t.p, Variable):
            n, s, o = (sum(v[i] for v in self.predicates.values()) for i in range(3))
        elif t.p not in self.predicates:
            return 0.0
        else:
            n, s, o = self.predicates[t.p]
        if fixed[0]:
            n /= max(1, s)
        if fixed[2]:
            n /= max(1, o)
        return float(n)


def order(patterns: list[TriplePattern], stats: Statistics | None = None, known: frozenset[str] = frozenset()) -> list[TriplePattern]:
    """Greedy: a pattern that shares a variable with those before comes before one that does not; then the fewest matches."""
    stats = stats or Statistics()
    left, out = list(patterns), []
    while left:
        best = min(left, key=lambda t: (bool(known) and bool(t.variables) and not t.bound(set(known)), stats.estimate(t, known), -t.bound(set(known))))
        left.remove(best)
        out.append(best)
        known = known | set(best.variables)
    return out


def order_stars(stars: list[StarPattern], stats: Statistics | None = None) -> list[StarPattern]:
    """Stars by their most selective pattern, connected ones first."""
    stats = stats or Statistics()
    left, out, known = list(stars), [], frozenset[str]()
    while left:
        best = min(left, key=lambda s: (bool(known) and not s.bound(set(known)), min(stats.estimate(t, known) for t in s.patterns), -s.bound(set(known))))
        left.remove(best)
        out.append(best)
        known = known | set(best.variables)
    return out
