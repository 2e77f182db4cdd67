"""SPARQL expressions as columns. An error is null, so conditions follow SQL's three-valued logic as SPARQL's do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as T


#: The types of numbers, lowest first: a result has the highest of its operands'.
RANKED = (T.INTEGER, T.DECIMAL, T.XSD + "float", T.DOUBLE)
WHOLE, EXACT = "decimal(38,0)", "decimal(38,18)"


@dataclass(frozen=True)
class Value:
    """A column and what it holds: term (canonical), num (a double), int (a long), str (a plain literal's form), bool, time,
    or number, whose type is known by row: the column is its value as a double, and `exactly` its rank in RANKED, its value
    as a WHOLE number (rank 0), and as an EXACT one (ranks 0 and 1)."""

    kind: str
    column: Column
    exactly: tuple[Column, Column, Column] | None = None

    @property
    def term(self) -> Column:
        c = self.column
        if self.kind == "term":
            return c
        if self.kind == "str":
            return T.plain(c)
        if self.kind == "bool":
            return T.typed(c.cast("string"), T.BOOLEAN)
        if self.kind == "time":
            return T.of_column(c, "timestamp")
        if self.kind == "number":
            rank, whole, exact = self.exactly
            form = F.when(rank == 0, whole.cast("string")).when(rank == 1, F.when(exact == 0, "0").otherwise(F.regexp_replace(exact.cast("string"), r"\.?0+$", ""))).otherwise(c.cast("string"))
            return F.concat(F.lit('"'), form, F.lit('"^^<'), F.get(F.array(*map(F.lit, RANKED)), rank), F.lit(">"))
        return T.typed(c.cast("string"), T.INTEGER if self.kind == "int" else T.DOUBLE)

    @property
    def parts(self) -> tuple[Column, Column, Column, Column]:
        """Rank, whole, exact and approx of a number; nulls of what is none."""
        c = self.column
        if self.kind == "number":
            return *self.exactly, c
        if self.kind == "int":
            return F.lit(0), c.cast(WHOLE), c.cast(EXACT), c.cast("double")
        none = F.lit(None).cast(WHOLE), F.lit(None).cast(EXACT)
        if self.kind == "num":
            return F.when(c.isNotNull(), F.lit(3)), *none, c.cast("double")
        if self.kind != "term":
            return F.lit(None).cast("int"), *none, F.lit(None).cast("double")
        text, name = T.numeral(c)
        rank = F.when(name == "double", 3).when(name == "float", 2).when(name == "decimal", 1).when(name != "", 0)
        return rank, text.try_cast(WHOLE), text.try_cast(EXACT), text.try_cast("double")

    @property
    def num(self) -> Column:
        if self.kind == "term":
            return T.number(self.column)
        return self.column if self.kind in NUMBERS else F.lit(None).cast("double")

    @property
    def text(self) -> Column:
        return self.column if self.kind == "str" else T.lex(self.term)

    @property
    def time(self) -> Column:
        return self.column if self.kind == "time" else T.timestamp(self.term)

    @property
    def true(self) -> Column:
        c = self.column
        if self.kind == "bool":
            return c
        if self.kind in NUMBERS:
            return self.num != 0
        if self.kind == "str":
            return c != ""
        n = T.number(c)
        return F.when(n.isNotNull(), n != 0).when(T.datatype(c) == T.BOOLEAN, T.lex(c) == "true").when(c.startswith('"'), T.lex(c) != "")


NUMBERS = ("num", "int", "number")


def number(rank: Column, whole: Column, exact: Column, approx: Column) -> Value:
    return Value("number", approx, (rank, whole.try_cast(WHOLE), exact.try_cast(EXACT)))


def single(v: Value) -> Value:
    """A value that is one column."""
    return Value("term", v.term) if v.kind == "number" else v


def constant(term: str) -> Value:
    t = T.term(term)
    if t.kind == "literal" and t.datatype == T.INTEGER:
        return Value("int", F.lit(int(t.lex)).cast("bigint"))
    if t.kind == "literal" and t.datatype == T.DECIMAL:
        return number(F.lit(1), F.lit(None).cast(WHOLE), F.lit(t.lex).try_cast(EXACT), F.lit(float(t.lex)))
    if t.kind == "literal" and t.datatype == T.DOUBLE:
        return Value("num", F.lit(float(t.lex)))
    if t.kind == "literal" and t.datatype == T.BOOLEAN:
        return Value("bool", F.lit(t.lex == "true"))
    return Value("term", F.lit(term))


def equal(a: Value, b: Value) -> Column:
    """Numbers by value, other terms by identity."""
    if {a.kind, b.kind} & set(NUMBERS):
        return a.num == b.num
    if a.kind == b.kind and a.kind in ("str", "bool", "time"):
        return a.column == b.column
    if {a.kind, b.kind} <= {"term", "str"} and "str" in (a.kind, b.kind):
        return a.term == b.term
    return F.coalesce(a.num == b.num, a.term == b.term)


def less(a: Value, b: Value, op: str) -> Column:
    of = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if {a.kind, b.kind} & set(NUMBERS):
        return of(a.num, b.num)
    if a.kind == b.kind and a.kind in ("str", "bool", "time"):
        return of(a.column, b.column)
    x, y = a.num, b.num
    return F.when(x.isNotNull() & y.isNotNull(), of(x, y)).when(x.isNull() & y.isNull(), of(a.text, b.text))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """The type of the result is the higher of the operands', and a decimal for two whole numbers' quotient. Overflow and division by 0 are errors."""
    of = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(op)
    if a.kind == b.kind == "int" and of:
        return Value("int", of(a.column, b.column))
    if "num" in (a.kind, b.kind) and {a.kind, b.kind} <= set(NUMBERS):
        x, y = a.num.cast("double"), b.num.cast("double")
        return Value("num", x / F.when(y != 0, y) if op == "/" else {"+": x + y, "-": x - y, "*": x * y}[op])
    (r, w, e, x), (s, v, f, y) = a.parts, b.parts
    high = F.when(r.isNotNull() & s.isNotNull(), F.greatest(r, s))
    if op == "/":
        quotient = x / F.when(y != 0, y)
        return number(F.greatest(high, F.when(high.isNotNull(), F.lit(1))), F.lit(None), quotient, quotient)
    return number(high, of(w, v), of(e, f), {"+": x + y, "-": x - y, "*": x * y}[op])


def total(v: Value, distinct: bool) -> Value:
    """The sum over a group: 0 of none; an error if a bound value is no number."""
    if v.kind == "num":
        return Value("num", F.coalesce(F.sum_distinct(v.column) if distinct else F.sum(v.column), F.lit(0.0)))
    rank, whole, exact, approx = v.parts
    add = (lambda c: F.sum_distinct(c)) if distinct else F.try_sum
    zero = F.lit(0)
    right = F.count_if(v.column.isNotNull() & rank.isNull()) == 0
    value = F.coalesce(F.sum_distinct(approx) if distinct else F.sum(approx), F.lit(0.0))
    return number(F.when(right, F.coalesce(F.max(rank), zero)), F.coalesce(add(whole), zero), F.coalesce(add(exact), zero), F.when(right, value))


def mean(v: Value, distinct: bool) -> Value:
    """The average over a group: 0 of none; a decimal for whole numbers; an error if a bound value is no number."""
    if v.kind == "num":
        return Value("num", F.coalesce(F.try_divide(F.sum_distinct(v.column), F.count_distinct(v.column)) if distinct else F.avg(v.column), F.lit(0.0)))
    rank, _, _, approx = v.parts
    value = F.try_divide(F.sum_distinct(approx), F.count_distinct(approx)) if distinct else F.avg(approx)
    right = F.count_if(v.column.isNotNull() & rank.isNull()) == 0
    value = F.coalesce(value, F.lit(0.0))
    return number(F.when(right, F.when(F.count(rank) == 0, 0).otherwise(F.greatest(F.max(rank), F.lit(1)))), F.lit(0), value, F.when(right, value))


def rank(v: Value) -> list[Column]:
    """Keys that sort as ORDER BY does: unbound, blank nodes, IRIs, literals; numbers by value before other literals."""
    if v.kind != "term":
        return [v.column]
    kind = F.when(v.column.isNull(), 0).when(v.column.startswith("_:"), 1).when(~v.column.startswith('"'), 2).otherwise(3)
    return [kind, v.num.isNull(), v.num, v.text]


def _string(f: Callable[..., Column], *args: Value) -> Value:
    return Value("str", f(*(a.text for a in args)))


def _regex(args: list[Value]) -> Column:
    flags = args[2].text if len(args) > 2 else F.lit("")
    return F.regexp_like(args[0].text, F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(""), args[1].text))


def _if(a: Value, b: Value, c: Value) -> Value:
    b, c = single(b), single(c)
    if b.kind == c.kind:
        return Value(b.kind, F.when(a.true, b.column).when(~a.true, c.column))
    return Value("term", F.when(a.true, b.term).when(~a.true, c.term))


def _coalesce(args: list[Value]) -> Value:
    args = [single(a) for a in args]
    if len({a.kind for a in args}) == 1:
        return Value(args[0].kind, F.coalesce(*(a.column for a in args)))
    return Value("term", F.coalesce(*(a.term for a in args)))


def _each(f: Callable[[Column], Column], a: Value) -> Value:
    """A function of a number that keeps its type."""
    if a.kind in ("int", "num"):
        return Value(a.kind, f(a.column).cast("bigint" if a.kind == "int" else "double"))
    rank, whole, exact, approx = a.parts
    return number(rank, f(whole), f(exact), f(approx).cast("double"))


def _time_part(f: Callable[[Column], Column]) -> Callable[[list[Value]], Value]:
    return lambda a: Value("int", f(a[0].time).cast("bigint"))


def _zone(a: Value) -> Column:
    """The zone that a time is written with: Z, +hh:mm or -hh:mm, or nothing."""
    return F.regexp_extract(a.text, r"^.*T.*?(Z|[+-]\d\d:\d\d)$", 1)


def _duration(zone: Column) -> Column:
    """A zone as a dayTimeDuration; an error without one."""
    hours, minutes = F.regexp_extract(zone, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)", 1).try_cast("int")
    body = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when((hours > 0) | (minutes == 0), F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    return T.typed(F.when(zone == "Z", "PT0S").when((hours == 0) & (minutes == 0), "PT0S").when(zone != "", body), T.XSD + "dayTimeDuration")


def _cast(datatype: str) -> Callable[[list[Value]], Value]:
    def run(a: list[Value]) -> Value:
        text = a[0].text
        if datatype == T.INTEGER:
            return Value("int", text.try_cast("double").cast("bigint"))
        if datatype in RANKED[1:]:
            approx = text.try_cast("double")
            return Value("num", approx) if datatype == T.DOUBLE else number(F.lit(RANKED.index(datatype)), F.lit(None), text.try_cast(EXACT) if datatype == T.DECIMAL else F.lit(None), approx)
        if datatype == T.BOOLEAN:
            return Value("bool", text.try_cast("boolean"))
        if datatype == T.DATETIME:
            return Value("time", text.try_cast("timestamp_ntz"))
        return Value("str", text)

    return run


FUNCTIONS: dict[str, Callable[[list[Value]], Value]] = {
    "STR": lambda a: Value("str", a[0].text),
    "LANG": lambda a: Value("str", T.lang(a[0].term)),
    "LANGMATCHES": lambda a: Value("bool", F.when(a[1].text == "*", a[0].text != "").otherwise((F.lower(a[0].text) == F.lower(a[1].text)) | F.startswith(F.lower(a[0].text), F.concat(F.lower(a[1].text), F.lit("-"))))),
    "DATATYPE": lambda a: Value("term", T.datatype(a[0].term)),
    "IRI": lambda a: Value("term", a[0].text),
    "URI": lambda a: Value("term", a[0].text),
    "STRDT": lambda a: Value("term", F.concat(F.lit('"'), a[0].text, F.lit('"^^<'), a[1].text, F.lit(">"))),
    "STRLANG": lambda a: Value("term", F.concat(F.lit('"'), a[0].text, F.lit('"@'), F.lower(a[1].text))),
    "ISIRI": lambda a: Value("bool", T.kind(a[0].term) == "iri"),
    "ISURI": lambda a: Value("bool", T.kind(a[0].term) == "iri"),
    "ISBLANK": lambda a: Value("bool", T.kind(a[0].term) == "bnode"),
    "ISLITERAL": lambda a: Value("bool", T.kind(a[0].term) == "literal"),
    "ISNUMERIC": lambda a: Value("bool", F.when(a[0].term.isNotNull(), a[0].num.isNotNull())),
    "SAMETERM": lambda a: Value("bool", a[0].term == a[1].term),
    "REGEX": lambda a: Value("bool", _regex(a)),
    "REPLACE": lambda a: Value("str", F.regexp_replace(a[0].text, a[1].text, a[2].text)),
    "CONTAINS": lambda a: Value("bool", F.contains(a[0].text, a[1].text)),
    "STRSTARTS": lambda a: Value("bool", F.startswith(a[0].text, a[1].text)),
    "STRENDS": lambda a: Value("bool", F.endswith(a[0].text, a[1].text)),
    "STRBEFORE": lambda a: Value("str", F.when(F.contains(a[0].text, a[1].text), F.left(a[0].text, F.call_function("instr", a[0].text, a[1].text) - 1)).otherwise("")),
    "STRAFTER": lambda a: Value("str", F.when(F.contains(a[0].text, a[1].text), F.substr(a[0].text, F.call_function("instr", a[0].text, a[1].text) + F.length(a[1].text))).otherwise("")),
    "STRLEN": lambda a: Value("int", F.length(a[0].text).cast("bigint")),
    "SUBSTR": lambda a: Value("str", F.substr(a[0].text, a[1].num.cast("int"), a[2].num.cast("int")) if len(a) > 2 else F.substr(a[0].text, a[1].num.cast("int"))),
    "UCASE": lambda a: _string(F.upper, a[0]),
    "LCASE": lambda a: _string(F.lower, a[0]),
    "CONCAT": lambda a: _string(F.concat, *a),
    "ENCODE_FOR_URI": lambda a: Value("str", F.replace(F.url_encode(a[0].text), F.lit("+"), F.lit("%20"))),
    "ABS": lambda a: _each(F.abs, a[0]),
    "ROUND": lambda a: _each(lambda x: F.floor(x + F.lit(0.5).cast("decimal(1,1)")), a[0]),
    "CEIL": lambda a: _each(F.ceil, a[0]),
    "FLOOR": lambda a: _each(F.floor, a[0]),
    "YEAR": _time_part(F.year),
    "MONTH": _time_part(F.month),
    "DAY": _time_part(F.dayofmonth),
    "HOURS": _time_part(F.hour),
    "MINUTES": _time_part(F.minute),
    "SECONDS": lambda a: Value("num", F.date_part(F.lit("SECONDS"), a[0].time).cast("double")),
    "IF": lambda a: _if(*a),
    "COALESCE": _coalesce,
    "NOW": lambda a: Value("time", F.current_timestamp().cast("timestamp_ntz")),
    "RAND": lambda a: Value("num", F.rand()),
    "UUID": lambda a: Value("term", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda a: Value("str", F.uuid()),
    "BNODE": lambda a: Value("term", F.concat(F.lit("_:b"), F.md5(a[0].text.cast("binary")) if a else F.replace(F.uuid(), F.lit("-")))),
    "TZ": lambda a: Value("str", F.when(a[0].time.isNotNull(), _zone(a[0]))),
    "TIMEZONE": lambda a: Value("term", _duration(_zone(a[0]))),
    "MD5": lambda a: Value("str", F.md5(a[0].text.cast("binary"))),
    "SHA1": lambda a: Value("str", F.sha1(a[0].text.cast("binary"))),
    "SHA256": lambda a: Value("str", F.sha2(a[0].text.cast("binary"), 256)),
    "SHA384": lambda a: Value("str", F.sha2(a[0].text.cast("binary"), 384)),
    "SHA512": lambda a: Value("str", F.sha2(a[0].text.cast("binary"), 512)),
    **{t: _cast(t) for t in (T.INTEGER, T.DOUBLE, T.DECIMAL, T.BOOLEAN, T.DATETIME, T.STRING, T.XSD + "float")},
}
