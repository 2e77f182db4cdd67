"""RDF terms as canonical strings, on the driver and as columns.

An IRI stands bare, a blank node as ``_:label``, a literal as ``"lex"``, ``"lex"@lang`` (lower case) or
``"lex"^^<datatype>``. xsd:string is a plain literal's type and not written. A literal's lex is raw, not escaped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE = RDF + "type"
INTEGER, DOUBLE, DECIMAL, BOOLEAN, DATETIME, STRING = (XSD + t for t in ("integer", "double", "decimal", "boolean", "dateTime", "string"))
NUMERIC = (INTEGER, DOUBLE, DECIMAL, *(XSD + t for t in ("float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")))
#: What a malformed literal in a request stands for; it matches nothing.
INVALID = "urn:invalid"

_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


@dataclass(frozen=True)
class Term:
    kind: str  # iri, literal or bnode
    lex: str
    datatype: str | None = None
    lang: str | None = None

    def __str__(self) -> str:
        if self.kind == "iri":
            return self.lex
        if self.kind == "bnode":
            return "_:" + self.lex
        if self.lang:
            return f'"{self.lex}"@{self.lang.lower()}'
        return f'"{self.lex}"' + ("" if self.datatype in (None, STRING) else f"^^<{self.datatype}>")


def iri(value: str) -> str:
    return value


def literal(value: object, datatype: str | None = None, lang: str | None = None) -> str:
    """The canonical string of a Python value."""
    if datatype is None and lang is None:
        if isinstance(value, bool):
            return f'"{str(value).lower()}"^^<{BOOLEAN}>'
        if isinstance(value, int):
            return f'"{value}"^^<{INTEGER}>'
        if isinstance(value, float):
            return f'"{value}"^^<{DOUBLE}>'
    return str(Term("literal", str(value), datatype, lang))


def term(text: str) -> Term:
    """The parts of a canonical string."""
    if text.startswith("_:"):
        return Term("bnode", text[2:])
    if text.startswith('"') and (m := re.match(_LITERAL, text)):
        return Term("literal", m[1], m[3], m[2])
    return Term("iri", text)


@dataclass(frozen=True)
class Variable:
    name: str  # without ?; empty: unspecified

    def __str__(self) -> str:
        return "?" + self.name


def parse_term(text: str | None) -> str | Variable:
    """A request's term by its first character: ? a variable, _ an anonymous one, < an IRI, " a literal, else a bare IRI.

    Empty or missing: an unspecified variable. A malformed literal: urn:invalid."""
    if not text:
        return Variable("")
    if text[0] == "?":
        return Variable(text[1:])
    if text[0] == "_":
        return Variable(text)
    if text[0] == "<":
        return text[1:-1] if text.endswith(">") else text[1:]
    if text[0] == '"':
        if not (m := re.match(r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<?([^<>"]+)>?)?$', text)):
            return INVALID
        return str(Term("literal", m[1], m[3], m[2]))
    return text


# Columns


def kind(c: Column) -> Column:
    return F.when(c.startswith('"'), "literal").when(c.startswith("_:"), "bnode").when(c.isNotNull(), "iri")


def lex(c: Column) -> Column:
    """A literal's lexical form; an IRI or blank node as it is."""
    return F.when(c.startswith('"'), F.regexp_extract(c, _LITERAL, 1)).otherwise(c)


def lang(c: Column) -> Column:
    """The language tag, empty for other literals, null for what is no literal."""
    return F.when(c.startswith('"'), F.regexp_extract(c, _LITERAL, 2))


def datatype(c: Column) -> Column:
    own = F.regexp_extract(c, _LITERAL, 3)
    return F.when(c.startswith('"'), F.when(own != "", own).when(F.regexp_extract(c, _LITERAL, 2) != "", RDF + "langString").otherwise(STRING))


def num(c: Column) -> Column:
    """A literal's number, whatever its type; null if its form is none."""
    return F.when(c.startswith('"'), F.regexp_extract(c, _LITERAL, 1).try_cast("double"))


_NUMBER = rf'^"([^"]*)"\^\^<{re.escape(XSD)}({"|".join(t.removeprefix(XSD) for t in NUMERIC)})>$'


def numeral(c: Column) -> tuple[Column, Column]:
    """The lexical form of a literal of a numeric type and that type's name; both empty for others."""
    return F.regexp_extract(c, _NUMBER, 1), F.regexp_extract(c, _NUMBER, 2)


def number(c: Column) -> Column:
    """The number of a literal of a numeric type; null for others."""
    return numeral(c)[0].try_cast("double")


def timestamp(c: Column) -> Column:
    return F.when(c.startswith('"'), F.regexp_extract(c, _LITERAL, 1).try_cast("timestamp_ntz"))


def typed(c: Column, type_iri: str) -> Column:
    """The canonical literal of a column of text, null for null."""
    return F.concat(F.lit('"'), c, F.lit(f'"^^<{type_iri}>'))


def plain(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def of_column(c: Column, sql_type: str) -> Column:
    """The canonical literal of a table's column, by its Spark type."""
    if sql_type in ("tinyint", "smallint", "int", "bigint"):
        return typed(c.cast("string"), INTEGER)
    if sql_type in ("float", "double"):
        return typed(c.cast("string"), DOUBLE)
    if sql_type.startswith("decimal"):
        return typed(c.cast("string"), DECIMAL)
    if sql_type == "boolean":
        return typed(c.cast("string"), BOOLEAN)
    if sql_type.startswith("timestamp") or sql_type == "date":
        return typed(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), DATETIME)
    return plain(c.cast("string"))


def binding_key(*columns: Column) -> Column:
    """A hash of a solution's values: equal for equal solutions, whatever the names of its variables."""
    return F.xxhash64(*columns)


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings share from the start. Strings compare by their bytes, as Spark's do."""
    least = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(least == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, least))


def crc(c: Column, bits: int = 32) -> Column:
    """The checksum of a string's bytes: CRC-32, or CRC-16 or CRC-8 over one bit after another."""
    if bits == 32:
        return F.crc32(c.cast("binary"))
    # The polynomials of CRC-16 (ARC, lowest bit first) and of CRC-8 (highest bit first)
    poly = {16: 0xA001, 8: 0x07}[bits]
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (poly if x & 1 else 0) if bits == 16 else (x << 1 ^ (poly if x & 128 else 0)) & 255
        table.append(x)
    codes = F.transform(F.split(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "$1,"), ","), lambda h: F.conv(F.when(h != "", h), 16, 10).cast("int"))
    rest = (lambda held: F.shiftright(held, 8)) if bits == 16 else (lambda held: F.lit(0))
    values = F.array(*map(F.lit, table))
    return F.aggregate(F.filter(codes, lambda x: x.isNotNull()), F.lit(0), lambda held, byte: F.get(values, held.bitwiseXOR(byte).bitwiseAND(F.lit(255))).bitwiseXOR(rest(held))).cast("long")


# N-Triples escapes

_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    """Reads \\t \\r \\n \\" \\\\ \\uXXXX and \\UXXXXXXXX; any other backslash is a ValueError."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        if m[3] in _SHORT and m[3]:
            return _SHORT[m[3]]
        raise ValueError(f"bad escape in {text!r}")

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.?))", one, text, flags=re.S) if "\\" in text else text


def escape(text: str) -> str:
    """Writes what unescape reads: ASCII alone, astral characters as one \\U."""
    out = []
    for c in text:
        if c in '"\\':
            out.append("\\" + c)
        elif c in "\t\n\r":
            out.append({"\t": "\\t", "\n": "\\n", "\r": "\\r"}[c])
        elif " " <= c <= "~":
            out.append(c)
        else:
            out.append(f"\\u{ord(c):04X}" if ord(c) < 0x10000 else f"\\U{ord(c):08X}")
    return "".join(out)


def ntriples_term(c: Column) -> Column:
    """A canonical term as N-Triples writes it, non-ASCII characters as they are (UTF-8)."""
    quoted = F.regexp_extract(c, _LITERAL, 1)
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(out))
    suffix = F.regexp_extract(c, r'(?s)^".*("(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$', 1)
    return F.when(c.startswith('"'), F.concat(F.lit('"'), quoted, suffix)).when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
