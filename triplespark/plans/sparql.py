"""A recursive-descent parser for SPARQL 1.1 queries; its triples block also reads Turtle."""

from __future__ import annotations

import re

from ..functions import terms as T
from ..functions.terms import Term, Variable
from . import algebra as A
from .patterns import Position, TriplePattern

_TOKENS = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<var>[?$]\w+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<bnode>_:[\w.-]*\w)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<name>[^\W\d_][\w.-]*(?<!\.)?:(?:(?:[\w:-]|\.(?=[\w:%\\-])|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*)|:(?:(?:[\w:-]|\.(?=[\w:%\\-])|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*))
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,/|^?*+!=<>-])""",
    re.X | re.S,
)


class SyntaxProblem(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at : at + 20]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """Positions are canonical terms or Variables; blank nodes of queries are Variables whose name starts with a dot."""

    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None, turtle: bool = False) -> None:
        self.tokens, self.at = tokens(text), 0
        self.base, self.prefixes, self.turtle = base, dict(prefixes or {}), turtle
        self.fresh = 0
        self.triples: list[TriplePattern | A.PathPattern] = []

    # tokens

    def peek(self, ahead: int = 0) -> str:
        kind, text = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text.upper() if kind == "word" else text

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self) -> str:
        text = self.tokens[self.at][1]
        self.at += 1
        return text

    def accept(self, *texts: str) -> str | None:
        if self.kind in ("op", "word") and self.peek() in texts:
            got = self.peek()
            self.at += 1
            return got
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise SyntaxProblem(f"expected {text}, got {self.peek()!r}")

    # terms

    def resolve(self, iri: str) -> str:
        from urllib.parse import urljoin

        iri = T.unescape(iri)
        if iri.startswith("#") and self.base:  # urljoin drops an empty fragment
            return self.base.partition("#")[0] + iri
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) or not self.base else urljoin(self.base, iri)

    def iri(self) -> str:
        if self.kind == "iri":
            return self.resolve(self.take()[1:-1])
        if self.kind == "name":
            prefix, _, local = self.take().partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"no prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxProblem(f"expected an IRI, got {self.peek()!r}")

    def blank(self) -> Position:
        self.fresh += 1
        return f"_:b{self.fresh}" if self.turtle else Variable(f".b{self.fresh}")

    def literal(self) -> str:
        text = self.take()
        quote = 3 if text[:3] in ('"""', "'''") else 1
        lex = T.unescape(text[quote:-quote])
        if self.kind == "lang":
            return str(Term("literal", lex, lang=self.take()[1:]))
        if self.accept("^^"):
            return str(Term("literal", lex, self.iri()))
        return str(Term("literal", lex))

    def number(self, sign: str = "") -> str:
        text = sign + self.take()
        return str(Term("literal", text, T.DOUBLE if "e" in text.lower() else T.DECIMAL if "." in text else T.INTEGER))

    def is_term(self) -> bool:
        return self.kind in ("iri", "name", "string", "var", "bnode", "number") or self.peek() in ("[", "(", "TRUE", "FALSE") or self.peek() in ("+", "-") and self.tokens[self.at + 1][0] == "number"

    def term(self) -> Position:
        if self.kind == "var":
            return Variable(self.take()[1:])
        if self.kind in ("iri", "name"):
            return self.iri()
        if self.kind == "string":
            return self.literal()
        if self.kind == "number":
            return self.number()
        if self.kind == "bnode":
            label = self.take()
            return label if self.turtle else Variable("." + label[2:])
        if sign := self.accept("+", "-"):
            return self.number(sign)
        if word := self.accept("TRUE", "FALSE"):
            return str(Term("literal", word.lower(), T.BOOLEAN))
        if self.accept("["):
            node = self.blank()
            if not self.accept("]"):
                self.property_list(node)
                self.expect("]")
            return node
        if self.accept("("):
            head: Position | None = None
            last: Position | None = None
            while not self.accept(")"):
                item, node = self.term(), self.blank()
                self.triples.append(TriplePattern(node, T.RDF + "first", item))
                if last is None:
                    head = node
                else:
                    self.triples.append(TriplePattern(last, T.RDF + "rest", node))
                last = node
            if last is None:
                return T.RDF + "nil"
            self.triples.append(TriplePattern(last, T.RDF + "rest", T.RDF + "nil"))
            return head
        raise SyntaxProblem(f"expected a term, got {self.peek()!r}")

    # triples

    def property_list(self, s: Position) -> None:
        while True:
            verb = self.verb()
            while True:
                o = self.term()
                self.triples.append(A.PathPattern(s, verb, o) if isinstance(verb, A.Path) else TriplePattern(s, verb, o))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek() in (".", "]", "}") or self.kind == "end":
                return

    def verb(self) -> Position | A.Path:
        if self.kind == "var":
            return Variable(self.take()[1:])
        if self.turtle:
            return T.TYPE if self.kind == "word" and self.accept("A") else self.iri()
        path = self.path()
        return path.args[0] if path.op == "iri" else path

    def path(self) -> A.Path:
        parts = [self.path_sequence()]
        while self.accept("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Path("alt", tuple(parts))

    def path_sequence(self) -> A.Path:
        parts = [self.path_step()]
        while self.accept("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else A.Path("seq", tuple(parts))

    def path_step(self) -> A.Path:
        if self.accept("^"):
            return A.Path("inv", (self.path_step(),))
        if self.accept("!"):
            own = []
            many = self.accept("(")
            while True:
                inverse = bool(self.accept("^"))
                own.append((self.path_iri(), inverse))
                if not (many and self.accept("|")):
                    break
            if many:
                self.expect(")")
            return A.Path("not", tuple(own))
        if self.accept("("):
            step = self.path()
            self.expect(")")
        else:
            step = A.Path("iri", (self.path_iri(),))
        if m := self.accept("?", "*", "+"):
            step = A.Path({"?": "opt", "*": "star", "+": "plus"}[m], (step,))
        return step

    def path_iri(self) -> str:
        return T.TYPE if self.kind == "word" and self.accept("A") else self.iri()

    def triples_block(self) -> None:
        while self.is_term():
            own = self.kind == "op"  # [...] or (...) may stand alone
            s = self.term()
            if not (own and (self.peek() in (".", "}") or self.kind == "end")):
                self.property_list(s)
            if not self.accept("."):
                return

    # groups

    def group(self) -> object:
        self.expect("{")
        if self.peek() == "SELECT":
            inner = self.select()
            self.expect("}")
            return inner
        out: object = None
        filters: list[object] = []
        join = lambda a, b: b if a is None else A.Join(a, b)
        while not self.accept("}"):
            if self.accept("FILTER"):
                filters.append(self.constraint())
            elif self.accept("OPTIONAL"):
                right = self.group()
                conditions = ()
                if isinstance(right, A.Filter):
                    right, conditions = right.inner, right.conditions
                out = A.LeftJoin(A.BGP(()) if out is None else out, right, conditions)
            elif self.accept("MINUS"):
                out = A.Minus(A.BGP(()) if out is None else out, self.group())
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                out = A.Extend(A.BGP(()) if out is None else out, self.take()[1:], e)
                self.expect(")")
            elif self.accept("VALUES"):
                out = join(out, self.values())
            elif self.accept("GRAPH"):
                name = self.term()
                out = join(out, A.InGraph(name, self.group()))
            elif self.peek() == "{":
                part = self.group()
                while self.accept("UNION"):
                    part = A.Union(part, self.group())
                out = join(out, part)
            elif self.is_term():
                held, self.triples = self.triples, []
                self.triples_block()
                found, self.triples = tuple(self.triples), held
                if isinstance(out, A.BGP):
                    out = A.BGP(out.patterns + found)
                elif isinstance(out, A.Join) and isinstance(out.right, A.BGP):
                    out = A.Join(out.left, A.BGP(out.right.patterns + found))
                else:
                    out = join(out, A.BGP(found))
            elif not self.accept("."):
                raise SyntaxProblem(f"unexpected {self.peek()!r}")
            self.accept(".")
        out = A.BGP(()) if out is None else out
        return A.Filter(out, tuple(filters)) if filters else out

    def values(self) -> A.Values:
        names, rows = [], []
        if many := bool(self.accept("(")):
            while not self.accept(")"):
                names.append(self.take()[1:])
        else:
            names.append(self.take()[1:])
        self.expect("{")
        item = lambda: None if self.accept("UNDEF") else self.term()
        while not self.accept("}"):
            if many:
                self.expect("(")
                row = []
                while not self.accept(")"):
                    row.append(item())
            else:
                row = [item()]
            if len(row) != len(names):
                raise SyntaxProblem("VALUES row of another length")
            rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    # expressions

    def constraint(self) -> object:
        if self.peek() in ("EXISTS", "NOT"):
            return self.unary()
        if self.peek() == "(":
            self.take()
            e = self.expression()
            self.expect(")")
            return e
        return self.primary()

    def expression(self) -> object:
        e = self.conjunction()
        while self.accept("||"):
            e = A.Call("||", (e, self.conjunction()))
        return e

    def conjunction(self) -> object:
        e = self.relation()
        while self.accept("&&"):
            e = A.Call("&&", (e, self.relation()))
        return e

    def relation(self) -> object:
        e = self.sum()
        if op := self.accept("=", "!=", "<", ">", "<=", ">="):
            return A.Call(op, (e, self.sum()))
        negated = self.peek() == "NOT" and self.peek(1) == "IN" and bool(self.accept("NOT"))
        if self.accept("IN"):
            return A.Call("NOT IN" if negated else "IN", (e, *self.arguments()))
        return e

    def sum(self) -> object:
        e = self.product()
        while op := self.accept("+", "-"):
            e = A.Call(op, (e, self.product()))
        return e

    def product(self) -> object:
        e = self.unary()
        while op := self.accept("*", "/"):
            e = A.Call(op, (e, self.unary()))
        return e

    def unary(self) -> object:
        if self.accept("!"):
            return A.Call("!", (self.unary(),))
        if self.accept("-"):
            return A.Call("NEG", (self.unary(),))
        if self.accept("+"):
            return self.unary()
        if self.peek() == "NOT" and self.peek(1) == "EXISTS":
            self.at += 2
            return A.Exists(self.group(), True)
        if self.accept("EXISTS"):
            return A.Exists(self.group(), False)
        return self.primary()

    def arguments(self) -> tuple:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            self.accept(",")
        return tuple(out)

    def primary(self) -> object:
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        if self.kind == "word" and self.peek() not in ("TRUE", "FALSE"):
            name = self.take().upper()
            if name in A.AGGREGATES:
                self.expect("(")
                distinct = bool(self.accept("DISTINCT"))
                args = () if self.accept("*") else (self.expression(),)
                separator = " "
                if self.accept(";"):
                    self.expect("SEPARATOR")
                    self.expect("=")
                    separator = T.term(self.literal()).lex
                self.expect(")")
                return A.Call(name, args, (distinct, separator))
            return A.Call(name, self.arguments())
        if self.kind in ("iri", "name"):
            iri = self.iri()
            return A.Call(iri, self.arguments()) if self.peek() == "(" else iri
        return self.term()

    # queries

    def prologue(self) -> None:
        while True:
            if self.kind == "lang" and self.tokens[self.at][1] in ("@prefix", "@base"):
                word, dot = self.take()[1:].upper(), True
            elif self.peek() in ("PREFIX", "BASE"):
                word, dot = self.take().upper(), False
            else:
                return
            if word == "PREFIX":
                name = self.take().partition(":")[0]
                self.prefixes[name] = self.resolve(self.take()[1:-1])
            else:
                self.base = self.resolve(self.take()[1:-1])
            if dot:
                self.expect(".")

    def query(self) -> A.Query:
        self.prologue()
        word = self.peek()
        if word == "SELECT":
            q = self.select()
        elif self.accept("ASK"):
            self.accept("WHERE")
            q = self.modifiers(A.Query("ask", self.group()))
        elif self.accept("CONSTRUCT"):
            template: list[TriplePattern] = []
            short = self.peek() == "WHERE"
            if not short:
                self.expect("{")
                self.triples_block()
                template, self.triples = self.triples, []
                self.expect("}")
            self.accept("WHERE")
            where = self.group()
            q = self.modifiers(A.Query("construct", where, template=list(where.patterns) if short else template))
        elif self.accept("DESCRIBE"):
            resources: list[Position] = []
            every = bool(self.accept("*"))
            while self.kind in ("var", "iri", "name"):
                resources.append(self.term())
            where: object = A.BGP(())
            if self.accept("WHERE") or self.peek() == "{":
                where = self.group()
            if every:
                resources = [Variable(v) for v in A.variables_of(where)]
            q = self.modifiers(A.Query("describe", where, resources=resources))
        else:
            raise SyntaxProblem(f"no query form {word!r}")
        if self.kind != "end":
            raise SyntaxProblem(f"unexpected {self.peek()!r}")
        return q

    def select(self) -> A.Query:
        self.expect("SELECT")
        how = self.accept("DISTINCT", "REDUCED")
        projection: list[tuple[str, object | None]] | None = []
        if self.accept("*"):
            projection = None
        else:
            while True:
                if self.kind == "var":
                    projection.append((self.take()[1:], None))
                elif self.accept("("):
                    e = self.expression()
                    self.expect("AS")
                    projection.append((self.take()[1:], e))
                    self.expect(")")
                else:
                    break
        self.accept("WHERE")
        return self.modifiers(A.Query("select", self.group(), projection, how == "DISTINCT", how == "REDUCED"))

    def modifiers(self, q: A.Query) -> A.Query:
        if self.accept("GROUP"):
            self.expect("BY")
            q.group = []
            while self.kind == "var" or self.peek() == "(" or self.kind == "word" and self.peek() not in ("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                if self.kind == "var":
                    q.group.append((self.take()[1:], None))
                elif self.accept("("):
                    e = self.expression()
                    q.group.append((self.take()[1:] if self.accept("AS") else f".g{len(q.group)}", e))
                    self.expect(")")
                else:
                    q.group.append((f".g{len(q.group)}", self.primary()))
        if self.accept("HAVING"):
            while self.peek() == "(" or self.kind == "word" and self.peek() not in ("ORDER", "LIMIT", "OFFSET", "VALUES"):
                q.having.append(self.constraint())
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                if way := self.accept("ASC", "DESC"):
                    q.order.append((self.constraint(), way == "DESC"))
                elif self.kind == "var":
                    q.order.append((self.term(), False))
                elif self.peek() == "(" or self.kind == "word" and self.peek() not in ("LIMIT", "OFFSET", "VALUES"):
                    q.order.append((self.constraint(), False))
                else:
                    break
        while word := self.accept("LIMIT", "OFFSET"):
            n = int(self.take())
            if word == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.accept("VALUES"):
            q.where = A.Join(q.where, self.values())
        return q


def parse(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> A.Query:
    return Parser(text, base, prefixes).query()


def parse_turtle(text: str, base: str = "") -> list[tuple[str, str, str]]:
    """The triples of a Turtle document, as canonical terms."""
    parser = Parser(text, base, turtle=True)
    while parser.kind != "end":
        parser.prologue()
        if parser.kind == "end":
            break
        at = parser.at
        parser.triples_block()
        if parser.at == at:
            raise SyntaxProblem(f"unexpected {parser.peek()!r}")
        if parser.tokens[parser.at - 1][1] != "." and parser.kind != "end":
            raise SyntaxProblem(f"expected . before {parser.peek()!r}")
    return [(t.s, t.p, t.o) for t in parser.triples]
