"""A recursive-descent parser of SPARQL 1.1 queries and updates."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quadloom.plans.algebra import BGP, Aggregate, Bind_, Call, Filter_, GraphPattern, Group, Minus_, Optional_, Query, Triple, Union_, Update
from quadloom.terms import IRI, RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, XSD_BOOLEAN, XSD_DECIMAL, XSD_DOUBLE, XSD_INTEGER, Literal, Var


class QuerySyntaxError(ValueError):
    """The text is not a query or update of the supported language."""


_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n\r]*)+)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<double>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
  | (?P<decimal>\d*\.\d+)
  | (?P<integer>\d+)
  | (?P<bnode>_:[\w](?:[\w.-]*[\w-])?)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
  | (?P<word>[A-Za-z][A-Za-z_0-9]*(?:-(?:UNIXTIME|unixtime))?)
  | (?P<sign>\^\^|&&|\|\||!=|<=|>=|!~~|~~|[{}()\[\].,;*+/<>=!|^?&-])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
# String escapes of the language.
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU" and len(c) > 1:
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise QuerySyntaxError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return _ESCAPE.sub(one, text)


AGGREGATES = ("count", "sum", "avg", "min", "max", "sample", "group_concat")


class Parser:
    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.base, self.prefixes, self.fresh = 0, base, dict(prefixes or {}), 0

    # Tokens

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("word", "sign") and value.lower() in values

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            return self.next()[1].lower()
        return None

    def need(self, *values: str) -> str:
        found = self.take(*values)
        if found is None:
            raise QuerySyntaxError(f"expected {' or '.join(values)}, found {self.tokens[self.at][1]!r}")
        return found

    def blank(self, label: str | None = None) -> Var:
        """A blank node in a pattern is a variable that can't be projected."""
        if label is None:
            self.fresh += 1
            label = f"{self.fresh}."
        return Var(f":{label}")

    # Terms

    def iri(self) -> IRI:
        kind, value = self.next()
        if kind == "iri":
            value = unescaped(value[1:-1])
            return IRI(urljoin(self.base, value) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", value) else value)
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise QuerySyntaxError(f"unknown prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise QuerySyntaxError(f"expected an IRI, found {value!r}")

    def literal(self) -> Literal:
        kind, value = self.next()
        if kind == "string":
            lex = unescaped(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.kind() == "lang":
                return Literal(lex, None, self.next()[1][1:])
            if self.take("^^"):
                return Literal(lex, self.iri().value)
            return Literal(lex)
        sign = ""
        if kind == "sign" and value in "+-":
            sign = value if value == "-" else ""
            kind, value = self.next()
        if kind in ("integer", "decimal", "double"):
            return Literal(sign + value, {"integer": XSD_INTEGER, "decimal": XSD_DECIMAL, "double": XSD_DOUBLE}[kind])
        if kind == "word" and value in ("true", "false"):
            return Literal(value, XSD_BOOLEAN)
        raise QuerySyntaxError(f"expected a literal, found {value!r}")

    def term(self, triples: list[Triple]):
        kind, value = self.tokens[self.at]
        if kind == "var":
            self.next()
            return Var(value[1:])
        if kind in ("iri", "pname"):
            return self.iri()
        if kind == "bnode":
            self.next()
            return self.blank(value[2:])
        if self.take("["):
            node = self.blank()
            if not self.take("]"):
                self.properties(node, triples)
                self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.term(triples))
            if not items:
                return IRI(RDF_NIL)
            nodes = [self.blank() for _ in items]
            for i, (n, x) in enumerate(zip(nodes, items, strict=True)):
                triples.append(Triple(n, IRI(RDF_FIRST), x))
                triples.append(Triple(n, IRI(RDF_REST), nodes[i + 1] if i + 1 < len(nodes) else IRI(RDF_NIL)))
            return nodes[0]
        return self.literal()

    def verb(self):
        if self.kind() == "word" and self.tokens[self.at][1] == "a":
            self.next()
            return IRI(RDF_TYPE)
        if self.kind() == "var":
            return Var(self.next()[1][1:])
        if self.peek("^", "!", "("):
            raise QuerySyntaxError("property paths are not supported")
        out = self.iri()
        if self.peek("/", "|", "^", "*", "+", "?"):
            raise QuerySyntaxError("property paths are not supported")
        return out

    def properties(self, subject, triples: list[Triple]) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.term(triples)
                triples.append(Triple(subject, p, o))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek(".", "}", "]") or self.kind() == "end":
                return

    def triples(self, ends: tuple[str, ...] = ("}",)) -> list[Triple]:
        """Triples up to a token that can't go on with them."""
        out: list[Triple] = []
        while not self.peek(*ends, "optional", "union", "minus", "graph", "filter", "bind", "let", "{", "service", "values"):
            n = len(out)
            bracket = self.peek("[", "(")
            s = self.term(out)
            if not (bracket and len(out) > n and self.peek(".", *ends)):
                self.properties(s, out)
            if not self.take("."):
                break
        return out

    # Patterns

    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.peek("select"):
            raise QuerySyntaxError("sub-selects are not supported")
        while not self.take("}"):
            if self.take("optional"):
                out.parts.append(Optional_(self.group()))
            elif self.take("minus"):
                out.parts.append(Minus_(self.group()))
            elif self.take("graph"):
                name = Var(self.next()[1][1:]) if self.kind() == "var" else self.iri()
                out.parts.append(GraphPattern(name, self.group()))
            elif self.take("filter"):
                out.parts.append(Filter_(self.constraint()))
            elif self.take("bind"):
                self.need("(")
                e = self.expression()
                self.need("as")
                out.parts.append(Bind_(e, Var(self.next()[1][1:])))
                self.need(")")
            elif self.take("let"):
                self.need("(")
                v = Var(self.next()[1][1:])
                if self.kind() == "pname" and self.tokens[self.at][1] == ":":
                    self.next()
                self.need("=")
                out.parts.append(Bind_(self.expression(), v))
                self.need(")")
            elif self.peek("{"):
                groups = [self.group()]
                while self.take("union"):
                    groups.append(self.group())
                out.parts.append(Union_(groups) if len(groups) > 1 else groups[0])
            elif self.peek("service", "values"):
                raise QuerySyntaxError(f"{self.next()[1]} is not supported")
            else:
                found = self.triples()
                if found:
                    out.parts.append(BGP(found))
                elif not self.peek("}"):
                    raise QuerySyntaxError(f"unexpected {self.tokens[self.at][1]!r}")
            self.take(".")
        return out

    # Expressions

    def constraint(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        left = self.conjunction()
        while self.take("||"):
            left = Call("||", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.relation()
        while self.take("&&"):
            left = Call("&&", (left, self.relation()))
        return left

    def relation(self):
        left = self.sum()
        op = self.take("=", "!=", "<", ">", "<=", ">=", "~~", "!~~")
        if op:
            return Call(op, (left, self.sum()))
        if self.take("in"):
            return Call("in", (left, *self.arguments()))
        if self.peek("not"):
            self.next()
            self.need("in")
            return Call("notin", (left, *self.arguments()))
        return left

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = Call(op, (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while op := self.take("*", "/"):
            left = Call(op, (left, self.unary()))
        return left

    def unary(self):
        if self.take("!"):
            return Call("!", (self.unary(),))
        if self.take("+"):
            return Call("u+", (self.unary(),))
        if self.take("-"):
            return Call("u-", (self.unary(),))
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(","):
                self.need(")")
                break
        return out

    def primary(self):
        kind, value = self.tokens[self.at]
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if kind == "var":
            self.next()
            return Var(value[1:])
        if kind in ("iri", "pname"):
            name = self.iri()
            return Call(name.value, tuple(self.arguments())) if self.peek("(") else name
        if kind == "word" and value not in ("true", "false"):
            name = self.next()[1].lower()
            if name in AGGREGATES:
                return self.aggregate(name)
            if name in ("exists", "not"):
                raise QuerySyntaxError("EXISTS is not supported")
            return Call(name, tuple(self.arguments()))
        return self.literal()

    def aggregate(self, name: str) -> Aggregate:
        self.need("(")
        distinct = bool(self.take("distinct"))
        if self.take("*"):
            e = None
        else:
            e = self.expression()
        separator = " "
        more = []
        while self.take(","):
            more.append(self.expression())
        if more:
            e = Call("concat", (Call("str", (e,)), *(Call("str", (m,)) for m in more)))
        if self.take(";"):
            self.need("separator")
            self.need("=")
            separator = self.literal().lex
        self.need(")")
        return Aggregate(name, e, distinct, separator)

    # Queries

    def prologue(self) -> None:
        while word := self.take("prefix", "base"):
            if word == "base":
                self.base = self.iri().value
            else:
                kind, value = self.next()
                if kind != "pname" or not value.endswith(":"):
                    raise QuerySyntaxError(f"expected a prefix, found {value!r}")
                self.prefixes[value[:-1]] = self.iri().value

    def query(self) -> Query:
        self.prologue()
        form = self.need("select", "ask", "construct", "describe")
        q = Query(form, Group())
        if form == "select":
            q.distinct = bool(self.take("distinct"))
            q.reduced = bool(self.take("reduced"))
            if not self.take("*"):
                q.select = []
                while self.kind() == "var" or self.peek("("):
                    if self.kind() == "var":
                        v = Var(self.next()[1][1:])
                        q.select.append((v, None))
                    else:
                        self.need("(")
                        e = self.expression()
                        if self.take("as"):
                            v = Var(self.next()[1][1:])
                        else:
                            v = Var(f"_{len(q.select)}")
                        q.select.append((v, e))
                        self.need(")")
                    self.take(",")
                if not q.select:
                    raise QuerySyntaxError("nothing is selected")
        elif form == "construct" and self.peek("{"):
            self.need("{")
            q.template = self.triples()
            self.need("}")
        elif form == "describe" and not self.take("*"):
            while self.kind() in ("var", "iri", "pname"):
                q.describe.append(self.term([]))
        while self.take("from"):
            (q.named if self.take("named") else q.sources).append(self.iri().value)
        self.take("where")
        if self.peek("{"):
            q.where = self.group()
        elif form != "describe":
            self.need("{")
        if form == "construct" and not q.template:
            q.template = [t for part in q.where.parts if isinstance(part, BGP) for t in part.triples]
        self.modifiers(q)
        if self.kind() != "end":
            raise QuerySyntaxError(f"unexpected {self.tokens[self.at][1]!r}")
        return q

    def modifiers(self, q: Query) -> None:
        if self.take("group"):
            self.need("by")
            while self.kind() in ("var", "iri", "pname") or self.peek("(") or (self.kind() == "word" and not self.peek("having", "order", "limit", "offset")):
                if self.take("("):
                    e, v = self.expression(), None
                    if self.take("as"):
                        v = Var(self.next()[1][1:])
                    self.need(")")
                    q.group_by.append((e, v))
                else:
                    q.group_by.append((self.primary(), None))
        if self.take("having"):
            while self.peek("(") or self.kind() in ("iri", "pname") or (self.kind() == "word" and not self.peek("order", "limit", "offset")):
                q.having.append(self.constraint())
        if self.take("order"):
            self.need("by")
            while True:
                if way := self.take("asc", "desc"):
                    q.order_by.append((self.constraint(), way == "asc"))
                elif self.kind() in ("var", "iri", "pname") or self.peek("(") or (self.kind() == "word" and not self.peek("limit", "offset")):
                    q.order_by.append((self.constraint(), True))
                else:
                    break
        while word := self.take("limit", "offset"):
            n = int(self.next()[1])
            if word == "limit":
                q.limit = n
            else:
                q.offset = n

    # Updates

    def quads(self, graph=None) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            if self.take("graph"):
                name = Var(self.next()[1][1:]) if self.kind() == "var" else self.iri()
                out += self.quads(name)
            else:
                found = self.triples()
                if not found and not self.peek("}", "graph"):
                    raise QuerySyntaxError(f"unexpected {self.tokens[self.at][1]!r}")
                out += [(graph, t) for t in found]
            self.take(".")
        return out

    def graph_ref(self) -> str | None:
        """A graph's IRI; None for the default graph, `*` and `named` for all and all named ones."""
        if self.take("default"):
            return None
        if word := self.take("all", "named"):
            return "*" if word == "all" else word
        self.take("graph")
        return self.iri().value

    def update(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.kind() == "end":
                return out
            out.append(self.operation())
            if not self.take(";"):
                if self.kind() != "end":
                    raise QuerySyntaxError(f"unexpected {self.tokens[self.at][1]!r}")
                return out

    def operation(self) -> Update:
        graph = None
        if self.take("with"):
            graph = self.iri()
        if graph is None and (word := self.take("load", "clear", "drop", "create", "add", "move", "copy")):
            silent = bool(self.take("silent"))
            u = Update(word, silent=silent)
            if word == "load":
                u.source = self.iri().value
                if self.take("into"):
                    u.target = self.graph_ref()
            elif word in ("add", "move", "copy"):
                u.source = self.graph_ref()
                self.need("to")
                u.target = self.graph_ref()
            else:
                u.target = self.graph_ref() if not self.peek(";") and self.kind() != "end" else None
            return u
        u = Update("modify")
        if self.take("delete"):
            if self.take("data"):
                return Update("delete_data", delete=self.quads(graph))
            if self.take("where"):
                u.delete = self.quads(graph)
                u.where = Group([GraphPattern(g, Group([BGP([t])])) if g is not None else BGP([t]) for g, t in u.delete])
                return u
            u.delete = self.quads(graph)
        if self.take("insert"):
            if self.take("data"):
                return Update("insert_data", insert=self.quads(graph))
            u.insert = self.quads(graph)
        while self.take("using"):
            self.take("named")
            u.using.append(self.iri().value)
        self.need("where")
        u.where = self.group()
        if graph is not None and not u.using:
            u.using = [graph.value]
        return u


def parse_query(text: str, base: str = "", prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, base, prefixes).query()


def parse_update(text: str, base: str = "", prefixes: dict[str, str] | None = None) -> list[Update]:
    return Parser(text, base, prefixes).update()
