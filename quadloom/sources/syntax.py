"""Parsers of whole RDF documents: Turtle, TriG, RDF/XML and TriX, each giving (graph, subject, predicate, object) rows."""

from __future__ import annotations

import hashlib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from quadloom import terms as R
from quadloom.plans.algebra import Triple
from quadloom.plans.parser import Parser, QuerySyntaxError

Row = tuple
XML = "{http://www.w3.org/XML/1998/namespace}"
_RDF = "{" + R.RDF + "}"


def label(scope: str, name: str) -> str:
    """A blank node's label is scoped by its document."""
    return "b" + hashlib.md5(f"{scope}\0{name}".encode()).hexdigest()


class _Turtle(Parser):
    def statements(self) -> Iterator[tuple[R.IRI | None, Triple]]:
        while self.kind() != "end":
            kind, value = self.tokens[self.at]
            if kind == "lang" and value in ("@prefix", "@base"):
                self.next()
                self._directive(value[1:])
                self.need(".")
            elif self.peek("prefix", "base"):
                self._directive(self.next()[1].lower())
            else:
                graph = None
                if self.take("graph"):
                    graph = self.iri()
                elif kind in ("iri", "pname") and self.tokens[self.at + 1] == ("sign", "{"):
                    graph = self.iri()
                if self.take("{"):
                    for t in self.triples():
                        yield graph, t
                    self.need("}")
                    self.take(".")
                else:
                    found: list[Triple] = []
                    bracket = self.peek("[", "(")
                    s = self.term(found)
                    if not (bracket and found and self.peek(".")):
                        self.properties(s, found)
                    self.need(".")
                    for t in found:
                        yield None, t

    def _directive(self, word: str) -> None:
        if word == "base":
            self.base = self.iri().value
        else:
            name = self.next()[1]
            self.prefixes[name[:-1]] = self.iri().value


def turtle(text: str, scope: str, graph: str) -> Iterator[Row]:
    """Turtle and TriG."""

    def row(x):
        return R.as_row(R.BNode(label(scope, x.name))) if isinstance(x, R.Var) else R.as_row(x)

    for g, t in _Turtle(text, scope).statements():
        if not isinstance(t.p, R.IRI) or isinstance(t.s, R.Literal):
            raise QuerySyntaxError("a triple with an invalid subject or predicate")
        yield g.value if g is not None else graph, row(t.s), t.p.value, row(t.o)


def rdfxml(text: str | bytes, scope: str, graph: str) -> Iterator[Row]:
    out: list[Row] = []
    count = iter(range(1 << 60))

    def bnode(name: str | None = None) -> Row:
        return (R.BNODE, label(scope, name if name is not None else f".{next(count)}"), None, None)

    def iri(value: str, base: str) -> Row:
        return (R.IRI_KIND, urljoin(base, value) if base else value, None, None)

    def tag_iri(tag: str) -> str:
        ns, _, local = tag[1:].partition("}")
        return ns + local

    def add(s: Row, p: str, o: Row) -> None:
        out.append((graph, s, p, o))

    def node(e: ET.Element, base: str, lang: str | None) -> Row:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        if (about := e.get(_RDF + "about")) is not None:
            s = iri(about, base)
        elif (name := e.get(_RDF + "ID")) is not None:
            s = iri("#" + name, base)
        else:
            s = bnode(e.get(_RDF + "nodeID"))
        if e.tag != _RDF + "Description":
            add(s, R.RDF_TYPE, (R.IRI_KIND, tag_iri(e.tag), None, None))
        attributes(e, s, lang)
        item = 0
        for p in e:
            name = tag_iri(p.tag)
            if p.tag == _RDF + "li":
                item += 1
                name = f"{R.RDF}_{item}"
            add_property(s, name, p, p.get(XML + "base", base), p.get(XML + "lang", lang))
        return s

    def attributes(e: ET.Element, s: Row, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((_RDF, XML)):
                add(s, tag_iri(k), (R.LITERAL, v, None, lang.upper() if lang else None))
            elif k == _RDF + "type":
                add(s, R.RDF_TYPE, (R.IRI_KIND, v, None, None))

    def add_property(s: Row, name: str, p: ET.Element, base: str, lang: str | None) -> None:
        kind = p.get(_RDF + "parseType")
        if kind == "Literal":
            text = (p.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in p)
            add(s, name, (R.LITERAL, text, R.RDF + "XMLLiteral", None))
        elif kind == "Resource":
            o = bnode()
            add(s, name, o)
            for c in p:
                add_property(o, tag_iri(c.tag), c, base, lang)
        elif kind == "Collection":
            items = [node(c, base, lang) for c in p]
            nodes = [bnode() for _ in items]
            nil = (R.IRI_KIND, R.RDF_NIL, None, None)
            add(s, name, nodes[0] if nodes else nil)
            for i, (n, x) in enumerate(zip(nodes, items, strict=True)):
                add(n, R.RDF_FIRST, x)
                add(n, R.RDF_REST, nodes[i + 1] if i + 1 < len(nodes) else nil)
        elif len(p):
            add(s, name, node(p[0], base, lang))
        elif (ref := p.get(_RDF + "resource")) is not None:
            o = iri(ref, base)
            add(s, name, o)
            attributes(p, o, lang)
        elif (ref := p.get(_RDF + "nodeID")) is not None:
            add(s, name, bnode(ref))
        elif any(k.startswith("{") and not k.startswith((_RDF, XML)) for k in p.attrib):
            o = bnode()
            add(s, name, o)
            attributes(p, o, lang)
        else:
            dt = p.get(_RDF + "datatype")
            add(s, name, (R.LITERAL, p.text or "", dt, lang.upper() if lang and not dt else None))

    root = ET.fromstring(text)
    base = root.get(XML + "base", scope)
    for e in root if root.tag == _RDF + "RDF" else [root]:
        node(e, base, root.get(XML + "lang"))
    return iter(out)


def trix(text: str | bytes, scope: str, graph: str) -> Iterator[Row]:
    def local(e: ET.Element) -> str:
        return e.tag.rpartition("}")[2]

    def term(e: ET.Element) -> Row:
        kind, value = local(e), e.text or ""
        if kind == "uri":
            return (R.IRI_KIND, value.strip(), None, None)
        if kind == "id":
            return (R.BNODE, label(scope, value.strip()), None, None)
        if kind == "plainLiteral":
            lang = e.get(XML + "lang")
            return (R.LITERAL, value, None, lang.upper() if lang else None)
        if kind == "typedLiteral":
            return (R.LITERAL, value, e.get("datatype"), None)
        raise ValueError(f"unknown TriX term {kind}")

    for g in ET.fromstring(text):
        parts = list(g)
        name = graph
        if parts and local(parts[0]) == "uri":
            name = (parts[0].text or "").strip()
            parts = parts[1:]
        for t in parts:
            s, p, o = map(term, t)
            yield name, s, p[1], o


PARSERS = {"turtle": turtle, "trig": turtle, "rdfxml": rdfxml, "trix": trix}
# File endings and media types of the syntaxes.
BY_ENDING = {"ttl": "turtle", "n3": "turtle", "trig": "trig", "nt": "ntriples", "nq": "nquads", "trix": "trix"}
BY_MEDIA_TYPE = {"text/turtle": "turtle", "application/x-turtle": "turtle", "text/n3": "turtle", "application/trig": "trig", "application/n-triples": "ntriples", "text/plain": "ntriples", "application/n-quads": "nquads", "application/rdf+xml": "rdfxml", "application/trix": "trix"}


def format_of(path: str) -> str:
    """By the file's ending; RDF/XML for any other."""
    return BY_ENDING.get(path.rsplit(".", 1)[-1].lower(), "rdfxml")
