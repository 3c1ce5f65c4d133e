"""RDF terms: as Python values in algebra and parsers, and as one struct column type in DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Namespaces and datatype IRIs of the W3C recommendations.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
RDF_FIRST, RDF_REST, RDF_NIL = RDF + "first", RDF + "rest", RDF + "nil"
XSD_INTEGER, XSD_DECIMAL, XSD_DOUBLE, XSD_FLOAT = XSD + "integer", XSD + "decimal", XSD + "double", XSD + "float"
XSD_STRING, XSD_BOOLEAN, XSD_DATETIME, XSD_DATE, XSD_INT = XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date", XSD + "int"
INTEGER_TYPES = tuple(
    XSD + n
    for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
)
DEFAULT_GRAPH, CONFIG_GRAPH = "default:", "system:config"

#: Kinds in the order in which SPARQL sorts them; unbound comes before all.
BNODE, IRI_KIND, LITERAL = 1, 2, 3

TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
TERM_DDL = "struct<kind:tinyint,lex:string,dt:string,lang:string>"
QUADS = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM)])


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class Literal:
    lex: str
    dt: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class BNode:
    label: str


def as_row(term: IRI | Literal | BNode) -> tuple:
    """The struct value of a term; language tags are kept in upper case."""
    if isinstance(term, IRI):
        return (IRI_KIND, term.value, None, None)
    if isinstance(term, BNode):
        return (BNODE, term.label, None, None)
    return (LITERAL, term.lex, term.dt, term.lang.upper() if term.lang else None)
