"""Readers and writers of quads as DataFrames.

N-Triples and N-Quads are read line by line with built-in functions; syntaxes that need the whole document are
parsed by one task for each file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.sources import syntax

_IRI, _NODE = r"<([^>]*)>", r"_:([^\s<\"]+?)"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?'
_LINE = rf"^\s*(?:{_IRI}|{_NODE})\s*{_IRI}\s*(?:{_IRI}|{_NODE}|{_LITERAL})\s*(?:{_IRI}|{_NODE})?\s*\.\s*(?:#.*)?$"


def unescaped(text: Column) -> Column:
    """A lexical form without its escapes."""
    wide = F.aggregate(
        F.regexp_extract_all(text, F.lit(r"\\U([0-9A-Fa-f]{8})"), F.lit(1)), text, lambda acc, x: F.replace(acc, F.concat(F.lit("\\U"), x), F.decode(F.unhex(x), "UTF-32"))
    )
    plain = F.replace(wide, F.lit("\\'"), F.lit("'"))
    read = F.from_json(F.concat(F.lit('{"a":"'), plain, F.lit('"}')), "a string", {"allowUnquotedControlChars": "true"}).getField("a")
    return F.when(text.contains("\\"), read).otherwise(text)


def parsed_lines(lines: DataFrame, graph: str = R.DEFAULT_GRAPH, scope: Column | None = None) -> DataFrame:
    """N-Triples or N-Quads of a column `value`; comments and empty lines are left out, broken lines too."""
    scope = F.lit("") if scope is None else scope
    part = lambda i: F.regexp_extract("value", _LINE, i)
    names = ("s_iri", "s_node", "p", "o_iri", "o_node", "lex", "dt", "lang", "g_iri", "g_node")
    df = lines.where(F.col("value").rlike(_LINE)).select(scope.alias("scope"), *(part(i + 1).alias(n) for i, n in enumerate(names)))

    def node(name: str) -> Column:
        return F.concat(F.lit("b"), F.md5(F.concat("scope", F.lit("\0"), name)))

    s = F.when(F.col("s_node") != "", V.term_struct(R.BNODE, node("s_node"))).otherwise(V.term_struct(R.IRI_KIND, unescaped(F.col("s_iri"))))
    literal = V.term_struct(R.LITERAL, unescaped(F.col("lex")), F.nullif(F.col("dt"), F.lit("")), F.upper(F.nullif(F.col("lang"), F.lit(""))))
    o = F.when(F.col("o_iri") != "", V.term_struct(R.IRI_KIND, unescaped(F.col("o_iri")))).when(F.col("o_node") != "", V.term_struct(R.BNODE, node("o_node"))).otherwise(literal)
    g = F.when(F.col("g_iri") != "", unescaped(F.col("g_iri"))).otherwise(F.lit(graph))
    return df.select(g.alias("g"), s.alias("s"), unescaped(F.col("p")).alias("p"), o.alias("o")).to(R.QUADS)


def _frame(rows) -> pd.DataFrame:
    keys = ("kind", "lex", "dt", "lang")
    return pd.DataFrame([(g, dict(zip(keys, s, strict=True)), p, dict(zip(keys, o, strict=True))) for g, s, p, o in rows], columns=["g", "s", "p", "o"])


def read(spark: SparkSession, path: str, form: str = "auto", graph: str = R.DEFAULT_GRAPH, per_file_graph: bool = False) -> DataFrame:
    """Quads of a file or folder. form: auto (by ending), ntriples, nquads, turtle, trig, rdfxml, trix or a media type."""
    form = syntax.BY_MEDIA_TYPE.get(form, form)
    form = syntax.format_of(path) if form == "auto" else form
    if form in ("ntriples", "nquads"):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
        out = parsed_lines(lines, graph, F.col("file"))
        return out
    parse = syntax.PARSERS[form]

    def run(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                text = content if form in ("rdfxml", "trix") else content.decode("utf-8")
                yield _frame(parse(text, name, name if per_file_graph else graph))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, R.QUADS)


def from_text(spark: SparkSession, text: str, form: str = "turtle", graph: str = R.DEFAULT_GRAPH, scope: str = "") -> DataFrame:
    """Quads of a document at hand (an upload); form may be a media type."""
    form = syntax.BY_MEDIA_TYPE.get(form, form)
    if form in ("ntriples", "nquads"):
        return parsed_lines(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"), graph, F.lit(scope))
    rows = list(syntax.PARSERS[form](text.encode() if form in ("rdfxml", "trix") else text, scope, graph))
    return spark.createDataFrame(rows, R.QUADS)


# Writers

_ILLEGAL = r'[\x00-\x20<>"{}|^`\\]'


def _escaped_iri(c: Column) -> Column:
    out = c
    for x in '\\<>"{}|^` \n\r\t':
        out = F.replace(out, F.lit(x), F.lit(f"\\u{ord(x):04X}")) if x != "\\" else F.replace(out, F.lit("\\"), F.lit("\\u005C"))
    return F.when(c.rlike(_ILLEGAL), out).otherwise(c)


def _escaped_text(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ntriples_term(t: Column) -> Column:
    """A term struct in N-Triples."""
    iri = F.concat(F.lit("<"), _escaped_iri(t.getField("lex")), F.lit(">"))
    text = F.concat(F.lit('"'), _escaped_text(t.getField("lex")), F.lit('"'))
    tail = F.when(t.getField("lang").isNotNull(), F.concat(F.lit("@"), F.lower(t.getField("lang")))).when(t.getField("dt").isNotNull(), F.concat(F.lit("^^<"), _escaped_iri(t.getField("dt")), F.lit(">"))).otherwise("")
    return F.when(t.getField("kind") == R.IRI_KIND, iri).when(t.getField("kind") == R.BNODE, F.concat(F.lit("_:"), t.getField("lex"))).otherwise(F.concat(text, tail))


def lines(quads: DataFrame, form: str = "ntriples") -> DataFrame:
    """DataFrame(value) of N-Triples, N-Quads or Turtle lines (each N-Triples line is Turtle)."""
    p = F.concat(F.lit("<"), _escaped_iri(F.col("p")), F.lit(">"))
    parts = [ntriples_term(F.col("s")), p, ntriples_term(F.col("o"))]
    if form == "nquads":
        parts.append(F.when(F.col("g") == R.DEFAULT_GRAPH, F.lit(None)).otherwise(F.concat(F.lit("<"), _escaped_iri(F.col("g")), F.lit(">"))))
    return quads.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rdfxml_lines(quads: DataFrame) -> DataFrame:
    """One rdf:Description for each triple; a predicate is split before its last run of name characters."""
    ns = F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w.-]*)$", 1)
    name = F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w.-]*)$", 2)
    s = F.when(F.col("s.kind") == R.BNODE, F.concat(F.lit('rdf:nodeID="'), F.col("s.lex"))).otherwise(F.concat(F.lit('rdf:about="'), _xml(F.col("s.lex"))))
    o = F.col("o")
    resource = F.when(o.getField("kind") == R.BNODE, F.concat(F.lit(' rdf:nodeID="'), o.getField("lex"), F.lit('"/>'))).otherwise(F.concat(F.lit(' rdf:resource="'), _xml(o.getField("lex")), F.lit('"/>')))
    kind = F.when(o.getField("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.lower(o.getField("lang")), F.lit('"'))).when(o.getField("dt").isNotNull(), F.concat(F.lit(' rdf:datatype="'), _xml(o.getField("dt")), F.lit('"'))).otherwise("")
    text = F.concat(kind, F.lit(">"), _xml(o.getField("lex")), F.lit("</ns0:"), name, F.lit(">"))
    body = F.concat(F.lit("<ns0:"), name, F.lit(' xmlns:ns0="'), _xml(ns), F.lit('"'), F.when(o.getField("kind") == R.LITERAL, text).otherwise(resource))
    return quads.select(F.concat(F.lit("<rdf:Description "), s, F.lit('">'), body, F.lit("</rdf:Description>")).alias("value"))


def rdfxml_document(quads: DataFrame):
    """The lines of a whole RDF/XML document."""
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{R.RDF}">'
    for r in rdfxml_lines(quads).toLocalIterator():
        yield r.value
    yield "</rdf:RDF>"


def trix_lines(quads: DataFrame) -> DataFrame:
    """DataFrame(g, value): a TriX triple element for each quad."""

    def term(t: Column) -> Column:
        lex = _xml(t.getField("lex"))
        return (
            F.when(t.getField("kind") == R.IRI_KIND, F.concat(F.lit("<uri>"), lex, F.lit("</uri>")))
            .when(t.getField("kind") == R.BNODE, F.concat(F.lit("<id>"), lex, F.lit("</id>")))
            .when(t.getField("dt").isNotNull(), F.concat(F.lit('<typedLiteral datatype="'), _xml(t.getField("dt")), F.lit('">'), lex, F.lit("</typedLiteral>")))
            .when(t.getField("lang").isNotNull(), F.concat(F.lit('<plainLiteral xml:lang="'), F.lower(t.getField("lang")), F.lit('">'), lex, F.lit("</plainLiteral>")))
            .otherwise(F.concat(F.lit("<plainLiteral>"), lex, F.lit("</plainLiteral>")))
        )

    return quads.select("g", F.concat(F.lit("<triple>"), term(F.col("s")), F.lit("<uri>"), _xml(F.col("p")), F.lit("</uri>"), term(F.col("o")), F.lit("</triple>")).alias("value"))


def trix_document(quads: DataFrame):
    """The lines of a TriX dump of all graphs."""
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">'
    now = None
    for r in trix_lines(quads).orderBy("g").toLocalIterator():
        if r.g != now:
            if now is not None:
                yield "</graph>"
            now = r.g
            name = now.replace("&", "&amp;").replace("<", "&lt;")
            yield f"<graph><uri>{name}</uri>"
        yield r.value
    if now is not None:
        yield "</graph>"
    yield "</TriX>"


def write(quads: DataFrame, path: str, form: str = "nquads", mode: str = "errorifexists") -> None:
    """Writes a folder of N-Triples, N-Quads or Turtle lines, from all tasks."""
    lines(quads, form).write.mode(mode).text(path)
