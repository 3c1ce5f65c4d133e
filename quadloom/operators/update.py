"""Updates of quads: each operation gives a new quads DataFrame, nothing is changed in place."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.operators.access import may_write
from quadloom.plans import algebra as G
from quadloom.plans.compiler import Dataset, QueryCompiler
from quadloom.plans.parser import parse_update


class UpdateError(ValueError):
    """An update that is not allowed or can't be done; operations before it in the same request are not kept either."""


def _constants(engine, rows: list) -> DataFrame:
    """Quads of constant triples; those with a literal subject or a predicate that is no IRI are dropped. NULL graph: none given."""
    out = []
    for g, t in rows:
        if isinstance(t.p, R.IRI) and not isinstance(t.s, R.Literal) and not isinstance(g, R.Literal):
            node = lambda x: R.as_row(R.BNode("u" + x.name[1:].replace(".", ""))) if isinstance(x, R.Var) else R.as_row(x)
            out.append((g.value if g is not None else None, node(t.s), t.p.value, node(t.o)))
    return engine.spark.createDataFrame(out, R.QUADS)


def with_quads(quads: DataFrame, more: DataFrame) -> DataFrame:
    """A set of quads and more; a NULL graph is the default graph."""
    more = more.select(F.coalesce("g", F.lit(R.DEFAULT_GRAPH)).alias("g"), "s", "p", "o")
    return quads.unionByName(more).dropDuplicates(["g", "s", "p", "o"])


def without_quads(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Quads but those given; a NULL graph deletes from every graph."""
    anywhere = gone.where("g is null").select("s", "p", "o").distinct()
    there = gone.where("g is not null").select("g", "s", "p", "o").distinct()
    return quads.join(anywhere, ["s", "p", "o"], "left_anti").join(there, ["g", "s", "p", "o"], "left_anti").select("g", "s", "p", "o")


def renamed_nodes(quads: DataFrame, scope: str) -> DataFrame:
    """Quads whose blank nodes have labels of their own in the target graph."""

    def own(c: Column) -> Column:
        lex = F.when(c.getField("kind") == R.BNODE, F.concat(F.lit("b"), F.md5(F.concat(F.lit(scope), F.lit("\0"), c.getField("lex"))))).otherwise(c.getField("lex"))
        return F.when(c.isNotNull(), F.struct(c.getField("kind").alias("kind"), lex.alias("lex"), c.getField("dt").alias("dt"), c.getField("lang").alias("lang")))

    return quads.select("g", own(F.col("s")).alias("s"), "p", own(F.col("o")).alias("o"))


def _templates(rel, quads: list) -> DataFrame | None:
    from quadloom.engine import _filled

    parts = []
    for g, t in quads:
        df = _filled(rel, [t], g)
        parts.append(df.withColumn("g", F.lit(None).cast("string")) if g is None else df)
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def applied(engine, quads: DataFrame, u: G.Update, allow_load: bool, held: list[DataFrame]) -> DataFrame:
    """One operation on quads. held: gathers what is kept in storage for it."""
    target = u.target or R.DEFAULT_GRAPH
    if u.kind == "insert_data":
        return with_quads(quads, _constants(engine, u.insert))
    if u.kind == "delete_data":
        return without_quads(quads, _constants(engine, u.delete))
    if u.kind == "modify":
        data = Dataset(engine.spark, {}, quads, None, engine.rules)
        query = G.Query("select", u.where, sources=u.using)
        rel = QueryCompiler(data, query).group(u.where)
        if u.delete and u.insert:
            held.append(rel.df.persist())  # the same solutions for both templates
        gone, more = _templates(rel, u.delete), _templates(rel, u.insert)
        quads = without_quads(quads, gone) if gone is not None else quads
        return with_quads(quads, more) if more is not None else quads
    if u.kind in ("clear", "drop"):
        if u.target == "*":
            return quads.where(F.lit(False))
        return quads.where(F.col("g") == R.DEFAULT_GRAPH) if u.target == "named" else quads.where(F.col("g") != target)
    if u.kind == "create":
        return quads
    if u.kind == "load":
        if not allow_load:
            raise UpdateError("LOAD is not allowed here")
        from quadloom.sources import rdf

        return with_quads(quads, rdf.read(engine.spark, u.source, graph=u.target or u.source))
    source = u.source or R.DEFAULT_GRAPH
    if source == target:
        return quads
    own = quads.where(F.col("g") == source)
    if u.kind in ("move", "copy"):
        if own.limit(1).count() == 0:
            if u.silent:
                return quads
            raise UpdateError(f"{u.kind.upper()} from the empty graph {source}")
        quads = quads.where(F.col("g") != target)
    moved = renamed_nodes(own, target) if u.kind != "move" else own
    quads = quads.where(F.col("g") != source) if u.kind == "move" else quads
    return with_quads(quads, moved.withColumn("g", F.lit(target)))


def updated(engine, text: str, allow_load: bool = False):
    """The engine after all operations of text, in order; if one fails none is kept."""
    from quadloom.engine import Engine

    if engine.controlled() and not may_write(engine.quads, engine.api_key):
        raise UpdateError("this key may not write")
    own = engine.materialised() if engine.tables else engine  # who may write sees all graphs
    quads = own.quads if own.quads is not None else engine.spark.createDataFrame([], R.QUADS)
    held: list[DataFrame] = []
    for u in parse_update(text, engine.base, engine.prefixes):
        quads = applied(own, quads, u, allow_load, held)
    out = Engine(engine.spark, {}, quads, rules=engine.rules, soft_limit=engine.soft_limit, default_graph_only=engine.default_graph_only, api_key=engine.api_key, base=engine.base, prefixes=engine.prefixes)
    for df in held:  # released with the engine; who still holds its quads computes them anew
        weakref.finalize(out, df.unpersist)
    return out


def put_graph(quads: DataFrame, graph: str, content: DataFrame) -> DataFrame:
    """Replaces a graph."""
    return with_quads(quads.where(F.col("g") != graph), content.withColumn("g", F.lit(graph)))


def post_graph(quads: DataFrame, graph: str, content: DataFrame) -> DataFrame:
    """Adds to a graph."""
    return with_quads(quads, content.withColumn("g", F.lit(graph)))


def delete_graph(quads: DataFrame, graph: str) -> DataFrame:
    return quads.where(F.col("g") != graph)
