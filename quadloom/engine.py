"""The public interface: query(), update() and results over a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.functions.values import Val
from quadloom.operators.relation import Rel
from quadloom.plans import algebra as G
from quadloom.plans.compiler import RULES, Dataset, QueryCompiler
from quadloom.plans.parser import parse_query


class Result:
    """Solutions of a SELECT query, or the one of ASK. df has a natively typed column for each variable."""

    def __init__(self, rel: Rel, variables: list[str], form: str = "select", warnings: list[str] | None = None):
        self.rel, self.variables, self.form, self.warnings = rel, variables, form, warnings or []

    @property
    def df(self) -> DataFrame:
        vals = self.rel.vars
        return self.rel.df.select(*((V.iri_text(vals[v]) if vals[v].kind in ("iri", "bnode") else vals[v].col).alias(v) for v in self.variables))

    def terms(self) -> DataFrame:
        """Each variable as a term struct."""
        return self.rel.df.select(*(V.to_term(self.rel.vars[v]).alias(v) for v in self.variables))

    def lexical(self) -> DataFrame:
        """Each variable as its lexical form."""
        return self.rel.df.select(*(V.lexical(self.rel.vars[v]).alias(v) for v in self.variables))

    def serialise(self, form: str = "json", callback: str | None = None):
        """The lines of a serialisation: sparql (xml), json, csv, tsv, text, ascii or testcase."""
        from quadloom.sources.results import serialise

        return serialise(self, form, callback)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


def _filled(rel: Rel, template: list[G.Triple], graph=None) -> DataFrame | None:
    """The triples that a template makes of solutions: (g, s, p, o), invalid ones left out."""
    row = F.monotonically_increasing_id().cast("string")
    base = rel.df.withColumn("_row", row) if any(isinstance(x, R.Var) and x.name.startswith(":") and x.name not in rel.vars for t in template for x in (t.s, t.o)) else rel.df

    def term(slot):
        if isinstance(slot, R.Var):
            if slot.name.startswith(":") and slot.name not in rel.vars:  # a new blank node for each solution
                return V.term_struct(R.BNODE, F.concat(F.lit("c" + slot.name[1:].replace(".", "") + "x"), F.col("_row")))
            v = rel.vars.get(slot.name)
            return V.to_term(v) if v is not None else F.lit(None).cast(R.TERM)
        return V.to_term(V.of_term(slot)) if isinstance(slot, R.IRI) else V.term_struct(*(F.lit(x).cast(t) for x, t in zip(R.as_row(slot), ("tinyint", "string", "string", "string"), strict=True)))

    parts = []
    for t in template:
        s, p, o = term(t.s), term(t.p), term(t.o)
        g = F.lit(R.DEFAULT_GRAPH) if graph is None else F.lit(graph.value) if isinstance(graph, R.IRI) else V.iri_text(rel.vars[graph.name]) if graph.name in rel.vars and rel.vars[graph.name].kind == "iri" else term(graph).getField("lex")
        df = base.select(g.alias("g"), s.alias("s"), p.alias("p"), o.alias("o"))
        df = df.where((F.col("s.kind") != R.LITERAL) & (F.col("p.kind") == R.IRI_KIND) & F.col("o").isNotNull() & F.col("g").isNotNull())
        parts.append(df.select("g", "s", F.col("p.lex").alias("p"), "o"))
    return reduce(DataFrame.unionAll, parts) if parts else None


def empty_quads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], R.QUADS)


class Engine:
    """Queries over mapped tables and quads.

    rules: the algebra rules that are on. soft_limit: rows a scan gives at most (off by default: answers are exact).
    restricted: with a soft limit, the inputs of joins between groups are cut there too, with a warning.
    default_graph_only: patterns outside GRAPH see the default graph alone instead of the union of all graphs.
    api_key: the reader's key where graphs are protected. access: whether they are; None: if quads hold any rule.
    """

    def __init__(self, spark: SparkSession, tables: dict | None = None, quads: DataFrame | None = None, *, rules=RULES, soft_limit: int = -1, restricted: bool = False, default_graph_only: bool = False, api_key: str | None = None, access: bool | None = None, base: str = "", prefixes: dict[str, str] | None = None):
        self.spark, self.tables, self.quads, self.rules, self.soft_limit, self.default_graph_only, self.api_key, self.base = spark, tables or {}, quads, frozenset(rules), soft_limit, default_graph_only, api_key, base
        self.restricted, self.access = restricted, access
        self._shared: frozenset[str] | None = None
        self.prefixes = {"xsd": R.XSD, "rdf": R.RDF, **(prefixes or {})}

    def controlled(self) -> bool:
        """Whether any access rule exists; looked up once, as patterns need no extra join where there is none."""
        if self.access is None:
            from quadloom.operators.access import rules_of

            self.access = self.quads is not None and rules_of(self.quads).limit(1).count() > 0
        return self.access

    def shared(self) -> frozenset[str]:
        """Predicates of mapped tables (rdf:type for their classes) that quads hold too; looked up once, one row for each."""
        if self._shared is None:
            if not self.tables or self.quads is None:
                self._shared = frozenset()
            else:
                mapped = [p for t in self.tables.values() for p in t.predicates]
                classes = [t.class_iri for t in self.tables.values()]
                both = F.col("p").isin(mapped) | ((F.col("p") == R.RDF_TYPE) & F.col("o.lex").isin(classes))
                self._shared = frozenset(r.p for r in self.quads.where(both).select("p").distinct().collect())
        return self._shared

    def dataset(self) -> Dataset:
        hidden = None
        if self.controlled():
            from quadloom.operators.access import hidden_graphs

            hidden = hidden_graphs(self.quads, self.api_key)
        return Dataset(self.spark, self.tables, self.quads, hidden, self.rules, self.soft_limit, self.default_graph_only, self.restricted, self.shared())

    def parsed(self, text: str) -> G.Query:
        return parse_query(text, self.base, self.prefixes)

    def query(self, text: str) -> Result | DataFrame:
        """A Result for SELECT and ASK, a DataFrame(g, s, p, o) for CONSTRUCT and DESCRIBE."""
        q = self.parsed(text)
        compiler = QueryCompiler(self.dataset(), q)
        if q.form == "select":
            rel = compiler.select()
            return Result(rel, list(rel.vars) if q.select is None else [v.name for v, _ in q.select], "select", compiler.warnings)
        if q.form == "ask":
            rel = compiler.group(q.where, None, set())
            answer = rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
            return Result(Rel(answer, {"answer": Val(F.col("answer"), "boolean")}), ["answer"], "ask", compiler.warnings)
        if q.form == "construct":
            return self.construct(q, compiler)
        return self.describe(q, compiler)

    def select(self, text: str) -> DataFrame:
        """The natively typed columns of a SELECT or ASK query."""
        return self.query(text).df

    def construct(self, q: G.Query, compiler: QueryCompiler) -> DataFrame:
        needed = G.pattern_vars(G.BGP(q.template))
        rel = compiler.group(q.where, None, needed).select(sorted(needed)).distinct() if needed else compiler.group(q.where, None, needed)
        if q.order_by or q.limit is not None or q.offset:
            scope_query = G.Query("select", q.where, [(R.Var(v), None) for v in sorted(needed)], True, order_by=q.order_by, limit=q.limit, offset=q.offset, sources=q.sources, named=q.named)
            rel = QueryCompiler(compiler.data, scope_query).select()
        made = _filled(rel, q.template)
        return made.distinct() if made is not None else empty_quads(self.spark)

    def insert_constructed(self, text: str, graph: str | None = None) -> Engine:
        """The engine with what a CONSTRUCT query makes added to a graph (the base IRI, if none is named)."""
        from quadloom.operators.update import post_graph

        own = self.materialised() if self.tables else self
        quads = own.quads if own.quads is not None else empty_quads(self.spark)
        return Engine(self.spark, {}, post_graph(quads, graph or self.base or R.DEFAULT_GRAPH, self.query(text)), rules=self.rules, api_key=self.api_key, base=self.base, prefixes=self.prefixes)

    def explain(self, text: str) -> str:
        """The algebra of a query and Spark's physical plan."""
        q = self.parsed(text)
        found = self.query(text)
        df = found if isinstance(found, DataFrame) else found.df
        return f"{q}\n\n{df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"

    def describe(self, q: G.Query, compiler: QueryCompiler) -> DataFrame:
        """All triples about each described resource, one level deep."""
        slots = q.describe or [R.Var(v) for v in sorted(G.pattern_vars(q.where)) if not v.startswith(":")]
        parts: list[DataFrame] = []
        fixed = [x for x in slots if isinstance(x, R.IRI)]
        names = [x.name for x in slots if isinstance(x, R.Var)]
        rel = compiler.group(q.where, None, set(names)) if names else None
        for table in compiler.data.tables.values():
            wanted = [table.rows().where(V.key_equals(table.subject(), x.value)) for x in fixed if table.key and V.template_key(x.value, table.template)]
            for v in names:
                own = rel.vars.get(v)
                if own is not None and own.kind == "iri" and own.template == table.template:
                    keys = rel.df.select(own.col.alias("_key")).where("_key is not null").distinct()
                    rows = table.rows()
                    wanted.append(rows.join(keys, table.subject().col == F.col("_key"), "left_semi"))
            for rows in wanted:
                df = rows.select(V.iri_text(table.graph_value()).alias("g"), V.to_term(table.subject()).alias("s"), F.explode(table.pairs()).alias("po"))
                parts.append(df.select("g", "s", "po.p", "po.o"))
        quads = compiler.data.visible_quads()
        if quads is not None:
            for x in fixed:
                parts.append(quads.where((F.col("s.kind") == R.IRI_KIND) & (F.col("s.lex") == x.value)))
            for v in names:
                own = rel.vars.get(v)
                if own is not None and own.kind in ("term", "iri", "bnode"):
                    keys = rel.df.select(V.to_term(own).alias("s")).where("s is not null").distinct()
                    parts.append(quads.join(keys, "s", "left_semi"))
        if not parts:
            return empty_quads(self.spark)
        out = reduce(lambda a, b: a.unionByName(b), parts)
        if q.sources:
            out = out.where(F.col("g").isin(q.sources))
        return out.select("g", "s", "p", "o").distinct()

    def match(self, g=None, s=None, p=None, o=None) -> DataFrame:
        """Raw quads by constant slots."""
        df = self.dataset().all_quads()
        for name, x in (("s", s), ("o", o)):
            if x is not None:
                kind, lex, dt, lang = R.as_row(x)
                df = df.where((F.col(f"{name}.kind") == kind) & (F.col(f"{name}.lex") == lex) & F.col(f"{name}.dt").eqNullSafe(F.lit(dt)) & F.col(f"{name}.lang").eqNullSafe(F.lit(lang)))
        for name, x in (("g", g), ("p", p)):
            if x is not None:
                df = df.where(F.col(name) == (x.value if isinstance(x, R.IRI) else x))
        return df

    def size(self) -> DataFrame:
        """Quads by graph."""
        return self.match().groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def materialised(self) -> Engine:
        """An engine over the same triples as generic quads, as far as the reader may see them."""
        access = False if self.quads is None else self.access
        return Engine(self.spark, {}, self.dataset().all_quads(), access=access, rules=self.rules, soft_limit=self.soft_limit, default_graph_only=self.default_graph_only, api_key=self.api_key, base=self.base, prefixes=self.prefixes)

    def update(self, text: str, **options) -> Engine:
        """The engine after an update, which works on quads; see quadloom.operators.update."""
        from quadloom.operators.update import updated

        return updated(self, text, **options)
