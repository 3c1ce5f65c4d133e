"""Compiles algebra to DataFrames.

Rules on the algebra, each of which can be switched off to compare plans:
  R1 a star of triples about one subject over one mapped table is one scan
  R2 groups without scope of their own are merged into their neighbours
  R3 foreign keys join on key columns, without IRI texts
  R4 the scans of a pattern are joined in a connected order, the most constant first
  R5 under DISTINCT and ASK a scan that only tests existence is a semi-join
  R6 under DISTINCT what is no longer needed is dropped and duplicates removed before a join that fans out
  R7 equality with a constant IRI or key is a comparison of columns, which reaches the scan
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.functions.expressions import Compiler
from quadloom.functions.values import Val
from quadloom.operators import aggregate as A
from quadloom.operators.relation import Rel, join, union, unit
from quadloom.plans import algebra as G
from quadloom.sources.mapping import Table

RULES = frozenset({"R1", "R2", "R3", "R4", "R5", "R6", "R7"})


@dataclass
class Dataset:
    """Mapped tables and generic quads that a query reads. hidden: DataFrame(g) of graphs that it may not see: tables and quads
    are handed out without them. shared: predicates of tables (or rdf:type, for their classes) that quads hold too."""

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    quads: DataFrame | None = None
    hidden: DataFrame | None = None
    rules: frozenset[str] = RULES
    soft_limit: int = -1
    default_only: bool = False
    restricted: bool = False
    shared: frozenset[str] = frozenset()

    def __post_init__(self):
        if self.hidden is not None:
            own = {name: t.without(self.hidden) for name, t in self.tables.items()}
            by_name = {t.name: t for t in own.values()}
            for t in own.values():
                t.foreign = {c: by_name.get(o.name, o) for c, o in t.foreign.items()}
            self.tables = own
        self.by_predicate = {p: t for t in self.tables.values() for p in t.predicates}
        self.by_class = {t.class_iri: t for t in self.tables.values()}

    def visible_quads(self) -> DataFrame | None:
        if self.quads is None or self.hidden is None:
            return self.quads
        return self.quads.join(self.hidden, "g", "left_anti")

    def all_quads(self) -> DataFrame:
        """Everything as generic quads."""
        parts = [t.quads() for t in self.tables.values()]
        own = self.visible_quads()
        parts += [own] if own is not None else []
        out = parts[0] if parts else self.spark.createDataFrame([], R.QUADS)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def scan_quads(quads: DataFrame, t: G.Triple, graph=None, sources: list[str] | None = None, default_only: bool = False) -> Rel:
    """Solutions of one triple pattern over quads(g, s, p, o)."""
    df, vals = quads, {}
    own = {"s": Val(F.col("s"), "term"), "p": Val(F.col("p"), "iri"), "o": Val(F.col("o"), "term"), "g": Val(F.col("g"), "iri")}
    if graph is not None:
        df = df.where(F.col("g") != R.DEFAULT_GRAPH)
    elif sources:
        df = df.where(F.col("g").isin(sources))
    elif default_only:
        df = df.where(F.col("g") == R.DEFAULT_GRAPH)
    for place, slot in (("g", graph), ("p", t.p), ("s", t.s), ("o", t.o)):
        if slot is None:
            continue
        if isinstance(slot, R.Var):
            if slot.name in vals:
                a, b = vals[slot.name], own[place]
                df = df.where(V.to_term(a) == V.to_term(b) if a.kind != b.kind else a.col == b.col)
            else:
                vals[slot.name] = own[place]
        elif place in ("g", "p"):
            df = df.where(F.col(place) == slot.value) if isinstance(slot, R.IRI) else df.where(F.lit(False))
        elif place == "s" and isinstance(slot, R.Literal):
            df = df.where(F.lit(False))
        else:
            kind, lex, dt, lang = R.as_row(slot)
            c = F.col(place)
            df = df.where((c.getField("kind") == kind) & (c.getField("lex") == lex))
            df = df.where(c.getField("dt").isNull() if dt is None else c.getField("dt") == dt)
            df = df.where(c.getField("lang").isNull() if lang is None else c.getField("lang") == lang)
    return Rel.of(df, vals)


@dataclass
class _Unit:
    """One scan of a pattern."""

    triples: list[G.Triple]
    table: Table | None
    near: Table | None = None  # the one mapped table that can hold the subject of an open predicate
    mixed: bool = False  # quads hold the table's predicate too

    @property
    def vars(self) -> set[str]:
        return G.pattern_vars(G.BGP(self.triples))

    @property
    def constants(self) -> int:
        return sum(not isinstance(x, R.Var) for t in self.triples for x in (t.s, t.o))


class QueryCompiler:
    def __init__(self, data: Dataset, query: G.Query | None = None):
        self.data, self.query = data, query
        self.sources = list(query.sources) if query else []
        self.named = list(query.named) if query else []
        self.existential = bool(query and (query.distinct or query.form in ("ask", "construct", "describe")) and not A.is_aggregate(query))
        self.warnings: list[str] = []

    def on(self, rule: str) -> bool:
        return rule in self.data.rules

    # Basic graph patterns

    def _table_of(self, t: G.Triple) -> Table | None:
        if isinstance(t.p, R.IRI):
            if t.p.value in self.data.by_predicate:
                return self.data.by_predicate[t.p.value]
            if t.p.value == R.RDF_TYPE and isinstance(t.o, R.IRI):
                return self.data.by_class.get(t.o.value)
        return None

    def units(self, triples: list[G.Triple]) -> list[_Unit]:
        known: dict = {}
        for t in triples:
            table = self._table_of(t)
            if table is not None:
                known.setdefault(t.s, table)
                column = table.predicates.get(t.p.value)
                if column in table.foreign and isinstance(t.o, R.Var):
                    known.setdefault(t.o, table.foreign[column])
            if isinstance(t.s, R.IRI):
                for own in self.data.tables.values():
                    if own.key and V.template_key(t.s.value, own.template):
                        known.setdefault(t.s, own)
        stars: dict[tuple, _Unit] = {}
        out: list[_Unit] = []
        for t in triples:
            table, near = self._table_of(t), None
            if table is None and (isinstance(t.p, R.Var) or (t.p == R.IRI(R.RDF_TYPE) and isinstance(t.o, R.Var))):
                near = known.get(t.s)
                if self.data.quads is None:
                    table = near
            if table is None:
                out.append(_Unit([t], None, near))
            elif isinstance(t.p, R.IRI) and t.p.value in self.data.shared:
                out.append(_Unit([t], table, mixed=True))
            elif not self.on("R1"):
                out.append(_Unit([t], table))
            elif (t.s, table.name) in stars:
                stars[t.s, table.name].triples.append(t)
            else:
                stars[t.s, table.name] = _Unit([t], table)
                out.append(stars[t.s, table.name])
        return out

    def ordered(self, units: list[_Unit]) -> list[_Unit]:
        if not self.on("R4") or len(units) < 2:
            return units
        left, out, have = list(units), [], set()
        while left:
            near = [u for u in left if u.vars & have] or left
            best = max(near, key=lambda u: (u.constants, -left.index(u)) if not out else (len(u.vars & have) > 0, u.constants, -left.index(u)))
            left.remove(best)
            out.append(best)
            have |= best.vars
        return out

    def scan(self, u: _Unit, graph, wanted: set[str]) -> Rel:
        if u.table is not None:
            subject = u.triples[0].s
            if not u.table.key and isinstance(subject, R.Var) and subject.name not in wanted and not any(subject in (t.p, t.o) for t in u.triples):
                subject = None  # a row's blank node that nothing reads
            if u.mixed:
                subject = u.triples[0].s
            rel = u.table.scan(subject, [(t.p, t.o) for t in u.triples], graph, self.sources, self.data.default_only)
            if u.mixed:
                rel = union([rel, scan_quads(self.data.visible_quads(), u.triples[0], graph, self.sources, self.data.default_only)])
        else:
            t = u.triples[0]
            quads = self.data.visible_quads()
            open_ = isinstance(t.p, R.Var) or (t.p == R.IRI(R.RDF_TYPE) and isinstance(t.o, R.Var))
            mapped = ([u.near] if u.near else list(self.data.tables.values())) if open_ else []
            own = quads if quads is not None else self.data.spark.createDataFrame([], R.QUADS)
            rels = [scan_quads(own, t, graph, self.sources, self.data.default_only)] if quads is not None or not mapped else []
            rels += [x.scan(t.s, [(t.p, t.o)], graph, self.sources, self.data.default_only) for x in mapped]
            rel = union(rels) if len(rels) > 1 else rels[0]
        if graph is not None and self.named and isinstance(graph, R.Var) and graph.name in rel.vars:
            rel = rel.where(V.iri_text(rel.vars[graph.name]).isin(self.named))
        if self.data.soft_limit > 0 and not (self.query and self.query.order_by):
            rel = Rel(rel.df.limit(self.data.soft_limit), rel.vars)
            self.warnings.append(f"a scan was cut at {self.data.soft_limit} rows")
        return rel

    def bgp(self, triples: list[G.Triple], graph, needed: set[str]) -> Rel:
        out: Rel | None = None
        units = self.ordered(self.units(triples))
        for i, u in enumerate(units):
            rest = set().union(*(x.vars for x in units[i + 1 :])) if i + 1 < len(units) else set()
            keep = needed | rest
            rel = self.scan(u, graph, keep | set(out.vars if out is not None else ()))
            if graph is not None and isinstance(graph, R.Var):
                keep = keep | {graph.name}
            if out is None:
                out = rel
            elif self.existential and self.on("R5") and set(out.vars) & set(rel.vars) and not (set(rel.vars) - set(out.vars)) & keep:
                out = join(out, rel, "semi")
            else:
                out = join(out, rel)
            if self.existential and self.on("R6") and self.query and self.query.distinct and i + 1 < len(units):
                if set(out.vars) - keep and units[i + 1].vars - set(out.vars):
                    out = out.select([v for v in out.vars if v in keep]).distinct()
        return out

    # Groups

    def _flat(self, group: G.Group) -> list:
        """R2: plain groups melt into the group around them, neighbouring patterns into one."""
        parts: list = []
        for p in group.parts:
            if self.on("R2") and isinstance(p, G.Group) and all(isinstance(x, (G.BGP, G.Group)) for x in p.parts):
                parts += self._flat(p)
            else:
                parts.append(p)
        out: list = []
        for p in parts:
            if isinstance(p, G.BGP) and self.on("R2"):
                before = next((x for x in reversed(out) if not isinstance(x, G.Filter_)), None)
                if isinstance(before, G.BGP):
                    out[next(i for i, x in enumerate(out) if x is before)] = G.BGP(before.triples + p.triples)
                    continue
            out.append(p)
        return out

    def group(self, group: G.Group, graph=None, needed: set[str] | None = None) -> Rel:
        rel, filters = self._group(group, graph, needed)
        return self._filtered(rel, filters)

    def _filtered(self, rel: Rel, filters: list) -> Rel:
        scope = Compiler(rel.vars)
        for e in filters:
            rel = rel.where(scope.truth(e))
        return rel

    def _group(self, group: G.Group, graph, needed: set[str] | None) -> tuple[Rel, list]:
        now: Rel | None = None
        filters: list = []
        parts = self._flat(group)
        for i, p in enumerate(parts):
            if isinstance(p, G.Filter_):
                filters.append(p.expr)
                continue
            if isinstance(p, G.Bind_):
                now = now or unit(self.data.spark)
                v = Compiler(now.vars)(p.expr)
                now = Rel.of(now.df, {**now.vars, p.var.name: Val(v.col, v.kind if v.kind != "error" else "string", v.template, True, v.datatype)})
                continue
            others = set().union(*(G.used_vars(x) for j, x in enumerate(parts) if j != i)) if len(parts) > 1 else set()
            inner = (needed if needed is not None else G.used_vars(group)) | others
            if isinstance(p, G.Optional_):
                right, conditions = self._group(p.group, graph, inner | G.used_vars(p.group))
                left = now or unit(self.data.spark)
                test = (lambda scope, own=conditions: _all_true(Compiler(scope), own)) if conditions else None
                now = join(left, right, "left", test)
                continue
            if isinstance(p, G.Minus_):
                if now is not None:
                    now = join(now, self.group(p.group, graph, G.used_vars(p.group)), "minus")
                continue
            if isinstance(p, G.BGP):
                rel = self.bgp(p.triples, graph, inner) if p.triples else None
            elif isinstance(p, G.Union_):
                rel = union([self.group(g, graph, inner | G.used_vars(g)) for g in p.groups])
            elif isinstance(p, G.GraphPattern):
                rel = self.graphs(p.name) if not p.group.parts else self.group(p.group, p.name, inner | G.used_vars(p.group))
            else:
                rel = self.group(p, graph, inner | G.used_vars(p))
            if rel is not None:
                now = rel if now is None else join(self._cut(now), self._cut(rel))
        return now or unit(self.data.spark), filters

    def _cut(self, rel: Rel) -> Rel:
        """Restricted mode: a join's input of soft_limit rows at most."""
        if not self.data.restricted or self.data.soft_limit <= 0:
            return rel
        self.warnings.append(f"a join's input was cut at {self.data.soft_limit} rows")
        return Rel(rel.df.limit(self.data.soft_limit), rel.vars)

    def graphs(self, name) -> Rel:
        """The graphs themselves: GRAPH ?g {}."""
        rels = [Rel.of(t.df.select(t.graph).distinct(), {"g": t.graph_value()}) for t in self.data.tables.values() if t.graph]
        quads = self.data.visible_quads()
        if quads is not None:
            rels.append(Rel.of(quads.select("g").where(F.col("g") != R.DEFAULT_GRAPH).distinct(), {"g": Val(F.col("g"), "iri")}))
        if not rels:
            rels = [Rel.of(self.data.spark.createDataFrame([], "g string"), {"g": Val(F.col("g"), "iri")})]
        out = union(rels).distinct() if len(rels) > 1 else rels[0]
        if isinstance(name, R.Var):
            return Rel(out.df, {name.name: out.vars["g"]})
        return Rel(out.df.where(V.iri_text(out.vars["g"]) == name.value), {})

    # Queries

    def select(self) -> Rel:
        """Projected, grouped, ordered and cut solutions of a SELECT query."""
        q = self.query
        star = [v for v in dict.fromkeys(_named_vars(q.where)) if not v.startswith(":")]
        head = q.select if q.select is not None else [(R.Var(v), None) for v in star]
        needed = set().union(*({v.name} | (G.expr_vars(e) if e is not None else set()) for v, e in head)) if head else set()
        for e, v in q.group_by:
            needed |= G.expr_vars(e)
        for e in q.having:
            needed |= G.expr_vars(e)
        for e, _ in q.order_by:
            needed |= G.expr_vars(e)
        rel = self.group(q.where, None, needed)
        if A.is_aggregate(q):
            rel, head, order, having = A.grouped(rel, q, head)
            for e in having:
                rel = rel.where(Compiler(rel.vars).truth(e))
        else:
            order = q.order_by
        aliases: dict = {}
        vals: dict[str, Val] = {}
        for v, e in head:
            e = G.replaced(e, aliases) if e is not None else v
            if e is not v:
                aliases[v] = e
            vals[v.name] = Compiler(rel.vars)(e)
        scope = {**rel.vars, **vals}
        keys = [k for e, up in order for k in V.sort_keys(Compiler(scope)(e), up)]
        if q.distinct:
            rel = Rel.of(rel.df, vals).distinct()
            if order:
                scope = Compiler(rel.vars)
                rel = Rel(rel.df.orderBy(*(k for e, up in order for k in V.sort_keys(scope(e), up))), rel.vars)
        else:
            rel = Rel.of(rel.df.orderBy(*keys) if keys else rel.df, vals)
        df = rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, rel.vars)


def _all_true(scope: Compiler, filters: list):
    out = scope.truth(filters[0])
    for e in filters[1:]:
        out = out & scope.truth(e)
    return F.coalesce(out, F.lit(False))


def _named_vars(part) -> list[str]:
    """Variables of a pattern in the order of their first appearance."""
    if isinstance(part, G.BGP):
        return [x.name for t in part.triples for x in (t.s, t.p, t.o) if isinstance(x, R.Var)]
    if isinstance(part, G.Group):
        return [v for p in part.parts for v in _named_vars(p)]
    if isinstance(part, G.Optional_):
        return _named_vars(part.group)
    if isinstance(part, G.Union_):
        return [v for g in part.groups for v in _named_vars(g)]
    if isinstance(part, G.GraphPattern):
        return ([part.name.name] if isinstance(part.name, R.Var) else []) + _named_vars(part.group)
    if isinstance(part, G.Bind_):
        return [part.var.name]
    return []
