"""Grouping and aggregates: partial aggregation is Spark's, the rules on errors and unbound values are here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.functions.expressions import Compiler
from quadloom.functions.values import NUMERIC, Val
from quadloom.operators.relation import Rel, fresh
from quadloom.plans import algebra as G


def is_aggregate(q: G.Query) -> bool:
    exprs = [e for _, e in q.select or [] if e is not None] + q.having + [e for e, _ in q.order_by]
    return bool(q.group_by or q.having or any(G.aggregates(e) for e in exprs))


def _whole(total: Column, v: Val) -> Column:
    """A sum or mean, unless some value was unbound or an error: then it is one too."""
    return F.when(F.count(F.lit(1)) == F.count(v.col), total) if v.maybe or v.kind == "term" else total


def compiled(a: G.Aggregate, scope: Compiler) -> Val:
    """One aggregate as a column of agg()."""
    if a.expr is None:
        rows = F.count(F.lit(1))
        if a.distinct:
            rows = F.count_distinct(F.struct(*(v.col for v in scope.scope.values())))
        return Val(rows, "integer")
    v = scope(a.expr)
    if a.name == "count":
        return Val(F.count_distinct(v.col) if a.distinct else F.count(v.col), "integer")
    if a.name in ("sum", "avg"):
        if v.kind == "error":
            return Val(F.when(F.count(F.lit(1)) == 0, F.lit(0)) if a.name == "sum" else F.lit(None).cast("double"), "integer", maybe=True)
        if v.kind == "term":
            number = Val(V.as_double(v), "double", maybe=True)
        elif v.kind in NUMERIC:
            number = v
        else:
            number = Val(F.lit(None).cast("double"), "double", maybe=True)
        kind = number.kind
        col = number.col.cast("bigint") if kind == "integer" else number.col
        if a.name == "sum":
            total = (F.sum_distinct(col.cast("decimal(38,0)")).try_cast("bigint") if kind == "integer" else F.sum_distinct(col)) if a.distinct else F.try_sum(col)
            zero = F.lit(0).cast("bigint" if kind == "integer" else "double" if kind == "double" else "decimal(38,10)")
            total = F.when(F.count(col) == 0, zero).otherwise(total)  # a sum that overflows is an error
            guarded = F.when(F.count(F.lit(1)) == 0, zero).otherwise(_whole(total, number)) if number.maybe else total
            return Val(guarded, kind, maybe=True)
        if kind == "integer":
            total = F.sum_distinct(col.cast("decimal(38,0)")) if a.distinct else F.try_sum(col)
            n = F.count_distinct(col) if a.distinct else F.count(col)
            mean = F.try_divide(total.cast("decimal(20,0)"), n.cast("decimal(20,0)"))
            return Val(_whole(mean, number), "decimal", maybe=True)
        mean = F.try_divide(F.sum_distinct(col), F.count_distinct(col)) if a.distinct else F.avg(col)
        return Val(_whole(mean, number), kind, maybe=True)
    if a.name in ("min", "max"):
        if v.kind == "iri" or v.kind == "bnode":
            v = Val(V.iri_text(v), v.kind, maybe=v.maybe)
        if v.kind == "term":
            key = F.when(v.col.isNotNull(), F.struct(v.col.getField("kind"), V.as_double(v), V.as_timestamp(v), v.col.getField("lex")))
            return Val((F.min_by if a.name == "min" else F.max_by)(v.col, key), "term", maybe=True)
        return Val((F.min if a.name == "min" else F.max)(v.col), v.kind, v.template, True, v.datatype)
    if a.name == "sample":
        return Val(F.first(v.col, ignorenulls=False), v.kind, v.template, True, v.datatype)
    if a.name == "group_concat":
        text = F.collect_set(V.lexical(v)) if a.distinct else F.collect_list(V.lexical(v))
        joined = F.array_join(F.sort_array(text), a.separator)
        return Val(F.when(F.count(F.lit(1)) == F.count(v.col), joined) if v.maybe else joined, "string", maybe=True)
    raise ValueError(f"unknown aggregate {a.name}")


def grouped(rel: Rel, q: G.Query, head: list):
    """Groups rel; returns it with the head, order and having rewritten to columns of the groups."""
    scope = Compiler(rel.vars)
    keys: dict[str, Val] = {}
    by: dict = {}
    for i, (e, v) in enumerate(q.group_by):
        name = v.name if v is not None else e.name if isinstance(e, R.Var) else f":key{i}"
        keys[name] = scope(e)
        by[e] = R.Var(name)
        scope = Compiler({**scope.scope, name: keys[name]})
    aliases = {v: e for v, e in head if e is not None}
    wanted: list[G.Aggregate] = []
    for e in [*(e for _, e in head if e is not None), *q.having, *(G.replaced(e, aliases) for e, _ in q.order_by)]:
        wanted += [a for a in G.aggregates(e) if a not in wanted]
    loose = [v for v, e in head if e is None and v.name not in keys and v.name in rel.vars]
    for e in [*(e for _, e in head if e is not None), *q.having]:
        for name in _outside(G.replaced(e, by)):
            if name not in keys and name in rel.vars and R.Var(name) not in loose and R.Var(name) not in aliases:
                loose.append(R.Var(name))
    wanted += [G.Aggregate("sample", v) for v in loose if G.Aggregate("sample", v) not in wanted]
    made = {a: compiled(a, scope) for a in wanted}
    names = {k: fresh(k) for k in keys}
    columns = {a: fresh(a.name) for a in wanted}
    aggs = [made[a].col.alias(columns[a]) for a in wanted]
    base = rel.df
    if keys:
        df = base.groupBy(*(v.col.alias(names[k]) for k, v in keys.items()))
        df = df.agg(*aggs) if aggs else base.select(*(v.col.alias(names[k]) for k, v in keys.items())).distinct()
    else:
        df = base.agg(*(aggs or [F.count(F.lit(1)).alias(fresh("n"))]))
    vars = {k: v.at(F.col(names[k])) for k, v in keys.items()}
    by |= {a: R.Var(f":agg{i}") for i, a in enumerate(wanted)}
    vars |= {f":agg{i}": made[a].at(F.col(columns[a])) for i, a in enumerate(wanted)}
    for v in loose:
        vars[v.name] = vars[by[G.Aggregate("sample", v)].name]
    fresh_head = [(v, G.replaced(e, by)) if e is not None else (v, None) for v, e in head]
    order = [(G.replaced(G.replaced(e, aliases), by), up) for e, up in q.order_by]
    having = [G.replaced(G.replaced(e, aliases), by) for e in q.having]
    return Rel(df, vars), fresh_head, order, having


def _outside(e) -> set[str]:
    """Variables of an expression outside its aggregates."""
    if isinstance(e, R.Var):
        return {e.name}
    if isinstance(e, G.Call):
        return set().union(*map(_outside, e.args)) if e.args else set()
    return set()
