"""Solution tables: a DataFrame with a typed value for each variable, and the joins and unions of them.

Every column has a name of its own, so tables join without clashes. Variables that may be unbound are joined by
halves: rows where both sides are bound meet by equality, the others by the remaining keys, so no join needs an OR of
null tests, which Spark could only plan as a nested loop.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import values as V
from quadloom.functions.expressions import union_kind
from quadloom.functions.values import NUMERIC, Val

_NUMBERS = itertools.count()


def fresh(name: str) -> str:
    return f"{name.strip(':.')}__{next(_NUMBERS)}"


class Rel:
    def __init__(self, df: DataFrame, vars: dict[str, Val]):
        self.df, self.vars = df, vars

    @staticmethod
    def of(df: DataFrame, vals: dict[str, Val]) -> Rel:
        """The values of df under fresh names, and nothing else."""
        names = {v: fresh(v) for v in vals}
        if not vals:
            return Rel(df.select(F.lit(1).alias(fresh("unit"))), {})
        out = df.select(*(x.col.alias(names[v]) for v, x in vals.items()))
        return Rel(out, {v: x.at(F.col(names[v])) for v, x in vals.items()})

    def where(self, condition: Column) -> Rel:
        return Rel(self.df.where(condition), self.vars)

    def select(self, names) -> Rel:
        return Rel.of(self.df, {v: self.vars[v] for v in names if v in self.vars})

    def distinct(self) -> Rel:
        return Rel(self.df.distinct(), self.vars)

    def renamed(self) -> Rel:
        return Rel.of(self.df, self.vars)


def unit(spark) -> Rel:
    """One solution without variables."""
    return Rel(spark.range(1).select(F.lit(1).alias(fresh("unit"))), {})


def _comparable(a: Val, b: Val) -> tuple[Column, Column] | None:
    """Columns that are equal where the values are the same term; None if they never are."""
    if a.kind == "error" or b.kind == "error":
        return V.to_term(a), V.to_term(b)
    if a.kind == b.kind == "iri":
        if a.template == b.template:
            return a.col, b.col
        if a.template and b.template:
            return None
        return V.iri_text(a), V.iri_text(b)
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.col, b.col
    if "term" in (a.kind, b.kind):
        return V.to_term(a), V.to_term(b)
    if a.kind != b.kind:
        return None
    if a.kind == "bnode" and a.template != b.template:
        return None
    return a.col, b.col


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _merged(a: Val, b: Val) -> Val:
    """The value of a variable of both sides of a join."""
    if not a.maybe or a.col is b.col:
        return a
    x, y = union_kind([a, b])
    return Val(F.coalesce(x.col, y.col), x.kind, x.template, b.maybe, x.datatype)


Condition = Callable[[dict[str, Val]], Column]


def join(left: Rel, right: Rel, how: str = "inner", condition: Condition | None = None) -> Rel:
    """how: inner, left, semi or minus. condition: over the scope of both sides (a filter inside OPTIONAL)."""
    shared = [v for v in left.vars if v in right.vars]
    if how == "minus" and not shared:
        return left
    pairs = {v: _comparable(left.vars[v], right.vars[v]) for v in shared}
    maybes = [v for v in shared if left.vars[v].maybe or right.vars[v].maybe]
    plain = [v for v in shared if v not in maybes]
    never = any(pairs[v] is None for v in plain)
    both = {**right.vars, **left.vars} | {v: _merged(left.vars[v], right.vars[v]) for v in shared}
    if how == "left":
        both |= {v: Val(x.col, x.kind, x.template, True, x.datatype) for v, x in both.items() if v not in left.vars}

    def keys(names: list[str]) -> Column:
        return F.lit(False) if never or any(pairs[v] is None for v in names) else _all([pairs[v][0] == pairs[v][1] for v in names])

    def on(names: list[str]) -> Column:
        c = keys(names)
        return c & condition(both) if condition is not None else c

    kind = {"inner": "inner", "left": "left", "semi": "left_semi", "minus": "left_anti"}[how]
    if not maybes:
        if how == "inner" and not plain:
            df = left.df.crossJoin(right.df)
            df = df.where(condition(both)) if condition is not None else df
        else:
            df = left.df.join(right.df, on(plain), kind)
        return Rel(df, left.vars if how in ("semi", "minus") else both)

    def halves(rel: Rel, names: list[str]):
        """Rows by which of names are bound."""
        for bits in itertools.product((True, False), repeat=len(names)):
            tests = [rel.vars[v].col.isNotNull() if b else rel.vars[v].col.isNull() for v, b in zip(names, bits, strict=True)]
            yield {v for v, b in zip(names, bits, strict=True) if b}, rel.df.where(_all(tests)) if tests else rel.df

    own_left = [v for v in maybes if left.vars[v].maybe]
    own_right = [v for v in maybes if right.vars[v].maybe]
    parts: list[DataFrame] = []
    for bound_left, l in halves(left, own_left):
        has_left = bound_left | set(maybes) - set(own_left)
        rest = l
        for bound_right, r in halves(right, own_right):
            has = has_left & (bound_right | set(maybes) - set(own_right))
            names = plain + sorted(has)
            if how in ("inner", "left"):
                parts.append(l.join(r, on(names), "inner") if names or condition is not None else l.crossJoin(r))
            if how in ("left", "minus") and (names or how == "left"):
                rest = rest.join(r, on(names), "left_anti")
            if how == "semi":
                parts.append(l.join(r, on(names), "left_semi"))
        if how == "minus":
            parts.append(rest)
        if how == "left":
            parts.append(rest)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if how == "semi":
        return Rel(df.distinct(), left.vars)
    return Rel(df, left.vars if how == "minus" else both)


def union(rels: list[Rel]) -> Rel:
    """All solutions of all tables; a variable that a table lacks is unbound in its rows."""
    names = list(dict.fromkeys(v for r in rels for v in r.vars))
    columns = {v: fresh(v) for v in names}
    rows = {v: union_kind([r.vars.get(v) or V.error() for r in rels]) for v in names}
    frames = []
    for i, r in enumerate(rels):
        frames.append(r.df.select(*(rows[v][i].col.alias(columns[v]) for v in names)) if names else r.df.select(F.lit(1).alias("unit")))
    df = reduce(DataFrame.unionAll, frames)
    out = {}
    for v in names:
        known = next((x for x in rows[v] if x.kind != "error"), rows[v][0])
        out[v] = Val(F.col(columns[v]), known.kind, known.template, any(v not in r.vars or r.vars[v].maybe for r in rels), known.datatype)
    return Rel(df, out)
