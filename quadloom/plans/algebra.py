"""The algebra that the parser makes: patterns, expressions, queries and updates."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quadloom.terms import IRI, Literal, Var

Slot = Any  # Var, IRI or Literal


@dataclass(frozen=True)
class Triple:
    s: Slot
    p: Slot
    o: Slot


@dataclass
class BGP:
    triples: list[Triple]


@dataclass
class Group:
    parts: list[Any] = field(default_factory=list)


@dataclass
class Optional_:
    group: Group


@dataclass
class Union_:
    groups: list[Group]


@dataclass
class Minus_:
    group: Group


@dataclass
class GraphPattern:
    name: Slot
    group: Group


@dataclass
class Filter_:
    expr: Any


@dataclass
class Bind_:
    expr: Any
    var: Var


@dataclass(frozen=True)
class Call:
    """A function, operator or cast on arguments. name is lower case, or the IRI of a cast."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    name: str
    expr: Any
    distinct: bool = False
    separator: str = " "


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    where: Group
    select: list[tuple[Var, Any]] | None = None  # None: *
    distinct: bool = False
    reduced: bool = False
    group_by: list[tuple[Any, Var | None]] = field(default_factory=list)
    having: list[Any] = field(default_factory=list)
    order_by: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    sources: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)
    template: list[Triple] = field(default_factory=list)
    describe: list[Slot] = field(default_factory=list)


@dataclass
class Update:
    """One operation: insert_data, delete_data, modify, clear, drop, create, load, add, move or copy."""

    kind: str
    insert: list[tuple[Slot | None, Triple]] = field(default_factory=list)
    delete: list[tuple[Slot | None, Triple]] = field(default_factory=list)
    where: Group | None = None
    using: list[str] = field(default_factory=list)
    source: str | None = None
    target: str | None = None
    silent: bool = False


def pattern_vars(part: Any) -> set[str]:
    """Names of the variables that a pattern can bind."""
    if isinstance(part, BGP):
        return {x.name for t in part.triples for x in (t.s, t.p, t.o) if isinstance(x, Var)}
    if isinstance(part, Group):
        return set().union(*map(pattern_vars, part.parts)) if part.parts else set()
    if isinstance(part, Optional_):
        return pattern_vars(part.group)
    if isinstance(part, Union_):
        return set().union(*map(pattern_vars, part.groups))
    if isinstance(part, GraphPattern):
        return pattern_vars(part.group) | ({part.name.name} if isinstance(part.name, Var) else set())
    if isinstance(part, Bind_):
        return {part.var.name}
    return set()


def expr_vars(e: Any) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(expr_vars, e.args)) if e.args else set()
    if isinstance(e, Aggregate):
        return expr_vars(e.expr)
    return set()


def used_vars(part: Any) -> set[str]:
    """Names of all variables in a pattern, those in filters included."""
    if isinstance(part, Group):
        return set().union(*map(used_vars, part.parts)) if part.parts else set()
    if isinstance(part, (Optional_, Minus_)):
        return used_vars(part.group)
    if isinstance(part, Union_):
        return set().union(*map(used_vars, part.groups))
    if isinstance(part, GraphPattern):
        return used_vars(part.group) | ({part.name.name} if isinstance(part.name, Var) else set())
    if isinstance(part, Filter_):
        return expr_vars(part.expr)
    if isinstance(part, Bind_):
        return expr_vars(part.expr) | {part.var.name}
    return pattern_vars(part)


def aggregates(e: Any) -> list[Aggregate]:
    if isinstance(e, Aggregate):
        return [e]
    if isinstance(e, Call):
        return [a for x in e.args for a in aggregates(x)]
    return []


def replaced(e: Any, by: dict[Any, Any]) -> Any:
    """e with whole sub-expressions exchanged."""
    try:
        if e in by:
            return by[e]
    except TypeError:
        pass
    if isinstance(e, Call):
        return Call(e.name, tuple(replaced(a, by) for a in e.args))
    return e


TRUE = Literal("true", "http://www.w3.org/2001/XMLSchema#boolean")
__all__ = [n for n in dir() if not n.startswith("_")] + ["IRI"]
