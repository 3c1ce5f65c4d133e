"""Joins of solutions with unbound variables against the definition of compatible solutions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadloom.functions.values import Val
from quadloom.operators.relation import Rel, join, union


def table(spark, rows, names, maybes):
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} long" for n in names))
    return Rel.of(df, {n: Val(F.col(n), "integer", maybe=n in maybes) for n in names})


def found(rel, names):
    return Counter(tuple(r) for r in rel.df.select(*(rel.vars[n].col for n in names)).collect())


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def expected(left, right, how, test):
    out = []
    for a in left:
        hits = [b for b in right if compatible(a, b)]
        if how == "minus":
            if not any(a.keys() & b.keys() for b in hits):
                out.append(a)
            continue
        joined = [a | b for b in hits if test(a | b)]
        out += joined or ([a] if how == "left" else [])
    return out


def made(r, names, maybes, n):
    return [{k: r.randint(0, 3) for k in names if k not in maybes or r.random() < 0.6} for _ in range(n)]


@pytest.mark.parametrize("how", ["inner", "left", "minus"])
@pytest.mark.parametrize("seed", range(3))
def test_compatible(spark, how, seed):
    r = random.Random(seed)
    maybe_left, maybe_right = [({"x"}, {"x"}), ({"x", "y"}, {"y"}), (set(), {"x", "y"})][seed]
    left, right = made(r, "axy", maybe_left, 12), made(r, "xyz", maybe_right, 12)
    a, b = table(spark, left, "axy", maybe_left), table(spark, right, "xyz", maybe_right)
    filtered = how == "left" and seed == 1
    condition = (lambda scope: F.coalesce(scope["a"].col < scope["z"].col, F.lit(False))) if filtered else None
    names = "axy" if how == "minus" else "axyz"
    test = (lambda s: "a" in s and "z" in s and s["a"] < s["z"]) if filtered else (lambda s: True)
    assert found(join(a, b, how, condition), names) == Counter(tuple(s.get(n) for n in names) for s in expected(left, right, how, test))


def test_union_pads(spark):
    a, b = table(spark, [{"x": 1}], "x", ()), table(spark, [{"y": 2}], "y", ())
    assert found(union([a, b]), "xy") == Counter([(1, None), (None, 2)])


def test_no_nested_loop_for_unbound_variables(spark):
    a, b = table(spark, [{"x": 1, "a": 1}], "ax", {"x"}), table(spark, [{"x": 1, "z": 2, "y": 1}], "xyz", ())
    plan = join(Rel(a.df, a.vars | {"y": a.vars["a"]}), b).df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
