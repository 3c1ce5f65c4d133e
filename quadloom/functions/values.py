"""Values of expressions: a column with its static kind. NULL is both unbound and error."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import terms as R

NUMERIC = ("integer", "decimal", "double")
DATATYPES = {"integer": R.XSD_INTEGER, "decimal": R.XSD_DECIMAL, "double": R.XSD_DOUBLE, "boolean": R.XSD_BOOLEAN, "dateTime": R.XSD_DATETIME, "date": R.XSD_DATE}


@dataclass(frozen=True)
class Val:
    """kind: boolean, integer, decimal, double, string, dateTime, date, iri, bnode, term or error.

    An iri with a template keeps its key columns in col; its text is made only where it is read. maybe: it may be
    unbound. datatype: the exact datatype where it is not the kind's own (an xsd:int column).
    """

    col: Column
    kind: str
    template: str | None = None
    maybe: bool = False
    datatype: str | None = None

    def at(self, col: Column) -> Val:
        return replace(self, col=col)


def error() -> Val:
    return Val(F.lit(None).cast("string"), "error", maybe=True)


def key_text(col: Column, fields: int) -> Column:
    if fields == 1:
        return col.cast("string")
    return F.concat_ws("/", *(col.getField(f"k{i}").cast("string") for i in range(fields)))


def iri_text(v: Val) -> Column:
    """The IRI's text, or the blank node's label."""
    if v.template is None:
        return v.col
    prefix, n = v.template.rsplit("#", 1) if v.template[-2:-1] == "#" else (v.template, "1")
    text = F.concat(F.lit(prefix), key_text(v.col, int(n)))
    return F.when(v.col.isNotNull(), text)


def lexical(v: Val) -> Column:
    """The lexical form of any value."""
    if v.kind == "term":
        return v.col.getField("lex")
    if v.kind in ("iri", "bnode"):
        return iri_text(v)
    if v.kind == "dateTime":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    if v.kind == "decimal":
        text = v.col.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return v.col.cast("string")


def term_struct(kind: int | Column, lex: Column, dt: Column | str | None = None, lang: Column | None = None) -> Column:
    dt = F.lit(dt).cast("string") if dt is None or isinstance(dt, str) else dt
    lang = F.lit(None).cast("string") if lang is None else lang
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.cast("tinyint").alias("kind"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang"))


def to_term(v: Val) -> Column:
    """The value as a term struct, NULL where it is."""
    if v.kind == "term":
        return v.col
    if v.kind == "error":
        return F.lit(None).cast(R.TERM)
    kind = {"iri": R.IRI_KIND, "bnode": R.BNODE}.get(v.kind, R.LITERAL)
    return F.when(v.col.isNotNull(), term_struct(kind, lexical(v), v.datatype or DATATYPES.get(v.kind)))


def as_term(v: Val) -> Val:
    return Val(to_term(v), "term", maybe=v.maybe)


def is_numeric_type(dt: Column) -> Column:
    return dt.isin(*R.INTEGER_TYPES, R.XSD_DECIMAL, R.XSD_DOUBLE, R.XSD_FLOAT)


def rank(v: Val) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double, NULL for what is no number."""
    if v.kind in NUMERIC:
        return F.when(v.col.isNotNull(), F.lit({"integer": 1, "decimal": 2, "double": 4}[v.kind]))
    if v.kind != "term":
        return F.lit(None).cast("int")
    dt = v.col.getField("dt")
    return F.when(dt.isin(*R.INTEGER_TYPES), 1).when(dt == R.XSD_DECIMAL, 2).when(dt == R.XSD_FLOAT, 3).when(dt == R.XSD_DOUBLE, 4)


def as_double(v: Val) -> Column:
    if v.kind in NUMERIC:
        return v.col.cast("double")
    if v.kind == "boolean":
        return v.col.cast("int").cast("double")
    if v.kind != "term":
        return F.lit(None).cast("double")
    lex, dt = v.col.getField("lex"), v.col.getField("dt")
    boolean = F.when(lex.isin("true", "1"), 1.0).otherwise(0.0)
    return F.when(is_numeric_type(dt), lex.try_cast("double")).when(dt == R.XSD_BOOLEAN, boolean)


def as_timestamp(v: Val) -> Column:
    if v.kind in ("dateTime", "date"):
        return v.col.cast("timestamp_ntz")
    if v.kind != "term":
        return F.lit(None).cast("timestamp_ntz")
    dt = v.col.getField("dt")
    return F.when(dt.isin(R.XSD_DATETIME, R.XSD_DATE), v.col.getField("lex").try_cast("timestamp").cast("timestamp_ntz"))


def as_string(v: Val) -> Column:
    """The text of a string-like value: plain, xsd:string or language-tagged; NULL for anything else."""
    if v.kind == "string":
        return v.col
    if v.kind != "term":
        return F.lit(None).cast("string")
    c = v.col
    return F.when((c.getField("kind") == R.LITERAL) & (c.getField("dt").isNull() | (c.getField("dt") == R.XSD_STRING)), c.getField("lex"))


def ebv(v: Val) -> Column:
    """The effective boolean value."""
    if v.kind == "boolean":
        return v.col
    if v.kind in ("integer", "decimal"):
        return v.col != 0
    if v.kind == "double":
        return (v.col != 0) & ~F.isnan(v.col)
    if v.kind == "string":
        return F.length(v.col) > 0
    if v.kind == "term":
        n, s = as_double(v), as_string(v)
        return F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(s.isNotNull(), F.length(s) > 0)
    return F.lit(None).cast("boolean")


def sort_keys(v: Val, ascending: bool) -> list[Column]:
    """Columns that order values as SPARQL does: unbound, blank nodes, IRIs, literals."""
    way = (lambda c: c.asc_nulls_first()) if ascending else (lambda c: c.desc_nulls_last())
    if v.kind in ("iri", "bnode"):
        return [way(iri_text(v))]
    if v.kind != "term":
        return [way(v.col)]
    return [way(v.col.getField("kind")), way(as_double(v)), way(as_timestamp(v)), way(v.col.getField("lex"))]


def of_literal(x: R.Literal) -> Val:
    if x.lang:
        return Val(term_struct(R.LITERAL, F.lit(x.lex), None, F.lit(x.lang.upper())), "term")
    if x.dt is None or x.dt == R.XSD_STRING:
        return Val(F.lit(x.lex), "string", datatype=x.dt)
    try:
        if x.dt in R.INTEGER_TYPES:
            return Val(F.lit(int(x.lex)), "integer", datatype=x.dt)
        if x.dt in (R.XSD_DOUBLE, R.XSD_FLOAT):
            return Val(F.lit(float(x.lex)), "double", datatype=x.dt)
        if x.dt == R.XSD_DECIMAL:
            digits = x.lex.lstrip("+-").partition(".")
            whole, part = max(1, len(digits[0])), max(1, len(digits[2]))
            return Val(F.lit(x.lex).cast(f"decimal({min(38, whole + part)},{min(part, 37)})"), "decimal")
    except ValueError:
        return Val(term_struct(R.LITERAL, F.lit(x.lex), x.dt), "term")
    if x.dt == R.XSD_BOOLEAN:
        return Val(F.lit(x.lex in ("true", "1")), "boolean")
    if x.dt == R.XSD_DATETIME:
        return Val(F.lit(x.lex).try_cast("timestamp").cast("timestamp_ntz"), "dateTime")
    if x.dt == R.XSD_DATE:
        return Val(F.lit(x.lex).try_cast("date"), "date")
    return Val(term_struct(R.LITERAL, F.lit(x.lex), x.dt), "term")


def of_term(x) -> Val:
    return Val(F.lit(x.value), "iri") if isinstance(x, R.IRI) else of_literal(x)


def template_key(iri: str, template: str) -> list[str] | None:
    """The key texts of an IRI made by a template; None for another IRI."""
    prefix, n = template.rsplit("#", 1) if template[-2:-1] == "#" else (template, "1")
    if not iri.startswith(prefix):
        return None
    parts = iri[len(prefix) :].split("/")
    return parts if len(parts) == int(n) else None


def key_equals(v: Val, iri: str) -> Column:
    """Whether a templated IRI is a given one, as a comparison of keys that can reach the scan."""
    parts = template_key(iri, v.template)
    if parts is None:
        return F.when(v.col.isNotNull(), F.lit(False)) if v.maybe else F.lit(False)
    if len(parts) == 1:
        return v.col == (F.lit(int(parts[0])) if parts[0].lstrip("-").isdigit() else F.lit(parts[0]))
    out = F.lit(True)
    for i, p in enumerate(parts):
        out &= v.col.getField(f"k{i}") == (F.lit(int(p)) if p.lstrip("-").isdigit() else F.lit(p))
    return out


def equal(a: Val, b: Val, same_term: bool = False) -> Column:
    """Equality of values, or of terms."""
    if "error" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    resources = ("iri", "bnode")
    if a.kind in resources and b.kind in resources:
        if a.kind != b.kind:
            return F.lit(False)
        if a.template is not None and a.template == b.template:
            return a.col == b.col
        return iri_text(a) == iri_text(b)
    if "term" in (a.kind, b.kind):
        ta, tb = to_term(a), to_term(b)
        identical = ta == tb
        if same_term:
            return identical
        na, nb, sa, sb = as_double(a), as_double(b), as_string(a), as_string(b)
        da, db = as_timestamp(a), as_timestamp(b)
        la, lb = F.coalesce(ta.getField("lang"), F.lit("")), F.coalesce(tb.getField("lang"), F.lit(""))
        known = F.coalesce(sa, na.cast("string"), da.cast("string")).isNotNull() & F.coalesce(sb, nb.cast("string"), db.cast("string")).isNotNull()
        literals = (ta.getField("kind") == R.LITERAL) & (tb.getField("kind") == R.LITERAL)
        return (
            F.when(ta.isNull() | tb.isNull(), F.lit(None).cast("boolean"))
            .when(na.isNotNull() & nb.isNotNull(), na == nb)
            .when(da.isNotNull() & db.isNotNull(), da == db)
            .when(sa.isNotNull() & sb.isNotNull(), (sa == sb) & (la == lb))
            .when(identical, True)
            .when(literals & ~known, F.lit(None).cast("boolean"))
            .otherwise(False)
        )
    if a.kind in resources or b.kind in resources:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if same_term and (a.kind != b.kind):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return a.col == b.col
    if a.kind == b.kind:
        return a.col == b.col
    if {a.kind, b.kind} == {"date", "dateTime"}:
        return as_timestamp(a) == as_timestamp(b)
    if "boolean" in (a.kind, b.kind) and (a.kind in NUMERIC or b.kind in NUMERIC):
        return as_double(a) == as_double(b)
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
