"""Compiles expressions to typed columns of built-in functions; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.functions.values import NUMERIC, Val
from quadloom.plans.algebra import Aggregate, Call


class ExpressionError(ValueError):
    """An expression that the language does not have."""


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if "term" in (a.kind, b.kind):
        return _term_arithmetic(op, a, b)
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        return V.error()
    kind = "double" if "double" in (a.kind, b.kind) else "decimal" if "decimal" in (a.kind, b.kind) or op == "/" else "integer"
    x, y = a.col, b.col
    if kind == "double":
        x, y = x.cast("double"), y.cast("double")
    elif kind == "integer":
        x, y = x.cast("bigint"), y.cast("bigint")
    else:
        x, y = x.try_cast("decimal(20,10)"), y.try_cast("decimal(20,10)")
    call = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    return Val(call(x, y), kind, maybe=a.maybe or b.maybe or op == "/")


def _number_term(r: Column, whole: Column, exact: Column, real: Column) -> Column:
    """A numeric literal of the rank r."""
    text = exact.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    lex = F.when(r == 1, whole.cast("string")).when(r == 2, text).otherwise(real.cast("string"))
    dt = F.when(r == 1, R.XSD_INTEGER).when(r == 2, R.XSD_DECIMAL).when(r == 3, R.XSD_FLOAT).otherwise(R.XSD_DOUBLE)
    return F.when(r.isNotNull() & lex.isNotNull(), V.term_struct(R.LITERAL, lex, dt))


def _term_arithmetic(op: str, a: Val, b: Val) -> Val:
    call = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    ra, rb = V.rank(a), V.rank(b)
    r = F.when(ra.isNotNull() & rb.isNotNull(), F.greatest(ra, rb, F.lit(2 if op == "/" else 1)))
    la, lb = V.lexical(a), V.lexical(b)
    whole = call(la.try_cast("bigint"), lb.try_cast("bigint"))
    exact = call(la.try_cast("decimal(20,10)"), lb.try_cast("decimal(20,10)"))
    return Val(_number_term(r, whole, exact, call(V.as_double(a), V.as_double(b))), "term", maybe=True)


def _unary(name: str, a: Val) -> Val:
    if a.kind == "term":
        r, lex = V.rank(a), V.lexical(a)
        whole, exact, real = lex.try_cast("bigint"), lex.try_cast("decimal(38,18)"), V.as_double(a)
        return Val(_number_term(r, *(_rounded(name, c) for c in (whole, exact, real))), "term", maybe=True)
    if a.kind not in NUMERIC:
        return V.error()
    if a.kind == "integer" and name in ("round", "floor", "ceil", "u+"):
        return a
    return Val(_rounded(name, a.col), a.kind, maybe=a.maybe)


def _rounded(name: str, c: Column) -> Column:
    """round is half towards positive infinity."""
    if name == "abs":
        return F.abs(c)
    if name == "u-":
        return F.negative(c)
    if name == "u+":
        return c
    if name == "floor":
        return F.floor(c)
    if name == "ceil":
        return F.ceil(c)
    return F.floor(c + F.lit("0.5").cast("decimal(2,1)"))


def _keep(name: str, a: Val) -> Val:
    """A rounding keeps its argument's datatype."""
    out = _unary(name, a)
    if a.kind == "double" and name in ("round", "floor", "ceil"):
        c = a.col + 0.5 if name == "round" else a.col
        whole = F.ceil(c) if name == "ceil" else F.floor(c)
        big = F.abs(a.col) >= 4.5e15
        return Val(F.when(big | F.isnan(a.col), a.col).otherwise(whole.cast("double")), "double", maybe=a.maybe)
    return out


def compare(op: str, a: Val, b: Val) -> Column:
    less = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if "error" in (a.kind, b.kind):
        return _null("boolean")
    if a.kind in ("iri", "bnode") or b.kind in ("iri", "bnode"):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if "term" in (a.kind, b.kind):
        na, nb, sa, sb, da, db = V.as_double(a), V.as_double(b), V.as_string(a), V.as_string(b), V.as_timestamp(a), V.as_timestamp(b)
        return (
            F.when(na.isNotNull() & nb.isNotNull(), less(na, nb))
            .when(da.isNotNull() & db.isNotNull(), less(da, db))
            .when(sa.isNotNull() & sb.isNotNull(), less(sa, sb))
        )
    if a.kind in NUMERIC and b.kind in NUMERIC or a.kind == b.kind:
        return less(a.col, b.col)
    if {a.kind, b.kind} == {"date", "dateTime"}:
        return less(V.as_timestamp(a), V.as_timestamp(b))
    if "boolean" in (a.kind, b.kind) and (a.kind in NUMERIC or b.kind in NUMERIC):
        return less(V.as_double(a), V.as_double(b))
    return _null("boolean")


def _same_language(a: Val, b: Val) -> Column | None:
    """The argument compatibility rule: a tagged second argument needs the first's tag."""
    if "term" not in (a.kind, b.kind):
        return None
    la = a.col.getField("lang") if a.kind == "term" else _null("string")
    lb = b.col.getField("lang") if b.kind == "term" else _null("string")
    return lb.isNull() | F.coalesce(la == lb, F.lit(False))


def _string_map(a: Val, f) -> Val:
    """A string function whose result keeps the argument's language or datatype."""
    if a.kind == "string":
        return Val(f(a.col), "string", maybe=a.maybe)
    if a.kind != "term":
        return V.error()
    s = V.as_string(a)
    return Val(F.when(s.isNotNull(), V.term_struct(R.LITERAL, f(s), a.col.getField("dt"), a.col.getField("lang"))), "term", maybe=True)


def _cast(kind: str, a: Val) -> Val:
    lex = V.lexical(a)
    if a.kind in ("bnode", "error") or (a.kind == "iri" and kind != "string"):
        return V.error()
    literal = F.lit(True) if a.kind != "term" else a.col.getField("kind") == R.LITERAL
    if kind == "string":
        ok = F.lit(True) if a.kind != "term" else a.col.getField("kind") != R.BNODE
        return Val(F.when(ok, lex) if a.kind == "term" else lex, "string", maybe=a.maybe)
    if kind == "double":
        col = a.col.cast("double") if a.kind in NUMERIC else V.as_double(a) if a.kind == "boolean" else lex.try_cast("double")
    elif kind == "decimal":
        col = a.col.try_cast("decimal(38,18)") if a.kind in NUMERIC else V.as_double(a).try_cast("decimal(38,18)") if a.kind == "boolean" else lex.try_cast("decimal(38,18)")
    elif kind == "integer":
        col = a.col.try_cast("bigint") if a.kind in (*NUMERIC, "boolean") else lex.try_cast("decimal(38,18)").try_cast("bigint")
    elif kind == "boolean":
        n = V.as_double(a)
        col = a.col if a.kind == "boolean" else (n != 0) if a.kind in NUMERIC else F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False).when(n.isNotNull(), n != 0)
    elif kind == "dateTime":
        col = V.as_timestamp(a) if a.kind in ("dateTime", "date") else lex.try_cast("timestamp").cast("timestamp_ntz")
    else:
        col = a.col.cast("date") if a.kind in ("dateTime", "date") else lex.try_cast("date")
    return Val(F.when(literal, col) if a.kind == "term" else col, kind, maybe=True)


CASTS = {R.XSD_DOUBLE: "double", R.XSD_FLOAT: "double", R.XSD_DECIMAL: "decimal", R.XSD_INTEGER: "integer", R.XSD_INT: "integer", R.XSD_STRING: "string", R.XSD_DATETIME: "dateTime", R.XSD_BOOLEAN: "boolean", R.XSD_DATE: "date"}


def union_kind(vals: list[Val]) -> list[Val]:
    """Values brought to one kind: their own if all agree, else the generic term."""
    own = [v for v in vals if v.kind != "error"]
    if not own:
        return vals
    first = own[0]
    if all(v.kind == first.kind and v.template == first.template for v in own):
        return [v if v.kind != "error" else Val(F.lit(None), first.kind, first.template, True) for v in vals]
    if all(v.kind in NUMERIC for v in own):
        kind = "double" if any(v.kind == "double" for v in own) else "decimal"
        to = "double" if kind == "double" else "decimal(38,18)"
        return [Val(v.col.try_cast(to) if v.kind != "error" else _null(to), kind, maybe=v.maybe) for v in vals]
    if all(v.kind == "iri" for v in own):
        return [Val(V.iri_text(v) if v.kind != "error" else _null("string"), "iri", maybe=v.maybe) for v in vals]
    return [V.as_term(v) for v in vals]


class Compiler:
    """Expressions over a scope of variables. aggregates: columns of aggregates that were computed before."""

    def __init__(self, scope: dict[str, Val], aggregates: dict[Aggregate, Val] | None = None):
        self.scope, self.aggregates = scope, aggregates or {}

    def __call__(self, e) -> Val:
        if isinstance(e, R.Var):
            return self.scope.get(e.name) or V.error()
        if isinstance(e, (R.IRI, R.Literal)):
            return V.of_term(e)
        if isinstance(e, Aggregate):
            if e not in self.aggregates:
                raise ExpressionError("an aggregate outside SELECT, HAVING and ORDER BY")
            return self.aggregates[e]
        return self.call(e)

    def truth(self, e) -> Column:
        return V.ebv(self(e))

    def boolean(self, c: Column) -> Val:
        return Val(c, "boolean", maybe=True)

    def call(self, e: Call) -> Val:
        name, args = e.name, e.args
        if name in ("&&", "||"):
            a, b = self.truth(args[0]), self.truth(args[1])
            return self.boolean(a & b if name == "&&" else a | b)
        if name == "!":
            return self.boolean(~self.truth(args[0]))
        if name == "bound":
            v = self.scope.get(args[0].name)
            return Val(v.col.isNotNull() if v else F.lit(False), "boolean")
        if name == "if":
            test = self.truth(args[0])
            a, b = union_kind([self(args[1]), self(args[2])])
            return Val(F.when(test.isNotNull(), F.when(test, a.col).otherwise(b.col)), a.kind if a.kind != "error" else b.kind, a.template, True)
        if name == "coalesce":
            vals = union_kind([self(a) for a in args])
            return Val(F.coalesce(*(v.col for v in vals)), vals[0].kind, vals[0].template, all(v.maybe for v in vals))
        if name in ("in", "notin"):
            first = self(args[0])
            hit = F.lit(False)
            plain = [a for a in args[1:] if isinstance(a, R.Literal) and not a.lang and V.of_literal(a).kind == first.kind]
            if plain and len(plain) == len(args) - 1:  # an isin reaches the scan
                hit = F.coalesce(first.col.isin(*(V.of_literal(a).col for a in plain)), F.lit(False)) if first.maybe else first.col.isin(*(V.of_literal(a).col for a in plain))
            else:
                for a in args[1:]:
                    hit |= F.coalesce(self.equality(first, a), F.lit(False))
            return self.boolean(~hit if name == "notin" else hit)
        if name in ("=", "!="):
            c = self.equality(self(args[0]), args[1]) if not isinstance(args[0], R.IRI) else self.equality(self(args[1]), args[0])
            return self.boolean(~c if name == "!=" else c)
        vals = [self(a) for a in args]
        if name in ("<", ">", "<=", ">="):
            return self.boolean(compare(name, *vals))
        if name in ("+", "-", "*", "/") and len(vals) == 2:
            return arithmetic(name, *vals)
        if name in ("u+", "u-"):
            return _unary(name, vals[0])
        if name in CASTS:
            return _cast(CASTS[name], vals[0])
        if name in ("~~", "!~~"):
            c = self.regex(vals[0], args[1], None)
            return self.boolean(c if name == "~~" else ~c)
        if name == "regex":
            return self.boolean(self.regex(vals[0], args[1], args[2] if len(args) > 2 else None))
        found = getattr(self, "f_" + name.replace("-", "_"), None)
        if found is None:
            raise ExpressionError(f"unknown function {name}")
        return found(*vals)

    def equality(self, a: Val, other) -> Column:
        if isinstance(other, R.IRI) and a.kind == "iri" and a.template is not None:
            return V.key_equals(a, other.value)
        return V.equal(a, self(other))

    def regex(self, a: Val, pattern, flags) -> Column:
        text = V.as_string(a)
        on = "".join(c for c in flags.lex if c in "smix") if isinstance(flags, R.Literal) else ""
        if isinstance(pattern, R.Literal):
            return text.rlike((f"(?{on})" if on else "") + pattern.lex)
        return F.regexp_like(text, F.concat(F.lit(f"(?{on})" if on else ""), V.as_string(self(pattern))))

    # Numbers

    f_abs = lambda self, a: _unary("abs", a)
    f_ceil = lambda self, a: _keep("ceil", a)
    f_floor = lambda self, a: _keep("floor", a)
    f_round = lambda self, a: _keep("round", a)

    def f_rand(self) -> Val:
        return Val(F.rand(), "double")

    # Terms

    def _kind_test(self, a: Val, kind: int, static: str) -> Val:
        if a.kind == "term":
            return self.boolean(a.col.getField("kind") == kind)
        is_it = (a.kind == static) if static else a.kind not in ("iri", "bnode")
        return self.boolean(F.when(a.col.isNotNull(), F.lit(is_it)))

    def f_isiri(self, a: Val) -> Val:
        return self._kind_test(a, R.IRI_KIND, "iri")

    f_isuri = f_isiri

    def f_isblank(self, a: Val) -> Val:
        return self._kind_test(a, R.BNODE, "bnode")

    def f_isliteral(self, a: Val) -> Val:
        return self._kind_test(a, R.LITERAL, "")

    def f_isnumeric(self, a: Val) -> Val:
        if a.kind == "term":
            return self.boolean(F.when(a.col.isNotNull(), F.coalesce(V.rank(a).isNotNull() & V.as_double(a).isNotNull(), F.lit(False))))
        return self.boolean(F.when(a.col.isNotNull(), F.lit(a.kind in NUMERIC)))

    def f_sameterm(self, a: Val, b: Val) -> Val:
        return self.boolean(V.equal(a, b, same_term=True))

    def f_str(self, a: Val) -> Val:
        return _cast("string", a)

    def f_lang(self, a: Val) -> Val:
        if a.kind == "term":
            return Val(F.when(a.col.getField("kind") == R.LITERAL, F.coalesce(a.col.getField("lang"), F.lit(""))), "string", maybe=True)
        return Val(F.when(a.col.isNotNull(), F.lit("")), "string", maybe=a.maybe) if a.kind not in ("iri", "bnode", "error") else V.error()

    def f_langmatches(self, a: Val, b: Val) -> Val:
        x, y = F.lower(V.as_string(a)), F.lower(V.as_string(b))
        return self.boolean(F.when(y == "*", x != "").otherwise((x == y) | x.startswith(F.concat(y, F.lit("-")))))

    def f_datatype(self, a: Val) -> Val:
        if a.kind == "term":
            plain = (a.col.getField("kind") == R.LITERAL) & a.col.getField("lang").isNull()
            return Val(F.when(plain, F.coalesce(a.col.getField("dt"), F.lit(R.XSD_STRING))), "iri", maybe=True)
        if a.kind in ("iri", "bnode", "error"):
            return V.error()
        return Val(F.when(a.col.isNotNull(), F.lit(a.datatype or V.DATATYPES.get(a.kind, R.XSD_STRING))), "iri", maybe=a.maybe)

    def f_iri(self, a: Val) -> Val:
        return a if a.kind == "iri" else Val(_cast("string", a).col, "iri", maybe=a.maybe)

    f_uri = f_iri

    def f_bnode(self, a: Val | None = None) -> Val:
        row = F.monotonically_increasing_id().cast("string")
        return Val(F.concat(F.lit("b"), F.md5(F.concat_ws(":", V.lexical(a), row)) if a else F.md5(row)), "bnode")

    def f_strlang(self, a: Val, b: Val) -> Val:
        return Val(F.when(V.as_string(a).isNotNull() & V.as_string(b).isNotNull(), V.term_struct(R.LITERAL, V.as_string(a), None, F.upper(V.as_string(b)))), "term", maybe=True)

    def f_strdt(self, a: Val, b: Val) -> Val:
        return Val(F.when(V.as_string(a).isNotNull(), V.term_struct(R.LITERAL, V.as_string(a), V.lexical(b))), "term", maybe=True)

    def f_uuid(self) -> Val:
        return Val(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri")

    def f_struuid(self) -> Val:
        return Val(F.uuid(), "string")

    # Strings

    def f_strlen(self, a: Val) -> Val:
        return Val(F.length(V.as_string(a)).cast("bigint"), "integer", maybe=a.maybe)

    def f_substr(self, a: Val, start: Val, length: Val | None = None) -> Val:
        at = F.greatest(V.as_double(start).try_cast("int"), F.lit(1))
        n = V.as_double(length).try_cast("int") if length is not None else F.lit(2**31 - 1)
        return _string_map(a, lambda s: F.substring(s, at, n))

    f_substring = f_substr

    def f_ucase(self, a: Val) -> Val:
        return _string_map(a, F.upper)

    def f_lcase(self, a: Val) -> Val:
        return _string_map(a, F.lower)

    def _pair(self, a: Val, b: Val, f) -> Val:
        ok, c = _same_language(a, b), f(V.as_string(a), V.as_string(b))
        return self.boolean(c if ok is None else F.when(ok, c))

    def f_strstarts(self, a: Val, b: Val) -> Val:
        return self._pair(a, b, F.startswith)

    def f_strends(self, a: Val, b: Val) -> Val:
        return self._pair(a, b, F.endswith)

    def f_contains(self, a: Val, b: Val) -> Val:
        return self._pair(a, b, F.contains)

    def _around(self, a: Val, b: Val, f) -> Val:
        y, ok = V.as_string(b), _same_language(a, b)
        out = _string_map(a, lambda s: f(s, y))
        return out if ok is None else out.at(F.when(ok, out.col))

    def f_strbefore(self, a: Val, b: Val) -> Val:
        return self._around(a, b, lambda s, y: F.when(F.position(y, s) > 0, F.substring(s, F.lit(1), F.position(y, s) - 1)).when(y.isNotNull() & s.isNotNull(), F.lit("")))

    def f_strafter(self, a: Val, b: Val) -> Val:
        return self._around(a, b, lambda s, y: F.when(F.position(y, s) > 0, F.substring(s, F.position(y, s) + F.length(y), F.length(s))).when(y.isNotNull() & s.isNotNull(), F.lit("")))

    def f_concat(self, *vals: Val) -> Val:
        return Val(F.concat(*(V.as_string(v) for v in vals)) if vals else F.lit(""), "string", maybe=any(v.maybe for v in vals))

    def f_encode_for_uri(self, a: Val) -> Val:
        out = F.replace(F.replace(F.replace(F.url_encode(V.as_string(a)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return Val(out, "string", maybe=a.maybe)

    def f_replace(self, a: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
        on = F.concat(F.lit("(?"), V.as_string(flags), F.lit(")")) if flags is not None else F.lit("")
        return _string_map(a, lambda s: F.regexp_replace(s, F.concat(on, V.as_string(pattern)), V.as_string(by)))

    # Hashes

    def f_md5(self, a: Val) -> Val:
        return Val(F.md5(V.as_string(a)), "string", maybe=a.maybe)

    def f_sha1(self, a: Val) -> Val:
        return Val(F.sha1(V.as_string(a)), "string", maybe=a.maybe)

    def _sha2(self, a: Val, bits: int) -> Val:
        return Val(F.sha2(V.as_string(a), bits), "string", maybe=a.maybe)

    f_sha224 = lambda self, a: self._sha2(a, 224)
    f_sha256 = lambda self, a: self._sha2(a, 256)
    f_sha384 = lambda self, a: self._sha2(a, 384)
    f_sha512 = lambda self, a: self._sha2(a, 512)

    # Dates

    def _date_part(self, a: Val, f, at: int, n: int) -> Val:
        """The part as written, without a shift to UTC."""
        if a.kind == "term":
            written = F.when(V.as_timestamp(a).isNotNull(), F.substring(a.col.getField("lex"), at, n).try_cast("bigint"))
            return Val(written, "integer", maybe=True)
        return Val(f(a.col).cast("bigint"), "integer", maybe=a.maybe) if a.kind in ("dateTime", "date") else V.error()

    f_year = lambda self, a: self._date_part(a, F.year, 1, 4)
    f_month = lambda self, a: self._date_part(a, F.month, 6, 2)
    f_day = lambda self, a: self._date_part(a, F.dayofmonth, 9, 2)

    def _time_part(self, a: Val, f) -> Val:
        return Val(f(V.as_timestamp(a)).cast("bigint"), "integer", maybe=True) if a.kind in ("dateTime", "date", "term") else V.error()

    f_hours = lambda self, a: self._time_part(a, F.hour)
    f_minutes = lambda self, a: self._time_part(a, F.minute)
    f_seconds = lambda self, a: self._time_part(a, F.second)

    def f_tz(self, a: Val) -> Val:
        return V.error()

    f_timezone = f_tz

    def f_now(self) -> Val:
        return Val(F.current_timestamp().cast("timestamp_ntz"), "dateTime")

    def f_from_unixtime(self, a: Val) -> Val:
        return Val(F.timestamp_seconds(V.as_double(a).try_cast("bigint")).cast("timestamp_ntz"), "dateTime", maybe=a.maybe)

    def f_to_unixtime(self, a: Val) -> Val:
        return Val(F.unix_timestamp(V.as_timestamp(a).cast("timestamp")), "integer", maybe=a.maybe)

