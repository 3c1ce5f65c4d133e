"""Serialisations of results: XML, JSON (with callback), CSV, TSV, plain text and the Turtle result set of test suites.

lines() makes the lines of solutions in all tasks, by built-in functions, and write() puts them into a folder; serialise() gives the
whole document to one reader, head and foot included.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms as R

# Names of the formats.
FORMATS = {"sparql": "xml", "xml": "xml", "json": "json", "csv": "csv", "tsv": "tsv", "text": "tsv", "ascii": "tsv", "testcase": "testcase"}
MEDIA_TYPES = {"xml": "application/sparql-results+xml", "json": "application/sparql-results+json", "csv": "text/csv", "tsv": "text/tab-separated-values", "testcase": "text/turtle"}


def _marked(c: Column, marks: dict[str, str]) -> Column:
    for a, b in marks.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_XML = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}
_ATTRIBUTE = {**_XML, '"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"}
_TSV = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", '"': '\\"'}


def _csv_column(t: Column) -> Column:
    lex = F.when(t.getField("kind") == R.BNODE, F.concat(F.lit("_:"), t.getField("lex"))).otherwise(t.getField("lex"))
    quoted = F.concat(F.lit('"'), F.replace(lex, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(lex.rlike('[",\r\n]'), quoted).otherwise(lex), F.lit(""))


def _tsv_column(t: Column) -> Column:
    kind, lex, dt, lang = (t.getField(k) for k in ("kind", "lex", "dt", "lang"))
    text = F.concat(F.lit('"'), _marked(lex, _TSV), F.lit('"'))
    out = F.when(kind == R.IRI_KIND, F.concat(F.lit("<"), lex, F.lit(">"))).when(kind == R.BNODE, F.concat(F.lit("_:"), lex))
    out = out.when(dt == R.XSD_INTEGER, lex).when(dt == R.XSD_DECIMAL, F.when(lex.contains("."), lex).otherwise(F.concat(lex, F.lit(".0"))))
    out = out.when(dt == R.XSD_DOUBLE, F.when(F.lower(lex).rlike("e|inf"), lex).otherwise(F.concat(lex, F.lit("e0"))))
    out = out.when(lang.isNotNull(), F.concat(text, F.lit("@"), F.lower(lang))).when(dt.isNotNull(), F.concat(text, F.lit("^^<"), dt, F.lit(">")))
    return F.coalesce(out.otherwise(text), F.lit(""))


def _xml_column(name: str, t: Column) -> Column:
    kind, lex, dt, lang = t.getField("kind"), _marked(t.getField("lex"), _XML), t.getField("dt"), t.getField("lang")
    more = F.when(lang.isNotNull(), F.concat(F.lit(' xml:lang="'), _marked(F.lower(lang), _ATTRIBUTE), F.lit('"'))).when(dt.isNotNull(), F.concat(F.lit(' datatype="'), _marked(dt, _ATTRIBUTE), F.lit('"'))).otherwise(F.lit(""))
    body = F.when(kind == R.IRI_KIND, F.concat(F.lit("<uri>"), lex, F.lit("</uri>"))).when(kind == R.BNODE, F.concat(F.lit("<bnode>"), lex, F.lit("</bnode>"))).otherwise(F.concat(F.lit("<literal"), more, F.lit(">"), lex, F.lit("</literal>")))
    return F.when(t.isNotNull(), F.concat(F.lit(f"<binding name={quoteattr(name)}>"), body, F.lit("</binding>"))).otherwise(F.lit(""))


def _json_column(t: Column) -> Column:
    kind, lang = t.getField("kind"), t.getField("lang")
    name = F.when(kind == R.IRI_KIND, "uri").when(kind == R.BNODE, "bnode").otherwise("literal")
    dt = F.when((kind == R.LITERAL) & lang.isNull(), t.getField("dt"))
    return F.when(t.isNotNull(), F.struct(name.alias("type"), t.getField("lex").alias("value"), F.lower(lang).alias("xml:lang"), dt.alias("datatype")))


def lines(result, form: str) -> DataFrame:
    """DataFrame(value): a line of xml, json, csv or tsv for each solution, without head and foot."""
    kind, df = FORMATS[form], result.terms()
    at = {v: F.col(f"`{v}`") for v in result.variables}
    if kind == "csv":
        value = F.concat_ws(",", *map(_csv_column, at.values()))
    elif kind == "tsv":
        value = F.concat_ws("\t", *map(_tsv_column, at.values()))
    elif kind == "xml":
        value = F.concat(F.lit("<result>"), *(_xml_column(v, c) for v, c in at.items()), F.lit("</result>"))
    elif kind == "json":
        value = F.to_json(F.struct(*(_json_column(c).alias(v) for v, c in at.items())))
    else:
        raise ValueError(f"no lines of {form}")
    return df.select(value.alias("value"))


def write(result, path: str, form: str, mode: str = "errorifexists") -> None:
    """A folder of lines(), from all tasks, in the result's order."""
    lines(result, form).write.mode(mode).text(path)


def _rows(result) -> Iterator[list]:
    for r in result.terms().toLocalIterator():
        yield [r[i] for i in range(len(result.variables))]


def _answer(result) -> bool:
    return bool(result.rel.df.first()[0])


def serialise(result, form: str = "json", callback: str | None = None) -> Iterator[str]:
    kind = FORMATS.get(form)
    if kind is None:
        raise ValueError(f"unknown format {form}")
    return {"xml": _as_xml, "json": _as_json, "csv": _as_csv, "tsv": _as_tsv, "testcase": _as_testcase}[kind](result, callback)


def _as_xml(result, _) -> Iterator[str]:
    yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">'
    yield "<head>" + "".join(f"<variable name={quoteattr(v)}/>" for v in ([] if result.form == "ask" else result.variables)) + "".join(f"<!-- warning: {escape(w)} -->" for w in result.warnings) + "</head>"
    if result.form == "ask":
        yield f"<boolean>{str(_answer(result)).lower()}</boolean>"
    else:
        yield "<results>"
        for row in _rows(result):
            cells = []
            for v, t in zip(result.variables, row, strict=True):
                if t is None:
                    continue
                if t.kind == R.IRI_KIND:
                    body = f"<uri>{escape(t.lex)}</uri>"
                elif t.kind == R.BNODE:
                    body = f"<bnode>{escape(t.lex)}</bnode>"
                else:
                    extra = f" xml:lang={quoteattr(t.lang.lower())}" if t.lang else f" datatype={quoteattr(t.dt)}" if t.dt else ""
                    body = f"<literal{extra}>{escape(t.lex)}</literal>"
                cells.append(f"<binding name={quoteattr(v)}>{body}</binding>")
            yield "<result>" + "".join(cells) + "</result>"
        yield "</results>"
    yield "</sparql>"


def _json_term(t) -> dict:
    if t.kind == R.IRI_KIND:
        return {"type": "uri", "value": t.lex}
    if t.kind == R.BNODE:
        return {"type": "bnode", "value": t.lex}
    out = {"type": "literal", "value": t.lex}
    if t.lang:
        out["xml:lang"] = t.lang.lower()
    elif t.dt:
        out["datatype"] = t.dt
    return out


def _as_json(result, callback: str | None) -> Iterator[str]:
    if callback:
        yield f"{callback}("
    if result.form == "ask":
        yield json.dumps({"head": {}, "boolean": _answer(result)})
    else:
        head = {"vars": result.variables} | ({"warnings": result.warnings} if result.warnings else {})
        yield '{"head": ' + json.dumps(head) + ', "results": {"bindings": ['
        first = True
        for row in _rows(result):
            own = {v: _json_term(t) for v, t in zip(result.variables, row, strict=True) if t is not None}
            yield ("" if first else ",") + json.dumps(own, ensure_ascii=False)
            first = False
        yield "]}}"
    if callback:
        yield ");"


def _csv_cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\r\n') else text


def _as_csv(result, _) -> Iterator[str]:
    if result.form == "ask":
        yield str(_answer(result)).lower() + "\r\n"
        return
    yield ",".join(result.variables) + "\r\n"
    for row in _rows(result):
        yield ",".join("" if t is None else _csv_cell(("_:" if t.kind == R.BNODE else "") + t.lex) for t in row) + "\r\n"


def _tsv_term(t) -> str:
    """Numbers stand bare: a decimal always with a point, a double always with an exponent."""
    if t is None:
        return ""
    if t.kind == R.IRI_KIND:
        return f"<{t.lex}>"
    if t.kind == R.BNODE:
        return f"_:{t.lex}"
    if t.dt == R.XSD_INTEGER:
        return t.lex
    if t.dt == R.XSD_DECIMAL:
        return t.lex if "." in t.lex else t.lex + ".0"
    if t.dt == R.XSD_DOUBLE:
        return t.lex if "e" in t.lex.lower() or "inf" in t.lex.lower() else t.lex + "e0"
    text = t.lex.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace('"', '\\"')
    return f'"{text}"' + (f"@{t.lang.lower()}" if t.lang else f"^^<{t.dt}>" if t.dt else "")


def _as_tsv(result, _) -> Iterator[str]:
    if result.form == "ask":
        yield str(_answer(result)).lower() + "\n"
        return
    yield "\t".join("?" + v for v in result.variables) + "\n"
    for row in _rows(result):
        yield "\t".join(map(_tsv_term, row)) + "\n"
    for w in result.warnings:
        yield f"#WARNING: {w}\n"


def _as_testcase(result, _) -> Iterator[str]:
    yield "@prefix rs: <http://www.w3.org/2001/sw/DataAccess/tests/result-set#> .\n"
    if result.form == "ask":
        yield f"[] a rs:ResultSet ; rs:boolean {str(_answer(result)).lower()} .\n"
        return
    yield "[] a rs:ResultSet ;\n  " + "rs:resultVariable " + ", ".join(json.dumps(v) for v in result.variables) + "".join(
        " ;\n  rs:solution [ " + " ; ".join(f"rs:binding [ rs:variable {json.dumps(v)} ; rs:value {_tsv_term(t)} ]" for v, t in zip(result.variables, row, strict=True) if t is not None) + " ]" for row in _rows(result)
    ) + " .\n"
