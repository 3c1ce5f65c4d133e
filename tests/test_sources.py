"""Syntaxes, serialisations, the store, full text and streaming."""

import json
import xml.etree.ElementTree as ET

from quadloom.engine import Engine
from quadloom.functions.phonetic import double_metaphone
from quadloom.functions.stem import english, stem
from quadloom.sources import rdf
from quadloom.sources.store import Store
from quadloom.streaming.ingest import ingest, quad_stream

NT = r"""# comment
<urn:a> <urn:p> "tab\there \"q\" \\ é \U0001F600" .
<urn:a> <urn:p> "x"@en-GB .
_:b <urn:q> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .
<urn:a> <urn:q> _:b .
broken line
<urn:a> <urn:p> <urn:c> <urn:g> .
"""


def values(df):
    return sorted((r.g, r.s.lex if r.s.kind != 1 else "_", r.p, r.o.lex if r.o.kind != 1 else "_", r.o.dt, r.o.lang) for r in df.collect())


def test_lines(spark, tmp_path):
    (tmp_path / "x.nq").write_text(NT)
    got = values(rdf.read(spark, str(tmp_path / "x.nq")))
    assert len(got) == 5
    assert ("default:", "urn:a", "urn:p", 'tab\there "q" \\ é 😀', None, None) in got
    assert ("default:", "urn:a", "urn:p", "x", None, "EN-GB") in got
    assert ("urn:g", "urn:a", "urn:p", "urn:c", None, None) in got


def test_round_trips(spark, tmp_path):
    quads = rdf.from_text(spark, NT, "nquads").cache()
    again = rdf.parsed_lines(rdf.lines(quads, "nquads"))
    assert values(again) == values(quads)
    default = quads.where("g = 'default:'")
    assert values(rdf.from_text(spark, "\n".join(rdf.rdfxml_document(default)), "rdfxml")) == values(default)
    assert values(rdf.from_text(spark, "\n".join(rdf.trix_document(quads)), "trix")) == values(quads)
    rdf.write(quads, str(tmp_path / "out.nq"))
    assert values(rdf.read(spark, str(tmp_path / "out.nq"))) == values(quads)


def test_turtle_and_rdfxml(spark, tmp_path):
    text = '@prefix : <urn:x#> .\n@base <urn:base/> .\n:a :p 1, 2.5, 1e3, true, """long "text\n""" ; :q [ :r (1 2) ] ; a :C .\nPREFIX y: <urn:y#>\ny:s y:p "a"^^y:t .'
    got = values(rdf.from_text(spark, text))
    assert len(got) == 13 and ("default:", "urn:x#a", "urn:x#p", 'long "text\n', None, None) in got
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="urn:x#" xml:lang="en">
      <x:C rdf:about="urn:a" x:attr="v"><x:p rdf:resource="urn:b"/><x:q rdf:datatype="urn:t">5</x:q><x:r rdf:parseType="Resource"><x:s>t</x:s></x:r></x:C></rdf:RDF>"""
    (tmp_path / "a.rdf").write_text(xml)
    assert len(values(rdf.read(spark, str(tmp_path / "a.rdf")))) == 6


def test_labels_are_scoped_by_document(spark, tmp_path):
    (tmp_path / "1.ttl").write_text("_:x <urn:p> 1 .")
    (tmp_path / "2.ttl").write_text("_:x <urn:p> 1 .")
    assert rdf.read(spark, str(tmp_path / "*.ttl")).select("s").distinct().count() == 2


def test_result_formats(spark):
    e = Engine(spark, {}, rdf.from_text(spark, '<urn:a> <urn:p> "x, \\"y\\"", 1.0, "z"@en .'))
    r = e.query("SELECT ?s ?o ?n WHERE { ?s <urn:p> ?o OPTIONAL { ?s <urn:none> ?n } } ORDER BY ?o")
    made = {f: "".join(r.serialise(f)) for f in ("sparql", "json", "csv", "tsv", "text", "testcase")}
    assert len(json.loads(made["json"])["results"]["bindings"]) == 3
    assert len(list(ET.fromstring(made["sparql"])[1])) == 3
    assert 'urn:a,"x, ""y""",\r\n' in made["csv"] and "\r\n" in made["csv"]
    assert "<urn:a>\t1.0\t\n" in made["tsv"] and '"z"@en' in made["tsv"]
    assert made["testcase"].count("rs:solution") == 3
    assert "".join(r.serialise("json", "f")).startswith("f(")
    assert json.loads("".join(e.query("ASK { ?s ?p ?o }").serialise("json")))["boolean"] is True


def test_store(spark, tmp_path):
    (tmp_path / "in.ttl").write_text("<urn:a> <urn:p> 1, 2 .")
    s = Store(spark, "file://" + str(tmp_path / "store"))
    assert s.load("file://" + str(tmp_path / "in.ttl"), dry_run=True) == 2 and s.version() is None
    first = s.load("file://" + str(tmp_path / "in.ttl"))
    s.update("INSERT DATA { <urn:a> <urn:p> 2, 3 }")
    assert s.version() != first and s.quads().count() == 3
    assert s.query("SELECT ?o WHERE { <urn:a> <urn:p> ?o }").df.count() == 3
    assert s.vacuum() == 1 and s.quads().count() == 3


def test_appends_write_what_is_new(spark, tmp_path, monkeypatch):
    s = Store(spark, "file://" + str(tmp_path / "store"))
    row = lambda i: f'<urn:a{i}> <urn:p{i % 2}> "{i}" .'
    quads = lambda *ids: rdf.from_text(spark, "\n".join(map(row, ids)))
    s.append(quads(1, 2, 3))
    s.append(quads(2, 3, 4))
    folders = s.version().split("\n")
    assert len(folders) == 2 and s.quads().count() == 4
    assert spark.read.parquet(f"{s.path}/{folders[1]}").count() == 1
    s.append(quads(1, 4))  # nothing new
    assert s.quads().count() == 4 and s.vacuum() == 0
    monkeypatch.setattr("quadloom.sources.store.MOST_FOLDERS", 3)
    s.append(quads(5))
    assert len(s.version().split("\n")) == 1 and s.quads().count() == 5 and s.vacuum() == 3


def test_text_index(spark, tmp_path):
    (tmp_path / "c.trig").write_text("<system:config> { <urn:t> <urn:quadloom:text#index> <urn:quadloom:text#token>, <urn:quadloom:text#stem>, <urn:quadloom:text#dmetaphone> }")
    (tmp_path / "d.ttl").write_text('<urn:a> <urn:t> "Running, the races!"@en ; <urn:u> "other" .')
    s = Store(spark, "file://" + str(tmp_path / "store"))
    s.load("file://" + str(tmp_path / "c.trig"))
    s.load("file://" + str(tmp_path / "d.ttl"))
    got = {(r.p[len("urn:quadloom:text#") :], r.o.lex) for r in s.quads().where("s.lex = 'urn:a' and p like '%text#%'").collect()}
    assert {("token", "running"), ("token", "the"), ("token", "races"), ("stem", "run"), ("stem", "race"), ("dmetaphone", "RNNK")} <= got
    assert s.query("SELECT ?x WHERE { ?x <urn:quadloom:text#stem> 'run' }").df.count() == 1


def test_other_languages():
    expected = {
        "de": {"aufeinanderfolgende": "aufeinanderfolg", "kategorischen": "kategor", "häuser": "haus", "freundlichkeit": "freundlich", "wissenschaften": "wissenschaft"},
        "sv": {"jaktkarlarne": "jaktkarl", "friskt": "frisk"},
        "no": {"havnedistriktene": "havnedistrikt", "opningene": "opning"},
        "da": {"indtage": "indtag", "husene": "hus"},
        "es": {"torear": "tor", "toreado": "tor", "cheques": "chequ", "rápidamente": "rapid", "naciones": "nacion"},
        "fr": {"maison": None},
    }
    for lang, words in expected.items():
        for w, x in words.items():
            assert stem(w, lang) == x, (lang, w, stem(w, lang))


def test_stems_and_codes():
    # Examples of the published descriptions.
    expected = {"consign": "consign", "consigned": "consign", "consisting": "consist", "consistency": "consist", "knightly": "knight", "hopping": "hop", "hoping": "hope", "relational": "relat", "skies": "sky", "generously": "generous", "ponies": "poni", "cats": "cat", "troubles": "troubl", "bed": "bed", "happy": "happi", "say": "say"}
    assert {w: english(w) for w in expected} == expected
    codes = {"Smith": ("SM0", "XMT"), "Schmidt": ("XMT", "SMT"), "Thomas": ("TMS", "TMS"), "Knight": ("NFT", "NXT")}
    assert double_metaphone("Smith") == codes["Smith"] and double_metaphone("Schmidt") == codes["Schmidt"] and double_metaphone("Thomas") == codes["Thomas"]
    assert double_metaphone("Knight")[0][:1] == "N" and double_metaphone("") == ("", "")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.nt").write_text("<urn:a> <urn:p> <urn:b> .\n<urn:a> <urn:p> <urn:b> .\n")
    store = Store(spark, "file://" + str(tmp_path / "store"))
    for n in (1, 2):
        q = ingest(store, quad_stream(spark, str(tmp_path / "in")), "file://" + str(tmp_path / "check"))
        q.awaitTermination()
        assert store.quads().count() == n
        (tmp_path / "in" / "2.nt").write_text("<urn:c> <urn:p> <urn:d> .\n")
