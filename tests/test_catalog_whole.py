"""Registered queries that read whole tables and whole values."""

import collections
import re

import duckdb

from quadloom.functions.stem import stem
from quadloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_whole_texts_are_encoded(spark):
    got = {r.id: r.e for r in QUERIES["fn_encode_uri"](spark, SF).collect()}
    assert got == dict(duckdb.sql(f"select item_id, url_encode(text) from '{SF}/benchmark.parquet'").fetchall())
    assert max(map(len, got.values())) > 120  # 40 characters are 120 signs at most, if each is one byte


def test_documents_of_every_language_are_stemmed(spark):
    words = collections.Counter()
    for lang, text in duckdb.sql(f"select lang, lower(text) from '{SF}/documents.parquet' where text is not null").fetchall():
        words.update((lang, t) for t in re.split(r"""[ \n\t\r!@$%^&*()\-_=+\[\]{};:"\\|<>,./?#]+""", text) if t)
    n, kinds = collections.Counter(), collections.Counter()
    for (lang, t), c in words.items():
        key = lang, stem(t, lang or "en")
        n[key] += c
        kinds[key] += 1
    got = {(r.lang, r.stem): (r.n, r.words) for r in QUERIES["ft_stem"](spark, SF).collect()}
    assert got == {k: (n[k], kinds[k]) for k in n} and {"en", "de", "es"} <= {lang for lang, _ in got}


def test_all_quads_are_written(spark):
    for name in ("write_ntriples", "write_trix", "write_rdfxml"):
        lines = [r.value for r in QUERIES[name](spark, SF).collect()]
        assert sorted(lines) == sorted(r[0] for r in duckdb.sql(ORACLES[name].replace("from region", f"from '{SF}/region.parquet'")).fetchall())
        assert len(lines) == 15
