"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quadloom.llm import html_extract, language_id, learned_ann, media, ngram_join, packing, pii, secret_scan, sentencepiece_codec, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, m string, spans string, part int"
LONG = "word " * 3000 + "x" * 30000
PASSAGE = " ".join(f"w{i}" for i in range(60))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", len(t) if t else None, "clash", "clash", "clash", 7) for i, t, l in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, LONG, "en"), (5, "the house and the garden of the king", "en"), (6, "la maison et le jardin du roi", "fr")]
    rows += [(7, PASSAGE + " end one", "en"), (8, "start two " + PASSAGE, "en"), (9, "same text here of five words", "en"), (10, "same text here of five words", "en"), (10, "same text here of five words", "en"), (None, "no id here", "en")]
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


MODEL = {"secret": secret_scan.trained([("ordinary", 0), ("words", 0)] + [(s, 1) for s in secret_scan.random_strings(200)])}

OPERATORS = {
    "sentencepiece": sentencepiece_codec.encoded,
    "packing": packing.packed,
    "language": language_id.predicted,
    "pii": pii.scan,
    "substring": substring_dedup.deduplicated,
    "secrets": lambda d: secret_scan.scan(d, MODEL["secret"]),
    "media": lambda d: media.features(media.encoded(d)),
    "join": ngram_join.classes,
}
STAGES = {
    "language": language_id.accepted,
    "join": ngram_join.representatives,
    "substring": substring_dedup.cleaned,
    "secrets": lambda d: secret_scan.redacted(d, MODEL["secret"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_document(docs, empty, name):
    out = OPERATORS[name](docs)
    got = out.groupBy("doc_id").count().collect()
    counts = {r.doc_id: r["count"] for r in got}
    if name == "packing":
        assert {k for k, n in counts.items() if n >= 1} == {None, *range(1, 11)}
    else:
        assert counts == {None: 1, **dict.fromkeys(range(1, 10), 1), 10: 2}
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_the_columns(docs, empty, name):
    out = STAGES[name](docs)
    assert out.columns == docs.columns and out.where("k = 'clash' and part = 7").count() == out.count() > 0
    assert STAGES[name](empty).count() == 0 and STAGES[name](empty).columns == docs.columns


def test_vectors(spark):
    v = [(i, [float(i % 5), 1.0, float(i)], i) for i in range(30)]
    v += [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [1.0, None, 2.0], 0), (103, [float("nan"), 1.0, 1.0], 0), (104, [float("inf"), 1.0, 1.0], 0), (105, [1.0], 0), (106, [3.0, 1.0, 8.0], 0), (107, [3.0, 1.0, 8.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, part int")
    rows = learned_ann.search(df, df, 3).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {*range(30), 106, 107}
    assert [(r.vec_id, r.score) for r in rows if r.query_id == 8] == [(106, 0.0), (107, 0.0), (7, pytest.approx(2**0.5))]  # ties by id
    assert learned_ann.search(df.where("vec_id < 2"), df.where("vec_id < 2"), 10).count() == 2
    assert learned_ann.search(df.where("false"), df, 3).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "no markup &amp; so"), (4, "x", "<div>" * 500 + "deep" + "</div>" * 500), (5, "http://h/c", "<p>one<p>two" * 2000), (5, "http://h/c", "<p>one"), (6, "http://h/d", "<a title='unclosed <b>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("wrapper", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.n_chars): r.text for r in html_extract.extraction(df).collect()}
    assert len(got) == 7 and got[1, 0] == got[2, 0] == "" and got[3, 14] == "no markup & so" and got[4, 4] == "deep"
    assert html_extract.extraction(df.where("false")).count() == 0
