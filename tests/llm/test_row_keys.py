"""Rows with null and shared ids in the pipeline's stages that compare documents."""

import pytest

from quadloom.llm import ngram_join, substring_dedup


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    near = words("near")
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (7, words("c")), (7, words("d")), (7, words("d")), (8, words("c")), (None, near + " one"), (None, near + " two"), (5, near + " three"), (None, None), (None, ""), (9, words("e"))]
    return spark.createDataFrame([(d, t, i, "clash") for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int, row string")


def test_null_and_shared_ids_stay(docs):
    got = sorted(r.n for r in ngram_join.representatives(docs).collect())
    # Rows that are equal in doc_id and text have the least row key; the others are told by doc_id.
    assert got == [0, 1, 3, 4, 9, 10, 11, 12]
    assert ngram_join.representatives(docs).columns == docs.columns


def test_links_of_nodes_without_an_id(spark):
    near = words("near")
    docs = spark.createDataFrame([(None, near + " one"), (None, near + " two"), (3, words("other"))], "doc_id long, text string")
    got = sorted((r.n_links, r.n_copies) for r in ngram_join.classes(docs).collect())
    assert got == [(0, 1), (1, 1), (1, 1)]
    assert ngram_join.representatives(docs).count() == 2


def test_passages_of_rows_without_an_id_or_with_a_shared_one(spark):
    rows = [(None, f"{words('x')} {words('p')}"), (None, f"{words('p')} {words('y')}"), (4, words("z", 80)), (4, f"{words('u')} {words('q')}"), (5, f"{words('q')} {words('v')}")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = {r.n: r.text for r in substring_dedup.cleaned(docs).collect()}
    assert got == {0: words("x"), 1: words("y"), 2: words("z", 80), 3: words("u"), 4: words("v")}


def removed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.deduplicated(docs).collect()), key=str)


def test_dedup_of_unlike_texts_under_one_id_and_of_rows_without_an_id(spark):
    rows = [(1, f"{words('l', 90)} {words('p')}"), (1, words("s", 3)), (2, words("p")), (3, words("w", 50)), (None, f"{words('p')} {words('n', 23)}")]
    assert removed(spark, rows) == sorted([(1, 130, 40), (1, 3, 0), (2, 40, 40), (3, 50, 0), (None, 63, 40)], key=str)


def test_dedup_starts_again_where_hashes_agree_and_texts_do_not(spark, monkeypatch):
    """With base 1 a word's hash is that of its letters in any order, so the two passages look alike until their texts are read."""
    one, two = " ".join(f"ab{i}cd" for i in range(100, 140)), " ".join(f"ba{i}dc" for i in range(100, 140))
    rows = [(1, one), (2, two), (3, f"x {words('p')}"), (4, f"{words('p')} y")]
    monkeypatch.setattr(substring_dedup, "BASES", (1, *substring_dedup.BASES))
    assert removed(spark, rows) == [(1, 40, 0), (2, 40, 0), (3, 41, 40), (4, 41, 40)]
    monkeypatch.setattr(substring_dedup, "BASES", (1,))
    with pytest.raises(RuntimeError):
        removed(spark, rows)


def test_dedup_of_a_crowded_passage(spark):
    rows = [(i, f"{words(f'd{i}x', 5)} {words('p')} {words(f'e{i}x', 5)}") for i in range(1500)] + [(2000, words("q") + " " + "r " * 40)]
    got = removed(spark, rows)
    assert [g for g in got if g[0] == 2000] == [(2000, 80, 40)] and all(g[1:] == (50, 40) for g in got if g[0] != 2000)
