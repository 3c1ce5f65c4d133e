"""The pipeline stage by stage, and its queries registered."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from quadloom.llm import text as X

SF = "/root/testdata/sf0.001"


def near_representatives(texts):
    """The least id of each class of texts that share 0.8 of their 5-word shingles, by brute force."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall("[^\x20\x09-\x0d]+", t)) else set() for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {root(d) for d in sets}


def test_names():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "substring_dedup", "secret_scan", "best_fit_packing"]


def test_stages(spark):
    docs = X.read(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = X.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "ngram_join":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in docs.collect()} == near_representatives(texts)
        before = docs
    assert docs.where("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.count()
    assert sorted(map(tuple, out.drop("sequence_id", "offset").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_query_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
