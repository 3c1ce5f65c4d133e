"""The training words of the secret model."""

import itertools
import string

from quadloom.llm import secret_scan


def test_all_words_of_the_sample_train(spark):
    words = ["".join(p) for p in itertools.product(string.ascii_lowercase, repeat=3)]
    words += [w.upper() for w in words] + [w.title() for w in words]
    docs = spark.createDataFrame([(i, " ".join(words[i::10])) for i in range(10)], "doc_id long, text string")
    got = {w for w, secret in secret_scan.labelled_samples(docs) if not secret}
    assert len(words) > 50000 and set(words) <= got
