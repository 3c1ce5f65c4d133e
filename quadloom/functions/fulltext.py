"""Full-text derivation: extra triples of tokens, stems and double metaphone codes.

Configured in the graph system:config by <predicate> text:index text:token, text:stem or text:dmetaphone. Tokens are made by
built-in functions; stems and codes by vectorised Python, once for each different token of a batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.functions.phonetic import double_metaphone
from quadloom.functions.stem import stem

TEXT = "urn:quadloom:text#"
INDEX, TOKEN, STEM, DMETAPHONE = TEXT + "index", TEXT + "token", TEXT + "stem", TEXT + "dmetaphone"
# Fixed value: the characters that part tokens.
BOUNDARY = r"""[ \n\t\r!@$%^&*()\-_=+\[\]{};:"\\|<>,./?#]+"""


def tokens(text: Column) -> Column:
    """The tokens of a text, as written."""
    return F.filter(F.split(text, BOUNDARY), lambda t: t != "")


@F.pandas_udf("string")
def _stems(word: pd.Series, lang: pd.Series) -> pd.Series:
    known = {(w, k): stem(w, k) for w, k in set(zip(word, lang, strict=True))}
    return pd.Series([known[x] for x in zip(word, lang, strict=True)])


@F.pandas_udf("array<string>")
def _codes(word: pd.Series) -> pd.Series:
    known = {w: list(dict.fromkeys(c for c in double_metaphone(w) if c)) for w in word.unique()}
    return word.map(known)


def stems(word: Column, lang: Column | None = None) -> Column:
    """The stem of a lower-case token; NULL for languages without a stemmer. No tag means English."""
    tag = F.lit("en") if lang is None else F.regexp_extract(F.coalesce(F.lower(lang), F.lit("en")), "^[a-z]*", 0)
    return _stems(word, tag)


def codes(word: Column) -> Column:
    """One or two double metaphone codes of a token."""
    return _codes(word)


def derived(quads: DataFrame, config: DataFrame) -> DataFrame:
    """The triples that the configuration derives from the literals of quads. config: few rows, one for each predicate and index."""
    rules = config.where((F.col("g") == R.CONFIG_GRAPH) & (F.col("p") == INDEX)).select(F.col("s.lex").alias("p"), F.col("o.lex").alias("kind")).distinct()
    text = quads.where(F.col("o.kind") == R.LITERAL).join(rules, "p").select("g", "s", "kind", F.col("o.lang").alias("lang"), F.explode(tokens(F.col("o.lex"))).alias("t"))
    plain = text.where(F.col("kind") == TOKEN).select("g", "s", "kind", F.lower("t").alias("t"))
    stemmed = text.where(F.col("kind") == STEM).select("g", "s", "kind", stems(F.lower("t"), F.col("lang")).alias("t")).where("t is not null")
    coded = text.where(F.col("kind") == DMETAPHONE).select("g", "s", "kind", F.explode(codes(F.col("t"))).alias("t"))
    out = plain.unionByName(stemmed).unionByName(coded).distinct()
    return out.select("g", "s", F.col("kind").alias("p"), V.term_struct(R.LITERAL, F.col("t")).alias("o")).to(R.QUADS)
