"""Tables as virtual graphs, by direct mapping: a row is a subject, a column a predicate, a foreign key an IRI.

A star of triples about one subject over one table is one scan with several columns. Key columns are kept as they are,
and IRIs are written out only where their text is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as R
from quadloom.functions import values as V
from quadloom.functions.values import Val
from quadloom.operators.relation import Rel

#: Kind and datatype of each Spark type that has one.
KINDS = {
    "int": ("integer", R.XSD_INT),
    "smallint": ("integer", R.XSD + "short"),
    "tinyint": ("integer", R.XSD + "byte"),
    "bigint": ("integer", None),
    "double": ("double", None),
    "float": ("double", R.XSD_FLOAT),
    "string": ("string", None),
    "boolean": ("boolean", None),
    "timestamp": ("dateTime", None),
    "timestamp_ntz": ("dateTime", None),
    "date": ("date", None),
}


def kind_of(dtype: str) -> tuple[str, str | None] | None:
    return ("decimal", None) if dtype.startswith("decimal") else KINDS.get(dtype)


@dataclass
class Table:
    """key: columns of the subject's IRI, none for a blank node for each row. foreign: column to table name.

    graph: column whose value names the row's graph. lang: text column to the column of its language tag.
    """

    name: str
    df: DataFrame
    key: tuple[str, ...] = ()
    foreign: dict[str, Table] = field(default_factory=dict)
    graph: str | None = None
    lang: dict[str, str] = field(default_factory=dict)
    prefix: str = "urn:t/"
    graph_prefix: str = "urn:g/"

    def __post_init__(self):
        self.kinds = {c: k for c, t in self.df.dtypes if c != "_row" and (k := kind_of(t))}
        self.class_iri = f"{self.prefix}{self.name}"
        self.predicates = {f"{self.class_iri}#{c}": c for c in self.kinds}
        self.template = f"{self.class_iri}/" + (f"#{len(self.key)}" if len(self.key) > 1 else "")

    def subject(self) -> Val:
        if self.key:
            col = F.col(self.key[0]) if len(self.key) == 1 else F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(self.key)))
            return Val(col, "iri", self.template)
        return Val(F.concat(F.lit(f"{self.name}."), F.col("_row")), "bnode")

    def column(self, name: str) -> Val:
        if name in self.foreign:
            other = self.foreign[name]
            return Val(F.col(name), "iri", other.template)
        if name in self.lang:
            c = F.col(name)
            return Val(F.when(c.isNotNull(), V.term_struct(R.LITERAL, c, None, F.upper(F.col(self.lang[name])))), "term")
        kind, dt = self.kinds[name]
        return Val(F.col(name), kind, datatype=dt)

    def rows(self, subject: bool = True) -> DataFrame:
        """The table; with the place of each row in its file where rows have no key and the subject is wanted."""
        if self.key or not subject or "_row" in self.df.columns:
            return self.df
        try:
            place = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
            return self.df.select("*", place.alias("_row"))
        except Exception:  # no file source below
            return self.df.withColumn("_row", F.xxhash64(*self.df.columns).cast("string"))

    def graph_value(self) -> Val:
        if self.graph is None:
            return Val(F.lit(R.DEFAULT_GRAPH), "iri")
        return Val(F.col(self.graph), "iri", self.graph_prefix)

    def without(self, hidden: DataFrame) -> Table:
        """The table as a reader sees it who may not see the graphs of hidden(g)."""
        hidden = hidden.select(F.col("g").alias("_hidden"))
        if self.graph is None:
            return replace(self, df=self.rows().join(hidden.where(F.col("_hidden") == R.DEFAULT_GRAPH).limit(1), F.lit(True), "left_anti"))
        return replace(self, df=self.rows().join(hidden, F.concat(F.lit(self.graph_prefix), F.col(self.graph)) == F.col("_hidden"), "left_anti"))

    def _matches(self, own: Val, wanted) -> Column:
        if isinstance(wanted, R.IRI):
            return V.key_equals(own, wanted.value) if own.template else V.iri_text(own) == wanted.value if own.kind == "iri" else F.lit(False)
        return F.coalesce(V.equal(own, V.of_literal(wanted)), F.lit(False)) if own.kind == "term" else V.equal(own, V.of_literal(wanted))

    def scan(self, subject, pairs: list[tuple], graph=None, sources: list[str] | None = None, default_only: bool = False) -> Rel:
        """Solutions of the star (subject p o) for pairs (p, o): one scan, whatever the number of pairs. subject: None if nothing reads it."""
        df, vals, conditions = self.rows(subject is not None), {}, []

        def bind(slot, own: Val) -> None:
            if isinstance(slot, R.Var):
                if slot.name in vals:
                    conditions.append(V.equal(vals[slot.name], own, same_term=True))
                else:
                    vals[slot.name] = own
            elif slot is not None:
                conditions.append(self._matches(own, slot))

        if isinstance(subject, R.Literal):
            conditions.append(F.lit(False))
        elif subject is not None:
            bind(subject, self.subject())
        if graph is not None and self.graph is None:
            conditions.append(F.lit(False))  # GRAPH never meets the default graph
            bind(graph, Val(F.lit(None).cast("string"), "iri"))
        elif graph is not None:
            bind(graph, self.graph_value())
        if default_only and graph is None and not sources and self.graph is not None:
            conditions.append(F.lit(False))
        if sources:
            own = self.graph_value()
            conditions.append(F.lit(R.DEFAULT_GRAPH in sources) if self.graph is None else V.iri_text(own).isin(sources))
        generic = [(p, o) for p, o in pairs if isinstance(p, R.Var)]
        for p, o in pairs:
            if isinstance(p, R.Var):
                continue
            if p.value == R.RDF_TYPE:
                bind(o, Val(F.lit(self.class_iri), "iri"))
            elif p.value in self.predicates:
                name = self.predicates[p.value]
                conditions.append(F.col(name).isNotNull())
                bind(o, self.column(name))
            else:
                conditions.append(F.lit(False))
                bind(o, V.error())
        for i, (p, o) in enumerate(generic):
            name = f"_po{i}"
            df = df.withColumn(name, F.explode(self.pairs()))
            bind(p, Val(F.col(f"{name}.p"), "iri"))
            bind(o, Val(F.col(f"{name}.o"), "term"))
        for c in conditions:
            df = df.where(c)
        return Rel.of(df, vals)

    def pairs(self) -> Column:
        """All (predicate, object) of a row as an array without unbound objects."""
        own = [F.struct(F.lit(iri).alias("p"), V.to_term(self.column(c)).alias("o")) for iri, c in self.predicates.items()]
        own.append(F.struct(F.lit(R.RDF_TYPE).alias("p"), V.to_term(Val(F.lit(self.class_iri), "iri")).alias("o")))
        return F.filter(F.array(*own), lambda x: x.getField("o").isNotNull())

    def quads(self) -> DataFrame:
        """The table as generic quads, predicate by predicate: a constant predicate leaves one branch that reads its column."""
        own = [(iri, self.column(c)) for iri, c in self.predicates.items()] + [(R.RDF_TYPE, Val(F.lit(self.class_iri), "iri"))]
        rows, g, s = self.rows(), V.iri_text(self.graph_value()).alias("g"), V.to_term(self.subject()).alias("s")
        parts = [rows.select(g, s, F.lit(iri).alias("p"), V.to_term(o).alias("o")).where("o is not null").to(R.QUADS) for iri, o in own]
        return reduce(DataFrame.unionAll, parts)


def star_schema(spark: SparkSession, folder: str, names: set[str] | None = None) -> dict[str, Table]:
    """The mapping of the driver's tables in a folder of parquet files; of names and what they refer to, if given."""
    # Keys, foreign keys, graphs and languages of the tables.
    keys = {
        "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (),
        "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",),
    }
    foreign = {
        "nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"},
        "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "events": {"user_id": "customer"}, "labels": {"doc_id": "documents"},
    }
    if names is not None:
        names, before = set(names), None
        while before != names:
            before = set(names)
            names |= {t for n in before for t in foreign.get(n, {}).values()}
    out: dict[str, Table] = {}
    for name, key in keys.items():
        if names is not None and name not in names:
            continue
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = Table(name, df, key, graph="event_type" if name == "events" else None, lang={"text": "lang"} if name == "documents" else {})
    for name, columns in foreign.items():
        if name in out:
            out[name].foreign = {c: out[t] for c, t in columns.items() if t in out}
    return out
