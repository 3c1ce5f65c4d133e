"""Access by graph: keys are triples of the configuration graph.

<graph> acl:onlyAccessBy "key" makes a graph private to its keys; <any> acl:admin "key" names keys that see all. Once
any such triple exists the configuration graph is for admins alone. There is no built-in key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms as R

ACL = "urn:quadloom:acl#"
ONLY_ACCESS_BY, ADMIN = ACL + "onlyAccessBy", ACL + "admin"


def rules_of(quads: DataFrame) -> DataFrame:
    """The triples that control access."""
    return quads.where((F.col("g") == R.CONFIG_GRAPH) & F.col("p").isin(ONLY_ACCESS_BY, ADMIN))


def hidden_graphs(quads: DataFrame, key: str | None) -> DataFrame:
    """The graphs that a reader with this key may not see, as DataFrame(g)."""
    rules = rules_of(quads).select(F.col("s.lex").alias("graph"), "p", F.col("o.lex").alias("key"))
    mine = F.col("key").eqNullSafe(F.lit(key))
    flags = rules.agg(F.coalesce(F.max((F.col("p") == ADMIN) & mine), F.lit(False)).alias("admin"), F.count(F.lit(1)).alias("n"))
    private = rules.where(F.col("p") == ONLY_ACCESS_BY).groupBy("graph").agg(F.max(mine).alias("open")).where("not open").select(F.col("graph").alias("g"))
    config = flags.where("n > 0").select(F.lit(R.CONFIG_GRAPH).alias("g"))
    return private.unionAll(config).crossJoin(flags.select("admin")).where("not admin").select("g").distinct()


def may_write(quads: DataFrame, key: str | None) -> bool:
    """Where access is controlled only admins may change graphs."""
    rules = rules_of(quads).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max((F.col("p") == ADMIN) & F.col("o.lex").eqNullSafe(F.lit(key))), F.lit(False)).alias("admin")).first()
    return rules.n == 0 or rules.admin
