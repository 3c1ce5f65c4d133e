"""The driver's queries: one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.sources.mapping import star_schema

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations embeddings".split()
PREFIXES = {"t": "urn:t/", "g": "urn:g/", **{t: f"urn:t/{t}#" for t in TABLES}}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, names: set[str], **options) -> Engine:
    return Engine(spark, star_schema(spark, sf_dir, names), prefixes=PREFIXES, **options)


def names_in(text: str) -> set[str]:
    return {t for t in TABLES if re.search(rf"\b{t}:|t:{t}\b|urn:t/{t}/", text)}


def sparql(name: str, text: str, oracle: str | None, materialised: bool = False, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir, names_in(text), **options)
        return (own.materialised() if materialised else own).select(text)

    run.__name__, run.__doc__, run.text = name, text, text
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes with the application; only a local session may have no such folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quadloom")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


# Patterns, filters, bindings

sparql(
    "flagship",
    """SELECT ?seg (COUNT(?price) AS ?n) (ROUND(SUM(?price * (1 - ?disc)) * 100) / 100 AS ?revenue) WHERE {
         ?l lineitem:l_orderkey ?o ; lineitem:l_extendedprice ?price ; lineitem:l_discount ?disc ; lineitem:l_quantity ?q .
         ?o orders:o_custkey ?c ; orders:o_orderstatus "F" . ?c customer:c_mktsegment ?seg FILTER(?q > 10)
       } GROUP BY ?seg ORDER BY DESC(?n) ?seg LIMIT 5""",
    """select c_mktsegment seg, count(*) n, floor(sum(l_extendedprice*(1-l_discount))*100+0.5)/100 revenue from lineitem join orders on l_orderkey=o_orderkey
       join customer on o_custkey=c_custkey where o_orderstatus='F' and l_quantity>10 group by 1 order by n desc, seg limit 5""",
)
sparql("bgp_star", "SELECT ?k ?name ?bal WHERE { ?c customer:c_custkey ?k ; customer:c_name ?name ; customer:c_acctbal ?bal }", "select c_custkey k, c_name name, c_acctbal bal from customer")
sparql("bgp_join_fk", "SELECT ?n ?r WHERE { ?x nation:n_name ?n ; nation:n_regionkey ?y . ?y region:r_name ?r }", "select n_name n, r_name r from nation join region on n_regionkey=r_regionkey")
sparql(
    "bgp_three_hop",
    'SELECT ?okey ?price WHERE { ?l lineitem:l_orderkey ?o ; lineitem:l_extendedprice ?price . ?o orders:o_custkey ?c ; orders:o_orderkey ?okey . ?c customer:c_mktsegment "BUILDING" }',
    "select l_orderkey okey, l_extendedprice price from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey where c_mktsegment='BUILDING'",
)
sparql("const_object", 'SELECT ?k WHERE { ?o orders:o_orderstatus "O" ; orders:o_orderkey ?k }', "select o_orderkey k from orders where o_orderstatus='O'")
sparql("const_subject", "SELECT ?name ?r WHERE { <urn:t/nation/7> nation:n_name ?name ; nation:n_regionkey ?r }", "select n_name as name, 'urn:t/region/'||n_regionkey r from nation where n_nationkey=7")
sparql("const_fk_object", "SELECT ?k WHERE { ?c customer:c_nationkey <urn:t/nation/3> ; customer:c_custkey ?k }", "select c_custkey k from customer where c_nationkey=3")
sparql("repeat_var", "SELECT ?k WHERE { ?x labels:doc_id ?d ; labels:quality ?k ; labels:toxic ?k }", "select quality k from labels where quality=toxic")
sparql("type_pattern", "SELECT ?n WHERE { ?x a t:region ; region:r_name ?n }", "select r_name n from region")
sparql("subject_iri", "SELECT ?x ?n WHERE { ?x region:r_name ?n }", "select 'urn:t/region/'||r_regionkey x, r_name n from region")
sparql("composite_key", "SELECT ?x ?role WHERE { ?x conversations:role ?role }", "select 'urn:t/conversations/'||conv_id||'/'||turn x, role from conversations")
sparql("star_intersection", 'SELECT ?k WHERE { ?p part:p_size 10 ; part:p_partkey ?k ; part:p_type ?t FILTER(STRSTARTS(?t, "S")) }', "select p_partkey k from part where p_size=10 and starts_with(p_type,'S')")
sparql("bnode_subject_optional", "SELECT (COUNT(?q) AS ?n) (COUNT(?t) AS ?m) WHERE { ?l lineitem:l_quantity ?q OPTIONAL { ?l lineitem:l_tax ?t FILTER(?t > 0.04) } }", "select count(l_quantity) n, count(case when l_tax>0.04 then 1 end) m from lineitem")
sparql("filter_cmp", "SELECT ?k ?p WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?p FILTER(?p >= 100000 && ?p < 200000.5) }", "select o_orderkey k, o_totalprice p from orders where o_totalprice>=100000 and o_totalprice<200000.5")
sparql("filter_bool", 'SELECT ?k WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b ; customer:c_mktsegment ?s FILTER(!(?b < 0 || ?s = "BUILDING") && ?k != 5) }', "select c_custkey k from customer where not (c_acctbal<0 or c_mktsegment='BUILDING') and c_custkey<>5")
sparql("filter_in", 'SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:o_orderpriority ?p FILTER(?p IN ("1-URGENT", "2-HIGH")) }', "select o_orderkey k from orders where o_orderpriority in ('1-URGENT','2-HIGH')")
sparql("filter_not_in", 'SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:o_orderstatus ?p FILTER(?p NOT IN ("F", "O")) }', "select o_orderkey k from orders where o_orderstatus not in ('F','O')")
sparql("filter_disjunct_eq", 'SELECT ?k ?seg WHERE { ?c customer:c_custkey ?k ; customer:c_mktsegment ?seg FILTER(?seg = "BUILDING" || ?seg = "MACHINERY") }', "select c_custkey k, c_mktsegment seg from customer where c_mktsegment in ('BUILDING','MACHINERY')")
sparql("filter_iri_eq", "SELECT ?k WHERE { ?c customer:c_custkey ?k ; customer:c_nationkey ?n FILTER(?n = <urn:t/nation/4>) }", "select c_custkey k from customer where c_nationkey=4")
sparql("filter_regex_flags", 'SELECT ?k ?t WHERE { ?p part:p_partkey ?k ; part:p_type ?t FILTER(REGEX(?t, "^small|BRASS$", "i")) }', "select p_partkey k, p_type t from part where regexp_matches(p_type,'^small|BRASS$','i')")
sparql("filter_match_operator", 'SELECT ?k WHERE { ?c customer:c_custkey ?k ; customer:c_name ?n FILTER(?n ~~ "7$") }', "select c_custkey k from customer where regexp_matches(c_name,'7$')")
sparql("filter_theta_join", "SELECT ?a ?b WHERE { ?x region:r_regionkey ?a . ?y region:r_regionkey ?b FILTER(?a < ?b) }", "select x.r_regionkey a, y.r_regionkey b from region x, region y where x.r_regionkey<y.r_regionkey")
sparql("bind_expr", "SELECT ?k ?v ?w WHERE { ?p part:p_partkey ?k ; part:p_size ?s BIND(?s * 2 AS ?v) BIND(?v + 1 AS ?w) }", "select p_partkey k, cast(p_size*2 as bigint) v, cast(p_size*2+1 as bigint) w from part")
sparql("project_expr", "SELECT ?k (?p * 2 AS ?d) (?d + 1 AS ?e) WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?p }", "select o_orderkey k, o_totalprice*2 d, o_totalprice*2+1 e from orders")
sparql("select_star", "SELECT * WHERE { ?x region:r_regionkey ?k ; region:r_name ?n }", "select 'urn:t/region/'||r_regionkey x, r_regionkey k, r_name n from region")

# Joins and sets

sparql("optional", "SELECT ?k ?e WHERE { ?c customer:c_custkey ?k OPTIONAL { ?v events:user_id ?c ; events:event_id ?e } }", "select c_custkey k, event_id e from customer left join events on user_id=c_custkey")
sparql(
    "optional_filter",
    "SELECT ?id ?lang ?q WHERE { ?d documents:lang ?lang ; documents:doc_id ?id OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?q FILTER(?q = 1) } }",
    "select d.doc_id id, d.lang, l.quality q from documents d left join labels l on l.doc_id=d.doc_id and l.quality=1",
)
sparql(
    "optional_filter_outer",
    "SELECT ?id ?q WHERE { ?d documents:doc_id ?id ; documents:n_chars ?n OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?q FILTER(?n > 1000) } }",
    "select d.doc_id id, l.quality q from documents d left join labels l on l.doc_id=d.doc_id and d.n_chars>1000",
)
sparql(
    "optional_nested",
    "SELECT ?k ?e ?w WHERE { ?c customer:c_custkey ?k OPTIONAL { ?v events:user_id ?c ; events:event_id ?e OPTIONAL { ?v events:value ?w FILTER(?w > 50) } } }",
    "select c_custkey k, event_id e, case when value>50 then value end w from customer left join events on user_id=c_custkey",
)
sparql(
    "optional_shared_var",
    "SELECT ?id ?v WHERE { ?d documents:doc_id ?id OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?v } OPTIONAL { ?y labels:doc_id ?d ; labels:toxic ?v } }",
    "select d.doc_id id, coalesce(l.quality,l.toxic) v from documents d left join labels l on l.doc_id=d.doc_id",
)
sparql("optional_no_lhs", "SELECT ?n WHERE { OPTIONAL { ?x region:r_name ?n FILTER(?n = \"none\") } }", "select cast(null as varchar) n")
sparql(
    "join_maybe_unbound",
    "SELECT ?id ?q ?n WHERE { { ?d documents:doc_id ?id OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?q } } { ?r region:r_regionkey ?q ; region:r_name ?n } }",
    "select d.doc_id id, coalesce(l.quality, r.r_regionkey) q, r_name n from documents d left join labels l on l.doc_id=d.doc_id join region r on l.quality is null or l.quality=r.r_regionkey",
)
sparql("union_two", "SELECT ?k WHERE { { ?c customer:c_custkey ?k } UNION { ?s supplier:s_suppkey ?k } }", "select c_custkey k from customer union all select s_suppkey from supplier")
sparql("union_pad", "SELECT ?b ?e WHERE { { ?c customer:c_acctbal ?b } UNION { ?s supplier:s_acctbal ?e } }", "select c_acctbal b, cast(null as double) e from customer union all select null, s_acctbal from supplier")
sparql(
    "union_filter",
    "SELECT ?n WHERE { { ?x nation:n_name ?n ; nation:n_nationkey ?k FILTER(?k < 3) } UNION { ?y region:r_name ?n } UNION { ?z supplier:s_name ?n ; supplier:s_suppkey ?j FILTER(?j = 1) } }",
    "select n_name n from nation where n_nationkey<3 union all select r_name from region union all select s_name from supplier where s_suppkey=1",
)
sparql("minus", "SELECT ?k WHERE { ?c customer:c_custkey ?k MINUS { ?e events:user_id ?c } }", "select c_custkey k from customer where not exists (select 1 from events where user_id=c_custkey)")
sparql("minus_filter", "SELECT ?k WHERE { ?c customer:c_custkey ?k MINUS { ?e events:user_id ?c ; events:value ?v FILTER(?v > 90) } }", "select c_custkey k from customer where not exists (select 1 from events where user_id=c_custkey and value>90)")
sparql("minus_disjoint", "SELECT ?r ?n WHERE { ?x region:r_regionkey ?r ; region:r_name ?n MINUS { ?y nation:n_name ?z } }", "select r_regionkey r, r_name n from region")
sparql(
    "minus_union_chain",
    'SELECT ?k WHERE { ?o orders:o_orderkey ?k MINUS { ?o orders:o_orderstatus "F" } MINUS { { ?o orders:o_orderpriority "1-URGENT" } UNION { ?l lineitem:l_orderkey ?o ; lineitem:l_returnflag "R" } } }',
    "select o_orderkey k from orders where o_orderstatus<>'F' and o_orderpriority<>'1-URGENT' and not exists (select 1 from lineitem where l_orderkey=o_orderkey and l_returnflag='R')",
)
sparql("cross_blocks", "SELECT ?r ?n WHERE { { ?x region:r_name ?r } { ?y nation:n_name ?n } }", "select r_name r, n_name n from region, nation")
sparql("distinct", "SELECT DISTINCT ?s ?p WHERE { ?o orders:o_orderstatus ?s ; orders:o_orderpriority ?p }", "select distinct o_orderstatus s, o_orderpriority p from orders")
sparql("distinct_semi", 'SELECT DISTINCT ?seg WHERE { ?c customer:c_mktsegment ?seg . ?o orders:o_custkey ?c ; orders:o_orderstatus "P" }', "select distinct c_mktsegment seg from customer where exists (select 1 from orders where o_custkey=c_custkey and o_orderstatus='P')")
sparql("reduced", "SELECT REDUCED ?n WHERE { ?x region:r_name ?n }", "select r_name n from region")
sparql("ask", 'ASK { ?c customer:c_mktsegment "BUILDING" ; customer:c_acctbal ?b FILTER(?b > 5000) }', "select count(*)>0 answer from customer where c_mktsegment='BUILDING' and c_acctbal>5000")
sparql("ask_none", 'ASK { ?c customer:c_mktsegment "NONE" }', "select false answer")


def lexical_quads(quads: DataFrame) -> DataFrame:
    return quads.select("g", F.col("s.lex").alias("s"), "p", F.col("o.kind").cast("int").alias("k"), F.col("o.lex").alias("o"))


@query("select 'default:' g, 'urn:t/nation/'||n_nationkey s, 'urn:x/in' p, 2 k, 'urn:t/region/'||n_regionkey o from nation union all select 'default:', 'urn:t/region/'||r_regionkey, 'urn:x/name', 3, r_name from region")
def construct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, {"nation"})
    return lexical_quads(own.query("CONSTRUCT { ?n <urn:x/in> ?r . ?r <urn:x/name> ?name . ?name <urn:x/bad> ?n } WHERE { ?n nation:n_regionkey ?r . ?r region:r_name ?name }"))


@query(
    """select 'default:' g, 'urn:t/nation/'||n_nationkey s, unnest(['urn:t/nation#n_name','urn:t/nation#n_nationkey','urn:t/nation#n_regionkey','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) p,
       unnest([3,3,2,2]) k, unnest([n_name, cast(n_nationkey as varchar), 'urn:t/region/'||n_regionkey, 'urn:t/nation']) o from nation where n_regionkey=1"""
)
def describe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_quads(engine(spark, sf_dir, {"nation"}).query("DESCRIBE ?n WHERE { ?n nation:n_regionkey <urn:t/region/1> }"))


# Aggregates, order

sparql("agg_count_star", "SELECT (COUNT(*) AS ?n) WHERE { ?l lineitem:l_quantity ?q }", "select count(*) n from lineitem")
sparql("agg_group", "SELECT ?seg (COUNT(?c) AS ?n) WHERE { ?c customer:c_mktsegment ?seg } GROUP BY ?seg", "select c_mktsegment seg, count(*) n from customer group by 1")
sparql("agg_count_distinct", "SELECT ?status (COUNT(DISTINCT ?cust) AS ?n) WHERE { ?o orders:o_orderstatus ?status ; orders:o_custkey ?cust } GROUP BY ?status", "select o_orderstatus status, count(distinct o_custkey) n from orders group by 1")
sparql("agg_sum_distinct", "SELECT (SUM(DISTINCT ?s) AS ?a) (COUNT(DISTINCT ?s) AS ?b) WHERE { ?p part:p_size ?s }", "select cast(sum(distinct p_size) as bigint) a, count(distinct p_size) b from part")
sparql(
    "agg_sum_avg_min_max",
    "SELECT ?f (ROUND(SUM(?q)) AS ?s) (ROUND(AVG(?p) * 100) / 100 AS ?a) (MIN(?p) AS ?lo) (MAX(?d) AS ?hi) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_quantity ?q ; lineitem:l_extendedprice ?p ; lineitem:l_shipdate ?d } GROUP BY ?f",
    "select l_returnflag f, floor(sum(l_quantity)+0.5) s, floor(avg(l_extendedprice)*100+0.5)/100 a, min(l_extendedprice) lo, max(l_shipdate) hi from lineitem group by 1",
)
sparql("agg_int_sum", "SELECT ?b (SUM(?s) AS ?n) WHERE { ?p part:p_brand ?b ; part:p_size ?s } GROUP BY ?b", "select p_brand b, cast(sum(p_size) as bigint) n from part group by 1")
sparql("agg_empty", "SELECT (COUNT(?b) AS ?n) (SUM(?b) AS ?total) (AVG(?b) AS ?mean) WHERE { ?c customer:c_acctbal ?b FILTER(?b > 1e12) }", "select count(c_acctbal) n, coalesce(sum(c_acctbal),0) total, avg(c_acctbal) mean from customer where c_acctbal>1e12")
sparql("agg_empty_group", "SELECT ?s (COUNT(?b) AS ?n) WHERE { ?c customer:c_acctbal ?b ; customer:c_mktsegment ?s FILTER(?b > 1e12) } GROUP BY ?s", "select c_mktsegment s, count(*) n from customer where c_acctbal>1e12 group by 1")
sparql(
    "agg_poison",
    "SELECT ?lang (SUM(?q) AS ?s) (COUNT(?q) AS ?n) WHERE { ?d documents:lang ?lang OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?q } } GROUP BY ?lang",
    "select lang, case when count(*)=count(quality) then cast(sum(quality) as bigint) end s, count(quality) n from documents d left join labels l on l.doc_id=d.doc_id group by 1",
)
sparql("agg_min_iri", "SELECT (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) WHERE { ?c customer:c_nationkey ?n }", "select min('urn:t/nation/'||c_nationkey) lo, max('urn:t/nation/'||c_nationkey) hi from customer")
sparql("agg_sample_min", "SELECT ?s (SAMPLE(?s) AS ?t) (MIN(?k) AS ?m) WHERE { ?o orders:o_orderstatus ?s ; orders:o_orderkey ?k } GROUP BY ?s", "select o_orderstatus s, o_orderstatus t, min(o_orderkey) m from orders group by 1")
sparql("group_concat", 'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?names) WHERE { ?x nation:n_regionkey ?y ; nation:n_name ?n . ?y region:r_name ?r } GROUP BY ?r', "select r_name r, string_agg(n_name, ', ' order by n_name) as names from nation join region on n_regionkey=r_regionkey group by 1")
sparql("having", "SELECT ?nation (COUNT(?c) AS ?n) WHERE { ?c customer:c_nationkey ?x . ?x nation:n_nationkey ?nation } GROUP BY ?nation HAVING(COUNT(?c) > 50)", "select c_nationkey nation, count(*) n from customer group by 1 having count(*)>50")
sparql("group_multi", "SELECT ?f ?s (COUNT(*) AS ?n) WHERE { ?l lineitem:l_returnflag ?f ; lineitem:l_linestatus ?s } GROUP BY ?f ?s", "select l_returnflag f, l_linestatus s, count(*) n from lineitem group by 1,2")
sparql("group_expr", "SELECT ?y (COUNT(?o) AS ?n) WHERE { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "select year(o_orderdate) y, count(*) n from orders group by 1")
sparql("agg_arith", "SELECT ?s (xsd:double(SUM(?k)) / COUNT(?k) * 2 AS ?v) (COUNT(*) + 1 AS ?n) WHERE { ?o orders:o_orderstatus ?s ; orders:o_orderkey ?k BIND(1 AS ?one) } GROUP BY ?s ORDER BY ?s", "select o_orderstatus s, sum(o_orderkey)::double/count(*)*2 v, count(*)+1 n from orders group by 1")
sparql("distinct_group", "SELECT DISTINCT (MAX(?k) > 10 AS ?big) WHERE { ?c customer:c_nationkey ?x ; customer:c_custkey ?k } GROUP BY ?x", "select distinct max(c_custkey)>10 big from customer group by c_nationkey")
sparql("order_limit", "SELECT ?k ?b WHERE { ?c customer:c_custkey ?k ; customer:c_acctbal ?b } ORDER BY DESC(?b) ?k LIMIT 20", "select c_custkey k, c_acctbal b from customer order by b desc, k limit 20")
sparql("order_offset", "SELECT ?k ?p WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 10 OFFSET 5", "select o_orderkey k, o_totalprice p from orders order by p desc, k limit 10 offset 5")
sparql("order_unbound_first", "SELECT ?id ?q WHERE { ?d documents:doc_id ?id OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?q } } ORDER BY ?q ?id LIMIT 15", "select d.doc_id id, quality q from documents d left join labels l on l.doc_id=d.doc_id order by q nulls first, id limit 15")
sparql("order_alias", "SELECT ?k (?p / 2 AS ?h) WHERE { ?o orders:o_orderkey ?k ; orders:o_totalprice ?p } ORDER BY ?h ?k LIMIT 7", "select o_orderkey k, o_totalprice/2 h from orders order by h, k limit 7")
sparql("topk", "SELECT ?t (COUNT(?e) AS ?n) WHERE { ?e events:user_id ?u . ?u customer:c_custkey ?t } GROUP BY ?t ORDER BY DESC(?n) ?t LIMIT 10", "select user_id t, count(*) n from events join customer on user_id=c_custkey group by 1 order by n desc, t limit 10")

# Scalar functions

sparql("fn_arith", "SELECT ?k (?a + ?s AS ?x) (?a - 1 AS ?y) (-?a AS ?z) (?s * ?s AS ?w) WHERE { ?p part:p_partkey ?k ; part:p_retailprice ?a ; part:p_size ?s }", "select p_partkey k, p_retailprice+p_size x, p_retailprice-1 y, -p_retailprice z, cast(p_size as bigint)*p_size w from part")
sparql("fn_div", "SELECT ?k (xsd:double(?s / 4) AS ?x) (?a / 2 AS ?y) (BOUND(?z) AS ?b) WHERE { ?p part:p_partkey ?k ; part:p_retailprice ?a ; part:p_size ?s BIND(?s / 0 AS ?z) }", "select p_partkey k, p_size/4 x, p_retailprice/2 y, false b from part")
sparql("fn_round_floor_ceil_abs", "SELECT ?k (ROUND(?b) AS ?r) (FLOOR(?b) AS ?f) (CEIL(?b) AS ?c) (ABS(?b) AS ?a) WHERE { ?x customer:c_custkey ?k ; customer:c_acctbal ?b }", "select c_custkey k, floor(c_acctbal+0.5) r, floor(c_acctbal) f, ceil(c_acctbal) c, abs(c_acctbal) a from customer")
sparql("fn_casts", 'SELECT ?k (xsd:integer(?b) AS ?i) (xsd:string(?k) AS ?s) (xsd:double("1e2") AS ?d) (xsd:boolean(?k) AS ?t) (xsd:integer("x") AS ?e) WHERE { ?x customer:c_custkey ?k ; customer:c_acctbal ?b }', "select c_custkey k, cast(trunc(c_acctbal) as bigint) i, cast(c_custkey as varchar) s, 100.0::double d, c_custkey<>0 t, cast(null as bigint) e from customer")
sparql("fn_string_case", "SELECT ?k (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) WHERE { ?x part:p_partkey ?k ; part:p_name ?n }", "select p_partkey k, upper(p_name) u, lower(p_name) l from part")
sparql("fn_substr", "SELECT ?k (SUBSTR(?n, 3) AS ?a) (SUBSTR(?n, 2, 4) AS ?b) (SUBSTR(?n, -1, 2) AS ?c) WHERE { ?x customer:c_custkey ?k ; customer:c_name ?n }", "select c_custkey k, substr(c_name,3) a, substr(c_name,2,4) b, substr(c_name,1,2) c from customer")
sparql(
    "fn_before_after",
    'SELECT ?k (STRBEFORE(?p, "-") AS ?b) (STRAFTER(?p, "-") AS ?a) (STRAFTER(?p, "#") AS ?e) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderpriority ?p }',
    "select o_orderkey k, case when instr(o_orderpriority,'-')>0 then substr(o_orderpriority,1,instr(o_orderpriority,'-')-1) else '' end b, case when instr(o_orderpriority,'-')>0 then substr(o_orderpriority,instr(o_orderpriority,'-')+1) else '' end a, '' e from orders",
)
sparql("fn_starts_ends_contains", 'SELECT ?k (STRSTARTS(?n, "Cust") AS ?a) (STRENDS(?n, "1") AS ?b) (CONTAINS(?n, "00") AS ?c) WHERE { ?x customer:c_custkey ?k ; customer:c_name ?n }', "select c_custkey k, starts_with(c_name,'Cust') a, ends_with(c_name,'1') b, contains(c_name,'00') c from customer")
sparql("fn_concat", 'SELECT ?k (CONCAT(?n, "/", ?s) AS ?x) WHERE { ?x customer:c_custkey ?k ; customer:c_name ?n ; customer:c_mktsegment ?s }', "select c_custkey k, c_name||'/'||c_mktsegment x from customer")
sparql("fn_strlen", "SELECT ?id (STRLEN(?t) AS ?n) WHERE { ?d documents:doc_id ?id ; documents:text ?t }", "select doc_id id, length(text) n from documents")
sparql("fn_encode_uri", "SELECT ?id (ENCODE_FOR_URI(?t) AS ?e) WHERE { ?b benchmark:item_id ?id ; benchmark:text ?t }", "select item_id id, url_encode(text) e from benchmark")
sparql("fn_hashes", "SELECT ?k (MD5(?n) AS ?a) (SHA256(?n) AS ?b) (SHA1(?n) AS ?c) WHERE { ?x customer:c_custkey ?k ; customer:c_name ?n }", "select c_custkey k, md5(c_name) a, sha256(c_name) b, sha1(c_name) c from customer")
sparql("fn_dates", "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) (SECONDS(?d) AS ?s) WHERE { ?e events:event_id ?k ; events:ts ?d }", "select event_id k, year(ts) y, month(ts) m, day(ts) a, hour(ts) h, minute(ts) i, second(ts) s from events")
sparql("fn_date_compare", 'SELECT ?k WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d FILTER(?d < "1998-01-01T00:00:00"^^xsd:dateTime) }', "select o_orderkey k from orders where o_orderdate<timestamp '1998-01-01'")
sparql("fn_if_coalesce_bound", 'SELECT ?id (IF(?q = 1, "good", "bad") AS ?i) (COALESCE(?q, -1) AS ?c) (BOUND(?q) AS ?b) WHERE { ?d documents:doc_id ?id OPTIONAL { ?x labels:doc_id ?d ; labels:quality ?q } }', "select d.doc_id id, case when quality=1 then 'good' when quality is not null then 'bad' end i, coalesce(quality,-1) c, quality is not null b from documents d left join labels l on l.doc_id=d.doc_id")
sparql("fn_term_tests", "SELECT ?k (ISIRI(?n) AS ?a) (ISBLANK(?n) AS ?b) (ISLITERAL(?k) AS ?c) (ISNUMERIC(?k) AS ?d) (SAMETERM(?n, <urn:t/nation/3>) AS ?e) WHERE { ?c customer:c_custkey ?k ; customer:c_nationkey ?n }", "select c_custkey k, true a, false b, true c, true d, c_nationkey=3 e from customer")
sparql("fn_lang_datatype", 'SELECT ?id (LANG(?t) AS ?l) (DATATYPE(?id) AS ?dt) (LANGMATCHES(LANG(?t), "en") AS ?m) WHERE { ?d documents:doc_id ?id ; documents:text ?t }', "select doc_id id, upper(lang) l, 'http://www.w3.org/2001/XMLSchema#integer' dt, lang='en' m from documents")
sparql("fn_unixtime", "SELECT ?k (TO-UNIXTIME(?d) AS ?u) (FROM-UNIXTIME(86400) AS ?f) WHERE { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d }", "select o_orderkey k, cast(epoch(o_orderdate) as bigint) u, timestamp '1970-01-02' f from orders")
sparql("fn_constructors", 'SELECT ?k (STR(IRI(CONCAT("urn:x/", ?n))) AS ?i) (LANG(STRLANG(?n, "de")) AS ?l) (STR(DATATYPE(STRDT(?n, xsd:date))) AS ?d) WHERE { ?c region:r_regionkey ?k ; region:r_name ?n }', "select r_regionkey k, 'urn:x/'||r_name i, 'DE' l, 'http://www.w3.org/2001/XMLSchema#date' d from region")
sparql("fn_uuid_rand", 'SELECT ?k (STRLEN(STRUUID()) AS ?n) (STRSTARTS(STR(UUID()), "urn:uuid:") AS ?u) (RAND() < 1 AS ?r) WHERE { ?c region:r_regionkey ?k }', "select r_regionkey k, 36 n, true u, true r from region")
sparql("fn_now_bnode", "SELECT ?k (NOW() = NOW() AS ?n) (ISBLANK(BNODE(?m)) AS ?b) WHERE { ?c region:r_regionkey ?k ; region:r_name ?m }", "select r_regionkey k, true n, true b from region")

# Generic quads and graphs

sparql("pred_var", "SELECT ?n ?p (STR(?v) AS ?x) WHERE { ?n a t:nation ; ?p ?v }", """select 'urn:t/nation/'||n_nationkey n, unnest(['urn:t/nation#n_name','urn:t/nation#n_nationkey','urn:t/nation#n_regionkey','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) p,
  unnest([n_name, cast(n_nationkey as varchar), 'urn:t/region/'||n_regionkey, 'urn:t/nation']) x from nation""")
sparql("pred_distinct", "SELECT DISTINCT ?p WHERE { ?s ?p ?o . ?s region:r_name ?n }", "select unnest(['urn:t/region#r_regionkey','urn:t/region#r_name','http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) p")
sparql("graph_var", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?e events:value ?v } } GROUP BY ?g", "select 'urn:g/'||event_type g, count(*) n from events group by 1")
sparql("graph_const", "SELECT ?k WHERE { GRAPH g:click { ?e events:event_id ?k } }", "select event_id k from events where event_type='click'")
sparql("graph_list", "SELECT ?g WHERE { GRAPH ?g { } ?x events:event_id 1 }", "select distinct 'urn:g/'||event_type g from events")
sparql("from_clause", "SELECT (COUNT(?k) AS ?n) FROM g:click FROM g:view WHERE { ?e events:event_id ?k }", "select count(*) n from events where event_type in ('click','view')")
sparql("from_named", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED g:error WHERE { GRAPH ?g { ?e events:value ?v } } GROUP BY ?g", "select 'urn:g/error' g, count(*) n from events where event_type='error'")
sparql("quads_star_join", "SELECT (STR(?n) AS ?name) (STR(?r) AS ?region) WHERE { ?x nation:n_name ?n ; nation:n_regionkey ?y . ?y region:r_name ?r }", "select n_name as name, r_name region from nation join region on n_regionkey=r_regionkey", materialised=True)
sparql("quads_mixed_arith", "SELECT (STR(?k) AS ?key) (STR(?k + 1) AS ?next) (STR(ABS(?k - 3)) AS ?d) WHERE { ?x region:r_regionkey ?k FILTER(?k >= 1) }", "select cast(r_regionkey as varchar) as key, cast(r_regionkey+1 as varchar) as next, cast(abs(r_regionkey-3) as varchar) d from region where r_regionkey>=1", materialised=True)
sparql("quads_optional_minus", 'SELECT (STR(?n) AS ?name) (STR(?z) AS ?big) WHERE { ?x nation:n_name ?n ; nation:n_nationkey ?k OPTIONAL { ?x nation:n_nationkey ?z FILTER(?z > 20) } MINUS { ?x nation:n_regionkey <urn:t/region/2> } }', "select n_name as name, case when n_nationkey>20 then cast(n_nationkey as varchar) end big from nation where n_regionkey<>2", materialised=True)
sparql("quads_order_mixed", "SELECT (STR(?o) AS ?v) WHERE { <urn:t/nation/5> ?p ?o } ORDER BY ?o", "select unnest(['urn:t/nation', 'urn:t/region/'||n_regionkey, cast(n_nationkey as varchar), n_name]) v from nation where n_nationkey=5", materialised=True)
sparql("quads_min_max_mixed", "SELECT (STR(MIN(?o)) AS ?lo) (STR(MAX(?o)) AS ?hi) (COUNT(?o) AS ?n) WHERE { ?s ?p ?o . ?s a t:region }", "select 'urn:t/region' lo, cast(max(r_regionkey) as varchar) hi, 3*count(*) n from region", materialised=True)


# Updates, on a materialised copy of a table


def _triples(spark: SparkSession, sf_dir: str, table: str) -> Engine:
    return engine(spark, sf_dir, {table}).materialised()


@query("select count(*) n, 2 m from region")
def insert_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'INSERT DATA { <urn:t/region/0> <urn:x/tag> "a", "b", "a" . "no" <urn:x/tag> "c" . GRAPH g:new { <urn:t/region/0> <urn:x/tag> "a" } }'
    own = _triples(spark, sf_dir, "region").update(text)
    tags = own.select("SELECT (COUNT(?t) AS ?c) FROM <default:> WHERE { ?s <urn:x/tag> ?t }").selectExpr("cast(c as int) m")
    return own.select("SELECT (COUNT(DISTINCT ?r) AS ?n) WHERE { ?r region:r_name ?x }").crossJoin(tags)


@query("select r_name n from region where r_regionkey<>2")
def delete_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _triples(spark, sf_dir, "region").update('DELETE DATA { <urn:t/region/2> region:r_regionkey "2"^^xsd:int }')
    return own.select("SELECT (STR(?x) AS ?n) WHERE { ?r region:r_name ?x ; region:r_regionkey ?k }")


@query("select case when event_type='error' then 'failure' else event_type end t, count(*) n from events group by 1")
def delete_insert_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _triples(spark, sf_dir, "events")
    own = own.update('DELETE { GRAPH ?g { ?e events:event_type ?t } } INSERT { GRAPH ?g { ?e events:event_type "failure" } } WHERE { GRAPH ?g { ?e events:event_type ?t } FILTER(?t = "error") }')
    return own.select("SELECT (STR(?x) AS ?t) (COUNT(?e) AS ?n) WHERE { ?e events:event_type ?x } GROUP BY ?x")


@query("select 'urn:g/'||event_type g, count(*) n from events where event_type<>'click' group by 1")
def clear_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _triples(spark, sf_dir, "events")
    return own.update("CREATE GRAPH g:other; CLEAR GRAPH g:click").select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?e events:event_type ?t } } GROUP BY ?g")


@query("select unnest(['urn:g/a','urn:g/b','urn:g/c']) g, count(*) n from region")
def add_copy_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _triples(spark, sf_dir, "region")
    own = own.update("ADD DEFAULT TO g:a; COPY g:a TO g:b; MOVE g:a TO g:c; COPY g:c TO g:a; DROP DEFAULT")
    return own.select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?r region:r_name ?x } } GROUP BY ?g")


@query("select r_name n, 'urn:x/loaded' g from region")
def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes N-Quads of a table to the shared folder and loads them."""
    from quadloom.sources import rdf

    path = place(spark, "load")
    rdf.write(_triples(spark, sf_dir, "region").quads, path + ".nt", "ntriples")
    own = Engine(spark, prefixes=PREFIXES).update(f"LOAD <{path}.nt> INTO GRAPH <urn:x/loaded>", allow_load=True)
    return own.select("SELECT (STR(?x) AS ?n) (STR(?h) AS ?g) WHERE { GRAPH ?h { ?r region:r_name ?x } }")


# Full text, access, serialisations


@query(r"""select count(*) n from (select distinct doc_id, unnest(string_split_regex(lower(text),'[ \n\t\r!@$%^&*()_=+\[\]{};:"\\|<>,./?#-]+')) tok from documents) where tok<>''""")
def ft_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.functions.fulltext import tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(tokens(F.lower("text"))).alias("t")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query()
def ft_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.functions.fulltext import stems, tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("lang", F.explode(tokens(F.lower("text"))).alias("t")).groupBy("lang", "t").agg(F.count(F.lit(1)).alias("c"))
    return words.groupBy("lang", stems(F.col("t"), F.col("lang")).alias("stem")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("words"))


@query()
def ft_metaphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.functions.fulltext import codes, tokens

    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(tokens(F.col("p_name"))).alias("t"))
    return names.select("p_partkey", F.explode(codes(F.col("t"))).alias("code")).distinct()


@query(
    r"""select i.item_id from (select item_id, unnest(string_split_regex(lower(text),'[ \n\t\r!@$%^&*()_=+\[\]{};:"\\|<>,./?#-]+')) tok from benchmark) i where tok='the' group by 1"""
)
def ft_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token index derived by configuration, searched by an ordinary pattern."""
    from quadloom.functions.fulltext import derived

    own = _triples(spark, sf_dir, "benchmark").update("INSERT DATA { GRAPH <system:config> { benchmark:text <urn:quadloom:text#index> <urn:quadloom:text#token> } }")
    own.quads = own.quads.unionByName(derived(own.quads, own.quads))
    return own.select('SELECT (xsd:integer(?k) AS ?item_id) WHERE { ?b <urn:quadloom:text#token> "the" ; benchmark:item_id ?k }')


@query("select 'urn:g/'||event_type g, count(*) n from events where event_type<>'purchase' group by 1")
def acl_hidden_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir, {"events"})
    rules = Engine(spark, prefixes=PREFIXES).update('INSERT DATA { GRAPH <system:config> { g:purchase <urn:quadloom:acl#onlyAccessBy> "k1" . g:click <urn:quadloom:acl#onlyAccessBy> "k2" . <urn:all> <urn:quadloom:acl#admin> "root" } }')
    reader = Engine(spark, own.tables, rules.quads, prefixes=PREFIXES, api_key="k2")
    return reader.select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?e events:value ?v } } GROUP BY ?g")


@query("select n_name as name, n_nationkey k from nation")
def read_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as lines, read again as N-Triples and queried."""
    from quadloom.sources import rdf

    lines = rdf.lines(_triples(spark, sf_dir, "nation").quads)
    own = Engine(spark, {}, rdf.parsed_lines(lines), prefixes=PREFIXES)
    return own.select("SELECT (STR(?x) AS ?name) (xsd:integer(?j) AS ?k) WHERE { ?n nation:n_name ?x ; nation:n_nationkey ?j }")


@query("select 'default:' g, count(*)*3 n from region")
def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, {"region"}).size()


@query("select n_name as name, 'urn:t/region/'||n_regionkey r from nation where n_nationkey<3")
def read_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle document at hand that refers to mapped rows, joined with the mapped tables."""
    from quadloom.sources import rdf

    own = engine(spark, sf_dir, {"nation"})
    own.quads = rdf.from_text(spark, "@prefix n: <urn:t/nation/> . @prefix : <urn:x/> . n:0 a :Picked ; :note 'a', \"b\"@en . n:1 a :Picked . n:2 a :Picked . n:99 a :Picked .")
    return own.select("PREFIX : <urn:x/> SELECT ?name ?r WHERE { ?n a :Picked . ?n nation:n_name ?name ; nation:n_regionkey ?r }")


@query(
    """select unnest(['<urn:t/region/'||r_regionkey||'> <urn:t/region#r_regionkey> "'||r_regionkey||'"^^<http://www.w3.org/2001/XMLSchema#int> .', '<urn:t/region/'||r_regionkey||'> <urn:t/region#r_name> "'||r_name||'" .',
       '<urn:t/region/'||r_regionkey||'> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:t/region> .']) as value from region"""
)
def write_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.sources import rdf

    return rdf.lines(_triples(spark, sf_dir, "region").quads)


@query(
    """select '<triple><uri>urn:t/region/'||r_regionkey||'</uri>'||unnest(['<uri>urn:t/region#r_regionkey</uri><typedLiteral datatype="http://www.w3.org/2001/XMLSchema#int">'||r_regionkey||'</typedLiteral>',
       '<uri>urn:t/region#r_name</uri><plainLiteral>'||r_name||'</plainLiteral>', '<uri>http://www.w3.org/1999/02/22-rdf-syntax-ns#type</uri><uri>urn:t/region</uri>'])||'</triple>' as value from region"""
)
def write_trix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.sources import rdf

    return rdf.trix_lines(_triples(spark, sf_dir, "region").quads).select("value")


@query(
    """select '<rdf:Description rdf:about="urn:t/region/'||r_regionkey||'">'||unnest(['<ns0:r_regionkey xmlns:ns0="urn:t/region#" rdf:datatype="http://www.w3.org/2001/XMLSchema#int">'||r_regionkey||'</ns0:r_regionkey>',
       '<ns0:r_name xmlns:ns0="urn:t/region#">'||r_name||'</ns0:r_name>', '<ns0:type xmlns:ns0="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:resource="urn:t/region"/>'])||'</rdf:Description>' as value from region"""
)
def write_rdfxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.sources import rdf

    return rdf.rdfxml_lines(_triples(spark, sf_dir, "region").quads)


def _serialised(form: str, head: str | None = None) -> Query:
    """The solutions as lines made in all tasks; with the head of the format, where it is one line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quadloom.sources.results import lines

        result = engine(spark, sf_dir, {"region"}).query("SELECT ?x ?k ?n WHERE { ?x region:r_regionkey ?j ; region:r_name ?n BIND(xsd:integer(?j) AS ?k) }")
        own = lines(result, form).withColumnRenamed("value", "line")
        return own if head is None else spark.createDataFrame([(head,)], "line string").union(own)

    return run


QUERIES["result_csv"], ORACLES["result_csv"] = _serialised("csv", "x,k,n"), "select 'x,k,n' line union all select 'urn:t/region/'||r_regionkey||','||r_regionkey||','||r_name from region"
QUERIES["result_tsv"], ORACLES["result_tsv"] = _serialised("tsv", "?x\t?k\t?n"), """select '?x'||chr(9)||'?k'||chr(9)||'?n' line union all select '<urn:t/region/'||r_regionkey||'>'||chr(9)||r_regionkey||chr(9)||'"'||r_name||'"' from region"""
QUERIES["result_xml"], ORACLES["result_xml"] = (
    _serialised("sparql"),
    """select '<result><binding name="x"><uri>urn:t/region/'||r_regionkey||'</uri></binding><binding name="k"><literal datatype="http://www.w3.org/2001/XMLSchema#integer">'||r_regionkey||'</literal></binding><binding name="n"><literal>'||r_name||'</literal></binding></result>' line from region""",
)
QUERIES["result_json"], ORACLES["result_json"] = (
    _serialised("json"),
    """select '{"x":{"type":"uri","value":"urn:t/region/'||r_regionkey||'"},"k":{"type":"literal","value":"'||r_regionkey||'","datatype":"http://www.w3.org/2001/XMLSchema#integer"},"n":{"type":"literal","value":"'||r_name||'"}}' line from region""",
)

from quadloom.plans import catalog_more  # noqa: E402, F401  registers its queries
