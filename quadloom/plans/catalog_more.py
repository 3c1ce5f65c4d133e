"""More of the driver's queries: syntaxes, stores, result forms, graph protocol, access rules, functions; registered into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.plans.catalog import PREFIXES, _triples, engine, place, query, sparql

ACL_RULES = 'INSERT DATA { GRAPH <system:config> { g:purchase <urn:quadloom:acl#onlyAccessBy> "k1" . g:click <urn:quadloom:acl#onlyAccessBy> "k2" . <urn:all> <urn:quadloom:acl#admin> "root" } }'

# Patterns and functions

QUADS_NATION = "SELECT (STR(?n) AS ?name) (STR(?r) AS ?region) WHERE { ?x nation:n_name ?n ; nation:n_regionkey ?y . ?y region:r_name ?r }"
sparql("fn_replace", 'SELECT ?k (REPLACE(?n, "[0-9]+", "#") AS ?a) (REPLACE(?n, "CUSTOMER", "c", "i") AS ?b) (REPLACE(?n, "(.)0", "$1o") AS ?c) WHERE { ?x customer:c_custkey ?k ; customer:c_name ?n }', "select c_custkey k, regexp_replace(c_name,'[0-9]+','#','g') a, regexp_replace(c_name,'(?i)CUSTOMER','c','g') b, regexp_replace(c_name,'(.)0','\\1o','g') c from customer")
sparql("fn_sha2_others", "SELECT ?n (STRLEN(SHA224(?n)) AS ?a) (STRLEN(SHA384(?n)) AS ?b) (STRLEN(SHA512(?n)) AS ?c) (SUBSTR(SHA512(\"abc\"), 1, 16) AS ?d) (SUBSTR(SHA384(\"abc\"), 1, 16) AS ?e) (SUBSTR(SHA224(\"abc\"), 1, 16) AS ?f) WHERE { ?x region:r_name ?n }", "select r_name n, 56 a, 96 b, 128 c, 'ddaf35a193617aba' d, 'cb00753f45a35e8b' e, '23097d223405d822' f from region")
sparql("fn_casts_more", 'SELECT ?k (xsd:float(?b) AS ?f) (xsd:double(xsd:decimal(?b)) AS ?d) (xsd:dateTime("2001-02-03T04:05:06") AS ?t) (YEAR(xsd:dateTime("2001-02-03T04:05:06")) AS ?y) (BOUND(?z) AS ?u) WHERE { ?x customer:c_custkey ?k ; customer:c_acctbal ?b BIND(xsd:dateTime("no date") AS ?z) }', "select c_custkey k, c_acctbal f, c_acctbal d, timestamp '2001-02-03 04:05:06' t, 2001 y, false u from customer")
sparql("fn_timezone", 'SELECT ?k (BOUND(?z) AS ?b) (HOURS("2001-02-03T04:05:06Z"^^xsd:dateTime) AS ?h) ("2001-02-03T04:05:06Z"^^xsd:dateTime = "2001-02-03T05:05:06+01:00"^^xsd:dateTime AS ?same) WHERE { ?e region:r_regionkey ?k BIND(TIMEZONE("2001-02-03T04:05:06Z"^^xsd:dateTime) AS ?z) }', "select r_regionkey k, false b, 4 h, true same from region")
sparql("fn_substr_beyond", 'SELECT ?k (SUBSTR(?n, 1e300) AS ?a) (BOUND(?b) AS ?c) WHERE { ?x region:r_regionkey ?k ; region:r_name ?n BIND(FROM-UNIXTIME(1e300) AS ?b) }', "select r_regionkey k, r_name a, false c from region")


@query("select r_name as name, cast(null as bigint) as total from region")
def agg_sum_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums past 64 bits are errors, so unbound."""
    return engine(spark, sf_dir, {"region", "nation"}).select("SELECT ?name (SUM(?k * 0 + 9223372036854775807) AS ?total) WHERE { ?x nation:n_nationkey ?k ; nation:n_regionkey ?y . ?y region:r_name ?name } GROUP BY ?name")


@query("select 'urn:t/nation/'||n_nationkey x, 'urn:t/nation#n_regionkey' y from nation where n_regionkey=1")
def quads_object_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, {"nation"}).materialised().select("SELECT (STR(?s) AS ?x) (STR(?p) AS ?y) WHERE { ?s ?p <urn:t/region/1> }")


# Syntaxes


def _copied(spark: SparkSession, sf_dir: str, lines: DataFrame, form: str, ending: str, head: str = "", foot: str = "") -> Engine:
    """Lines written as one document and read again, beside the mapped tables."""
    from quadloom.sources import rdf

    path = place(spark, "document") + ending
    body = lines.agg(F.array_join(F.collect_list("value"), "\n").alias("value"))  # the few triples of nation and region
    body.select(F.concat(F.lit(head), "value", F.lit(foot))).write.text(path)
    return Engine(spark, {}, rdf.read(spark, path, form), prefixes=PREFIXES)


NATIONS = "select n_name as name, r_name region from nation join region on n_regionkey=r_regionkey"


@query(NATIONS)
def read_rdfxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom import terms as R
    from quadloom.sources import rdf

    lines = rdf.rdfxml_lines(engine(spark, sf_dir, {"nation"}).materialised().quads)
    return _copied(spark, sf_dir, lines, "rdfxml", ".rdf", f'<rdf:RDF xmlns:rdf="{R.RDF}">', "</rdf:RDF>").select(QUADS_NATION)


@query(NATIONS)
def restore_trix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TriX dump read back as a whole."""
    from quadloom.sources import rdf

    lines = rdf.trix_lines(engine(spark, sf_dir, {"nation"}).materialised().quads).select("value")
    return _copied(spark, sf_dir, lines, "trix", ".trix", '<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/"><graph>', "</graph></TriX>").select(QUADS_NATION)


@query("select 'urn:g/'||event_type g, count(*) n, sum(event_id) s from events group by 1")
def read_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as N-Quads, whole, and read again with their graphs."""
    from quadloom.sources import rdf

    path = place(spark, "events") + ".nq"
    rdf.write(_triples(spark, sf_dir, "events").quads, path, "nquads")
    own = Engine(spark, {}, rdf.read(spark, path, "nquads"), prefixes=PREFIXES)
    return own.select("SELECT ?g (COUNT(?e) AS ?n) (SUM(xsd:integer(?k)) AS ?s) WHERE { GRAPH ?g { ?e events:event_id ?k } } GROUP BY ?g")


@query("select n_name as name, 'urn:x/'||case when n_nationkey=0 then 'one' else 'two' end g from nation where n_nationkey<2")
def read_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.sources import rdf

    own = engine(spark, sf_dir, {"nation"})
    own.quads = rdf.from_text(spark, "@prefix n: <urn:t/nation/> . @prefix : <urn:x/> . :one { n:0 a :Picked } :two { n:1 a :Picked . n:99 a :Picked }", "trig")
    return own.select("SELECT ?name (STR(?h) AS ?g) WHERE { GRAPH ?h { ?n a <urn:x/Picked> } ?n nation:n_name ?name }")


@query("select 'urn:t/nation#'||unnest(['n_name','n_nationkey','n_regionkey']) p, count(*) n from nation group by 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of lines that arrive in a folder become quads of a store; what arrives twice is kept once."""
    from quadloom.sources import rdf
    from quadloom.sources.store import Store
    from quadloom.streaming.ingest import ingest, quad_stream

    folder, store = place(spark, "arriving"), Store(spark, place(spark, "store"))
    quads = _triples(spark, sf_dir, "nation").quads.where("p like 'urn:t/nation#%'")
    for _ in range(2):
        rdf.lines(quads).write.mode("append").text(folder)
        ingest(store, quad_stream(spark, folder), place(spark, "progress")).awaitTermination()
    return store.quads().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# Stores and the graph protocol


@query(
    """select 'all' what, 3*(select count(*) from region)+4*(select count(*) from nation) n union all select 'dry run', 3*(select count(*) from region) union all select 'folders', 2
       union all select 'replaced', 3*(select count(*) from region)"""
)
def store_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports into a store: a dry run, an append that writes what is new, a replaced graph."""
    from quadloom.sources import rdf
    from quadloom.sources.store import Store

    store, paths = Store(spark, place(spark, "store")), {}
    for name in ("region", "nation"):
        paths[name] = place(spark, name) + ".nt"
        rdf.write(_triples(spark, sf_dir, name).quads.where(F.col("s.lex").startswith(f"urn:t/{name}/")), paths[name], "ntriples")
    dry = store.load(paths["region"], dry_run=True)
    for name in ("region", "nation", "region"):
        store.load(paths[name], index_text=False)
    folders = len(set(store.version().split("\n"))) - 1  # the third adds a folder without rows
    every = store.quads().count()
    store.load(paths["region"], replace=True, index_text=False)
    return spark.createDataFrame([("all", every), ("dry run", dry), ("folders", folders), ("replaced", store.quads().count())], "what string, n long")


@query(NATIONS)
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored copy of the tables, where a constant predicate reads its own files."""
    from quadloom.sources.store import Store

    store = Store(spark, place(spark, "store"), prefixes=PREFIXES)
    store.commit(engine(spark, sf_dir, {"nation"}).materialised().quads)
    return store.query(QUADS_NATION).df


@query("select unnest(['urn:x/a','urn:x/b']) g, unnest([(select count(*) from region)*3+(select count(*) from nation)*4, (select count(*) from nation)*4]) n")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUT replaces a graph, POST adds to one, DELETE removes one."""
    from quadloom.operators.update import delete_graph, post_graph, put_graph

    region, nation = (_triples(spark, sf_dir, t).quads.where(F.col("s.lex").startswith(f"urn:t/{t}/")) for t in ("region", "nation"))
    quads = put_graph(region.where("false"), "urn:x/a", nation)
    quads = put_graph(post_graph(quads, "urn:x/a", region), "urn:x/b", region)
    quads = delete_graph(put_graph(put_graph(quads, "urn:x/b", nation), "urn:x/c", region), "urn:x/c")
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("select r_name as name from region where r_regionkey>1")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _triples(spark, sf_dir, "region").update('DELETE WHERE { <urn:t/region/0> ?p ?o } ; DELETE WHERE { <urn:t/region/1> region:r_name ?n }')
    return own.select("SELECT (STR(?n) AS ?name) WHERE { ?r region:r_name ?n }")


@query("select 'urn:x/a' g, r_name as name from region where r_regionkey<>3 union all select 'urn:x/a', 'moved' union all select 'urn:x/b', r_name from region")
def modify_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WITH names the graph of both templates and of the pattern."""
    own = _triples(spark, sf_dir, "region").update("ADD DEFAULT TO <urn:x/a>; ADD DEFAULT TO <urn:x/b>; DROP DEFAULT")
    own = own.update('WITH <urn:x/a> DELETE { ?r region:r_name ?n } INSERT { ?r region:r_name "moved" } WHERE { ?r region:r_name ?n ; region:r_regionkey ?k FILTER(?k = 3) }')
    return own.select("SELECT (STR(?h) AS ?g) (STR(?n) AS ?name) WHERE { GRAPH ?h { ?r region:r_name ?n } }")


@query("select 'urn:t/region/'||n_regionkey r, 'urn:t/nation/'||n_nationkey n from nation")
def construct_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a CONSTRUCT query makes, added to a graph."""
    own = engine(spark, sf_dir, {"nation"}).insert_constructed("CONSTRUCT { ?y <urn:x/holds> ?x } WHERE { ?x nation:n_regionkey ?y }", "urn:x/made")
    return own.select("SELECT (STR(?y) AS ?r) (STR(?x) AS ?n) WHERE { GRAPH <urn:x/made> { ?y <urn:x/holds> ?x } }")


# Result forms, limits


@query("""select 'callback(' line union all select '{"head": {}, "boolean": true}' union all select ');'""")
def result_jsonp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, {"region"}).query("ASK { ?r region:r_name ?n }")
    return spark.createDataFrame([(line.rstrip("\n"),) for line in found.serialise("json", "callback")], "line string")


@query("""select 'rs:binding [ rs:variable "n" ; rs:value "'||r_name||'" ]' line from region""")
def result_testcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir, {"region"}).query("SELECT ?n WHERE { ?r region:r_name ?n }")
    text = spark.createDataFrame([("".join(found.serialise("testcase")),)], "t string")
    return text.select(F.explode(F.regexp_extract_all("t", F.lit(r"(rs:binding \[[^\]]*\])"), F.lit(1))).alias("line"))


@query("select unnest(['n','k','n','n,k']) names, unnest(['head','head','star','csv']) kind")
def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of variables in the order of the head, of * and of the csv line."""
    own = engine(spark, sf_dir, {"region"})
    found = own.query("SELECT ?n ?k WHERE { ?r region:r_name ?n ; region:r_regionkey ?k }")
    star = own.query("SELECT * WHERE { <urn:t/region/1> region:r_name ?n }")
    csv = next(iter(found.serialise("csv"))).strip()
    return spark.createDataFrame([(v, "head") for v in found.variables] + [(v, "star") for v in star.variables] + [(csv, "csv")], "names string, kind string")


@query("select unnest(['rows','warnings']) what, unnest([3, 1]) n")
def soft_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan gives soft_limit rows at most and says so."""
    found = engine(spark, sf_dir, {"customer"}, soft_limit=3).query("SELECT ?n WHERE { ?c customer:c_name ?n }")
    rows = found.df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("rows").alias("what"), "n")
    return rows.union(spark.createDataFrame([("warnings", len(found.warnings))], "what string, n int"))


@query("select true cut, true told")
def restricted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted mode cuts the inputs of joins between groups, with a warning."""
    text = "SELECT ?a ?b WHERE { { ?x customer:c_name ?a } UNION { ?x customer:c_mktsegment ?a } { ?y customer:c_name ?b } UNION { ?y customer:c_mktsegment ?b } }"
    found = engine(spark, sf_dir, {"customer"}, soft_limit=2, restricted=True).query(text)
    return found.df.agg((F.count(F.lit(1)) <= 4).alias("cut")).select("cut", F.lit(any("join" in w for w in found.warnings)).alias("told"))


# Access, mixed datasets, the default graph


def _reader(spark: SparkSession, sf_dir: str, key: str | None = "k2") -> Engine:
    rules = Engine(spark, prefixes=PREFIXES).update(ACL_RULES)
    return Engine(spark, engine(spark, sf_dir, {"events"}).tables, rules.quads, prefixes=PREFIXES, api_key=key)


SEEN = "select 'urn:g/'||event_type g, count(*) n from events where event_type<>'purchase' group by 1"


@query(SEEN)
def acl_open_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).select("SELECT ?g (COUNT(DISTINCT ?s) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


@query("select distinct 'urn:g/'||event_type g from events where event_type<>'purchase'")
def acl_graph_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).select("SELECT ?g WHERE { GRAPH ?g { } }")


@query("select 'urn:g/'||event_type g, 7*count(*) n from events where event_type not in ('purchase','click') group by 1")
def acl_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir, None).size().where("g like 'urn:g/%'")


@query("select 'urn:t/events/'||event_id s, 7 n from events where event_id<20 and event_type<>'purchase'")
def acl_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reader(spark, sf_dir).query("DESCRIBE ?e WHERE { ?e events:event_id ?k FILTER(?k < 20) }")
    return found.groupBy(F.col("s.lex").alias("s")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(SEEN)
def acl_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).materialised().select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?e events:value ?v } } GROUP BY ?g")


@query("select 'urn:g/'||event_type g, count(*) n from events group by 1 union all select 'system:config', 3")
def acl_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir, "root").select("SELECT ?g (COUNT(DISTINCT ?s) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


@query("select unnest(['reader','admin']) who, unnest([false, true]) may")
def acl_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.operators.update import UpdateError

    rows = []
    for who, key in (("reader", "k2"), ("admin", "root")):
        try:
            _reader(spark, sf_dir, key).update("INSERT DATA { <urn:a> <urn:b> <urn:c> }")
            rows.append((who, True))
        except UpdateError:
            rows.append((who, False))
    return spark.createDataFrame(rows, "who string, may boolean")


@query("select 'urn:t/region/'||r_regionkey r, r_name n from region union all select unnest(['urn:t/region/0','urn:x/new']), unnest(['also','fresh'])")
def mixed_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapped predicate that quads hold too."""
    from quadloom.sources import rdf

    own = engine(spark, sf_dir, {"region"})
    own.quads = rdf.from_text(spark, "<urn:t/region/0> <urn:t/region#r_name> 'also' . <urn:x/new> <urn:t/region#r_name> 'fresh' .")
    return own.select("SELECT (STR(?x) AS ?r) (STR(?y) AS ?n) WHERE { ?x region:r_name ?y }")


@query("select 0 events, count(*) nations from nation")
def default_graph_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns outside GRAPH see the default graph alone: no row of a table whose rows lie in named graphs."""
    own = engine(spark, sf_dir, {"events", "nation"}, default_graph_only=True)
    text = "SELECT (COUNT(?e) AS ?events) WHERE { ?e events:event_id ?k }", "SELECT (COUNT(?n) AS ?nations) WHERE { ?n nation:n_name ?k }"
    events, nations = (own.select(t) for t in text)
    return events.selectExpr("cast(events as int) events").join(nations)


# Full text: expected values are published examples of the algorithms


@query(
    """select unnest(['consigned','knightly','hopping','relational','häuser','freundlichkeit','jaktkarlarne','havnedistriktene','indtage','naciones']) word,
       unnest(['en','en','en','en','de','de','sv','no','da','es']) lang, unnest(['consign','knight','hop','relat','haus','freundlich','jaktkarl','havnedistrikt','indtag','nacion']) stem"""
)
def ft_stem_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.functions.fulltext import stems

    rows = [("consigned", "en"), ("knightly", "en"), ("hopping", "en"), ("relational", "en"), ("häuser", "de"), ("freundlichkeit", "de"), ("jaktkarlarne", "sv"), ("havnedistriktene", "no"), ("indtage", "da"), ("naciones", "es")]
    return spark.createDataFrame(rows, "word string, lang string").select("word", "lang", stems(F.col("word"), F.col("lang")).alias("stem"))


@query("select unnest(['Smith','Smith','Schmidt','Schmidt','Thomas']) word, unnest(['SM0','XMT','XMT','SMT','TMS']) code")
def ft_metaphone_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.functions.fulltext import codes

    words = spark.createDataFrame([("Smith",), ("Schmidt",), ("Thomas",)], "word string")
    return words.select("word", F.explode(codes(F.col("word"))).alias("code"))
