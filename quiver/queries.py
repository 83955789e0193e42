"""Named queries over the TPC-H-like tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.ids import id_local, id_type, make_id
from quiver.operators import history, search, traverse, write
from quiver.plans import typeql
from quiver.plans.cypher import cypher
from quiver.sources.testdata import testdata_graph

_CYPHER: dict[str, tuple[str, dict]] = {}
_OTHER: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _c(name: str, text: str, sql: str | None = None, **params) -> None:
    _CYPHER[name] = (text, params)
    if sql:
        _SQL[name] = sql


def query(name: str, sql: str | None = None):
    def add(f):
        _OTHER[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


PARTY = "(SELECT c_nationkey k, c_acctbal b, c_name nm FROM customer UNION ALL SELECT s_nationkey, s_acctbal, s_name FROM supplier)"
SLICE = (
    "MATCH (p:Party)-[:BASED_IN]->(n:Nation)-[:IN_REGION]->(:Region {name:'ASIA'}) WHERE p.acctbal > $min "
    "RETURN n.name AS nation, count(*) AS parties, round(avg(p.acctbal), 4) AS mean ORDER BY parties DESC, nation LIMIT 10"
)
_c("slice_party_by_nation", SLICE, f"SELECT n_name AS nation, count(*) AS parties, round(avg(b), 4) AS mean FROM {PARTY} p JOIN nation ON n_nationkey=k JOIN region ON r_regionkey=n_regionkey WHERE r_name='ASIA' AND b>1000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", min=1000)
_c("label_scan_union", "MATCH (p:Party) RETURN p.name AS name, p.acctbal AS acctbal, p.mktsegment AS segment", "SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
_c("any_node_scan", "MATCH (a) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region)+(SELECT count(*) FROM nation)+(SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier)+(SELECT count(*) FROM part)+(SELECT count(*) FROM orders)+(SELECT count(*) FROM events)+(SELECT count(*) FROM conversations)+(SELECT count(*) FROM embeddings)+(SELECT count(*) FROM documents) AS n")
_c("unknown_label", "MATCH (a:Nothing) RETURN a.name AS name", "SELECT r_name AS name FROM region WHERE false")
_c("inline_filter", "MATCH (c:Customer {mktsegment: $segment}) RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment='BUILDING'", segment="BUILDING")
_c("reverse_hop", "MATCH (n:Nation)<-[:BASED_IN]-(s:Supplier) RETURN n.name AS nation, count(s) AS suppliers", "SELECT n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey=s_nationkey GROUP BY 1")
_c("undirected_hop", "MATCH (t:Turn)-[:NEXT]-(u:Turn) RETURN t.role AS role, count(u) AS n", "WITH e AS (SELECT a.role ra, b.role rb FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1) SELECT role, count(*) AS n FROM (SELECT ra AS role FROM e UNION ALL SELECT rb FROM e) GROUP BY 1")
_c("type_alternatives", "MATCH (o:Order)-[r:CONTAINS|SHIPPED_BY]->(x) RETURN type(r) AS kind, count(*) AS n, round(sum(r.quantity), 2) AS quantity", "SELECT kind, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (SELECT 'CONTAINS' kind, l_quantity FROM lineitem UNION ALL SELECT 'SHIPPED_BY', l_quantity FROM lineitem) GROUP BY 1")
_c("two_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.size > 40 RETURN c.mktsegment AS segment, count(*) AS lines, round(sum(l.price), 2) AS revenue", "SELECT c_mktsegment AS segment, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE p_size>40 GROUP BY 1")
_c("co_purchase_isomorphism", "MATCH (:Part {partkey:1})<-[:CONTAINS]-(:Order)-[:CONTAINS]->(q:Part) RETURN q.partkey AS partkey, count(*) AS n", "WITH e AS (SELECT row_number() OVER () id, l_orderkey o, l_partkey p FROM lineitem) SELECT b.p AS partkey, count(*) AS n FROM e a JOIN e b ON a.o=b.o AND a.id<>b.id WHERE a.p=1 GROUP BY 1")
_c("optional_match_null", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS custkey, count(o) AS orders", "SELECT c_custkey AS custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
_c("optional_all_or_nothing", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.size = 50 AND o.totalprice > 300000 RETURN c.custkey AS custkey, count(DISTINCT o) AS orders, count(p) AS parts", "SELECT c_custkey AS custkey, count(DISTINCT o_orderkey) AS orders, count(p_partkey) AS parts FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, p_partkey FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE p_size=50 AND o_totalprice>300000) ON o_custkey=c_custkey GROUP BY 1")
_c("multi_match", "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) MATCH (c:Customer)-[:BASED_IN]->(n) WHERE c.acctbal > 9000 RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM supplier JOIN nation ON n_nationkey=s_nationkey JOIN customer ON c_nationkey=n_nationkey WHERE c_acctbal>9000 GROUP BY 1")
_c("comma_cross", "MATCH (r:Region), (q:Region) WHERE r.regionkey < q.regionkey RETURN r.name AS a, q.name AS b", "SELECT r.r_name AS a, q.r_name AS b FROM region r, region q WHERE r.r_regionkey<q.r_regionkey")
_c("with_having", "MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(*) AS n WHERE n > 12 RETURN c.custkey AS custkey, n", "SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>12")
_c("with_then_match", "MATCH (c:Customer) WITH c ORDER BY c.acctbal DESC, c.custkey LIMIT 20 MATCH (c)-[:PLACED]->(o:Order) RETURN c.custkey AS custkey, round(sum(o.totalprice), 2) AS total", "SELECT o_custkey AS custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) GROUP BY 1")
_c("unwind_list", "UNWIND $names AS x MATCH (r:Region {name: x}) RETURN x AS name, r.regionkey AS regionkey", "SELECT r_name AS name, r_regionkey AS regionkey FROM region WHERE r_name IN ('ASIA','EUROPE')", names=["ASIA", "EUROPE", "NOWHERE"])
_c("collect_sorted", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, n.name AS nation ORDER BY nation RETURN region, size(collect(nation)) AS nations, size(collect(DISTINCT region)) AS one", "SELECT r_name AS region, count(*)::INT AS nations, 1 AS one FROM nation JOIN region ON r_regionkey=n_regionkey GROUP BY 1")
_c("distinct_count", "MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN count(DISTINCT p) AS parts, count(DISTINCT p.brand) AS brands, count(p) AS lines", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT p_brand) AS brands, count(*) AS lines FROM lineitem JOIN part ON p_partkey=l_partkey")
_c("aggregate_functions", "MATCH (o:Order) RETURN o.status AS status, min(o.totalprice) AS low, max(o.totalprice) AS high, round(stdev(o.totalprice), 4) AS spread, round(percentile(o.totalprice, 0.5), 4) AS mid", "SELECT o_orderstatus AS status, min(o_totalprice) AS low, max(o_totalprice) AS high, round(stddev_samp(o_totalprice), 4) AS spread, round(quantile_cont(o_totalprice, 0.5), 4) AS mid FROM orders GROUP BY 1")
_c("sum_of_nothing", "MATCH (o:Order) WHERE o.totalprice < 0 RETURN sum(o.totalprice) AS total, count(o) AS n, size(collect(o.status)) AS kept", "SELECT 0.0::DOUBLE AS total, 0::BIGINT AS n, 0::INT AS kept")
_c("return_distinct", "MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS segment ORDER BY segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer")
_c("order_skip_limit", "MATCH (p:Part) RETURN p.partkey AS partkey, p.retailprice AS price ORDER BY p.retailprice DESC, p.partkey SKIP 5 LIMIT 20", "SELECT p_partkey AS partkey, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5")
_c("case_when", "MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n", "SELECT CASE WHEN c_acctbal<0 THEN 'debt' WHEN c_acctbal<5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1")
_c("case_simple", "MATCH (o:Order) RETURN CASE o.status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, count(*) AS n FROM orders GROUP BY 1")
_c("string_predicates", "MATCH (p:Part) WHERE p.name STARTS WITH 'P' AND p.name CONTAINS '1' AND NOT p.name ENDS WITH '0' RETURN p.partkey AS partkey, toUpper(p.name) AS up", "SELECT p_partkey AS partkey, upper(p_name) AS up FROM part WHERE starts_with(p_name,'P') AND contains(p_name,'1') AND NOT ends_with(p_name,'0')")
_c("regex_predicate", "MATCH (n:Nation) WHERE n.name =~ '_1[0-9]' RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE regexp_matches(n_name,'_1[0-9]')")
_c("null_safe_eq", "MATCH (p:Party) WHERE p.mktsegment = null RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier")
_c("is_null", "MATCH (p:Party) WHERE p.mktsegment IS NOT NULL AND p.acctbal IS NOT NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL")
_c("boolean_xor", "MATCH (p:Part) WHERE (p.size > 25) XOR (p.retailprice > 1000) RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE (p_size>25) <> (p_retailprice>1000)")
_c("in_list", "MATCH (o:Order) WHERE o.priority IN ['1-URGENT', '2-HIGH'] RETURN o.priority AS priority, count(*) AS n", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') GROUP BY 1")
_c("list_comprehension", "MATCH (r:Region) RETURN r.name AS name, size([x IN [1,2,3,4] WHERE x > r.regionkey | x * 2]) AS n, [1,2,3][r.regionkey] AS item, [1,2,3][-1] AS final", "SELECT r_name AS name, (4-least(r_regionkey,4))::INT AS n, CASE WHEN r_regionkey<3 THEN r_regionkey+1 END AS item, 3 AS final FROM region")
_c("list_predicate_all", "MATCH (r:Region) WHERE all(x IN [1,2,3] WHERE x > r.regionkey) OR none(x IN [1,2] WHERE x = r.regionkey) RETURN r.name AS name, any(x IN [0,4] WHERE x = r.regionkey) AS some, single(x IN [1,1,2] WHERE x = r.regionkey) AS one", "SELECT r_name AS name, r_regionkey IN (0,4) AS some, r_regionkey=2 AS one FROM region WHERE r_regionkey<1 OR r_regionkey NOT IN (1,2)")
_c("map_projection", "MATCH (r:Region) WITH r {.name, twice: r.regionkey * 2} AS m RETURN m.name AS name, m.twice AS twice", "SELECT r_name AS name, r_regionkey*2 AS twice FROM region")
_c("whole_node", "MATCH (r:Region) WITH collect(r) AS rs UNWIND rs AS x RETURN x.name AS name, x._type AS kind", "SELECT r_name AS name, 'Region' AS kind FROM region")
_c("labels_and_type", "MATCH (s:Supplier)-[b:BASED_IN]->(n) RETURN DISTINCT size(labels(s)) AS labels, type(b) AS kind, size(keys(n)) AS keys", "SELECT 2 AS labels, 'BASED_IN' AS kind, 2 AS keys")
_c("label_predicate", "MATCH (p:Party) WHERE p:Supplier RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier")
_c("string_functions", "MATCH (n:Nation) RETURN n.name AS name, toLower(n.name) AS low, substring(n.name, 0, 3) AS head, size(n.name) AS len, replace(n.name, 'NATION', 'N') AS short, split(n.name, '_')[1] AS tail, trim('  x ') AS t", "SELECT n_name AS name, lower(n_name) AS low, substr(n_name,1,3) AS head, length(n_name)::INT AS len, replace(n_name,'NATION','N') AS short, split_part(n_name,'_',2) AS tail, 'x' AS t FROM nation")
_c("math_functions", "MATCH (n:Nation) RETURN n.nationkey AS k, abs(n.nationkey - 12) AS a, round(sqrt(n.nationkey), 6) AS s, n.nationkey / 4 AS q, n.nationkey % 4 AS m, n.nationkey / 0 AS z, round(2.0 ^ n.nationkey, 1) AS p, -n.nationkey AS neg", "SELECT n_nationkey AS k, abs(n_nationkey-12) AS a, round(sqrt(n_nationkey),6) AS s, (n_nationkey//4)::INT AS q, n_nationkey%4 AS m, NULL::INT AS z, round(pow(2.0,n_nationkey),1) AS p, -n_nationkey AS neg FROM nation")
_c("conversion_functions", "MATCH (n:Nation) RETURN toString(n.nationkey) AS s, toInteger(split(n.name, '_')[1]) AS i, toFloat('x') AS f, coalesce(toInteger('y'), 7) AS c", "SELECT n_nationkey::VARCHAR AS s, split_part(n_name,'_',2)::BIGINT AS i, NULL::DOUBLE AS f, 7::BIGINT AS c FROM nation")
_c("id_function", "MATCH (s:Supplier) RETURN id(s) % 65536 AS local, elementId(s) = toString(id(s)) AS same", "SELECT s_suppkey % 65536 AS local, true AS same FROM supplier")
_c("union_all", "MATCH (r:Region) RETURN r.name AS name UNION ALL MATCH (n:Nation) RETURN n.name AS name", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
_c("union_distinct", "MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_NEXT = "e AS (SELECT a.conv_id c, a.turn s, b.turn t FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1)"
_c("vlp_trails_count", "MATCH (a:Turn)-[:NEXT*1..3]->(b:Turn) RETURN count(b) AS trails", f"WITH RECURSIVE {_NEXT}, w AS (SELECT c, t, 1 k FROM e UNION ALL SELECT w.c, e.t, k+1 FROM w JOIN e ON e.c=w.c AND e.s=w.t WHERE k<3) SELECT count(*) AS trails FROM w")
_c("vlp_path_lengths", "MATCH p = (a:Turn {turn: 0})-[:NEXT*0..7]->(b:Turn) RETURN length(p) AS hops, size(nodes(p)) AS nodes, size(relationships(p)) AS edges, count(*) AS n", f"WITH RECURSIVE {_NEXT}, w AS (SELECT conv_id c, turn t, 0 k FROM conversations WHERE turn=0 UNION ALL SELECT w.c, e.t, k+1 FROM w JOIN e ON e.c=w.c AND e.s=w.t WHERE k<7) SELECT k AS hops, k+1 AS nodes, k AS edges, count(*) AS n FROM w GROUP BY 1,2,3")
_c("vlp_distinct_rewrite", "MATCH (a:Turn {turn: 0})-[:NEXT*1..5]->(b:Turn) RETURN DISTINCT b.conv_id AS conv_id, b.turn AS turn", f"WITH RECURSIVE {_NEXT}, w AS (SELECT c, t, 1 k FROM e WHERE s=0 UNION ALL SELECT w.c, e.t, k+1 FROM w JOIN e ON e.c=w.c AND e.s=w.t WHERE k<5) SELECT DISTINCT c AS conv_id, t AS turn FROM w")
_c("vlp_undirected", "MATCH (a:Turn {turn: 1})-[:NEXT*1..2]-(b:Turn) RETURN b.turn AS turn, count(*) AS n", f"WITH {_NEXT}, g AS (SELECT c,s,t,s AS id FROM e UNION ALL SELECT c,t,s,s FROM e), w AS (SELECT c,t FROM g WHERE s=1 UNION ALL SELECT a.c,b.t FROM g a JOIN g b ON b.c=a.c AND b.s=a.t AND b.id<>a.id WHERE a.s=1) SELECT t AS turn, count(*) AS n FROM w GROUP BY 1")
_c("call_labels", "CALL db.labels() YIELD label RETURN label ORDER BY label", "SELECT unnest(['Customer','Document','Event','Nation','Order','Part','Party','Place','Region','Supplier','Turn','Vector']) AS label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cypher(testdata_graph(spark, sf_dir), SLICE, {"min": 1000})


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, params = _CYPHER[name]
    return lambda spark, sf_dir: cypher(testdata_graph(spark, sf_dir), text, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _run(n) for n in _CYPHER} | dict(_OTHER)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)




# storage, traversal, search and history --------------------------------------
@query("nodes_by_root", "SELECT 'Customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    names = spark.createDataFrame([(t.type_id, t.name) for t in g.catalog.types.values()], "type_id int, kind string")
    return g.nodes_of("Party").join(names, "type_id").groupBy("kind").agg(F.count("*").alias("n"))


@query("expand_batch", "SELECT o_custkey AS custkey, count(*) AS n FROM orders WHERE o_custkey < 50 GROUP BY 1")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    starts = g.label_view("Customer").filter("custkey < 50").select("_id")
    return g.expand(starts, "PLACED").groupBy("start").agg(F.count("*").alias("n")).select(id_local(F.col("start")).alias("custkey"), "n")


@query("degree", "SELECT o_custkey AS custkey, count(*) AS degree FROM orders GROUP BY 1")
def _(spark, sf_dir):
    return testdata_graph(spark, sf_dir).degree("PLACED").select(id_local(F.col("_id")).alias("custkey"), "degree")


@query("degree_histogram", "SELECT CAST(least(floor(d/4),9) AS INTEGER) AS bucket, count(*) AS nodes, max(d) AS max_degree FROM (SELECT o_custkey, count(*) d FROM orders GROUP BY 1) GROUP BY 1")
def _(spark, sf_dir):
    d = testdata_graph(spark, sf_dir).degree("PLACED")
    return d.groupBy(F.least(F.floor(F.col("degree") / 4), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"))


@query("degree_distribution", "SELECT CAST(floor(d/128.0)+1 AS INTEGER) AS bucket, count(*) AS nodes, min(d) AS low, max(d) AS high FROM (SELECT l_suppkey, count(*) d FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1) GROUP BY 1")
def _(spark, sf_dir):
    return testdata_graph(spark, sf_dir).degree_distribution("SUPPLIES")


@query("graph_stats", "SELECT 'Customer' AS type, 'node' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'Order','node',count(*) FROM orders UNION ALL SELECT 'PLACED','edge',count(*) FROM orders UNION ALL SELECT 'CONTAINS','edge',count(*) FROM lineitem UNION ALL SELECT 'BASED_IN','edge',(SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier)")
def _(spark, sf_dir):
    return testdata_graph(spark, sf_dir).stats().filter(F.col("type").isin("Customer", "Order", "PLACED", "CONTAINS", "BASED_IN"))


@query("integrity_empty", "SELECT 'dangling_source' AS kind, o_orderkey AS entity FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    g.edges = {"PLACED": g.edges["PLACED"], "CONTAINS": g.edges["CONTAINS"]}
    return g.check_integrity().select("kind", F.col("entity_id").alias("entity"))


@query("integrity_found", "SELECT 'dangling_source' AS kind, count(*) AS n FROM orders WHERE o_custkey >= 100")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    g.edges = {"PLACED": g.edges["PLACED"]}
    g.nodes["Customer"] = g.nodes["Customer"].filter("custkey < 100")
    return g.check_integrity().groupBy("kind").agg(F.count("*").alias("n"))


@query("relational_views", "SELECT 'Order' AS name, count(*) AS n FROM orders UNION ALL SELECT 'Part', count(*) FROM part")
def _(spark, sf_dir):
    v = testdata_graph(spark, sf_dir).relational_views()
    return v["node"].join(v["type"].filter(F.col("name").isin("Order", "Part")), "type_id").groupBy("name").agg(F.count("*").alias("n"))


@query("interval_containment", "SELECT unnest(['Customer','Party','Supplier']) AS name")
def _(spark, sf_dir):
    v = testdata_graph(spark, sf_dir).relational_views()
    a = v["type_label"].join(v["type"], "type_id").filter("name = 'Party'").select(F.col("lft").alias("l"), F.col("rgt").alias("r"))
    return v["type_label"].join(v["type"], "type_id").join(a, (F.col("lft") >= F.col("l")) & (F.col("rgt") <= F.col("r"))).select("name")


@query("row_level_security", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_acctbal > 5000")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir).enable_rls("Party", "acctbal > 5000")
    return cypher(g, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(*) AS n, count(DISTINCT c) AS customers")


_G = "g AS (SELECT a s,b t FROM (SELECT DISTINCT l_suppkey a, l_partkey+1000000 b FROM lineitem) UNION ALL SELECT b,a FROM (SELECT DISTINCT l_suppkey a, l_partkey+1000000 b FROM lineitem))"


@query("reach_min_depth", f"WITH RECURSIVE {_G}, w AS (SELECT 0::BIGINT n, 0 k UNION SELECT g.t, k+1 FROM w JOIN g ON g.s=w.n WHERE k<3) SELECT n AS node, min(k) AS depth FROM w WHERE k>0 AND n<>0 GROUP BY 1")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    starts = g.label_view("Supplier").filter("suppkey = 0").select("_id")
    found = traverse.reach(starts, g.edge_view("SUPPLIES", direction="both"), 1, 3, True)
    part = g.catalog.types["Part"].type_id
    return found.select((id_local(F.col("node")) + F.when(id_type(F.col("node")) == part, 1000000).otherwise(0)).alias("node"), "depth")


@query("reach_many_seeds", "WITH RECURSIVE e AS (SELECT a.conv_id c, a.turn s, b.turn t FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1), w AS (SELECT c, t, 1 k FROM e WHERE s=0 UNION ALL SELECT w.c, e.t, k+1 FROM w JOIN e ON e.c=w.c AND e.s=w.t) SELECT c AS conv_id, t AS turn, k AS depth FROM w")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    turns = g.label_view("Turn")
    found = traverse.reach(turns.filter("turn = 0").select("_id"), g.edge_view("NEXT"))
    return found.join(turns, found["node"] == turns["_id"]).select("conv_id", "turn", "depth")


@query("csr_reach", "WITH RECURSIVE e AS (SELECT a.conv_id c, a.turn s, b.turn t FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1), w AS (SELECT c, t, 1 k FROM e WHERE s=0 UNION ALL SELECT w.c, e.t, k+1 FROM w JOIN e ON e.c=w.c AND e.s=w.t WHERE k < 4) SELECT k AS depth, count(*) AS n FROM w GROUP BY 1")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    kernel = traverse.Csr(g.edge_view("NEXT"))
    return kernel.reach(g.label_view("Turn").filter("turn = 0").select("_id"), 4).groupBy("depth").agg(F.count("*").alias("n"))


@query("shortest_hops", "SELECT k AS part, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey=1 AND l_partkey=k) THEN 1 ELSE 3 END AS hops FROM (SELECT DISTINCT l_partkey k FROM lineitem WHERE l_partkey BETWEEN 1 AND 40)")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    s, p = g.catalog.types["Supplier"].type_id, g.catalog.types["Part"].type_id
    ends = g.edges["SUPPLIES"].select(F.col("_dst").alias("dst")).distinct().filter(id_local(F.col("dst")).between(1, 40))
    pairs = ends.select(F.lit(make_id(0, s, 1)).alias("src"), "dst")
    return traverse.hops(pairs, g.edge_view("SUPPLIES", direction="both"), 4).select(id_local(F.col("dst")).alias("part"), "hops")


@query("expand_all", "SELECT o_custkey AS custkey, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return g.expand(g.label_view("Customer").select("_id"), "PLACED").groupBy("start").agg(F.count("*").alias("n")).select(id_local(F.col("start")).alias("custkey"), "n")


@query("shortest_hops_all", "WITH e AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), one AS (SELECT p FROM e WHERE s=1), two AS (SELECT DISTINCT s FROM e WHERE p IN (SELECT p FROM one)), three AS (SELECT DISTINCT p FROM e WHERE s IN (SELECT s FROM two)) SELECT p_partkey AS part, CASE WHEN p_partkey IN (SELECT p FROM one) THEN 1 WHEN p_partkey IN (SELECT p FROM three) THEN 3 END AS hops FROM part")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    pairs = g.label_view("Part").select(F.lit(make_id(0, g.catalog.types["Supplier"].type_id, 1)).alias("src"), F.col("_id").alias("dst"))
    return traverse.hops(pairs, g.edge_view("SUPPLIES", direction="both"), 4).select(id_local(F.col("dst")).alias("part"), "hops")


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0)"


def _vector(g, i=0):
    return g.label_view("Vector").filter(F.col("vec_id") == i).select("embedding").first()[0]


@query("vector_cosine_topk", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return search.vector_search(g, "Vector", "embedding", _vector(g), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_l2_topk", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 10")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return search.vector_search(g, "Vector", "embedding", _vector(g), 10, metric="l2").select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_ip_topk", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return search.vector_search(g, "Vector", "embedding", _vector(g), 10, metric="ip").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_filtered_topk", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}), 6) AS distance FROM embeddings WHERE label=3 ORDER BY 2, 1 LIMIT 10")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return search.vector_search(g, "Vector", "embedding", _vector(g), 10, "label = 3", "l2").select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_similar", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE vec_id<>0 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return search.similar(g, make_id(0, g.catalog.types["Vector"].type_id, 0), "Vector", "embedding", 5).select("vec_id", F.round("score", 6).alias("score"))


@query("hybrid_rrf", f"WITH p AS (SELECT vec_id, label, row_number() OVER (ORDER BY 1-list_cosine_similarity(embedding::DOUBLE[], {_Q}), vec_id) AS r FROM embeddings QUALIFY r <= 100) SELECT vec_id, round(1.0/(60+r) + CASE WHEN vec_id=0 THEN 1.0/60 WHEN label=(SELECT label FROM embeddings WHERE vec_id=0) THEN 1.0/62 ELSE 0 END, 8) AS score FROM p ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    g.create_type("Tag", label="int").relation("TAGGED", "Vector", "Tag")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    g.map_table("Tag", vectors.select("label").distinct(), "label", {"label": "label"}).map_edges("TAGGED", vectors, ("Vector", "vec_id"), ("Tag", "label"), key="vec_id")
    anchor = make_id(0, g.catalog.types["Vector"].type_id, 0)
    return search.hybrid(g, "Vector", "embedding", _vector(g), anchor, 10, edge_types=("TAGGED",)).select(id_local(F.col("_id")).alias("vec_id"), F.round("score", 8).alias("score"))


@query("fulltext_match", r"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, round(len(list_filter(w, lambda x: x='license'))/(1+ln(len(w)+1)), 6) AS score FROM d WHERE list_contains(w,'license') AND NOT list_contains(w,'apache')")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return search.fulltext(g, "Document", ["text"], "license -apache").select("doc_id", F.round("score", 6).alias("score"))


@query("fulltext_phrase_or", r"WITH d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM documents) SELECT doc_id FROM d WHERE contains(t, ' public license ') OR contains(t, ' apache ')")
def _(spark, sf_dir):
    return search.fulltext(testdata_graph(spark, sf_dir), "Document", ["text"], '"public license" OR apache').select("doc_id")


@query("as_of_lookup", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(spark, sf_dir):
    events = testdata_graph(spark, sf_dir).label_view("Event")
    return history.as_of(events, datetime(2024, 1, 15), "user_id", "ts", "event_type", "event_id").withColumnRenamed("event_type", "state")


@query("history_intervals", "SELECT event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events")
def _(spark, sf_dir):
    events = testdata_graph(spark, sf_dir).label_view("Event")
    return history.history(events, "user_id", "ts", "event_id").select("event_id", "valid_from", "valid_to")


@query("apoc_meta_schema", "SELECT 'PLACED' AS relation, 'Customer' AS source, 'Order' AS target, count(*) AS n FROM orders UNION ALL SELECT 'BASED_IN','Customer','Nation',count(*) FROM customer UNION ALL SELECT 'BASED_IN','Supplier','Nation',count(*) FROM supplier")
def _(spark, sf_dir):
    out = cypher(testdata_graph(spark, sf_dir), "CALL apoc.meta.schema() YIELD relation, source, target, n RETURN relation, source, target, n")
    return out.filter(F.col("relation").isin("PLACED", "BASED_IN"))


@query("call_vector_index", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    g.catalog.indexes["vec"] = {"kind": "vector", "type": "Vector", "props": ["embedding"]}
    return cypher(g, "CALL db.index.vector.queryNodes('vec', 5, $q) YIELD node, score RETURN node.vec_id AS vec_id, round(score, 6) AS score", {"q": [float(x) for x in _vector(g)]})


@query("call_fulltext_index", r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'apache')")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    g.catalog.indexes["docs"] = {"kind": "fulltext", "type": "Document", "props": ["text"]}
    return cypher(g, "CALL db.index.fulltext.queryNodes('docs', 'apache') YIELD node, score RETURN node.doc_id AS doc_id")


@query("neighbours_tohop", "WITH e AS (SELECT DISTINCT l_suppkey a, l_partkey b FROM lineitem) SELECT (SELECT count(DISTINCT b) FROM e WHERE a=5) + (SELECT count(DISTINCT y.a) FROM e x JOIN e y ON x.b=y.b WHERE x.a=5 AND y.a<>5) AS n")
def _(spark, sf_dir):
    return cypher(testdata_graph(spark, sf_dir), "MATCH (s:Supplier {suppkey: 5}) CALL apoc.neighbors.tohop(s, 'SUPPLIES', 2) YIELD node RETURN count(DISTINCT node) AS n")


@query("json_rows", "SELECT r_name AS name FROM region")
def _(spark, sf_dir):
    from quiver.plans.cypher import cypher_json

    return cypher_json(testdata_graph(spark, sf_dir), "MATCH (r:Region) RETURN r.name AS name").select(F.get_json_object("row", "$.name").alias("name"))


# writes ----------------------------------------------------------------------
def _regions(spark, sf_dir):
    from quiver.graph import Graph

    whole, g = testdata_graph(spark, sf_dir), Graph(spark)
    g.catalog = whole.catalog
    g.nodes = {t: whole.nodes[t] for t in ("Region", "Nation")}
    g.edges = {"IN_REGION": whole.edges["IN_REGION"]}
    return g


@query("create_rows", "SELECT r_name AS name FROM region UNION ALL SELECT 'ATLANTIS' UNION ALL SELECT 'MU'")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "UNWIND ['ATLANTIS', 'MU'] AS x CREATE (:Region {name: x})")
    return cypher(g, "MATCH (r:Region) RETURN r.name AS name")


@query("create_edges", "SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON r_regionkey=n_regionkey GROUP BY 1 UNION ALL SELECT 'ATLANTIS', count(*) FROM nation WHERE n_nationkey < 3")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "CREATE (:Region {name: 'ATLANTIS'})")
    g, _ = write.execute(g, "MATCH (n:Nation), (r:Region {name: 'ATLANTIS'}) WHERE n.nationkey < 3 CREATE (n)-[:IN_REGION]->(r)")
    return cypher(g, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS nations")


@query("merge_counts", "SELECT r_name AS name, CASE WHEN r_name='ASIA' THEN 1 END AS seen FROM region UNION ALL SELECT 'ATLANTIS', 0")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "UNWIND ['ASIA', 'ATLANTIS', 'ATLANTIS'] AS x MERGE (r:Region {name: x}) ON CREATE SET r.seen = 0 ON MATCH SET r.seen = 1")
    return cypher(g, "MATCH (r:Region) RETURN r.name AS name, r.seen AS seen")


@query("set_and_remove", "SELECT n_name AS name, CASE WHEN n_nationkey >= 10 THEN n_nationkey * 2 END AS twice FROM nation WHERE n_nationkey >= 5")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "MATCH (n:Nation) SET n.twice = n.nationkey * 2")
    g, _ = write.execute(g, "MATCH (n:Nation) WHERE n.nationkey < 10 REMOVE n.twice")
    return cypher(g, "MATCH (n:Nation) WHERE n.nationkey >= 5 RETURN n.name AS name, n.twice AS twice")


@query("detach_delete", "SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM nation JOIN region ON r_regionkey=n_regionkey WHERE r_name<>'ASIA') AS edges, (SELECT count(*)-1 FROM region) AS regions")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "MATCH (r:Region {name: 'ASIA'}) DETACH DELETE r")
    n = lambda q, c: cypher(g, q + f" RETURN count(*) AS {c}")
    return n("MATCH (n:Nation)", "nations").crossJoin(n("MATCH (:Nation)-[e:IN_REGION]->()", "edges")).crossJoin(n("MATCH (r:Region)", "regions"))


@query("change_history", "SELECT 'd' AS op, 1::BIGINT AS n UNION ALL SELECT 'i', (SELECT count(*) FROM region)+1 UNION ALL SELECT 'u', 1")
def _(spark, sf_dir):
    g = write.enable_history(_regions(spark, sf_dir), "Region")
    for q in ("CREATE (:Region {name: 'ATLANTIS'})", "MATCH (r:Region {name: 'ATLANTIS'}) SET r.name = 'LOST'", "MATCH (r:Region {name: 'LOST'}) DELETE r"):
        g, _ = write.execute(g, q)
    return g.changes.groupBy("op").agg(F.count("*").alias("n"))


# TypeQL ----------------------------------------------------------------------
def typeql_store(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    store = typeql.Store(spark)
    store, _ = typeql.run(store, """define
      attribute name, value string; attribute custkey, value integer; attribute suppkey, value integer; attribute acctbal, value double;
      attribute key-number, value integer; attribute status, value string; attribute price, value double; attribute segment, value string;
      entity party @abstract, owns name, owns acctbal, plays basing:member; entity customer sub party, owns custkey @key, owns segment, plays placing:buyer;
      entity supplier sub party, owns suppkey @key; entity nation, owns name, plays basing:place; entity order, owns key-number @key, owns status, owns price, plays placing:bought;
      relation basing, relates member, relates place; relation placing, relates buyer, relates bought;""")
    store.map_instances("customer", read("customer"), "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "custkey": "c_custkey", "segment": "c_mktsegment"})
    store.map_instances("supplier", read("supplier"), "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal", "suppkey": "s_suppkey"})
    store.map_instances("nation", read("nation"), "n_nationkey", {"name": "n_name"})
    store.map_instances("order", read("orders"), "o_orderkey", {"key-number": "o_orderkey", "status": "o_orderstatus", "price": "o_totalprice"})
    store.map_relation("basing", read("customer"), "c_custkey", {"member": ("customer", "c_custkey"), "place": ("nation", "c_nationkey")})
    store.map_relation("placing", read("orders"), "o_orderkey", {"buyer": ("customer", "o_custkey"), "bought": ("order", "o_orderkey")})
    return store


def _t(name: str, text: str, sql: str) -> None:
    _SQL[name] = sql
    _OTHER[name] = lambda spark, sf_dir: typeql.typeql(typeql_store(spark, sf_dir), text)


_t("typeql_isa_subtypes", "match $p isa party; reduce $n = count;", "SELECT (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier) AS n")
_t("typeql_isa_exact", "match $p isa! party; reduce $n = count;", "SELECT 0::BIGINT AS n")
_t("typeql_has_filter", "match $c isa customer, has custkey $k, has acctbal > 9000.0, has segment == 'BUILDING'; select $k;", "SELECT c_custkey AS k FROM customer WHERE c_acctbal>9000 AND c_mktsegment='BUILDING'")
_t("typeql_links", "match $p isa placing, links (buyer: $c, bought: $o); $o has status 'F'; $c has segment $s; reduce $n = count groupby $s;", "SELECT c_mktsegment AS s, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderstatus='F' GROUP BY 1")
_t("typeql_positional", "match placing ($a, $b); reduce $n = count;", "SELECT 2*count(*) AS n FROM orders")
_t("typeql_reduce_groupby", "match $o isa order, has status $status, has price $p; reduce $m = median($p), $s = max($p), $low = min($p), $n = count groupby $status;", "SELECT o_orderstatus AS status, median(o_totalprice) AS m, max(o_totalprice) AS s, min(o_totalprice) AS low, count(*) AS n FROM orders GROUP BY 1")
_t("typeql_not", "match $c isa customer, has custkey $k; not { placing (buyer: $c, bought: $o); $o has price > 250000.0; }; select $k;", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>250000)")
_t("typeql_or", "match $c isa customer, has custkey $k, has acctbal $a; { $a < 0.0; } or { placing (buyer: $c, bought: $o); $o has price > 400000.0; }; select $k;", "SELECT c_custkey AS k FROM customer WHERE c_acctbal<0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)")
_t("typeql_let_compare", "match $c isa customer, has custkey $k, has acctbal $a; let $b = round($a * 2.0 - 1.0); $b > 19000.0; select $k, $b;", "SELECT c_custkey AS k, round(c_acctbal*2-1) AS b FROM customer WHERE round(c_acctbal*2-1) > 19000")
_t("typeql_sort_limit", "match $c isa customer, has custkey $k, has acctbal $a; sort $a desc, $k; offset 3; limit 7; select $k;", "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 3")
_t("typeql_distinct", "match $c isa customer, has segment $s; select $s; distinct;", "SELECT DISTINCT c_mktsegment AS s FROM customer")
_t("typeql_like_contains", "match $n isa nation, has name $x; $x like '_1[0-4]$'; $x contains 'nation'; select $x;", "SELECT n_name AS x FROM nation WHERE regexp_matches(n_name,'_1[0-4]$') AND contains(lower(n_name),'nation')")
_t("typeql_cross_components", "match $n isa nation, has name $a; $a contains '_1'; $m isa nation, has name $b; $b like '_2[0-4]$'; select $a, $b;", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE contains(a.n_name,'_1') AND regexp_matches(b.n_name,'_2[0-4]$')")
_t("typeql_fetch", "match $c isa customer, has custkey $k; $k < 5; fetch { \"key\": $k, \"segment\": $c.segment };", "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_custkey<5")


_t("typeql_fetch_all", "match $c isa customer, has custkey $k; fetch { \"key\": $k, \"segment\": $c.segment };", "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer")


@query("typeql_fetch_nested_all", "SELECT c_custkey AS key, count(o_orderkey)::INT AS orders, 1 AS names FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def _(spark, sf_dir):
    out = typeql.typeql(typeql_store(spark, sf_dir), 'match $c isa customer, has custkey $k; fetch { "key": $k, "doc": { "names": [$c.name] }, "orders": [match placing (buyer: $c, bought: $o); fetch { "number": $o.key-number };] };')
    return out.select("key", F.size("orders").alias("orders"), F.size("doc.names").alias("names"))


@query("typeql_fetch_nested", "SELECT c_custkey AS key, count(o_orderkey)::INT AS orders, 1 AS names FROM customer LEFT JOIN orders ON o_custkey=c_custkey WHERE c_custkey<20 GROUP BY 1")
def _(spark, sf_dir):
    out = typeql.typeql(typeql_store(spark, sf_dir), 'match $c isa customer, has custkey $k; $k < 20; fetch { "key": $k, "doc": { "names": [$c.name] }, "orders": [match placing (buyer: $c, bought: $o); fetch { "number": $o.key-number };] };')
    return out.select("key", F.size("orders").alias("orders"), F.size("doc.names").alias("names"))


@query("typeql_insert_delete", "SELECT count(*)+1 AS n FROM supplier")
def _(spark, sf_dir):
    store, _ = typeql.run(typeql_store(spark, sf_dir), 'insert $s isa supplier, has suppkey 900001, has name "new"; $t isa supplier, has suppkey 900002, has name "gone";')
    store, _ = typeql.run(store, 'match $t isa supplier, has name "gone"; delete $t;')
    return typeql.typeql(store, "match $s isa supplier; reduce $n = count;")


@query("cypher_typeql_agree", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1")
def _(spark, sf_dir):
    a = cypher(testdata_graph(spark, sf_dir), "MATCH (:Customer)-[:BASED_IN]->(n:Nation) RETURN n.name AS nation, count(*) AS n")
    b = typeql.typeql(typeql_store(spark, sf_dir), "match basing (member: $c, place: $p); $p has name $nation; reduce $n = count groupby $nation;")
    return a.intersect(b)


# analytics that the DataFrame side adds ---------------------------------------
@query("rollup_revenue", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
def _(spark, sf_dir):
    return testdata_graph(spark, sf_dir).label_view("Order").rollup("status", "priority").agg(F.count("*").alias("n"))


@query("rdf_round_trip", "SELECT 12::BIGINT AS n, 1::BIGINT AS owned")
def _(spark, sf_dir):
    from quiver.graph import Graph
    from quiver.sources import rdf

    g, _ = rdf.load(Graph(spark), RDF_SAMPLE)
    owned = cypher(g, "MATCH (o:Observer)-[:reads]->(s:Station) RETURN count(*) AS owned")
    return rdf.dump(g).agg(F.count("*").alias("n")).crossJoin(owned)


@query("packed_adjacency", "WITH e AS (SELECT l_suppkey s, row_number() OVER (PARTITION BY l_suppkey) - 1 AS r FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) SELECT s AS suppkey, (r // 64)::INT AS seq, count(*)::INT AS n FROM e GROUP BY 1, 2")
def _(spark, sf_dir):
    return testdata_graph(spark, sf_dir).packed("SUPPLIES", chunk=64).select(id_local(F.col("_src")).alias("suppkey"), "seq", "n")


@query("segment_unnest", "SELECT DISTINCT l_suppkey AS suppkey, l_partkey AS partkey FROM lineitem")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return g.unpacked(g.packed("SUPPLIES", chunk=64)).select(id_local(F.col("_src")).alias("suppkey"), id_local(F.col("nbr")).alias("partkey"))


@query("prop_lookup", "SELECT r_name AS name FROM region UNION ALL SELECT NULL FROM orders WHERE o_orderkey < 10")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    wanted = g.label_view("Region").select("_id").unionByName(g.label_view("Order").filter("orderkey < 10").select("_id"))
    return g.prop(wanted, "name").select("name")


@query("prop_lookup_all", "SELECT r_name AS name FROM region UNION ALL SELECT NULL FROM orders")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    wanted = g.label_view("Region").select("_id").unionByName(g.label_view("Order").select("_id"))
    return g.prop(wanted, "name").select("name")


@query("rename_type", "SELECT count(*) AS n FROM nation")
def _(spark, sf_dir):
    return cypher(_regions(spark, sf_dir).rename_type("Nation", "Country"), "MATCH (c:Country)-[:IN_REGION]->(:Region) RETURN count(c) AS n")


@query("typeql_role_specialisation", "SELECT 'buyer' AS role, count(*) AS n FROM orders UNION ALL SELECT 'member', count(*) FROM customer")
def _(spark, sf_dir):
    store, _ = typeql.run(typeql_store(spark, sf_dir), "define relation linking, relates linked; relation basing sub linking, relates member as linked; relation placing sub linking, relates buyer as linked;")
    store.catalog.types["basing"].roles["member"].parent = store.catalog.types["placing"].roles["buyer"].parent = "linked"
    found = typeql.typeql(store, "match $r isa linking, links (linked: $x); select $r, $x;")
    return found.withColumn("role", F.when(id_type(F.col("r")) == store.catalog.types["placing"].type_id, "buyer").otherwise("member")).groupBy("role").agg(F.count("*").alias("n"))


@query("typeql_define_views", "SELECT 'buyer' AS role, 'placing' AS relation UNION ALL SELECT 'bought','placing' UNION ALL SELECT 'member','basing' UNION ALL SELECT 'place','basing'")
def _(spark, sf_dir):
    return typeql_store(spark, sf_dir).views()["role"].select("role", "relation")


@query("mapped_and_stored", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON r_regionkey=n_regionkey GROUP BY 1")
def _(spark, sf_dir):
    g = _regions(spark, sf_dir)
    g.materialize("Nation", f"{traverse.shared_folder(spark.sparkContext)}/nation-{spark.sparkContext.applicationId}")
    return cypher(g, "MATCH (:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n")


RDF_SAMPLE = """@prefix w: <http://weather.test/ns#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
w:Station a owl:Class . w:Buoy a owl:Class ; rdfs:subClassOf w:Station . w:Observer a owl:Class .
w:reads a owl:ObjectProperty ; rdfs:domain w:Observer ; rdfs:range w:Station .
w:ines a w:Observer ; w:badge "17"^^xsd:integer . w:b12 a w:Buoy ; w:site "Nordsee"@de . w:ines w:reads w:b12 .
"""


def _triples(spark, sf_dir):
    """Parties, nations and their relation as triples with typed literals."""
    from quiver.sources import rdf

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    base, null = "http://shop.test/", F.lit(None).cast("string")
    iri = lambda kind, key: F.concat(F.lit(f"{base}{kind}/"), F.col(key).cast("string"))
    row = lambda s, p, o, kind="iri", datatype=null: (s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("datatype"), null.alias("lang"))
    schema = [(base + c, rdf.RDF + "type", rdf.OWL + "Class") for c in ("Party", "Customer", "Supplier", "Nation")] + [(base + c, rdf.RDFS + "subClassOf", base + "Party") for c in ("Customer", "Supplier")]
    schema += [(base + "basedIn", rdf.RDF + "type", rdf.OWL + "ObjectProperty"), (base + "basedIn", rdf.RDFS + "domain", base + "Party"), (base + "basedIn", rdf.RDFS + "range", base + "Nation")]
    out = spark.createDataFrame([(*t, "iri", None, None) for t in schema], rdf.SCHEMA)
    for kind, table, key, values in (("Customer", "customer", "c_custkey", {"balance": ("c_acctbal", "double"), "title": ("c_name", "string"), "number": ("c_custkey", "long")}), ("Supplier", "supplier", "s_suppkey", {"balance": ("s_acctbal", "double")}), ("Nation", "nation", "n_nationkey", {"title": ("n_name", "string")})):
        frame, me = read(table), iri(kind, key)
        out = out.unionByName(frame.select(*row(me, rdf.RDF + "type", F.lit(base + kind))))
        for name, (column, datatype) in values.items():
            out = out.unionByName(frame.select(*row(me, base + name, F.col(column).cast("string"), "literal", F.lit(rdf.XSD + datatype))))
        if kind != "Nation":
            out = out.unionByName(frame.select(*row(me, base + "basedIn", iri("Nation", f"{table[0]}_nationkey"))))
    return out


def _rdf_graph(spark, sf_dir):
    from quiver.graph import Graph
    from quiver.sources import rdf

    return rdf.load_triples(Graph(spark), _triples(spark, sf_dir))


@query("rdf_many_subjects", "SELECT n_name AS nation, count(*) AS parties, round(sum(b), 2) AS balance FROM (SELECT c_nationkey k, c_acctbal b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) JOIN nation ON n_nationkey=k GROUP BY 1")
def _(spark, sf_dir):
    g, _ = _rdf_graph(spark, sf_dir)
    return cypher(g, "MATCH (p:Party)-[:basedIn]->(n:Nation) RETURN n.title AS nation, count(DISTINCT p) AS parties, round(sum(p.balance), 2) AS balance")


@query("rdf_typed_literals", "SELECT c_custkey AS number, c_acctbal AS balance, c_name AS title FROM customer")
def _(spark, sf_dir):
    g, _ = _rdf_graph(spark, sf_dir)
    return cypher(g, "MATCH (c:Customer) RETURN c.number AS number, c.balance AS balance, c.title AS title")


@query("rdf_dump_lines", "SELECT 'http://shop.test/balance' AS p, (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'http://shop.test/basedIn', (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier) UNION ALL SELECT 'http://shop.test/number', (SELECT count(*) FROM customer) UNION ALL SELECT 'http://shop.test/title', (SELECT count(*) FROM customer)+(SELECT count(*) FROM nation)")
def _(spark, sf_dir):
    from quiver.sources import rdf

    g, _ = _rdf_graph(spark, sf_dir)
    for t in ("Customer", "Supplier", "Nation"):
        for p in g.catalog.types[t].properties.values():
            p.iri = f"http://shop.test/{p.name}"
    p = F.regexp_extract("line", "^<[^>]*> <(http://shop[.]test/[a-z][A-Za-z]*)>", 1).alias("p")
    return rdf.dump(g).select(p).filter("p <> ''").groupBy("p").agg(F.count("*").alias("n"))


@query("rdf_report", "SELECT 4::BIGINT AS classes, 1::BIGINT AS relations, (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier)+(SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier) AS edges, 0::BIGINT AS overflow")
def _(spark, sf_dir):
    _, report = _rdf_graph(spark, sf_dir)
    return spark.createDataFrame([tuple(report[k] for k in ("classes", "relations", "nodes", "edges", "overflow"))], "classes long, relations long, nodes long, edges long, overflow long")


# projections, functions and procedures over whole tables ----------------------
_c("return_star", "MATCH (n:Nation) WITH n.name AS name, n.nationkey AS nationkey RETURN *", "SELECT n_name AS name, n_nationkey AS nationkey FROM nation")
_c("default_names", "MATCH (c:Customer) RETURN c.mktsegment, count(*)", 'SELECT c_mktsegment AS "c.mktsegment", count(*) AS "count(*)" FROM customer GROUP BY 1')
_c("whole_relationship", "MATCH (o:Order)-[r:CONTAINS]->(:Part) WITH o, collect(r) AS rs UNWIND rs AS x RETURN x._type AS kind, count(*) AS n, round(sum(x.quantity), 2) AS quantity", "SELECT 'CONTAINS' AS kind, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem")
_c("edge_property_join", "MATCH (o:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE l.quantity > p.size RETURN p.brand AS brand, count(*) AS n, round(sum(l.price), 2) AS revenue", "SELECT p_brand AS brand, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_returnflag='R' AND l_quantity>p_size GROUP BY 1")
_c("rebind_value", "MATCH (n:Nation) WITH collect(n) AS ns UNWIND ns AS x MATCH (x)<-[:BASED_IN]-(c:Customer) RETURN x.name AS nation, count(c) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1")
_c("string_predicates_part", "MATCH (p:Part) WHERE p.name STARTS WITH 'red' AND p.name CONTAINS 'i' AND NOT p.name ENDS WITH 'g' RETURN p.partkey AS partkey, toUpper(p.name) AS up", "SELECT p_partkey AS partkey, upper(p_name) AS up FROM part WHERE starts_with(p_name,'red') AND contains(p_name,'i') AND NOT ends_with(p_name,'g')")
_c("rand_range", "MATCH (o:Order) WITH o.orderkey AS k, rand() AS x RETURN k, x >= 0 AND x < 1 AS inside", "SELECT o_orderkey AS k, true AS inside FROM orders")
_c("clock_functions", "MATCH (r:Region) RETURN r.name AS name, timestamp() > 1600000000 AS later, exists(datetime()) AS known", "SELECT r_name AS name, true AS later, true AS known FROM region")
_c("exists_function", "MATCH (p:Party) WHERE exists(p.mktsegment) RETURN p.mktsegment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
_c("ceil_floor", "MATCH (o:Order) RETURN sum(ceil(o.totalprice)) AS up, sum(floor(o.totalprice)) AS down", "SELECT sum(ceil(o_totalprice))::BIGINT AS up, sum(floor(o_totalprice))::BIGINT AS down FROM orders")
_c("vector_functions", "MATCH (v:Vector) RETURN v.vec_id AS vec_id, round(vector.similarity(v.embedding, $q), 5) AS cosine, round(vector.distance(v.embedding, $q), 5) AS apart, round(vector.l2(v.embedding, $q), 5) AS l2", "WITH q AS (SELECT list_transform(range(64), lambda x: (x % 7 - 3)::DOUBLE) AS q) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS cosine, round(1-list_cosine_similarity(embedding::DOUBLE[], q), 5) AS apart, round(list_distance(embedding::DOUBLE[], q), 5) AS l2 FROM embeddings, q", q=[float(i % 7 - 3) for i in range(64)])
_c("call_relationship_types", "CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS name", "SELECT unnest(['BASED_IN','CONTAINS','IN_REGION','NEXT','PLACED','SHIPPED_BY','SUPPLIES']) AS name")
_c("call_property_keys", "CALL db.propertyKeys() YIELD propertyKey WITH propertyKey AS k WHERE k STARTS WITH 'c' RETURN k", "SELECT unnest(['conv_id','custkey']) AS k")
_c("call_components", "CALL dbms.components() YIELD name, edition RETURN count(*) AS n, count(DISTINCT edition) AS editions", "SELECT 1::BIGINT AS n, 1::BIGINT AS editions")
_c("call_no_op", "CALL db.awaitIndexes() YIELD done RETURN done", "SELECT true AS done")
_c("vlp_undirected_distinct", "MATCH (a:Turn {turn: 1})-[:NEXT*1..6]-(b:Turn) RETURN DISTINCT b.conv_id AS conv_id, b.turn AS turn", "SELECT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id WHERE a.turn=1 AND b.turn<>1 AND abs(b.turn-1)<=6")
_c("vlp_low_two", "MATCH (a:Turn {turn: 0})-[:NEXT*2..4]->(b:Turn) RETURN DISTINCT b.conv_id AS conv_id, b.turn AS turn", "SELECT DISTINCT b.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id WHERE a.turn=0 AND b.turn BETWEEN 2 AND 4")


def _ranked(frame: DataFrame) -> DataFrame:
    """Rows with their place; an ordered result with a limit is one partition."""
    return frame.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("order_with_places", "SELECT p_partkey AS partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 6 AS place FROM part QUALIFY place BETWEEN 0 AND 19")
def _(spark, sf_dir):
    return _ranked(cypher(testdata_graph(spark, sf_dir), "MATCH (p:Part) RETURN p.partkey AS partkey ORDER BY p.retailprice DESC, p.partkey SKIP 5 LIMIT 20"))


@query("typeql_sort_places", "SELECT c_custkey AS k, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 4 AS place FROM customer QUALIFY place BETWEEN 0 AND 6")
def _(spark, sf_dir):
    return _ranked(typeql.typeql(typeql_store(spark, sf_dir), "match $c isa customer, has custkey $k, has acctbal $a; sort $a desc, $k; offset 3; limit 7; select $k;"))


@query("collect_in_order", "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey=n_regionkey GROUP BY 1")
def _(spark, sf_dir):
    out = cypher(testdata_graph(spark, sf_dir), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, n.name AS nation ORDER BY nation RETURN region, collect(nation) AS nations")
    return out.select("region", F.array_join("nations", ",").alias("nations"))


@query("edges_by_root", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS sources, count(DISTINCT o_orderkey) AS targets FROM orders")
def _(spark, sf_dir):
    return testdata_graph(spark, sf_dir).edges_of("PLACED").agg(F.count("*").alias("n"), F.count_distinct("_src").alias("sources"), F.count_distinct("_dst").alias("targets"))


@query("edge_id_type", "SELECT 'CONTAINS' AS kind, count(*) AS n, count(*) AS ids FROM lineitem UNION ALL SELECT 'PLACED', count(*), count(*) FROM orders")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    frames = [g.edges[t].select("_id", id_type(F.col("_id")).alias("type_id")) for t in ("CONTAINS", "PLACED")]
    names = spark.createDataFrame([(t.type_id, t.name) for t in g.catalog.types.values()], "type_id int, kind string")
    return frames[0].unionByName(frames[1]).join(F.broadcast(names), "type_id").groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("_id").alias("ids"))


@query("map_string_key", "SELECT p_brand AS brand, count(*) AS parts, count(DISTINCT p_type) AS types FROM part GROUP BY 1")
def _(spark, sf_dir):
    from quiver.graph import Graph

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    g = Graph(spark).create_type("Brand", name="string").create_type("Item", sort="string", number="long").relation("OF", "Item", "Brand")
    g.map_table("Brand", part.select("p_brand").distinct(), "p_brand", {"name": "p_brand"}).map_table("Item", part, "p_partkey", {"sort": "p_type", "number": "p_partkey"})
    g.map_edges("OF", part, ("Item", "p_partkey"), ("Brand", "p_brand"), key="p_partkey")
    return cypher(g, "MATCH (i:Item)-[:OF]->(b:Brand) RETURN b.name AS brand, count(*) AS parts, count(DISTINCT i.sort) AS types")


@query("rls_mid_path", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey WHERE c_acctbal > 5000")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir).enable_rls("Party", "acctbal > 5000")
    return cypher(g, "MATCH (n:Nation)<-[:BASED_IN]-()-[:PLACED]->(o:Order) RETURN count(*) AS n, count(DISTINCT o) AS orders")


@query("rls_trails", "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_acctbal > 5000")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir).enable_rls("Party", "acctbal > 5000")
    return cypher(g, "MATCH (c)-[:PLACED*1..2]->(o:Order) RETURN count(*) AS n")


@query("constraint_enforced", "SELECT 'constraint' AS code, count(*) AS n FROM nation")
def _(spark, sf_dir):
    from quiver.catalog import GraphError

    g, _ = write.execute(_regions(spark, sf_dir), "CREATE CONSTRAINT one FOR (n:Nation) REQUIRE n.name IS UNIQUE")
    try:
        g, _ = write.execute(g, "CREATE (:Nation {name: 'NATION_1'})")
        code = "none"
    except GraphError as e:
        code = e.code
    return cypher(g, "MATCH (n:Nation) RETURN $code AS code, count(*) AS n", {"code": code})


@query("constraint_dropped", "SELECT count(*) + 1 AS n FROM nation")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "CREATE CONSTRAINT one FOR (n:Nation) REQUIRE n.name IS UNIQUE")
    g, _ = write.execute(g, "DROP CONSTRAINT one")
    g, _ = write.execute(g, "CREATE (:Nation {name: 'NATION_1'})")
    return cypher(g, "MATCH (n:Nation) RETURN count(*) AS n")


@query("relabel", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON r_regionkey=n_regionkey GROUP BY 1")
def _(spark, sf_dir):
    g, _ = write.execute(_regions(spark, sf_dir), "MATCH (n:Nation) REMOVE n:Nation SET n:Country")
    return cypher(g, "MATCH (c:Country)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n")


@query("read_only_role", "SELECT 'read_only' AS code, count(*) AS n FROM region")
def _(spark, sf_dir):
    from quiver import agent
    from quiver.catalog import GraphError

    g = _regions(spark, sf_dir)
    agent.create_role(g, "reader", read_only=True)
    agent.apply_role(g, "reader")
    try:
        g, _ = write.execute(g, "CREATE (:Region {name: 'MU'})")
        code = "none"
    except GraphError as e:
        code = e.code
    finally:
        g.catalog.settings.clear()
    return cypher(g, "MATCH (r:Region) RETURN $code AS code, count(*) AS n", {"code": code})


@query("writes_by_function", "SELECT o_orderpriority AS name, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, sf_dir):
    whole = testdata_graph(spark, sf_dir)
    g = whole.create_type("Priority", name="string").relation("HAS_PRIORITY", "Order", "Priority")
    orders = g.label_view("Order").select("_id", "priority")
    g = write.create_nodes(g, "Priority", orders.select(F.col("priority").alias("name")).distinct())
    made = g.nodes["Priority"].select(F.col("_id").alias("_dst"), "name")
    g = write.create_edges(g, "HAS_PRIORITY", orders.join(F.broadcast(made), F.col("priority") == F.col("name")).select(F.col("_id").alias("_src"), "_dst"))
    return cypher(g, "MATCH (:Order)-[:HAS_PRIORITY]->(p:Priority) RETURN p.name AS name, count(*) AS orders")


@query("provenance", "SELECT c_mktsegment AS source, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    rows = g.label_view("Customer").select(F.col("_id").alias("entity_id"), F.col("mktsegment").alias("source"), F.lit(1.0).alias("confidence"), F.lit("load").alias("author"))
    history.set_source(g, rows.withColumn("source", F.lit("first")))
    history.set_source(g, rows)
    return g.sources.groupBy("source").agg(F.count("*").alias("n"))


@query("set_by_function", "SELECT CASE WHEN n_nationkey < 10 THEN 'low' ELSE n_name END AS name FROM nation")
def _(spark, sf_dir):
    g = _regions(spark, sf_dir)
    g = write.set_props(g, "Nation", g.nodes["Nation"].filter("nationkey < 10").select("_id", F.lit("low").alias("name")))
    return cypher(g, "MATCH (n:Nation) RETURN n.name AS name")


@query("delete_by_function", "SELECT count(*) AS n FROM nation WHERE n_nationkey >= 10")
def _(spark, sf_dir):
    g = _regions(spark, sf_dir)
    g = write.delete(g, g.nodes["Nation"].filter("nationkey < 10").select("_id"), detach=True)
    return cypher(g, "MATCH (n:Nation)-[:IN_REGION]->(:Region) RETURN count(*) AS n")


@query("drop_type", "SELECT count(*) AS n, 0::BIGINT AS edges FROM region")
def _(spark, sf_dir):
    g = _regions(spark, sf_dir).drop_type("Nation")
    return cypher(g, "MATCH (a) RETURN count(*) AS n").crossJoin(cypher(g, "MATCH ()-[e:IN_REGION]->() RETURN count(e) AS edges"))


@query("drop_graph", "SELECT 0::BIGINT AS n")
def _(spark, sf_dir):
    return cypher(_regions(spark, sf_dir).drop(), "MATCH (a) RETURN count(*) AS n")


@query("saved_and_loaded", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON r_regionkey=n_regionkey GROUP BY 1")
def _(spark, sf_dir):
    from quiver.graph import Graph

    path = f"{traverse.shared_folder(spark.sparkContext)}/saved-{spark.sparkContext.applicationId}"
    _regions(spark, sf_dir).save(path)
    return cypher(Graph.load(spark, path), "MATCH (:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n")


@query("pattern_diagnosis", "SELECT 0 AS step, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 1, (SELECT count(*) FROM orders)")
def _(spark, sf_dir):
    from quiver.plans.cypher import diagnose

    found = diagnose(testdata_graph(spark, sf_dir), "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c")
    return spark.createDataFrame([(d["step"], d["rows"]) for d in found], "step int, n long")


@query("csr_stats", "SELECT count(*) AS edges FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1")
def _(spark, sf_dir):
    found = traverse.Csr(testdata_graph(spark, sf_dir).edge_view("NEXT")).stats()
    return spark.createDataFrame([(found["edges"],)], "edges long")


@query("except_subtypes", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    return cypher(g, "MATCH (c:Customer) RETURN c.nationkey AS k").subtract(cypher(g, "MATCH (s:Supplier) WHERE s.acctbal > 9000 RETURN s.nationkey AS k"))


@query("typeql_reduce_more", "SELECT o_orderstatus AS status, round(avg(o_totalprice), 4) AS m, round(stddev_samp(o_totalprice), 4) AS d, round(sum(o_totalprice), 2) AS t, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    out = typeql.typeql(typeql_store(spark, sf_dir), "match $o isa order, has status $status, has price $p; reduce $m = mean($p), $d = std($p), $t = sum($p), $n = count groupby $status;")
    return out.select("status", F.round("m", 4).alias("m"), F.round("d", 4).alias("d"), F.round("t", 2).alias("t"), "n")


@query("typeql_update", "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_acctbal >= 9000 GROUP BY 1 UNION ALL SELECT 'small', count(*) FROM customer WHERE c_acctbal < 9000")
def _(spark, sf_dir):
    store, _ = typeql.run(typeql_store(spark, sf_dir), 'match $c isa customer, has acctbal $a; $a < 9000.0; update $c has segment "small";')
    return typeql.typeql(store, "match $c isa customer, has segment $s; reduce $n = count groupby $s;")


@query("typeql_put", "SELECT count(*)+1 AS n FROM supplier")
def _(spark, sf_dir):
    store = typeql_store(spark, sf_dir)
    for _ in range(2):
        store, _ = typeql.run(store, 'put $s isa supplier, has suppkey 900001, has name "once";')
    return typeql.typeql(store, "match $s isa supplier; reduce $n = count;")


@query("typeql_dump_round_trip", "SELECT true AS same")
def _(spark, sf_dir):
    store = typeql_store(spark, sf_dir)
    again, _ = typeql.run(typeql.Store(spark), typeql.dump(store))
    return spark.createDataFrame([(typeql.dump(again) == typeql.dump(store),)], "same boolean")


@query("graph_schema_text", "SELECT 'CONTAINS' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'Customer', count(*) FROM customer")
def _(spark, sf_dir):
    from quiver import agent

    lines = agent.schema(testdata_graph(spark, sf_dir)).splitlines()
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    name, n = F.regexp_extract("line", "^[a-z]+ ([A-Za-z_]+)", 1), F.regexp_extract("line", "# ([0-9]+) rows", 1).cast("long")
    return frame.select(name.alias("name"), n.alias("n")).filter("name in ('CONTAINS', 'Customer')")


@query("error_explained", "SELECT 'unbound' AS code, false AS ok")
def _(spark, sf_dir):
    from quiver import agent

    found = agent.explain_error(testdata_graph(spark, sf_dir), "MATCH (c:Customer) RETURN d.name")
    return spark.createDataFrame([(found["code"], found["ok"])], "code string, ok boolean")


@query("genai_encoder", "SELECT c_custkey AS custkey, length(c_name)::DOUBLE AS size FROM customer")
def _(spark, sf_dir):
    g = testdata_graph(spark, sf_dir)
    g.encoder = lambda text: F.array(F.length(text).cast("double"))
    return cypher(g, "MATCH (c:Customer) RETURN c.custkey AS custkey, genai.vector.encode(c.name)[0] AS size")


@query("stale_embeddings", "SELECT count(*) AS before, 0::BIGINT AS after FROM nation")
def _(spark, sf_dir):
    g = _regions(spark, sf_dir)
    nation = g.nodes["Nation"].withColumn("vector", F.array(F.col("nationkey").cast("float"), F.lit(1.0).cast("float")))
    search.add_embedding(g, "Nation", "vector", 2, source="name")
    g.nodes["Nation"] = nation
    before = search.stale_embeddings(g).count()
    search.mark_embedded(g, nation.selectExpr("_id", "name as source"), "vector")
    return spark.createDataFrame([(before, search.stale_embeddings(g).count())], "before long, after long")
