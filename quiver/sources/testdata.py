"""The TPC-H-like tables as one typed graph, mapped without a copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.catalog import GraphError
from quiver.graph import Graph, dense_ids
from quiver.ids import MAX_LOCAL


#: Lines of which one task finds the distinct pairs of supplier and part, about.
PAIR_LINES = 1_000_000
_graphs: dict[tuple[str, str], Graph] = {}


def testdata_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder: the schemas are read once for an application, each call gets its own version."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = _build(spark, sf_dir)
    return _graphs[key].version()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """turns with key, a local id of its own for each (conv_id, turn).

    conv_id * width + turn, where width covers the longest conversation.  Where
    that leaves the local bits, the conversations are laid end to end: offsets
    are summed by range of conv_id, and of at most 4096 ranges on the driver.
    """
    ends = turns.agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"), F.min("turn").alias("first"), F.max("turn").alias("last")).first()
    if ends["high"] is None or ends["last"] is None:
        return turns.withColumn("key", (F.col("conv_id") + F.col("turn")).cast("long"))
    if ends["first"] < 0:
        raise GraphError(f"turn {ends['first']} is negative", "id_range")
    width, conv = ends["last"] + 1, F.col("conv_id").cast("long")
    if ends["low"] >= 0 and (ends["high"] + 1) * width - 1 <= MAX_LOCAL:
        return turns.withColumn("key", conv * F.lit(width).cast("long") + F.col("turn"))
    step = -(-(ends["high"] - ends["low"] + 1) // 4096)
    sizes = turns.filter("conv_id is not null and turn is not null").groupBy(conv.alias("of")).agg((F.max("turn") + 1).cast("long").alias("n"))
    sizes = sizes.withColumn("range", F.floor((F.col("of") - F.lit(ends["low"])) / F.lit(step)))
    bases, total = [], 0
    for r in sorted(sizes.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        bases.append((r["range"], total))
        total += r["n"]
    if total - 1 > MAX_LOCAL:
        raise GraphError(f"{total} turns do not fit the local ids", "id_range")
    base = F.broadcast(turns.sparkSession.createDataFrame(bases, "range long, base long"))
    before: Column = F.sum("n").over(Window.partitionBy("range").orderBy("of")) - F.col("n")
    placed = sizes.withColumn("before", before).join(base, "range").select("of", (F.col("base") + F.col("before")).alias("offset"))
    return turns.join(placed, conv == F.col("of"), "left").withColumn("key", F.col("offset") + F.col("turn")).drop("of", "offset")


def _build(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    g = Graph(spark, "testdata")
    g.create_type("Place", abstract=True, name="string")
    g.create_type("Region", "Place", regionkey="int").create_type("Nation", "Place", nationkey="int")
    g.create_type("Party", abstract=True, name="string", acctbal="double", nationkey="int")
    g.create_type("Customer", "Party", custkey="long", mktsegment="string").create_type("Supplier", "Party", suppkey="long")
    g.create_type("Part", partkey="long", name="string", brand="string", type="string", size="int", retailprice="double")
    g.create_type("Order", orderkey="long", custkey="long", status="string", totalprice="double", orderdate="timestamp_ntz", priority="string")
    g.create_type("Event", event_id="long", user_id="long", event_type="string", value="double", ts="timestamp_ntz", props="json")
    g.create_type("Turn", conv_id="long", turn="long", role="string", text="string")
    g.create_type("Vector", vec_id="long", label="int", embedding="vector(64)")
    g.create_type("Document", doc_id="long", text="string", lang="string", source="string", n_chars="long")
    g.relation("IN_REGION", "Nation", "Region").relation("BASED_IN", "Party", "Nation").relation("PLACED", "Customer", "Order")
    g.relation("CONTAINS", "Order", "Part", quantity="double", price="double", discount="double", returnflag="string")
    g.relation("SHIPPED_BY", "Order", "Supplier", quantity="double").relation("SUPPLIES", "Supplier", "Part").relation("NEXT", "Turn", "Turn")

    region, nation, customer, supplier = map(read, ("region", "nation", "customer", "supplier"))
    orders, lineitem = read("orders"), read("lineitem")
    g.map_table("Region", region, "r_regionkey", {"name": "r_name", "regionkey": "r_regionkey"})
    g.map_table("Nation", nation, "n_nationkey", {"name": "n_name", "nationkey": "n_nationkey"})
    g.map_table("Customer", customer, "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "nationkey": "c_nationkey", "custkey": "c_custkey", "mktsegment": "c_mktsegment"})
    g.map_table("Supplier", supplier, "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal", "nationkey": "s_nationkey", "suppkey": "s_suppkey"})
    g.map_table("Part", read("part"), "p_partkey", {"partkey": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"})
    g.map_table("Order", orders, "o_orderkey", {"orderkey": "o_orderkey", "custkey": "o_custkey", "status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"})
    g.map_table("Event", read("events"), "event_id", {c: c for c in ("event_id", "user_id", "event_type", "value", "ts", "props")})
    turns = numbered_turns(read("conversations"))
    g.map_table("Turn", turns, "key", {c: c for c in ("conv_id", "turn", "role", "text")})
    g.map_table("Vector", read("embeddings"), "vec_id", {c: c for c in ("vec_id", "label", "embedding")})
    g.map_table("Document", read("documents"), "doc_id", {c: c for c in ("doc_id", "text", "lang", "source", "n_chars")})

    g.map_edges("IN_REGION", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey")
    g.map_edges("BASED_IN", customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey")
    based = supplier.withColumn("key", F.col("s_suppkey") + F.lit(1 << 35))
    g.edges["BASED_IN"] = g.edges["BASED_IN"].unionByName(g.map_edges("BASED_IN", based, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="key").edges["BASED_IN"])
    g.map_edges("PLACED", orders, ("Customer", "o_custkey"), ("Order", "o_orderkey"), key="o_orderkey")
    g.map_edges("CONTAINS", lineitem, ("Order", "l_orderkey"), ("Part", "l_partkey"), {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "returnflag": "l_returnflag"})
    g.map_edges("SHIPPED_BY", lineitem, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), {"quantity": "l_quantity"})
    # A pair's edge is named by its first line: a product of both keys would leave the local bits.
    # Dealt out by a count of lines, so that a task holds a bounded number of pairs.
    tasks = lineitem.count() // PAIR_LINES + 1
    lines = dense_ids(lineitem.select("l_suppkey", "l_partkey"), "line", 0).repartition(tasks, "l_suppkey", "l_partkey")
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(F.min("line").alias("key"))
    g.map_edges("SUPPLIES", pairs, ("Supplier", "l_suppkey"), ("Part", "l_partkey"), key="key")
    # A turn's successor is found by a join, so the edge exists only if both ends do.
    after = turns.select(F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("key").alias("next"))
    g.map_edges("NEXT", turns.select("conv_id", "turn", "key").join(after, ["conv_id", "turn"]), ("Turn", "key"), ("Turn", "next"), key="key")
    return g
