"""Parser, catalog, Cypher reads and writes on small graphs."""

import pytest

from quiver.catalog import Catalog, GraphError, edit_distance
from quiver.graph import Graph
from quiver.ids import id_local, id_shard, id_type, make_id, with_shard
from quiver.operators import write
from quiver.plans.cypher import check, columns, cypher, cypher_json, diagnose
from quiver.plans.cypher_parser import parse


@pytest.fixture(scope="module")
def harbour(spark):
    """Four ferries that follow one another, and a tug."""
    g = Graph(spark)
    for q in (
        "CREATE (:Vessel:Ferry {name: 'Alma', tons: 1200}), (:Vessel:Ferry {name: 'Brise', tons: 640}), (:Vessel:Ferry {name: 'Corvin', tons: 2100}), (:Vessel:Ferry {name: 'Dorte', tons: 900})",
        "CREATE (:Vessel:Tug {name: 'Ox', power: 8})",
        "MATCH (f:Ferry), (t:Ferry) WHERE f.name = 'Alma' AND t.name = 'Brise' CREATE (f)-[:FOLLOWS {gap: 12}]->(t)",
        "MATCH (f:Ferry), (t:Ferry) WHERE f.name = 'Brise' AND t.name = 'Dorte' CREATE (f)-[:FOLLOWS {gap: 30}]->(t)",
        "MATCH (f:Ferry), (t:Ferry) WHERE f.name = 'Dorte' AND t.name = 'Corvin' CREATE (f)-[:FOLLOWS {gap: 7}]->(t)",
        "MATCH (f:Ferry {name: 'Corvin'}), (t:Tug) CREATE (f)-[:TOWED_BY]->(t)",
    ):
        g, _ = write.execute(g, q)
    return g


def rows(graph, text, **params):
    return sorted(map(tuple, cypher(graph, text, params).collect()), key=repr)


def test_ids():
    x = make_id(3, 77, 12345)
    assert (id_shard(x), id_type(x), id_local(x)) == (3, 77, 12345) and id_shard(with_shard(x, 5)) == 5
    with pytest.raises(ValueError):
        make_id(0, 1 << 18, 0)


def test_catalog():
    c = Catalog()
    c.create_type("Vehicle")
    c.create_type("Car", parents=["Vehicle"])
    c.create_type("EV", parents=["Car"])
    c.create_type("Truck", parents=["Vehicle"])
    c.add_property("Vehicle", "year", "int")
    assert c.subtypes("Vehicle") == ["Vehicle", "Car", "EV", "Truck"] and c.is_subtype("EV", "Vehicle") and not c.is_subtype("Truck", "Car")
    assert "year" in c.types["EV"].properties and c.supertypes("EV") == ["EV", "Car", "Vehicle"]
    c.create_type("Amphibian", parents=["Car"])
    c.add_parent("Amphibian", "Truck")
    assert c.resolve([["Car"], ["Truck"]]) == ["Amphibian"]
    with pytest.raises(GraphError):
        c.add_parent("Vehicle", "EV")
    with pytest.raises(GraphError) as e:
        c.get("Vehicel")
    assert e.value.suggestions == ("Vehicle",) and edit_distance("kitten", "sitting") == 3
    again = Catalog.from_json(c.to_json())
    assert again.to_json() == c.to_json()
    with pytest.raises(GraphError):
        c.add_property("Car", "x", "strange")


def test_parser():
    assert columns("MATCH (n) RETURN n.name, count(*), n AS m, 1, $p, n.a + 1") == ["n.name", "count(*)", "m", "1", "$p", "expr"]
    q = parse("MATCH (a)-[:T*2..4]->(b)<-[r:S|U]-(c:A:B|C) WHERE NOT a.x = 1 OR a.y > 2 AND b.z RETURN a UNION ALL RETURN 1 AS a")
    path = q.clauses[0].patterns[0]
    assert path.edges[0].hops == (2, 4) and path.edges[1].direction == "in" and path.nodes[2].labels == [["A"], ["B", "C"]]
    assert q.clauses[0].where[1] == "OR" and q.union[0] == "all"
    assert parse("RETURN 2 ^ 3 ^ 2 AS x").clauses[0].items[0].expr == ("bin", "^", ("lit", 2), ("bin", "^", ("lit", 3), ("lit", 2)))
    bad = check("MATHC (n) RETURN n")
    assert not bad["ok"] and "MATCH" in bad["suggestions"]
    assert check("MATCH (n) DELETE n")["writes"]


def test_reads(harbour):
    assert rows(harbour, "MATCH (f:Ferry) WHERE f.tons > 1000 RETURN f.name") == [("Alma",), ("Corvin",)]
    assert rows(harbour, "MATCH (:Ferry {name: 'Alma'})-[:FOLLOWS*1..2]->(x) RETURN x.name") == [("Brise",), ("Dorte",)]
    assert rows(harbour, "MATCH (v:Vessel) RETURN count(*), avg(v.tons)") == [(5, 1210.0)]
    assert rows(harbour, "MATCH (f:Ferry) OPTIONAL MATCH (f)-[k:FOLLOWS]->(q:Ferry) WHERE q.tons < 1000 RETURN f.name, q.name, k.gap") == [("Alma", "Brise", 12), ("Brise", "Dorte", 30), ("Corvin", None, None), ("Dorte", None, None)]
    assert rows(harbour, "MATCH (f:Ferry)-[r]->(b) RETURN type(r), labels(b)") == [("FOLLOWS", ["Ferry", "Vessel"])] * 3 + [("TOWED_BY", ["Tug", "Vessel"])]
    assert rows(harbour, "UNWIND [8, 5, 6] AS x WITH x ORDER BY x RETURN sum(x), collect(x)") == [(19, [5, 6, 8])]
    assert cypher_json(harbour, "MATCH (t:Tug) RETURN t.name AS n").first().row == '{"n":"Ox"}'
    assert [d["rows"] for d in diagnose(harbour, "MATCH (f:Ferry)-[:FOLLOWS]->(t:Tug) RETURN f")] == [4, 0]


def test_distinct_ends_of_undirected_trails(harbour):
    """Reachability gives the ends of all trails; a start only if a trail closes."""
    line = "MATCH (f:Ferry {name: 'Brise'})-[:FOLLOWS*1..3]-(x) RETURN DISTINCT x.name"
    assert rows(harbour, line) == [("Alma",), ("Corvin",), ("Dorte",)]
    ring, _ = write.execute(harbour, "MATCH (f:Ferry), (t:Ferry) WHERE f.name = 'Corvin' AND t.name = 'Brise' CREATE (f)-[:FOLLOWS {gap: 1}]->(t)")
    for top in (2, 3, 4):
        want = {r for r in rows(ring, f"MATCH (f:Ferry)-[:FOLLOWS*1..{top}]-(x) RETURN f.name, x.name")}
        assert set(rows(ring, f"MATCH (f:Ferry)-[:FOLLOWS*1..{top}]-(x) RETURN DISTINCT f.name, x.name")) == want


def test_errors(harbour):
    for text, code in (("MATCH (f:Ferry) RETURN q.name", "unbound"), ("MATCH (f:Ferry) RETURN foo(f)", "unknown_function"), ("CALL db.nothing()", "unknown_procedure"), ("MATCH (f:Ferry) RETURN $x", "missing_parameter"), ("MATCH (f) RETURN DISTINCT f.name ORDER BY f.tons", "distinct_order")):
        with pytest.raises(GraphError) as e:
            cypher(harbour, text)
        assert e.value.code == code


def test_writes(harbour):
    g, out = write.execute(harbour, "MATCH (f:Ferry {name: 'Corvin'}) SET f.tons = 2200 RETURN f.tons AS tons")
    assert [r.tons for r in out.collect()] == [2200] and g.counters["properties_set"] == 1
    assert rows(g, "MATCH (f:Ferry) RETURN max(f.tons)") == [(2200,)] and rows(harbour, "MATCH (f:Ferry) RETURN max(f.tons)") == [(2100,)]
    with pytest.raises(GraphError):
        write.execute(g, "MATCH (f:Ferry {name: 'Dorte'}) DELETE f")
    g, _ = write.execute(g, "MATCH (f:Ferry {name: 'Dorte'}) DETACH DELETE f")
    assert g.counters == {"relationships_deleted": 2, "nodes_deleted": 1, "contains_updates": True}
    g, _ = write.execute(g, "MATCH (f:Ferry {name: 'Alma'}) SET f = {name: 'A'}")
    assert rows(g, "MATCH (f:Ferry) WHERE f.tons IS NULL RETURN f.name") == [("A",)]
    g, _ = write.execute(g, "MERGE (f:Ferry {name: 'A'}) ON MATCH SET f.tons = 1")
    g, _ = write.execute(g, "MERGE (f:Ferry {name: 'Elin'}) ON CREATE SET f.tons = 2")
    assert rows(g, "MATCH (f:Ferry) RETURN f.name, f.tons") == [("A", 1), ("Brise", 640), ("Corvin", 2200), ("Elin", 2)]
    g, _ = write.execute(g, "MATCH (f:Ferry {name: 'Elin'}) SET f.tons = 'heavy'")  # widens to text
    assert rows(g, "MATCH (f:Ferry {name: 'Elin'}) RETURN f.tons") == [("heavy",)]


def test_constraints_hold_after_they_are_made(harbour):
    g, _ = write.execute(harbour, "CREATE CONSTRAINT one IF NOT EXISTS FOR (f:Ferry) REQUIRE f.name IS UNIQUE")
    g, _ = write.execute(g, "CREATE VECTOR INDEX v FOR (f:Ferry) ON (f.emb) OPTIONS {dims: 3}")
    assert set(g.catalog.indexes) == {"one", "v"} and g.catalog.types["Ferry"].properties["name"].unique
    g, _ = write.execute(g, "DROP INDEX v")
    with pytest.raises(GraphError):
        write.execute(g, "DROP INDEX v")
    for text in ("CREATE (:Ferry {name: 'Alma'})", "MATCH (f:Ferry {name: 'Brise'}) SET f.name = 'Alma'"):
        with pytest.raises(GraphError) as e:
            write.execute(g, text)
        assert e.value.code == "constraint"
    g, _ = write.execute(g, "DROP CONSTRAINT one")
    assert not g.catalog.types["Ferry"].properties["name"].unique
    g, _ = write.execute(g, "CREATE (:Ferry {name: 'Alma'})")
    with pytest.raises(GraphError):
        write.execute(g, "CREATE CONSTRAINT two FOR (f:Ferry) REQUIRE f.name IS UNIQUE")


def test_policy_history_and_storage(harbour, tmp_path):
    g = write.enable_history(harbour, "Ferry")
    g, _ = write.execute(g, "MATCH (f:Ferry {name: 'Alma'}) SET f.tons = 1250")
    assert sorted(r.op for r in g.changes.collect()) == ["i", "i", "i", "i", "u"]
    g.save(str(tmp_path / "g"))
    again = Graph.load(g.spark, str(tmp_path / "g"))
    assert rows(again, "MATCH (f:Ferry) RETURN f.name, f.tons") == rows(g, "MATCH (f:Ferry) RETURN f.name, f.tons")
    again.enable_rls("Vessel", "name <> 'Brise'")
    assert rows(again, "MATCH (f:Ferry)-[:FOLLOWS]->(x) RETURN f.name") == [("Dorte",)]
    # A hidden node is no way through: neither unnamed, nor inside a trail.
    assert rows(again, "MATCH (f:Ferry)-[:FOLLOWS]->()-[:FOLLOWS]->(x) RETURN x.name") == []
    assert rows(again, "MATCH (f:Ferry {name: 'Alma'})-[:FOLLOWS*1..3]->(x) RETURN DISTINCT x.name") == []


def test_rename_by_statement_and_roles(harbour):
    from quiver import agent

    g, _ = write.execute(harbour, "MATCH (t:Tug) REMOVE t:Tug SET t:Pusher")
    assert rows(g, "MATCH (p:Pusher) RETURN p.name") == [("Ox",)] and rows(g, "MATCH (t:Tug) RETURN t.name") == []
    with pytest.raises(GraphError):
        write.execute(harbour, "MATCH (t:Tug) REMOVE t:Tug")
    g = harbour.version()
    agent.create_role(g, "guest", max_bytes=1)
    agent.apply_role(g, "guest")
    for call in (lambda: write.execute(g, "CREATE (:Tug {name: 'Elk'})"), lambda: cypher(g, "MATCH (f:Ferry) RETURN f.name")):
        with pytest.raises(GraphError):
            call()


def test_keys_of_mapped_tables(spark):
    items = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", None)], "name string, box string")
    g = Graph(spark).create_type("Box", name="string").create_type("Item", name="string").relation("IN", "Item", "Box")
    g.map_table("Box", items.select("box").dropna().distinct(), "box", {"name": "box"}).map_table("Item", items, "name", {"name": "name"})
    g.map_edges("IN", items, ("Item", "name"), ("Box", "box"))
    assert rows(g, "MATCH (i:Item)-[:IN]->(b:Box) RETURN i.name, b.name") == [("x", "p"), ("y", "p")]
    kinds = {id_type(r["_id"]) for r in g.edges["IN"].collect()}
    assert kinds == {g.catalog.types["IN"].type_id}
    bad = Graph(spark).create_type("N", name="long").map_table("N", spark.range(1).selectExpr("id - 5 AS k"), "k", {"name": "k"})
    with pytest.raises(Exception, match="out of range"):
        bad.nodes["N"].collect()


@pytest.fixture
def no_guess(spark):
    """Only what is asked for is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def test_nodes_are_not_dealt_out_by_type(spark, no_guess):
    """The catalog is sent to the nodes: one type's rows would meet in one task."""
    from pyspark.sql import functions as F

    from quiver.queries import queries

    found = queries()["relational_views"](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" in (plan := _plan(found)) and "SortMergeJoin" not in plan
    g = Graph(spark).create_type("Kind", name="string").create_type("Thing", name="string").relation("OF", "Thing", "Kind")
    g = write.create_nodes(g, "Kind", spark.range(2).select(F.col("id").cast("string").alias("name")))
    g = write.create_nodes(g, "Thing", spark.range(20000).select(F.col("id").cast("string").alias("name")))
    kinds, things = g.nodes["Kind"].select(F.col("_id").alias("_dst"), "name"), g.nodes["Thing"]
    g = write.create_edges(g, "OF", things.select(F.col("_id").alias("_src"), (F.col("name").cast("int") % 2).cast("string").alias("name")).join(kinds, "name").select("_src", "_dst"))
    found = cypher(g, "MATCH (:Thing)-[:OF]->(k:Kind) RETURN k.name AS name, count(*) AS n")
    assert "BroadcastHashJoin" in _plan(found) and {tuple(r) for r in found.collect()} == {("0", 10000), ("1", 10000)}
    wide = write.create_nodes(Graph(spark).create_type("Kind", name="string"), "Kind", spark.range(9).select(F.repeat(F.lit("x"), 1 << 20).alias("name")))
    assert "ResolvedHint" not in wide.nodes["Kind"]._jdf.queryExecution().analyzed().toString()


def test_matches_that_meet_are_counted_before_they_are_joined(spark):
    """Counts over two patterns with a node in common, equal to those over all pairs of rows."""
    import random

    rng = random.Random(5)
    towns = {i: None if i == 3 else f"t{i % 4}" for i in range(6)}
    people = [(i, rng.randrange(6), rng.choice([None, "x", "y", "z"])) for i in range(25)]
    shops = [(i, rng.randrange(5), rng.choice([None, 1, 2, 3])) for i in range(20)]
    g = Graph(spark).create_type("Town", name="string").create_type("Person", nick="string").create_type("Shop", size="int").relation("LIVES", "Person", "Town").relation("STANDS", "Shop", "Town")
    g.map_table("Town", spark.createDataFrame([*towns.items(), (0, "again")], "k long, name string"), "k", {"name": "name"})  # town 0 twice
    people_frame, shops_frame = spark.createDataFrame(people, "k long, t long, nick string"), spark.createDataFrame(shops, "k long, t long, size int")
    g.map_table("Person", people_frame, "k", {"nick": "nick"}).map_table("Shop", shops_frame, "k", {"size": "size"})
    g.map_edges("LIVES", people_frame, ("Person", "k"), ("Town", "t"), key="k").map_edges("STANDS", shops_frame, ("Shop", "k"), ("Town", "t"), key="k")
    joined = [(k, name, p, s) for k, name in [*towns.items(), (0, "again")] for p in people if p[1] == k for s in shops if s[1] == k]

    def by_name(value):
        return sorted(((n, *value([j for j in joined if j[1] == n])) for n in {j[1] for j in joined}), key=repr)

    two = "MATCH (p:Person)-[:LIVES]->(t:Town) MATCH (s:Shop)-[:STANDS]->(t) "
    counted = cypher(g, two + "RETURN t.name AS name, count(*) AS n, count(s.size) AS sizes, count(DISTINCT s) AS shops, max(s.size) AS top")
    assert "sum(_weight" in counted._jdf.queryExecution().optimizedPlan().toString()
    least = lambda js: (len(js), sum(j[3][2] is not None for j in js), len({j[3][0] for j in js}), max((j[3][2] for j in js if j[3][2] is not None), default=None))
    assert sorted(map(tuple, counted.collect()), key=repr) == by_name(least)
    assert rows(g, two + "WHERE s.size > 1 AND p.nick <> 'x' RETURN count(*) AS n") == [(sum(j[3][2] is not None and j[3][2] > 1 and j[2][2] != "x" for j in joined),)]
    assert rows(g, two + "RETURN count(p.nick) AS n, count(p) AS p") == [(sum(j[2][2] is not None for j in joined), len(joined))]
    assert rows(g, two + "RETURN sum(s.size) AS n") == [(sum(j[3][2] or 0 for j in joined),)]
    three = [(j, q) for j in joined for q in people if q[1] == j[0]]
    assert rows(g, two + "MATCH (q:Person)-[:LIVES]->(t) RETURN count(*) AS n, count(q.nick) AS nicks") == [(len(three), sum(q[2] is not None for _, q in three))]
    assert rows(g, "MATCH (p:Person) MATCH (s:Shop) RETURN count(*) AS n") == [(500,)]
    assert rows(g, "MATCH (p:Person {nick: 'none'}) MATCH (s:Shop) RETURN count(*) AS n") == [(0,)]
    assert rows(g, "MATCH (p:Person {nick: 'none'}) MATCH (s:Shop) RETURN s.size AS size, count(*) AS n") == []
