"""TypeQL, RDF, search, introspection and the change stream."""

import datetime

import pytest

from quiver import agent
from quiver.catalog import GraphError
from quiver.graph import Graph
from quiver.operators import search, write
from quiver.plans import typeql
from quiver.plans.cypher import cypher
from quiver.queries import RDF_SAMPLE
from quiver.sources import rdf
from quiver.streaming import changes

SCHEMA = """define
  attribute title, value string; attribute isbn, value string; attribute genre, value string; attribute score, value integer @range(0 .. 5); attribute name, value string;
  entity book @abstract, owns title, owns isbn @key, owns genre @card(0 .. 3), plays rating:rated, plays contribution:work;
  entity hardback sub book; entity paperback sub book;
  entity person, owns name @key, plays authoring:author, plays contribution:contributor, plays rating:rater;
  relation contribution, relates contributor, relates work; relation authoring sub contribution, relates author as contributor;
  relation rating, relates rated, relates rater, owns score;
  fun best() -> { book }: match $b isa book; return { $b };"""
DATA = """insert $a isa person, has name "Ann"; $b isa hardback, has title "One", has isbn "1", has genre "fiction"; $c isa paperback, has title "Two", has isbn "2", has genre "fact", has genre "fiction"; (author: $a, work: $b) isa authoring; (contributor: $a, work: $c) isa contribution;
  end;
  match $b isa book, has isbn "1"; $a isa person; insert $r isa rating, links (rated: $b, rater: $a), has score 5;"""


@pytest.fixture(scope="module")
def store(spark):
    s, _ = typeql.run(typeql.Store(spark), SCHEMA)
    s, _ = typeql.run(s, DATA)
    return s


def ask(store, text):
    return sorted(map(tuple, typeql.typeql(store, text).collect()), key=repr)


def test_typeql_reads(store):
    assert ask(store, "match $b isa book; reduce $n = count;") == [(2,)] and ask(store, "match $b isa! book; reduce $n = count;") == [(0,)]
    assert ask(store, 'match $b isa book, has title $t; not { $b has genre "fact"; }; select $t;') == [("One",)]
    assert ask(store, "match contribution (contributor: $p, work: $b); $b has title $t; select $t;") == [("One",), ("Two",)]
    assert ask(store, "match authoring (author: $p, work: $b); $b has title $t; select $t;") == [("One",)]
    assert ask(store, "match rating ($x, $y); reduce $n = count;") == [(2,)]
    assert ask(store, 'match $b isa book; fetch { "t": $b.title, "g": [$b.genre] };') == [("One", ["fiction"]), ("Two", ["fact", "fiction"])]
    assert store.catalog.functions["best"].startswith("fun best")


def test_typeql_checks(store):
    for text, code in (
        ('insert $b isa book, has title "x";', "abstract"), ('insert $b isa hardback, has isbn "1";', "key"), ('insert $r isa rating, has score 9;', "range"), ('insert $p isa person, has title "x";', "not_owned"),
        ("match $x has $y; select $x;", "syntax"), ("get $x;", "unsupported"), ("undefine person;", "unsupported"),
    ):
        with pytest.raises(GraphError) as e:
            typeql.run(store, text)
        assert e.value.code == code, text


def test_typeql_writes_and_dump(store):
    s, _ = typeql.run(store, 'match $b isa book, has isbn "2"; update $b has title "Deux";')
    assert ask(s, 'match $b isa book, has isbn "2", has title $t; select $t;') == [("Deux",)]
    s, _ = typeql.run(s, 'match $b isa book, has isbn "2", has genre $g; $g == "fact"; delete has $g of $b;')
    assert ask(s, 'match $b has genre $g; reduce $n = count;') == [(2,)]
    s, _ = typeql.run(s, "match $p isa person; delete $p;")
    assert ask(s, "match contribution (work: $b); reduce $n = count;") == [(2,)] and ask(s, "match $p isa person; reduce $n = count;") == [(0,)]
    again, _ = typeql.run(typeql.Store(store.spark), typeql.dump(store))
    assert typeql.dump(again) == typeql.dump(store)


def test_rdf(spark):
    g, report = rdf.load(Graph(spark), RDF_SAMPLE + 'w:fog w:depth "4" . w:ines w:trusts w:fog .')
    assert report["nodes"] == 2 and report["edges"] == 1 and report["overflow"] == 2
    assert [tuple(r) for r in cypher(g, "MATCH (o:Observer)-[:reads]->(s:Station) RETURN o.badge, s.`site@de`").collect()] == [(17, "Nordsee")]
    lines = {r.line for r in rdf.dump(g).collect()}
    assert '<http://weather.test/ns#fog> <http://weather.test/ns#depth> "4" .' in lines and {r.reason for r in rdf.mapping_report(g).collect()} == {"untyped subject", "unmapped predicate"}
    with pytest.raises(GraphError):
        rdf.parse("x:y x:z x:w .")


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://a> <http://p> "v"@en .\n<http://a> <http://q> _:b .\n# no triple\n')
    assert sorted(map(tuple, rdf.read_ntriples(spark, str(tmp_path)).collect())) == [("http://a", "http://p", "v", "literal", None, "en"), ("http://a", "http://q", "_:b", "blank", None, None)]


@pytest.fixture(scope="module")
def recipes(spark):
    """Dishes on a plane of (sour, hot)."""
    g = Graph(spark)
    search.add_embedding(g.create_type("Dish", title="string", steps="string"), "Dish", "taste", 2, source="steps")
    rows = spark.createDataFrame([("borscht", "simmer beet and cabbage slowly", [4.0, 3.0]), ("kimchi", "salt cabbage and let it stand", [3.0, 4.0]), ("curry", "fry paste then simmer", [0.0, 2.0])], "title string, steps string, taste array<float>")
    return write.create_nodes(g, "Dish", rows)


def test_search(recipes):
    found = search.vector_search(recipes, "Dish", "taste", [4, 3], 2).collect()
    assert [(r.title, round(r.score, 4)) for r in found] == [("borscht", 1.0), ("kimchi", 0.96)]
    assert [r.title for r in search.vector_search(recipes, "Dish", "taste", [4, 3], 2, "title <> 'borscht'").collect()] == ["kimchi", "curry"]
    assert [r.title for r in search.similar(recipes, found[0]["_id"], "Dish", "taste", 1).collect()] == ["kimchi"]
    with pytest.raises(GraphError):
        search.vector_search(recipes, "Dish", "taste", [4], 2)
    assert {r.title for r in search.fulltext(recipes, "Dish", ["steps"], "simmer -beet").collect()} == {"curry"}
    assert {r.title for r in search.fulltext(recipes, "Dish", ["steps"], '"salt cabbage" or paste').collect()} == {"kimchi", "curry"}
    assert search.stale_embeddings(recipes).count() == 3
    search.mark_embedded(recipes, recipes.nodes["Dish"].selectExpr("_id", "steps as source"), "taste")
    assert search.stale_embeddings(recipes).count() == 0 and search.embedding_stats(recipes).count() == 1


def test_agent(recipes):
    assert "entity Dish" in agent.schema(recipes) and "Dish" in agent.schema_for(recipes, "what dishes have a title")
    bad = agent.explain_error(recipes, "MATCH (d:Dish) RETURN dd.title")
    assert not bad["ok"] and bad["code"] == "unbound"
    assert agent.estimate(recipes, "MATCH (d:Dish) RETURN d.title")["would_run"]
    agent.create_role(recipes, "reader", max_rows=1)
    agent.apply_role(recipes, "reader")
    assert cypher(recipes, "MATCH (d:Dish) RETURN d.title").count() == 1
    recipes.catalog.settings.clear()
    assert agent.audit(recipes).count() >= 1 and agent.interop_report(recipes)["types"] == 1


def test_change_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(i, False, "iu"[i % 2], at + datetime.timedelta(minutes=i), "{}") for i in range(12)]
    spark.createDataFrame(rows, "entity_id long, is_edge boolean, op string, recorded_at timestamp, payload string").write.parquet(str(tmp_path / "log"))
    counts = changes.windowed_changes(changes.change_stream(spark, str(tmp_path / "log")))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("counted").collect()) == 12 and spark.table("counted").count() == 6


def test_whole_table_queries(spark):
    """The lookups and fetches run over all customers, parts and orders, not a subset of ids."""
    from collections import Counter

    from quiver.queries import queries

    folder = "/root/testdata/sf0.001"
    run = lambda name: [tuple(r) for r in queries()[name](spark, folder).collect()]
    table = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(*c).collect()]
    customers, orders = table("customer", "c_custkey", "c_mktsegment"), Counter(c for (c,) in table("orders", "o_custkey"))
    known = {c for c, _ in customers}
    assert dict(run("expand_all")) == {c: n for c, n in orders.items() if c in known}
    assert sorted(run("typeql_fetch_all")) == sorted(customers)
    assert sorted(run("typeql_fetch_nested_all")) == sorted((c, orders.get(c, 0), 1) for c in known)
    names = Counter(n for (n,) in run("prop_lookup_all"))
    assert names == Counter([n for (n,) in table("region", "r_name")]) + Counter({None: sum(orders.values())})
    supplied = set(table("lineitem", "l_suppkey", "l_partkey"))
    one = {p for s, p in supplied if s == 1}
    two = {s for s, p in supplied if p in one}
    three = {p for s, p in supplied if s in two}
    assert dict(run("shortest_hops_all")) == {p: 1 if p in one else 3 if p in three else None for (p,) in table("part", "p_partkey")}
