"""Trails and reachability against brute-force depth-first search."""

import random

import pytest

from quiver.catalog import GraphError
from quiver.graph import turned
from quiver.operators import traverse


def paths(edges, start, low, high, direction):
    steps = [(i, a, b) for i, a, b in edges] if direction == "out" else [(i, b, a) for i, a, b in edges] if direction == "in" else [(i, a, b) for i, a, b in edges] + [(i, b, a) for i, a, b in edges]
    out = []

    def walk(at, used):
        if low <= len(used) <= high:
            out.append((at, tuple(used)))
        if len(used) < high:
            for i, a, b in steps:
                if a == at and i not in used:
                    walk(b, [*used, i])

    walk(start, [])
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "_id long, _src long, _dst long")


DIAMOND = [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 3), (5, 3, 0)]


@pytest.mark.parametrize("direction, counts", [("out", [2, 4, 6, 8, 10]), ("in", [1, 3, 5, 5, 5]), ("both", [3, 7, 13, 19, 25])])
def test_diamond(spark, direction, counts):
    start = spark.createDataFrame([(0,)], "_id long")
    edges = turned(frame(spark, DIAMOND), direction)
    assert [traverse.trails(start, edges, 1, k).count() for k in range(1, 6)] == counts


def test_random_graphs(spark):
    rng = random.Random(7)
    for trial in range(4):
        edges = [(i, rng.randrange(6), rng.randrange(6)) for i in range(rng.randrange(4, 11))]
        starts = spark.createDataFrame([(n,) for n in range(6)], "_id long")
        direction = ("out", "in", "both", "out")[trial]
        found = traverse.trails(starts, turned(frame(spark, edges), direction), 0, 3).collect()
        want = sorted((s, at, ids) for s in range(6) for at, ids in paths(edges, s, 0, 3, direction))
        assert sorted((r["_id"], r["_end"], tuple(r["_edges"])) for r in found) == want
        if direction == "both":
            continue
        reached = {(r.start, r.node): r.depth for r in traverse.reach(starts, turned(frame(spark, edges), direction), 1, 3).collect()}
        least = {}
        for s, at, ids in want:
            if ids:
                least[(s, at)] = min(least.get((s, at), 9), len(ids))
        assert reached == least
        kernel = traverse.Csr(turned(frame(spark, edges), direction))
        assert {(r.start, r.node): r.depth for r in kernel.reach(starts, 3).collect()} == least


def test_bounds_and_hops(spark):
    edges = frame(spark, DIAMOND)
    with pytest.raises(GraphError):
        traverse.reach(spark.createDataFrame([(0,)], "_id long"), edges, 2, 4)
    with pytest.raises(GraphError):
        traverse.Csr(edges, limit=2)
    pairs = spark.createDataFrame([(0, 3), (0, 0), (3, 9)], "src long, dst long")
    assert sorted((r.src, r.dst, r.hops) for r in traverse.hops(pairs, edges).collect() if r.hops is not None) == [(0, 0, 0), (0, 3, 2)]
    single = turned(frame(spark, [(1, 0, 1)]), "both")
    assert [(r.node, r.depth) for r in traverse.reach(spark.createDataFrame([(0,)], "_id long"), single, 1, 4, True).collect()] == [(1, 1)]


@pytest.mark.parametrize("far", [1, 1 << 30, (1 << 36) - 1])
def test_turns_of_long_conversations(spark, tmp_path, far):
    """Turns keep ids of their own and NEXT stays in its conversation, however long it is or great its id."""
    from pathlib import Path

    from quiver.ids import id_local, id_type
    from quiver.queries import queries
    from quiver.sources.testdata import testdata_graph

    for table in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / table.name).symlink_to(table)
    (tmp_path / "conversations.parquet").unlink()
    rows = [(0, t, "user", "x") for t in range(4090, 4100)] + [(0, 0, "user", "x")] + [(c, t, "user", "x") for c in (far, far - 1 or 7) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    g = testdata_graph(spark, str(tmp_path))
    nodes = {r["_id"]: (r.conv_id, r.turn) for r in g.label_view("Turn").collect()}
    assert sorted(nodes.values()) == sorted(r[:2] for r in rows)
    assert {id_type(i) for i in nodes} == {g.catalog.types["Turn"].type_id} and all(id_local(i) >= 0 for i in nodes)
    steps = [(nodes[r["_src"]], nodes[r["_dst"]]) for r in g.edge_view("NEXT").collect()]
    assert len(steps) == 9 + 4 and all(a[0] == b[0] and a[1] + 1 == b[1] for a, b in steps)
    got = {tuple(r) for r in queries()["reach_many_seeds"](spark, str(tmp_path)).collect()}
    assert got == {(c, t, t) for c in (far, far - 1 or 7) for t in (1, 2)}


def test_every_role_is_checked(spark):
    """An undeclared role is found among any number of rows and declared names."""
    from pyspark.sql import functions as F

    from quiver.catalog import Role
    from quiver.graph import Graph

    g = Graph(spark).create_type("Thing").relation("LINKS", "Thing", "Thing")
    g.catalog.types["LINKS"].roles.update({f"r{i}": Role(f"r{i}", "Thing", i) for i in range(3000)})
    rows = spark.range(3000).select(F.col("id").alias("rel_id"), F.concat(F.lit("r"), "id").alias("role"), F.col("id").alias("player_id"))
    assert g.add_role_players(rows).players.count() == 3000
    for stray in ("zz", None):
        with pytest.raises(GraphError, match="unknown role"):
            g.add_role_players(rows.union(spark.createDataFrame([(1, stray, 1)], "rel_id long, role string, player_id long")))


def test_ends_of_undirected_trails(spark):
    """Distinct ends as depth-first search finds them, starts on cycles, loops and parallel edges included."""
    rng = random.Random(17)
    for size in (5, 9):
        edges = [(i, rng.randrange(size), rng.randrange(size)) for i in range(size + 1)]
        both = turned(frame(spark, edges), "both")
        starts = spark.createDataFrame([(i,) for i in range(size)], "_id long")
        for high in (2, 4):
            got = {(r.start, r.node) for r in traverse.ends(starts, both, 1, high, True).collect()}
            assert got == {(s, end) for s in range(size) for end, _ in paths(edges, s, 1, high, "both")}


def test_hops_from_both_ends(spark):
    rng = random.Random(23)
    edges = [(i, rng.randrange(12), rng.randrange(12)) for i in range(18)]
    far = {}
    for s in range(12):
        far[s, s], level, depth = 0, {s}, 0
        while level:
            depth += 1
            level = {b for _, a, b in edges if a in level and (s, b) not in far}
            far |= {(s, b): depth for b in level}
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(12)], "src long, dst long")
    got = {(r.src, r.dst): r.hops for r in traverse.hops(pairs, frame(spark, edges), 20).collect()}
    assert got == {(a, b): far.get((a, b)) for a in range(12) for b in range(12)}


def test_edges_of_great_supplier_and_part_keys(spark, tmp_path):
    """A SUPPLIES edge has an id of its own for each pair, however great the keys are."""
    from pathlib import Path

    from quiver.queries import queries
    from quiver.sources.testdata import testdata_graph

    for table in Path("/root/testdata/sf0.001").glob("*.parquet"):
        (tmp_path / table.name).symlink_to(table)
    (tmp_path / "lineitem.parquet").unlink()
    pairs = {(s, p) for s in (1, 2, 5999, (1 << 36) - 1) for p in (0, 7, 1 << 24, (1 << 36) - 1)}
    lines = spark.createDataFrame([(s, p) for s, p in sorted(pairs)] * 3, "l_suppkey long, l_partkey long")
    lines.selectExpr("l_suppkey l_orderkey", "*", "1D l_quantity", "1D l_extendedprice", "0D l_discount", "'N' l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = testdata_graph(spark, str(tmp_path)).edge_view("SUPPLIES").collect()
    assert len({e["_id"] for e in edges}) == len(edges) == len(pairs)
    assert {tuple(r) for r in queries()["segment_unnest"](spark, str(tmp_path)).collect()} == pairs
    assert sorted(map(tuple, queries()["packed_adjacency"](spark, str(tmp_path)).collect())) == [(s, 0, 4) for s in sorted({s for s, _ in pairs})]


def test_hops_make_no_product_of_pairs_and_nodes(spark, monkeypatch):
    """One source, many targets: the joins make rows in proportion to either, and a search without a way on ends."""
    from pyspark.sql import functions as F

    met, joined = traverse._met, []

    def seen(left, a, b, near, far):
        joined.append(min(traverse._rows(*x)[0] for x in ((left, a, near), (left, b, far), (a, b, "_meet"))))
        out = met(left, a, b, near, far)
        assert out.count() <= 1000
        return out

    monkeypatch.setattr(traverse, "_met", seen)
    edges = spark.range(1000).selectExpr("id _id", "0L _src", "id + 1 _dst")
    pairs = spark.range(3000).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.dst: r.hops for r in traverse.hops(pairs, edges, 20).collect()}
    assert got == {d: 1 if d <= 1000 else None for d in range(1, 3001)}
    assert len(joined) == 2 and max(joined) <= 3000


def test_pairs_are_found_in_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    """Tasks grow in number with the lines; reach keeps parallel edges out of its levels without a distinct set of steps."""
    from quiver.sources import testdata

    (tmp_path / "copy").symlink_to("/root/testdata/sf0.001")
    monkeypatch.setattr(testdata, "PAIR_LINES", 200)
    g = testdata.testdata_graph(spark, str(tmp_path / "copy"))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey", "l_partkey")
    assert g.edges["SUPPLIES"].rdd.getNumPartitions() >= lines.count() // 200
    assert g.edges["SUPPLIES"].select("_src", "_dst").distinct().count() == g.edges["SUPPLIES"].count() == lines.distinct().count()
    edges = frame(spark, [(i, i % 3, i % 3 + 1) for i in range(300)])
    found = traverse.reach(spark.createDataFrame([(0,)], "_id long"), edges, 1, 3)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
