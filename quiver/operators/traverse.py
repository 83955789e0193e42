"""Traversal: trails, reachability and shortest hops.

trails: one row for each path without a repeated edge, by unrolled joins (one
plan, for bounded depth).  reach: breadth-first levels with a visited set, one
join and one anti-join a level, cut by checkpoints; it does not grow with the
number of paths.  A node reached again after the start counts as reached only if
a trail leads there (directed: a cycle; undirected: never by going back along
the same edge, so the start is left out).
"""

from __future__ import annotations

import os
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.catalog import GraphError

MAX_HOPS = 8
#: Levels after which the visited set is written as one frame.
COMPACT = 16
#: So many ends of searches (one long each) are sent to all tasks at most.
FEW = 10_000
#: Compressed adjacency is only built for graphs of at most so many edges (8 bytes each, twice).
CSR_EDGES = 20_000_000


def trails(starts: DataFrame, edges: DataFrame, low: int, high: int | None, column: str = "_id") -> DataFrame:
    """starts with _end, _depth, _edges (ids in order) and _nodes, one row for each trail.

    edges: (_id, _src, _dst), already turned to the direction wanted.
    """
    high = max(MAX_HOPS, low) if high is None else high
    steps = edges.select(F.col("_id").alias("_eid"), F.col("_src").alias("_from"), F.col("_dst").alias("_to"))
    kept = ["`" + c.replace("`", "``") + "`" for c in starts.columns]
    level = starts.select("*", F.col(column).alias("_end"), F.lit(0).alias("_depth"), F.array().cast("array<long>").alias("_edges"), F.array(F.col(column)).alias("_nodes"))
    found = [level] if low == 0 else []
    for depth in range(1, high + 1):
        joined = level.join(steps, F.col("_end") == F.col("_from"))
        if depth > 1:
            joined = joined.filter(~F.array_contains("_edges", F.col("_eid")))
        level = joined.select(*kept, F.col("_to").alias("_end"), F.lit(depth).alias("_depth"), F.concat("_edges", F.array("_eid")).alias("_edges"), F.concat("_nodes", F.array("_to")).alias("_nodes"))
        if depth >= low:
            found.append(level)
    return reduce(DataFrame.unionByName, found) if found else level.limit(0)


def shared_folder(context) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise GraphError("set spark.checkpoint.dir to a folder that all executors share", "configuration")
        folder = os.path.join(tempfile.gettempdir(), "quiver-checkpoints")
    return folder


def _cut(frame: DataFrame) -> DataFrame:
    """Cut a level's lineage in the checkpoint folder that the cluster names."""
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(context))
    return frame.checkpoint()


def reach(starts: DataFrame, edges: DataFrame, low: int = 1, high: int | None = None, undirected: bool = False) -> DataFrame:
    """(start, node, depth): each node with the depth at which it is first met.

    edges are turned to the direction wanted (both ways if undirected).  With
    low <= 1 these are the distinct ends of the trails, but for an undirected
    start, which is left out.  high None: until nothing new is met.
    """
    if low > 1:
        raise GraphError("reach needs a lower bound of 0 or 1; use trails", "bounds")
    # Not made distinct: each level is, and a task would hold all of its steps for that.
    steps = edges.select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"))
    if high is None or high > 1:  # dealt out by start once, so that a level only moves its frontier
        steps = _cut(steps.repartition("_from"))
    frontier = _cut(starts.select(F.col("_id").alias("start"), F.col("_id").alias("node")).distinct())
    visited = frontier.withColumn("depth", F.lit(0))
    again = None
    depth = 0
    while high is None or depth < high:
        depth += 1
        met = frontier.join(steps, frontier["node"] == steps["_from"]).select("start", F.col("_to").alias("node")).distinct()
        if not undirected:
            back = met.filter("start = node").withColumn("depth", F.lit(depth))
            again = back if again is None else again.unionByName(back)
        frontier = _cut(met.join(visited.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % COMPACT == 0:  # a long chain must not leave a union as deep as it is long
            visited = _cut(visited)
    found = visited if low == 0 else visited.filter("depth > 0")
    if again is not None and low == 1:
        found = found.unionByName(again.groupBy("start", "node").agg(F.min("depth").alias("depth")))
    return found


def closed(starts: DataFrame, edges: DataFrame, high: int | None) -> DataFrame:
    """(start, node, depth) of the starts that an undirected trail leads back to, node being the start.

    Levels of (start, node, first edge): a path that leaves by one edge and does
    not pass the start again meets an edge back to it that is another one.  Two
    first edges a node are enough, the two that reach it soonest: of any two one
    differs from the edge that leads back.
    """
    steps = edges.select(F.col("_id").alias("_eid"), F.col("_src").alias("_from"), F.col("_dst").alias("_to"))
    leave = starts.select(F.col("_id").alias("start")).distinct().join(steps, F.col("start") == F.col("_from"))
    loops = leave.filter("_to = start").select("start").distinct().withColumn("depth", F.lit(1))

    def two(met: DataFrame, visited: DataFrame | None) -> DataFrame:
        if visited is None:
            room = met.groupBy("start", "node").agg(F.min("first").alias("low"), F.max("first").alias("high")).withColumn("room", F.lit(2))
        else:
            have = visited.groupBy("start", "node").agg(F.count("*").alias("have"))
            fresh = met.join(visited, ["start", "node", "first"], "left_anti").groupBy("start", "node").agg(F.min("first").alias("low"), F.max("first").alias("high"))
            room = fresh.join(have, ["start", "node"], "left").withColumn("room", (2 - F.coalesce("have", F.lit(0))).cast("int")).filter("room > 0")
        return room.select("start", "node", F.explode(F.slice(F.array_distinct(F.array("low", "high")), F.lit(1), F.col("room"))).alias("first"))

    frontier = _cut(two(leave.filter("_to <> start").select("start", F.col("_to").alias("node"), F.col("_eid").alias("first")), None))
    visited, found, depth = frontier, loops, 1
    while high is None or depth < high:
        depth += 1
        met = frontier.join(steps, F.col("node") == F.col("_from"))
        back = _cut(met.filter("_to = start and _eid <> first").select("start").distinct())
        found = found.unionByName(back.withColumn("depth", F.lit(depth)))
        on = met.filter("_to <> start").join(back, "start", "left_anti").select("start", F.col("_to").alias("node"), "first")
        frontier = _cut(two(on, visited))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % COMPACT == 0:
            visited = _cut(visited)
    return found.groupBy("start").agg(F.min("depth").alias("depth")).select("start", F.col("start").alias("node"), "depth")


def ends(starts: DataFrame, edges: DataFrame, low: int = 1, high: int | None = None, undirected: bool = False) -> DataFrame:
    """(start, node, depth) of the distinct ends of all trails of low (0 or 1) to high edges."""
    found = reach(starts, edges, low, high, undirected)
    return found.unionByName(closed(starts, edges, high)) if undirected and low == 1 else found


def _among(frame: DataFrame, ends: DataFrame, on: str) -> DataFrame:
    """The rows whose column on is in ends; a few ends are sent out, as all rows of one end would meet in one task."""
    few = len(ends.select(on).distinct().head(FEW + 1)) <= FEW
    return frame.join(F.broadcast(ends) if few else ends, on, "left_semi")


def _rows(a: DataFrame, b: DataFrame, on: str) -> tuple[int, int]:
    """The rows that a join would make, in all and of its greatest key; no row of it is made."""
    n = a.groupBy(on).agg(F.count("*").alias("_a")).join(b.groupBy(on).agg(F.count("*").alias("_b")), on)
    found = n.agg(F.sum(F.col("_a").cast("double") * F.col("_b")).alias("n"), F.max(F.col("_a").cast("double") * F.col("_b")).alias("most")).first()
    return found["n"] or 0, found["most"] or 0


def _met(left: DataFrame, a: DataFrame, b: DataFrame, near: str, far: str) -> DataFrame:
    """(src, dst, _rest) of the pairs of left with a node in a (near, _meet) and in b (far, _meet, _rest).

    Of the three frames the two come first that make the fewest rows: with one
    source and many targets, pairs and a alone would make their product.
    """
    orders = [(left, b, far, a, [near, "_meet"]), (left, a, near, b, [far, "_meet"]), (a, b, "_meet", left, [near, far])]
    one, two, on, last, then = min(orders, key=lambda o: _rows(*o[:3]))
    return one.join(two, on).join(last, then)


def hops(pairs: DataFrame, edges: DataFrame, high: int = 32) -> DataFrame:
    """(src, dst, hops): the least number of hops, null beyond high; 0 if equal.

    Both ends grow by turns, the smaller frontier first, and a pair leaves as soon
    as its sides meet or one of them cannot go on: all of that side has then been
    compared.  Sides are kept by node, so pairs that share an end share its search.
    """
    wanted = _cut(pairs.select("src", "dst").distinct())
    steps = _cut(edges.select(F.col("_src").alias("_from"), F.col("_dst").alias("_to")))
    sides = []
    for end, near, far in (("src", "_from", "_to"), ("dst", "_to", "_from")):
        seed = _cut(wanted.select(F.col(end).alias("start"), F.col(end).alias("node")).distinct())
        sides.append({"end": end, "near": near, "far": far, "front": seed, "seen": seed.withColumn("depth", F.lit(0)), "depth": 0})
    done = wanted.filter("src = dst").withColumn("hops", F.lit(0))
    left = _cut(wanted.filter("src <> dst"))
    total = 0
    while total < high and not left.isEmpty():
        for s in sides:  # only the searches whose pairs are still open go on
            s["open"] = _among(s["front"], left.select(F.col(s["end"]).alias("start")).distinct(), "start")
        side, other = sorted(sides, key=lambda x: x["open"].count())
        total += 1
        side["depth"] += 1
        front = side["open"]
        met = front.join(steps, front["node"] == steps[side["near"]]).select("start", F.col(side["far"]).alias("node")).distinct()
        side["front"] = _cut(met.join(side["seen"].select("start", "node"), ["start", "node"], "left_anti"))
        side["seen"] = side["seen"].unionByName(side["front"].withColumn("depth", F.lit(side["depth"])))
        if side["depth"] % COMPACT == 0:
            side["seen"] = _cut(side["seen"])
        a = side["front"].select(F.col("start").alias(side["end"]), F.col("node").alias("_meet"))
        b = other["seen"].select(F.col("start").alias(other["end"]), F.col("node").alias("_meet"), F.col("depth").alias("_rest"))
        found = _met(left, a, b, side["end"], other["end"]).groupBy("src", "dst").agg((F.min("_rest") + side["depth"]).cast("int").alias("hops"))
        found = _cut(found)
        done = done.unionByName(found.select("src", "dst", "hops"))
        left = _among(left.join(found, ["src", "dst"], "left_anti"), a.select(side["end"]).distinct(), side["end"])
        left = _cut(left)
    return pairs.join(_cut(done), ["src", "dst"], "left")


class Csr:
    """Compressed adjacency of a bounded graph, sent to all executors; seeds are searched in parallel."""

    def __init__(self, edges: DataFrame, limit: int = CSR_EDGES):
        n = edges.count()
        if n > limit:
            raise GraphError(f"{n} edges are more than the {limit} that may be sent to every executor; use reach", "too_large")
        table = edges.select("_src", "_dst").toArrow()
        src, dst = table.column(0).to_numpy(), table.column(1).to_numpy()
        self.ids = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.argsort(a, kind="stable")
        self.targets = b[order].astype(np.int32)
        self.starts = np.searchsorted(a[order], np.arange(len(self.ids) + 1))

    def stats(self) -> dict:
        return {"nodes": len(self.ids), "edges": len(self.targets), "bytes": self.ids.nbytes + self.targets.nbytes + self.starts.nbytes}

    def levels(self, seed: int, high: int | None):
        """(depth, node places) of each level from a seed."""
        at = np.searchsorted(self.ids, seed)
        if at == len(self.ids) or self.ids[at] != seed:
            return
        seen = np.zeros(len(self.ids), bool)
        seen[at] = True
        frontier, depth = np.asarray([at]), 0
        while len(frontier) and (high is None or depth < high):
            depth += 1
            size = self.starts[frontier + 1] - self.starts[frontier]
            first = np.repeat(self.starts[frontier] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            met = np.unique(self.targets[first])
            if (met == at).any():
                yield depth, np.asarray([at])
            frontier = met[~seen[met]]
            seen[frontier] = True
            yield depth, frontier

    def reach(self, starts: DataFrame, high: int | None = None) -> DataFrame:
        """(start, node, depth) as reach() gives it, directed, from depth 1."""

        def run(batches):
            for batch in batches:
                for seed in batch.column(0).to_pylist():
                    own = False
                    for depth, places in self.levels(seed, high):
                        nodes = self.ids[places]
                        if len(nodes) == 1 and nodes[0] == seed:
                            if own:
                                continue
                            own = True
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), seed, np.int64)), pa.array(nodes), pa.array(np.full(len(nodes), depth, np.int32))], names=["start", "node", "depth"])

        return starts.select(F.col("_id").cast("long")).mapInArrow(run, "start long, node long, depth int")
