"""CALL ... YIELD: a closed registry of procedures, each a frame of its yields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.catalog import GraphError, suggest
from quiver.functions.expressions import Compiler, Element, Value, quoted

#: Fixed names: procedures that do nothing here.
NO_OPS = ("db.awaitIndex", "db.awaitIndexes", "db.index.fulltext.awaitEventuallyConsistentIndexRefresh", "db.clearQueryCaches", "db.resampleIndex")
NAMES = (*NO_OPS, "db.labels", "db.relationshipTypes", "db.propertyKeys", "dbms.components", "apoc.meta.schema", "db.index.vector.queryNodes", "db.index.fulltext.queryNodes", "apoc.neighbors.tohop")


def _names(graph, column: str, values) -> DataFrame:
    return graph.spark.createDataFrame([(v,) for v in sorted(set(values))], f"{column} string")


def frame_of(reader, scope, call) -> DataFrame:
    from quiver.operators import search, traverse

    graph, name = reader.graph, call.name
    types = graph.catalog.types.values()
    if name in NO_OPS:
        return graph.spark.createDataFrame([(True,)], "done boolean")
    if name == "db.labels":
        return _names(graph, "label", (t.name for t in types if t.kind == "entity"))
    if name == "db.relationshipTypes":
        return _names(graph, "relationshipType", (t.name for t in types if t.kind == "relation"))
    if name == "db.propertyKeys":
        return _names(graph, "propertyKey", (p for t in types for p in t.properties))
    if name == "dbms.components":
        return graph.spark.createDataFrame([("quiver", [graph.spark.version], "spark")], "name string, versions array<string>, edition string")
    if name == "apoc.meta.schema":
        from quiver.agent import meta_schema

        return meta_schema(graph)
    values = [graph.spark.range(1).select(Compiler(reader.start())(a).alias("v")).first()["v"] for a in call.args] if not name.startswith("apoc.neighbors") else []
    if name in ("db.index.vector.queryNodes", "db.index.fulltext.queryNodes"):
        index = graph.catalog.indexes.get(values[0])
        if index is None:
            raise GraphError(f"no index {values[0]!r}", "unknown_index", suggest(values[0], graph.catalog.indexes))
        if "vector" in name:
            found = search.vector_search(graph, index["type"], index["props"][0], values[2], int(values[1]))
        else:
            found = search.fulltext(graph, index["type"], index["props"], values[1])
        return found.select(F.col("_id").alias("node"), "score")
    if name == "apoc.neighbors.tohop":
        start = scope.vars.get(call.args[0][1])
        if not isinstance(start, Element):
            raise GraphError("apoc.neighbors.tohop needs a bound node", "unbound")
        spec, high = (graph.spark.range(1).select(Compiler(reader.start())(a).alias("v")).first()["v"] for a in call.args[1:3])
        named = spec.strip("<>")
        direction = "out" if spec.endswith(">") else "in" if spec.startswith("<") else "both"
        edges = graph.edge_view(*([t for t in named.split("|") if t]), direction=direction)
        seeds = scope.frame.select(F.col(quoted(start.columns["_id"])).alias("_id")).distinct()
        return traverse.reach(seeds, edges, 1, int(high), direction == "both").filter("start <> node").select("start", "node")
    raise GraphError(f"unknown procedure {name!r}; supported: {', '.join(NAMES)}", "unknown_procedure", suggest(name, NAMES))


def call(reader, scope, c):
    """The scope after a CALL: its yields are bound, node yields as nodes."""
    frame = frame_of(reader, scope, c)
    yields = c.yields or [(col, col) for col in frame.columns if col != "start"]
    missing = [y for y, _ in yields if y not in frame.columns]
    if missing:
        raise GraphError(f"{c.name} has no yield {missing[0]!r}", "unknown_yield", suggest(missing[0], frame.columns))
    start = scope.vars[c.args[0][1]].columns["_id"] if "start" in frame.columns else None
    columns = [F.col(y).alias(f"{a}._id" if y == "node" else a) for y, a in yields]
    table = frame.select(*columns, *([F.col("start").alias("_start")] if start else []))
    if start:
        joined = scope.frame.join(table, F.col(quoted(start)) == F.col("_start")).drop("_start")
    else:
        joined = scope.frame.crossJoin(table) if scope.vars else table
    variables = dict(scope.vars)
    for y, a in yields:
        if y != "node":
            variables[a] = Value(a)
            continue
        types = reader.graph.node_types()
        view = reader.graph.view(types)
        prefix = f"{a}@"
        whole = view.select(*(F.col(quoted(x)).alias(prefix + x) for x in view.columns))
        joined = joined.join(whole, F.col(quoted(f"{a}._id")) == F.col(quoted(prefix + "_id")))
        variables[a] = Element("node", {x: prefix + x for x in view.columns}, types)
    out = reader.scope(joined, variables)
    return reader.scope(out.frame.filter(Compiler(out)(c.where)), variables) if c.where is not None else out
