"""Introspection for callers that write queries: schema text, errors, estimates, limits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver import ids
from quiver.catalog import GraphError
from quiver.plans import cypher as lang


def schema(graph, token_budget: int = 1000) -> str:
    """Types with properties and ends, the most populous first, as far as the budget of words goes."""
    counts = {r["type"]: r["n"] for r in graph.stats().collect()}
    lines, words = [], 0
    for t in sorted(graph.catalog.types.values(), key=lambda t: (-counts.get(t.name, 0), t.name)):
        line = _line(graph, t, counts.get(t.name))
        words += len(line.split())
        if lines and words > token_budget:
            break
        lines.append(line)
    return "\n".join(lines)


def _line(graph, t, n) -> str:
    props = ", ".join(f"{p.name}: {p.data_type}" for p in t.properties.values())
    ends = " -> ".join(r.player for r in sorted(t.roles.values(), key=lambda r: r.ordinal)[:2])
    return f"{t.kind} {t.name}" + (f" < {', '.join(t.parents)}" if t.parents else "") + (f" [{ends}]" if ends else "") + f" {{{props}}}" + (f" # {n} rows" if n is not None else "")


def schema_for(graph, question: str, top: int = 10) -> str:
    """The types whose names, ends and properties share the most words with a question."""
    words = lambda text: {w.lower().removesuffix("s") for w in re.findall(r"[A-Za-z][a-z]*|[A-Z]+", text)}
    asked = words(question)

    def shared(t):
        # A type is as close as the share of its own words that were asked for, then of its properties'.
        own = words(t.name)
        ends = set().union(*(words(r.player) for r in t.roles.values()), set())
        props = set().union(*(words(p) for p in t.properties), set())
        share = lambda x: len(x & asked) / len(x) if x else 0.0
        return share(own), share(ends), len(props & asked)

    ranked = sorted(((shared(t), t.name) for t in graph.catalog.types.values()), key=lambda x: ([-v for v in x[0]], x[1]))
    return "\n".join(_line(graph, graph.catalog.types[n], None) for s, n in ranked[:top] if any(s))


def explain_error(graph, text: str) -> dict:
    """Why a query fails, with a code and suggestions; ok if it does not."""
    try:
        lang.cypher(graph, text, {})
        return {"ok": True}
    except GraphError as e:
        return {"ok": False, "code": e.code, "message": str(e), "suggestions": list(e.suggestions)}


diagnose_empty = lang.diagnose


def estimate(graph, text: str, params: dict | None = None) -> dict:
    """Catalyst's size estimate, and whether the graph's limits would let the query run."""
    frame = lang.cypher(graph, text, params)
    stats = frame._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    rows = stats.rowCount()
    limit = graph.catalog.settings.get("max_bytes")
    advice = "add a label, a property filter or LIMIT" if limit and size > int(limit) else ""
    return {"bytes": size, "rows": int(str(rows.get())) if rows.isDefined() else None, "advice": advice, "would_run": not advice}


def create_role(graph, name: str, max_rows: int | None = None, read_only: bool = True, max_bytes: int | None = None) -> None:
    """A role: its rows are cut at max_rows, writes fail if it is read_only, and queries whose estimate is above max_bytes fail."""
    graph.catalog.agents[name] = {"max_rows": max_rows, "read_only": read_only, "max_bytes": max_bytes}


def apply_role(graph, name: str) -> None:
    if name not in graph.catalog.agents:
        raise GraphError(f"no role {name!r}", "unknown_role")
    graph.catalog.settings |= {k: str(v) for k, v in graph.catalog.agents[name].items() if v is not None}


def meta_schema(graph) -> DataFrame:
    """(relation, source, target, n): the types that relations really connect."""
    spark, catalog = graph.spark, graph.catalog
    frames = [f.groupBy(ids.id_type(F.col("_src")).alias("a"), ids.id_type(F.col("_dst")).alias("b")).agg(F.count("*").alias("n")).withColumn("relation", F.lit(t)) for t, f in graph.edges.items()]
    if not frames:
        return spark.createDataFrame([], "relation string, source string, target string, n long")
    names = spark.createDataFrame([(t.type_id, t.name) for t in catalog.types.values()], "id int, name string")
    found = reduce(DataFrame.unionByName, frames)
    return found.join(names.select(F.col("id").alias("a"), F.col("name").alias("source")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("target")), "b").select("relation", "source", "target", "n")


def audit(graph) -> DataFrame:
    rows = [(a.get("language"), a["query"], a.get("seconds")) for a in graph.audit]
    return graph.spark.createDataFrame(rows, "language string, query string, seconds double")


def interop_report(graph) -> dict:
    c = graph.catalog
    return {"types": len(c.types), "indexes": len(c.indexes), "policies": len(c.policies), "embeddings": len(c.embeddings), "settings": dict(c.settings), "version": c.version}


def set_setting(graph, name: str, value: str) -> None:
    graph.catalog.settings[name] = value
