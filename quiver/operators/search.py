"""Vector, hybrid and full-text search.

Vector search is exact: the distance is a higher-order expression on the stored
array, evaluated in the scan, and the k best are a distributed top-k.  A score
is always better when it is higher: cosine similarity, inner product, or
1 / (1 + distance) for l2.  Full text ranks by term frequency in the words of
the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.catalog import GraphError
from quiver.functions.expressions import _cosine, dot, l2
from quiver.operators import traverse

METRICS = ("cosine", "ip", "l2")
#: Smoothing of reciprocal rank fusion.
RRF = 60


def add_embedding(graph, type_name: str, prop: str, dims: int, metric: str = "cosine", source: str | None = None):
    if metric not in METRICS or not 1 <= dims <= 16000:
        raise GraphError(f"metric must be one of {', '.join(METRICS)} and dims in 1..16000", "bad_embedding")
    if prop not in graph.catalog.get(type_name).properties:
        graph.catalog.add_property(type_name, prop, f"vector({dims})")
    graph.catalog.embeddings[(type_name, prop)] = {"dims": dims, "metric": metric, "source": source}
    return graph


def _embedding(graph, type_name: str, prop: str) -> dict:
    for t in graph.catalog.supertypes(type_name):
        if (t, prop) in graph.catalog.embeddings:
            return graph.catalog.embeddings[(t, prop)] | {"root": t}
    declared = graph.catalog.get(type_name).properties.get(prop)
    if declared is None:
        raise GraphError(f"{type_name!r} has no property {prop!r}", "unknown_property")
    m = re.fullmatch(r"vector\((\d+)\)", declared.data_type.lower())
    return {"dims": int(m[1]) if m else None, "metric": "cosine", "source": None, "root": type_name}


def measures(vector: Column, query: Column, metric: str) -> tuple[Column, Column]:
    """(distance, score) of a metric."""
    if metric == "cosine":
        s = _cosine(vector, query)
        return 1 - s, s
    if metric == "ip":
        s = dot(vector, query)
        return -s, s
    d = l2(vector, query)
    return d, 1 / (1 + d)


def _literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _scan(graph, type_name: str, edges: bool = False) -> DataFrame:
    kind = graph.catalog.get(type_name).kind
    return graph.view(graph.catalog.resolve([[type_name]], kind), edges=kind == "relation")


def vector_search(graph, type_name: str, prop: str, query, k: int = 10, where: Column | str | None = None, metric: str | None = None) -> DataFrame:
    """The k nearest elements of a type: its columns, distance and score; ties by _id.

    where is applied before the distances, in the same scan.
    """
    e = _embedding(graph, type_name, prop)
    if e["dims"] and len(query) != e["dims"]:
        raise GraphError(f"the query has {len(query)} dimensions, {type_name}.{prop} has {e['dims']}", "dimensions")
    frame = _scan(graph, type_name).filter(F.col(prop).isNotNull())
    if where is not None:
        frame = frame.filter(where)
    distance, score = measures(F.col(prop), _literal(query), metric or e["metric"])
    return frame.withColumn("distance", distance).withColumn("score", score).orderBy("distance", "_id").limit(k)


vector_search_exact = vector_search


def similar(graph, element_id: int, type_name: str, prop: str, k: int = 10) -> DataFrame:
    """Neighbours of a stored element over its root type, without itself."""
    e = _embedding(graph, type_name, prop)
    found = _scan(graph, e["root"]).filter(F.col("_id") == element_id).select(prop).first()
    if found is None or found[0] is None:
        raise GraphError(f"element {element_id} has no {prop}", "no_vector")
    return vector_search(graph, e["root"], prop, found[0], k, F.col("_id") != element_id)


def hybrid(graph, type_name: str, prop: str, query, anchor: int, k: int = 10, vector_weight: float = 1.0, graph_weight: float = 1.0, hops: int = 3, edge_types=()) -> DataFrame:
    """Reciprocal rank fusion of vector rank and hop distance from an anchor.

    _id, score, vector_score, graph_score, hops over a pool of max(10 k, 50).
    """
    pool = vector_search(graph, type_name, prop, query, max(10 * k, 50)).select("_id", F.col("score").alias("vector_score"), "distance")
    ranked = pool.withColumn("rank", F.row_number().over(Window.orderBy("distance", "_id")))
    start = graph.spark.createDataFrame([(anchor,)], "_id long")
    near = traverse.reach(start, graph.edge_view(*edge_types, direction="both"), 0, hops, True).select(F.col("node").alias("_id"), F.col("depth").alias("hops"))
    joined = ranked.join(near, "_id", "left")
    closeness = F.coalesce(1.0 / (RRF + F.col("hops")), F.lit(0.0))
    score = vector_weight / (RRF + F.col("rank")) + graph_weight * closeness
    return joined.select("_id", score.alias("score"), "vector_score", F.coalesce(1.0 / (1 + F.col("hops")), F.lit(0.0)).alias("graph_score"), "hops").orderBy(F.desc("score"), "_id").limit(k)


def words(text: Column) -> Column:
    """Lower-cased words (letters and digits) of a text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (or) of conjunctions of (wanted, phrase words)."""
    groups: list[list] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not minus and word.lower() == "or":
            groups.append([])
            continue
        terms = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if terms:
            groups[-1].append((not minus, terms))
    return [g for g in groups if g]


def _times(term: str) -> Column:
    return F.size(F.filter("_words", lambda w: w == term))


def fulltext(graph, type_name: str, props: list[str], query: str) -> DataFrame:
    """Matching elements with score; words and, or, -not and "phrases"."""
    text = F.concat_ws(" ", *(F.col(p).cast("string") for p in props))
    frame = _scan(graph, type_name).withColumn("_words", words(text))
    padded = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    match, score = F.lit(False), F.lit(0.0)
    for group in parse_websearch(query):
        every = F.lit(True)
        for wanted, terms in group:
            hit = F.array_contains("_words", terms[0]) if len(terms) == 1 else F.contains(padded, F.lit(" " + " ".join(terms) + " "))
            every = every & (hit if wanted else ~hit)
            if wanted:
                for t in terms:
                    times = _times(t)
                    score = score + F.when(times > 0, times / (F.lit(1.0) + F.log(F.size("_words") + F.lit(1.0)))).otherwise(0.0)
        match = match | every
    return frame.filter(match).withColumn("score", score).drop("_words")


# freshness of embeddings -------------------------------------------------
def mark_embedded(graph, rows: DataFrame, prop: str) -> None:
    """Record that the elements (_id, source text) have been embedded."""
    fresh = rows.select("_id", F.lit(prop).alias("prop"), F.md5(F.col("source").cast("binary")).alias("source_hash"), F.current_timestamp().alias("embedded_at"))
    graph.embedded = fresh if graph.embedded is None else graph.embedded.join(fresh, ["_id", "prop"], "left_anti").unionByName(fresh)


def stale_embeddings(graph) -> DataFrame:
    """(_id, prop, reason): vectors that are missing or whose source has changed."""
    found = graph.spark.createDataFrame([], "_id long, prop string, reason string")
    for (t, prop), e in graph.catalog.embeddings.items():
        if not e["source"]:
            continue
        frame = _scan(graph, t).select("_id", F.md5(F.col(e["source"]).cast("binary")).alias("now"), F.col(prop).isNull().alias("missing"))
        known = (graph.embedded.filter(F.col("prop") == prop).select("_id", "source_hash") if graph.embedded is not None else graph.spark.createDataFrame([], "_id long, source_hash string"))
        joined = frame.join(known, "_id", "left").filter(F.col("missing") | F.col("source_hash").isNull() | (F.col("now") != F.col("source_hash")))
        found = found.unionByName(joined.select("_id", F.lit(prop).alias("prop"), F.when(F.col("missing"), "missing").when(F.col("source_hash").isNull(), "unknown").otherwise("changed").alias("reason")))
    return found


def embedding_stats(graph) -> DataFrame:
    rows = [(t, p, e["dims"], e["metric"], e["source"]) for (t, p), e in graph.catalog.embeddings.items()]
    return graph.spark.createDataFrame(rows, "type string, prop string, dims int, metric string, source string")


def normalise(vector: Column, dims: int) -> Column:
    """The first dims components, scaled to length 1."""
    cut = F.slice(vector, 1, dims)
    return F.transform(cut, lambda x: x / F.sqrt(dot(cut, cut)))
