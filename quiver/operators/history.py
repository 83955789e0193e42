"""Change history: an append-only log of (entity_id, is_edge, op, recorded_at, payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.catalog import GraphError

SCHEMA = "entity_id long, is_edge boolean, op string, recorded_at timestamp, payload string"


def log_change(graph, frame: DataFrame, op: str, is_edge: bool) -> None:
    payload = F.to_json(F.struct(*(F.col("`" + c + "`") for c in frame.columns)))
    rows = frame.select(F.col("_id").alias("entity_id"), F.lit(is_edge).alias("is_edge"), F.lit(op).alias("op"), F.current_timestamp().alias("recorded_at"), payload.alias("payload"))
    graph.changes = rows if graph.changes is None else graph.changes.unionByName(rows)


def history(changes: DataFrame, key: str = "entity_id", at: str = "recorded_at", tie: str | None = None) -> DataFrame:
    """The log with validity: valid_from, and valid_to when the next change of the entity came."""
    order = [at] + ([tie] if tie else [])
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def as_of(changes: DataFrame, moment, key: str = "entity_id", at: str = "recorded_at", payload: str = "payload", tie: str | None = None) -> DataFrame:
    """(key, payload): each entity's last change at or before a moment, combined before the shuffle."""
    order = F.struct(at, tie) if tie else F.struct(at)
    return changes.filter(F.col(at) <= F.lit(moment)).groupBy(key).agg(F.max_by(payload, order).alias(payload))


def entity_as_of(graph, entity_id: int, moment):
    if graph.changes is None:
        raise GraphError("history is not enabled", "untracked")
    found = as_of(graph.changes.filter(F.col("entity_id") == entity_id), moment).first()
    if found is None:
        raise GraphError(f"element {entity_id} is not tracked", "untracked")
    return found["payload"]


def set_source(graph, rows: DataFrame) -> None:
    """Provenance (entity_id, source, confidence, author): the newest row of an element stays."""
    rows = rows.withColumn("ingested_at", F.current_timestamp())
    graph.sources = rows if graph.sources is None else graph.sources.join(rows, "entity_id", "left_anti").unionByName(rows)
