"""Mixing sources to target weights: a time-varying curriculum.

Every source s has a weight schedule over training time t in [0, 1],
    w_s(t) = target_s * (1 + tilt_s * (2 t - 1)),
whose integral, the cumulative token demand
    D_s(t) = target_s * (t + tilt_s * (t * t - t)),
reaches its target at t = 1.  The documents of a source are laid end to end in
the order of a hash, and laid again until the target is met (at most CAP
times); the one that crosses the target is cut there.  A copy whose words lie
around cumulative demand c gets the training position t with D_s(t) = c, and
the copies are sorted by range of position.

Targets: weights 5, 2, 1 repeat over the sources in code-point order (null
last) and share the whole size; a target stops at CAP times its source's size,
and the excess is shared by weight among the others.  This water filling has a
closed form over the sources ordered by CAP * size / weight.

Cumulative sizes never gather a source in one task: sizes are summed by
(source, bucket of the hash), the bucket sums give each bucket's offset, and a
window only runs inside a bucket.  Only ids, sizes and hashes are shuffled.

Nulls: a null text has size 0, a null doc_id hashes as the empty text, a null
source is a source.  Repeated rows are documents of their own.  Of a source
without words nothing is taken.  Ties of hash and doc_id go by size; equal rows
then share their words in any order, with equal sums.  A very long text is one
row and may be cut at the target.  An empty table gives an empty result.  Columns
named in keep are carried; others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target of each source; one row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    # The first source that is not full at the level of those before it sets the level.
    filled = (
        sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * cap).cast("double")).withColumn("ratio", ratio)
        .withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    )
    return filled.select("source", "source_size", "weight", F.when(F.col("ratio") < F.col("level"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, cap: int = CAP, tilts=(0.5, 0.0, -0.5), keep=()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position, copies.

    copies: array of (copy, words, position), one for each time that the mix
    takes the document; position is that of the first (null if not taken).
    keep: further columns of documents to carry.
    """
    sized = documents.select("doc_id", "source", *keep, size_of(F.col("text")).alias("size"))
    if not keep:  # words are counted once; with columns to keep, the texts are read again instead of written again
        sized = written(sized, "mix-sizes")
    # 4096 buckets of the hash: even a source with a third of all rows is spread over them.
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = sized.withColumn("_hash", name).withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    sums = written(placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    goal = targets(sums.select("source", F.col("_sum").alias("size")), weights, cap)
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    goal = goal.withColumn("tilt", F.element_at(F.array(*map(F.lit, tilts)), ((F.row_number().over(rank) - 1) % len(tilts) + 1).cast("int")))
    offsets = sums.select("source", "_bucket", (F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).alias("_offset"))
    facts = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(offsets["source"].alias("_source"), F.col("_bucket").alias("_b"), "_offset", "source_size", "target", "tilt")
    inside = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        placed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(facts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")), "left")
        .withColumn("_start", F.col("_offset") + F.col("_before"))
    )
    demand, tilt = F.floor("target"), F.col("tilt")

    def copy(i):
        begin = F.col("_start") + i * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), demand - begin)).cast("long")
        c = F.least(F.lit(1.0), F.try_divide(begin + words / 2.0, F.col("target")))
        # D(t) / target = (1 - tilt) t + tilt t**2 = c, solved without cancellation
        root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * c)
        return F.struct(F.lit(i).alias("copy"), words.alias("words"), (2 * c / ((1 - tilt) + root)).alias("position"))

    copies = F.filter(F.array(*(copy(i) for i in range(cap))), lambda x: x["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return laid.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(F.filter(F.array(copy(0)), lambda x: F.lit(False)))).select(
        "doc_id", "source", *keep, "size", "source_size", "target", taken.alias("taken"), F.get("copies", F.lit(0))["position"].alias("position"), "copies"
    )


def schedule_rows(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The training order: one row per copy, sorted by range of position, with all columns of mixed."""
    names = [c for c in mixed.columns if c not in ("copies", "position")]
    copies = mixed.select(*names, F.explode("copies").alias("c")).select(*names, F.col("c.copy").alias("copy"), F.col("c.words").alias("words"), F.col("c.position").alias("position"))
    order = ("position", "doc_id", "copy")
    dealt = copies.repartitionByRange(parts, *order) if parts else copies.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)


#: DuckDB SQL of op2's columns.
ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, (source_size * 3)::DOUBLE AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, cap / weight AS ratio,
             ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
v AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, encode(source) NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN ratio < v.level THEN cap ELSE v.level * weight END AS target FROM l, v),
p AS (SELECT sized.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM sized)
SELECT p.doc_id, p.size, g.source_size, g.target,
       (greatest(0, least(size, floor(target) - begin)) + greatest(0, least(size, floor(target) - begin - source_size))
        + greatest(0, least(size, floor(target) - begin - 2 * source_size)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
