"""Block-wise search: a stated query set against all rows, in blocks.

Rows go to row blocks by a hash of their id, each once.  A task indexes the rows
of a block once and then streams the queries past the index, a batch at a time;
the queries are a hundredth of the rows, so it is they that are sent to every
block.  A block holds a bounded number of components, so the memory of a task
does not grow with the table or with the queries.  The k best of each block are
merged.  There is no cross join of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Components and rows of a block, at most.
COMPONENTS = 1 << 22
ROW_BLOCK = 1 << 16
#: Queries that meet an index at once.
QUERY_BATCH = 512


def usable(vector: Column, zero: bool = True) -> Column:
    """Not null, not empty, all components finite (and, unless zero, not all 0)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    found = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return found if zero else found & F.exists(vector, lambda x: x != 0)


class Vectors:
    """Ids and vectors of arrow columns, flat."""

    def __init__(self, ids, lists):
        self.ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.start = np.cumsum(self.size) - self.size

    def vector(self, i: int) -> list[float]:
        return self.values[self.start[i] : self.start[i] + self.size[i]].tolist()

    def by_length(self):
        """(length, ids, matrix) of each length, sorted by id; the least vector of an id that repeats."""
        order = np.argsort(self.ids, kind="stable")
        ids = self.ids[order]
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            best: dict[int, int] = {}
            for i in order.tolist():
                x = int(self.ids[i])
                if x not in best or self.vector(i) < self.vector(best[x]):
                    best[x] = i
            order = np.asarray([best[x] for x in sorted(best)])
        for n in np.unique(self.size[order]):
            pick = order[self.size[order] == n]
            yield int(n), self.ids[pick], self.values[self.start[pick][:, None] + np.arange(n)]


def search(rows: DataFrame, queries: DataFrame, index: Callable, answer: Callable, k: int, score: str, ascending: bool, components: int = COMPONENTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller vec_id.

    rows and queries have (vec_id long, vector array).  index(ids, matrix) is made
    of the rows of one length of a block, sorted by id; answer(index, query ids,
    query matrix, k) yields (query number, row numbers, scores).
    """
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    size = max(256, min(ROW_BLOCK, components // max(1, facts["width"] or 1)))
    # Small tables are spread over the cores as well; the results do not depend on it.
    blocks = max(1, ceil(facts["n"] / size), min(2 * spark.sparkContext.defaultParallelism, ceil(facts["n"] / 8192)))
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "vector")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "vector")

    def run(batches):
        block, held, indexes = None, [], None
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(numbers)]):
                if s == e:
                    continue
                if numbers[s] != block:
                    block, held, indexes = numbers[s], [], None
                part = batch.slice(s, e - s)
                if not asks[s]:
                    held.append(part)
                    continue
                if indexes is None:
                    whole = pa.Table.from_batches(held).combine_chunks() if held else None
                    indexes = {} if whole is None else {n: (ids, index(ids, x)) for n, ids, x in Vectors(whole.column(2).combine_chunks(), whole.column(3).combine_chunks()).by_length()}
                    held = []
                found = []
                for first in range(0, part.num_rows, QUERY_BATCH):
                    some = part.slice(first, QUERY_BATCH)
                    for n, query_ids, x in Vectors(some.column(2), some.column(3)).by_length():
                        if n in indexes:
                            ids, made = indexes[n]
                            found += [(np.full(len(picked), query_ids[q]), ids[picked], scores) for q, picked, scores in answer(made, query_ids, x, k)]
                if found:
                    q, v, s_ = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s_, pa.float64() if score == "double" else pa.int64())], names=["query_id", "vec_id", "score"])

    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "asks", "vec_id")
    best = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
