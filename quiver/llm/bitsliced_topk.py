"""Exact top-k inner products with a bit-sliced index.

Every component x becomes the integer floor(SCALE * x).  A block of rows keeps,
for each attribute, one bitmap per bit of the integers (shifted to be
non-negative).  A query's score is a sum of attribute slices, shifted by the
bits of the query's own integers; carry-save adders sum them with bitmap
arithmetic, which gives the scores themselves as bit slices.  A negative query
component adds the complement of its slices.

The k best are found from the most significant score slice downward: rows
certainly in, rows still tied, rows out.  Rows tied at the boundary are resolved
exactly: the tie goes to the smaller vec_id, and the block is sorted by it.

Rows with a component of 2**52 or more are kept beside the slices and scored one
by one in whole numbers of any size; so is a query's score of a row where the sum
might not fit in a long.

Nulls and vectors with null or non-finite components take no part, nor do pairs
of different length.  Rows that repeat a vec_id count once (the least vector).
Scores beyond a long are given as the nearest long and rank by vec_id among
themselves.  Empty tables give an empty result; a query with fewer than k
candidates gets all of them.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.blocks import search, usable

SCALE = 1024
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


WIDE = 2.0**52
LONG = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    over, under = float(x).as_integer_ratio()
    return SCALE * over // under


class BitSlices:
    """slices[d][b]: bitmap of bit b of attribute d over the block's rows."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.low = values.min(axis=0)
        self.bits = [int(x).bit_length() for x in (values.max(axis=0) - self.low)]
        self.words = -(-self.rows // 64)
        shifted = (values - self.low).astype(np.uint64)
        self.slices = [[self._pack((shifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(n)] for d, n in enumerate(self.bits)]
        self.full = self._pack(np.ones(self.rows, np.uint64))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(bool), bitorder="little")
        out = np.zeros(self.words * 8, np.uint8)
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def unpack(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.rows])

    def score_slices(self, query: list[int]) -> list[np.ndarray]:
        """Slices of sum(q * x) plus a constant of the query, from the lowest bit."""
        columns: list[list[np.ndarray]] = []
        for d, q in enumerate(query):
            weight, b = abs(q), 0
            slices = self.slices[d] if q >= 0 else [~s for s in self.slices[d]]
            while weight:
                if weight & 1:
                    for i, s in enumerate(slices):
                        while len(columns) <= i + b:
                            columns.append([])
                        columns[i + b].append(s)
                weight >>= 1
                b += 1
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            carries = columns[at + 1] if at + 1 < len(columns) else []
            while len(column) > 2:  # full adders: three bitmaps to a sum and a carry
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.insert(0, half ^ z) if len(column) < 2 else column.append(half ^ z)
                half &= z
                half |= x & y
                carries.append(half)
            if len(column) == 2:
                x, y = column
                carries.append(x & y)
                column[:] = [x ^ y]
            if at + 1 == len(columns) and carries:
                columns.append(carries)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def top(self, score: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k largest scores, boundary ties to the earlier row."""
        count = lambda m: int(np.bitwise_count(m).sum())
        sure, tied = np.zeros_like(allowed), allowed.copy()
        if count(tied) <= k:
            return self.unpack(tied)
        have = 0
        for s in reversed(score):
            high = tied & s
            n = have + count(high)
            if n > k:
                tied = high
            else:
                sure |= high
                tied &= ~s
                have = n
                if n == k:
                    return self.unpack(sure)
        return np.concatenate([self.unpack(sure), self.unpack(tied)[: k - have]])


class Index:
    """A block's rows: bit slices, and those with wide components as they are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        with np.errstate(over="ignore"):
            scaled = np.floor(vectors * SCALE)
        wide = (np.abs(scaled) >= WIDE).any(axis=1)
        self.narrow = np.flatnonzero(~wide)
        self.rows = scaled[self.narrow].astype(np.int64)
        self.slices = BitSlices(self.rows) if len(self.rows) else None
        self.wide = [(i, [whole(x) for x in vectors[i].tolist()]) for i in np.flatnonzero(wide).tolist()]
        self.most = np.abs(self.rows).max(axis=0, initial=0).tolist()

    def scores(self, picked: np.ndarray, query: list[int]) -> list[int]:
        if sum(abs(q) * m for q, m in zip(query, self.most)) <= LONG and max(map(abs, query)) <= LONG:
            return (self.rows[picked] @ np.asarray(query, np.int64)).tolist()
        return [sum(q * x for q, x in zip(query, row)) for row in self.rows[picked].tolist()]

    def best(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(row, score) of the k best, the best first."""
        found = []
        if self.slices is not None:
            allowed = self.slices.full
            own = int(np.searchsorted(self.ids[self.narrow], query_id))
            if own < len(self.narrow) and self.ids[self.narrow[own]] == query_id:
                allowed = allowed.copy()
                allowed[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
            picked = self.slices.top(self.slices.score_slices(query), allowed, k)
            found = list(zip(self.narrow[picked].tolist(), self.scores(picked, query)))
        found += [(i, sum(q * x for q, x in zip(query, row))) for i, row in self.wide if self.ids[i] != query_id]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def answer(index: Index, query_ids, query_vectors, k):
    for q, vector in enumerate(query_vectors.tolist()):
        found = index.best(int(query_ids[q]), [whole(x) for x in vector], k)
        yield q, np.asarray([i for i, _ in found], np.int64), np.asarray([max(-LONG - 1, min(LONG, s)) for _, s in found], np.int64)


def exact_topk(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest integer inner products.

    Both frames have vec_id and embedding; a query's own vec_id is no candidate.
    """
    vectors = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return search(vectors(embeddings), vectors(queries), Index, answer, k, "long", ascending=False)


#: DuckDB SQL of op3: every query against every row.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
