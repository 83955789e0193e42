"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors are centred and turned by ROTATIONS learned orthogonal
matrices (iterative quantisation: alternate sign codes and the orthogonal
matrix that fits them best); the signs are the bits.  The rotations and the
search radius are fitted for each length of vectors on a sample (SAMPLE vectors in
all, LEAST of a length or more); every row is coded and indexed.

Index: a code is cut into substrings of 8 bits, and each substring of each
block of rows has a table from its value to the rows that hold it.  By the
pigeonhole principle a code within Hamming radius r of a query has a substring
within r // m of the query's, m being the number of substrings, so probing the
buckets in that ball of every table reaches every code within r; those are
checked on the whole code and reranked by the Euclidean distance of the
original vectors, in double precision.  Where a block yields fewer than k rows
the radius grows by m until it does or the block is exhausted.

Nulls, zero vectors and vectors with null or non-finite components take no
part, nor do pairs of different length.  Rows that repeat a vec_id count once
(the least vector).  Empty tables give an empty result; a query with fewer than
k candidates gets all of them.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.blocks import search, usable

SAMPLE = 8192
LEAST = 64
ROTATIONS = 4
#: Share of the sample's true neighbours that the radius must reach.
REACH = 0.985
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))


def _rotation(x: np.ndarray, rng, rounds: int = 25) -> np.ndarray:
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


class Coder:
    """Centre, rotations and radius of vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = np.linalg.norm(sample, axis=1, keepdims=True)
        unit = sample / scale
        self.centre = unit.mean(axis=0)
        self.turns = np.concatenate([_rotation(unit[:4096] - self.centre, rng) for _ in range(ROTATIONS)], axis=1)
        pad = -self.turns.shape[1] % 8
        self.turns = np.pad(self.turns, ((0, 0), (0, pad)))
        self.tables = self.turns.shape[1] // 8
        self.radius = self._fit_radius(sample, k)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits((unit - self.centre) @ self.turns >= 0, axis=1)

    def _fit_radius(self, sample: np.ndarray, k: int) -> int:
        codes, far = self.codes(sample), []
        for i in range(0, min(len(sample), 256)):
            d = ((sample - sample[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argsort(d)[: min(k, len(sample) - 1)]
            far.append(_BITS[codes[near] ^ codes[i]].sum(axis=1))
        return int(np.quantile(np.concatenate(far), REACH)) if far and len(sample) > 1 else 8 * self.tables


class MultiIndex:
    """One table for each substring: value -> rows of the block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        ordered = np.take_along_axis(codes, self.order, axis=0)
        self.starts = np.stack([np.searchsorted(ordered[:, j], np.arange(257)) for j in range(codes.shape[1])])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        m = self.codes.shape[1]
        ball = radius // m
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            near = np.flatnonzero(_BITS[np.arange(256) ^ int(code[j])] <= ball)
            starts = self.starts[j]
            for value in near[starts[near + 1] > starts[near]]:
                hit[self.order[starts[value] : starts[value + 1], j]] = True
            if hit.all():
                break
        rows = np.flatnonzero(hit)
        return rows[_BITS[self.codes[rows] ^ code].sum(axis=1, dtype=np.int32) <= radius]


def answer(made, query_ids, query_vectors, k):
    row_ids, row_vectors, coder, index = made
    for q, code in enumerate(coder.codes(query_vectors)):
        radius, want = coder.radius, k + 1
        rows = index.within(code, radius)
        while len(rows) < want and radius < 8 * coder.tables:
            radius = min(radius + coder.tables, 8 * coder.tables)
            rows = index.within(code, radius)
        rows = rows[row_ids[rows] != query_ids[q]]
        d = np.sqrt(((row_vectors[rows] - query_vectors[q]) ** 2).sum(axis=1))
        best = np.lexsort((row_ids[rows], d))[:k]
        yield q, rows[best], d[best]


def ann(embeddings: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows found.

    Both frames have vec_id and embedding; a query's own vec_id is no candidate.
    """
    vectors = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), zero=False))
    rows = vectors(embeddings)
    # A sample of each length, in the order of a hash: the same rows each time, SAMPLE of them in all
    # (LEAST of each length, if there are very many lengths).
    lengths = rows.agg(F.count_distinct(F.size("vector"))).first()[0]
    each = max(LEAST, SAMPLE // max(1, lengths))
    place = F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "vector"))
    sampled = rows.select("vector", place.alias("place")).filter(F.col("place") <= each).select("vector").collect()
    by_length: dict[int, list] = {}
    for (vector,) in sampled:
        by_length.setdefault(len(vector), []).append(vector)
    coders = {n: Coder(np.asarray(v, np.float64), k) for n, v in by_length.items()}

    def index(ids, matrix):
        coder = coders[matrix.shape[1]]
        return ids, matrix, coder, MultiIndex(coder.codes(matrix))

    return search(rows, vectors(queries), index, answer, k, "double", ascending=True)
