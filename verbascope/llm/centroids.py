"""Centroid clustering of integer vectors by equal-average equal-variance search.

Centroids lie sorted by the sum of their components. A vector looks at them outward
from its own sum: the one next to it first, then the next on either side. The sums
alone bound the distance from below, (Sx - Sc)^2 / K, and that bound grows outward,
so a side is left for good once it passes the least distance found. What remains is
held against the sharper bound with the deviations, and only then measured, in whole
numbers. Ties of distance go to the smaller number at every step.

Rounds scan the vectors where they are: a task returns one row of sums for each
centroid, so what is shuffled and what the driver holds is bounded by their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import need
from verbascope.session import materialise

SCALE = 64
LARGEST = 1 << 26  # of a component, so that no squared distance of 64 components passes a long


@dataclass
class Centroids:
    """Integer centroids with their sums and deviations, in the order of their sums."""

    values: np.ndarray

    def __post_init__(self):
        self.width = self.values.shape[1]
        total = self.values.sum(axis=1)
        self.order = np.lexsort((np.arange(len(total)), total))
        self.sums = total[self.order]
        self.spread = deviation(self.values, total)[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row; how many distances were measured."""
        n, k = len(x), len(self.order)
        best, least, measured = np.full(n, -1, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), 0
        total = x.sum(axis=1)
        own = deviation(x, total)
        right = np.searchsorted(self.sums, total)
        left = right - 1

        def look(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Hold the rows against the centroids at these places; the rows whose side stays open."""
            nonlocal measured
            gap = total[rows] - self.sums[at]
            # A gap^2 above K * least rules out this centroid and all beyond it.
            near = (best[rows] < 0) | (np.abs(gap) <= _root(self.width, least[rows]))
            rows, at, gap = rows[near], at[near], gap[near]
            # The deviations are rounded, so their bound must be passed clearly.
            low = gap.astype(np.float64) ** 2 / self.width + (own[rows] - self.spread[at]) ** 2
            close = (best[rows] < 0) | (low <= least[rows] * (1 + 1e-9) + 1)
            r, c = rows[close], self.order[at[close]]
            measured += len(r)
            apart = x[r] - self.values[c]
            d = np.einsum("ij,ij->i", apart, apart)
            better = (d < least[r]) | ((d == least[r]) & (c < best[r]))
            best[r[better]], least[r[better]] = c[better], d[better]
            return rows

        # The nearer neighbour first: its distance closes most of the rest.
        below = (left >= 0) & ((right >= k) | (total - self.sums[left] <= self.sums[np.minimum(right, k - 1)] - total))
        look(np.flatnonzero(below), left[below])
        look(np.flatnonzero(~below), right[~below])
        left[below] -= 1
        right[~below] += 1
        open_left, open_right = np.flatnonzero(left >= 0), np.flatnonzero(right < k)
        while len(open_left) or len(open_right):
            if len(open_right):
                open_right = look(open_right, right[open_right])
                right[open_right] += 1
                open_right = open_right[right[open_right] < k]
            if len(open_left):
                open_left = look(open_left, left[open_left])
                left[open_left] -= 1
                open_left = open_left[left[open_left] >= 0]
        return best, least, measured


def deviation(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Length of a vector's difference from its mean."""
    mean = total / x.shape[1]
    return np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))


def _root(width: int, least: np.ndarray) -> np.ndarray:
    """A whole number not below the root of width * least, a product that may pass a long."""
    return (np.sqrt(least.astype(np.float64) * width) * (1 + 1e-12)).astype(np.int64) + 2


def whole_vectors(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors of ``width`` finite components as whole numbers floor(64 x)."""
    x = F.col("v").cast("array<double>")
    fit = F.forall(x, lambda c: F.coalesce((c >= -LARGEST / SCALE) & (c < LARGEST / SCALE), F.lit(False)))  # NaN is above any number
    rows = need(vectors, id_col, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.where((F.size("v") == width) & fit).select("id", F.transform(x, lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(x.flatten(), dtype=np.int64).reshape(-1, width)


def starts(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hash of their id; equal ids by their components."""
    first = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), "x")
    found = first.orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in found], dtype=np.int64)


def moved(rows: DataFrame, centroids: Centroids) -> Centroids:
    """Every centroid that has vectors becomes the floor of their mean, component by component."""
    width = centroids.width

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids.values), dtype=np.int64), np.zeros(centroids.values.shape, dtype=np.int64)
        for batch in batches:
            x = matrix(batch, width)
            which, _, _ = centroids.nearest(x)
            turn = np.argsort(which, kind="stable")
            at, begin = np.unique(which[turn], return_index=True)
            if len(at):
                total[at] += np.add.reduceat(x[turn], begin, axis=0)
                n[at] += np.diff(np.r_[begin, len(which)])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = rows.select("x").mapInArrow(add, "cluster int, n long, total array<long>")
    whole = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    values = centroids.values.copy()
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row for each centroid at most
        values[r.cluster] = [int(s) // r.n for s in r[2:]]
    return Centroids(values)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``width`` components, none NULL or non-finite; they
    are taken as whole numbers floor(64 x). (A component of 2^20 or more in size, where
    squared distances could pass a long, counts as none that can be kept.) The ``k``
    kept vectors of the smallest sha256 of ``1:<id>`` start as centroids, fewer if the
    table has fewer; a NULL id starts none but is assigned like any other, and where
    only NULL ids are kept the least vector starts. Repeated rows count each, columns
    of other names are not read, a table without kept vectors gives an empty one.
    Centroids without vectors stay where they are. All values are exact whole numbers.
    """
    rows = whole_vectors(vectors, width, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long"
    first = starts(rows, k)
    if not len(first):
        first = np.array([r.x for r in rows.orderBy("x").limit(1).collect()], dtype=np.int64)
    if not len(first):
        assigned = rows.sparkSession.createDataFrame([], schema)
        return _report(assigned, np.zeros((0, width), dtype=np.int64), id_col)
    centroids = Centroids(first)
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, apart, _ = centroids.nearest(matrix(batch, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which, pa.int32()), pa.array(apart, pa.int64())], ["id", "cluster", "distance"])

    return _report(materialise(rows.mapInArrow(assign, schema), "clusters"), centroids.values, id_col)


def _report(assigned: DataFrame, values: np.ndarray, id_col: str) -> DataFrame:
    """Adds the sums of the distances, and the centroids: a row for each of them, so a bounded side of the join."""
    spark = assigned.sparkSession
    whole: Column = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(whole.alias("s")).collect()}
    every = sum(per.values())
    table = [(c, per.get(c, 0), every, [int(v) for v in row]) for c, row in enumerate(values)]
    known = spark.createDataFrame(table, "c int, cluster_inertia long, inertia long, centroid array<long>")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    both = assigned.join(F.broadcast(known), F.col("cluster") == F.col("c"))
    return both.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", digest.alias("centroid_sha256"))
