"""Nearest neighbours by multi-index hashing of learned binary codes.

A few rotations are learned on a bounded sample (iterative quantisation: turn the
vectors so that their signs lose least). The signs after all rotations are a
vector's code. A code is split into one-byte substrings, each with an index from
value to rows. Codes within Hamming radius R of a query must agree with it up to
t_j bits in some substring j whenever the (t_j + 1) add up to R + 1; so probing each
index within t_j bits and checking the whole code retrieves every code in the
radius. What is retrieved is ranked by the original vectors.

Every row is indexed. The rows are dealt into shards of bounded size, the queries into
blocks of bounded size, and one task searches one shard for one block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbascope.llm.common import need, pieces

SAMPLE_ROWS = 4096
ROTATIONS = 2
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4096
QUERIES_AT_ONCE = 256


@dataclass
class Codes:
    """Learned rotations side by side, the search radius and the probe width of each substring."""

    rotation: np.ndarray
    radius: int
    widths: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit-length rows, a byte for each substring."""
        return np.packbits(x @ self.rotation > 0, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, nearest: int, recall: float = 0.94, rotations: int = ROTATIONS, rounds: int = 20, seed: int = 7) -> Codes:
    """Fit codes on the sample; the radius reaches each row's ``nearest`` with the given share.

    ``nearest`` is the rank in the sample that a neighbour sought in the whole table has.
    """
    rng, x = np.random.default_rng(seed), unit(sample)
    n, dim = x.shape
    found = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        found.append(r)
    pad = (-dim * rotations) % 8
    rotation = np.concatenate([*found, np.zeros((dim, pad))], axis=1)
    codes = Codes(rotation, 0, np.zeros(0))
    if n > 1:
        probe = x[: min(n, 512)]
        near = probe @ sample.T
        near[np.arange(len(probe)), np.arange(len(probe))] = -np.inf
        top = np.argsort(-near, axis=1)[:, : max(1, min(nearest, n - 1))]
        bits = codes.of(x)
        apart = np.bitwise_count(bits[: len(probe), None, :] ^ bits[top]).sum(axis=2)
        codes.radius = int(np.quantile(apart, recall))
    parts = rotation.shape[1] // 8
    codes.widths = np.array([(codes.radius + 1 + j) // parts - 1 for j in range(parts)])
    return codes


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: Codes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, inner product) of the best ``k`` rows of a shard that each query's probing retrieves.

    A query that retrieves fewer than ``k`` rows of other ids is held against all rows of the shard.
    """
    a, b = codes.of(unit(q)), codes.of(unit(x))
    wide = -len(codes.widths) % 8
    a8 = np.pad(a, ((0, 0), (0, wide))).view(np.uint64)
    b8 = np.pad(b, ((0, 0), (0, wide))).view(np.uint64)
    found = np.zeros((len(q), len(x)), dtype=bool)
    near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    for j, width in enumerate(codes.widths):
        if width < 0:
            continue
        order = np.argsort(b[:, j], kind="stable")
        first = np.searchsorted(b[order, j], np.arange(257))
        asked = np.argsort(a[:, j], kind="stable")
        values, starts = np.unique(a[asked, j], return_index=True)
        for value, lo, hi in zip(values, starts, np.r_[starts[1:], len(asked)]):
            rows = np.concatenate([order[first[v] : first[v + 1]] for v in np.flatnonzero(near[value] <= width)])
            theirs = np.ascontiguousarray(b8[rows].T)
            for who in np.array_split(asked[lo:hi], -(-(hi - lo) // QUERIES_AT_ONCE)):
                apart = np.zeros((len(who), len(rows)), dtype=np.uint16)
                for word in range(b8.shape[1]):
                    apart += np.bitwise_count(a8[who, word, None] ^ theirs[word])
                hit, at = np.divmod(np.flatnonzero(apart <= codes.radius), len(rows))
                found[who[hit], rows[at]] = True
    found &= q_ids[:, None] != ids[None, :]
    for i in np.flatnonzero(found.sum(axis=1) < k):
        found[i] = q_ids[i] != ids
    out = []
    for i in range(len(q)):
        rows = np.flatnonzero(found[i])
        score = np.einsum("ij,j->i", x[rows], q[i])
        if len(rows) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), q_ids[i]), ids[rows[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _whole(vector: Column) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, recall: float = 0.94) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products found for each query.

    Queries are the rows where ``is_query`` holds over ``id``; candidates are all rows
    but those of the query's own id. Vectors that are NULL, all zero or hold a NULL or
    a value that is not finite take no part, nor do rows without an id or of another
    length than most of the sample. Equal scores go to the smaller id. Codes are
    fitted on ``sample_rows`` rows at most, those of the smallest hash; a query with
    fewer than ``k`` candidates gets them all, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = need(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _whole(F.col("v")))
    out = "query_id long, id long, score double"
    n = rows.count()
    drawn = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()]
    if not drawn:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(v) for v in drawn]
    dim = max(set(sizes), key=sizes.count)
    sample = np.array([v for v in drawn if len(v) == dim])
    codes = learn(sample, nearest=max(1, round(k * len(sample) / n)), recall=recall)
    rows = rows.where(F.size("v") == dim)
    queries = rows.where(is_query)
    shards, blocks = pieces(n, SHARD_ROWS), pieces(queries.count(), BLOCK_QUERIES)
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(m)).cast("int")
    asked = queries.select("id", "v", deal(blocks).alias("block")).select("*", spread(shards).alias("shard"))
    held = rows.select("id", "v", deal(shards).alias("shard")).select("*", spread(blocks).alias("block"))

    def dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        return t.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table(dict(zip(("query_id", "id", "score"), search(*dense(left), *dense(right), codes, k))))

    found = asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInArrow(run, out)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
