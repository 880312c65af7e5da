"""Time-interval joins as bucketed equi-joins.

Both sides are spread over fixed time buckets and joined on (keys, bucket); the
pair is kept only in its first common bucket, so no de-duplication is needed.
One long recording is spread over as many join keys as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BUCKET_S = 30.0


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width)))


def _spread(df: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    first = _bucket(lo, width)
    last = F.greatest(_bucket(hi, width), first)
    return df.withColumn("_first", first).withColumn("_b", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    closed: bool,
    suffixes: tuple[str, str] = ("", "_r"),
    left_span: tuple[str, str] = ("start_s", "end_s"),
    right_span: tuple[str, str] = ("start_s", "end_s"),
    width: float = DEFAULT_BUCKET_S,
) -> DataFrame:
    """Pairs of overlapping intervals within ``keys``.

    ``closed`` intervals that only touch count as overlapping, open ones do not.
    Columns other than the keys get the side's suffix when both sides have them.
    """
    keys = list(keys)
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    ren = lambda df, sfx: df.select(*[F.col(c).alias(c + sfx) if c in shared and sfx else F.col(c) for c in df.columns])
    name = lambda c, sfx: c + sfx if c in shared else c
    ls, le = (name(c, suffixes[0]) for c in left_span)
    rs, re_ = (name(c, suffixes[1]) for c in right_span)
    l = _spread(ren(left, suffixes[0]), F.col(ls), F.col(le), width).withColumnRenamed("_first", "_lf")
    r = _spread(ren(right, suffixes[1]), F.col(rs), F.col(re_), width).withColumnRenamed("_first", "_rf")
    if closed:
        meets = (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs))
    else:
        meets = (F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs))
    hit = l.join(r, [*keys, "_b"]).where(meets & (F.col("_b") == F.greatest("_lf", "_rf")))
    return hit.drop("_b", "_lf", "_rf")


def points_in(
    points: DataFrame, at: str, spans: DataFrame, keys: Sequence[str], span: tuple[str, str] = ("start_s", "end_s"), width: float = DEFAULT_BUCKET_S
) -> DataFrame:
    """Points joined to the closed intervals that contain them (inner)."""
    s = _spread(spans, F.col(span[0]), F.col(span[1]), width).drop("_first")
    p = points.withColumn("_b", _bucket(F.col(at), width))
    return p.join(s, [*keys, "_b"]).where((F.col(span[0]) <= F.col(at)) & (F.col(at) <= F.col(span[1]))).drop("_b")


def first_containing(
    points: DataFrame, at: str, spans: DataFrame, keys: Sequence[str], point_key: Sequence[str], pick: str, default=0, width: float = DEFAULT_BUCKET_S
) -> DataFrame:
    """Each point with the smallest ``pick`` of the intervals that contain it."""
    hits = points_in(points.select(*keys, *point_key, at), at, spans.select(*keys, pick, "start_s", "end_s"), keys, width=width)
    best = hits.groupBy(*keys, *point_key).agg(F.min(pick).alias(pick))
    joined = points.join(best, [*keys, *point_key], "left")
    return joined.withColumn(pick, F.coalesce(pick, F.lit(default)))


def within(points: DataFrame, at: str, centers: DataFrame, center: str, radius: float, keys: Sequence[str], width: float = DEFAULT_BUCKET_S) -> DataFrame:
    """Points at most ``radius`` seconds from a centre."""
    c = centers.withColumn("_lo", F.col(center) - radius).withColumn("_hi", F.col(center) + radius)
    near = points_in(points, at, c, keys, span=("_lo", "_hi"), width=width)
    return near.where(F.abs(F.col(at) - F.col(center)) <= radius).drop("_lo", "_hi")
