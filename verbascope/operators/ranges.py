"""Merging of padded time ranges (gaps and islands) without one task per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbascope.operators.ordered import running

CHUNK_S = 3600.0


def merge_ranges(
    spans: DataFrame, pad: float = 2.0, gap: float = 5.0, cap: int | None = None, keys: tuple[str, ...] = ("file_id",), chunk_s: float = CHUNK_S
) -> DataFrame:
    """Pad, sort and merge ranges whose start is at most ``gap`` after the running end.

    Output ``keys, range_no (from 1), start_s, end_s, n``; with ``cap`` only the
    first ranges of each key are kept (the feature's own limit).
    """
    keys = list(keys)
    padded = spans.select(
        *keys, F.greatest(F.col("start_s") - pad, F.lit(0.0)).alias("s"), (F.col("end_s") + pad).alias("e")
    ).groupBy(*keys, "s", "e").agg(F.count("*").alias("n"))
    chunk = F.floor(F.col("s") / chunk_s)
    seen = running(padded, keys, chunk, ["s", "e"], F.col("e"), "_reach", how="max")
    opens = F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + gap), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    marked = seen.withColumn("_open", opens)
    numbered = running(marked, keys, chunk, ["s", "e"], F.col("_open"), "range_no", inclusive=True)
    merged = numbered.groupBy(*keys, F.col("range_no").cast("int").alias("range_no")).agg(
        F.min("s").alias("start_s"), F.max("e").alias("end_s"), F.sum("n").alias("n")
    )
    return merged.where(F.col("range_no") <= cap) if cap else merged


def sample_ranges(merged: DataFrame, every: float = 5.0, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """One time stamp every ``every`` seconds inside each range, ends included."""
    n = F.floor((F.col("end_s") - F.col("start_s")) / every)
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("k")
    return merged.select(*keys, "range_no", "start_s", step).select(
        *keys, "range_no", (F.col("start_s") + F.col("k") * every).alias("ts")
    )


def drop_repeats(rows: DataFrame, keys: tuple[str, ...], order: str, value: str, chunk_s: float = CHUNK_S) -> DataFrame:
    """Drop a row whose value equals the previous row's.

    Equality makes "previous" and "last kept" the same, so a ``lag`` inside time
    chunks is enough; each chunk learns the last value of the chunk before.
    """
    keys = list(keys)
    base = rows.withColumn("_part", F.struct(*keys, F.floor(F.col(order) / chunk_s).alias("_chunk")))
    lagged = base.withColumn("_prev", F.lag(F.struct(value)).over(Window.partitionBy("_part").orderBy(order)))
    ends = base.groupBy(*keys, "_part").agg(F.max_by(F.struct(value), F.struct(order)).alias("_last"))
    before = Window.partitionBy(F.struct(*keys) if keys else F.lit(0)).orderBy("_part._chunk")
    ends = ends.select(F.col("_part").alias("_of"), F.lag("_last").over(before).alias("_carry"))
    both = lagged.join(ends, F.col("_part") == F.col("_of"))
    prev = F.coalesce("_prev", "_carry")
    return both.where(prev.isNull() | ~prev[value].eqNullSafe(F.col(value))).drop("_part", "_of", "_prev", "_carry")
