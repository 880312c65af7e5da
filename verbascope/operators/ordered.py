"""Running totals and global ranks that no single task has to carry alone.

A plain window over a file puts the whole file into one task. Here every group
is cut into chunks by an order-preserving chunk column: the window runs inside
(group, chunk), one small row per chunk carries the total on, and the two are
added. A group that holds a third of all rows is spread over as many tasks as it
has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _group(keys: Sequence[str]) -> Column:
    """One value for a group's keys. A struct of NULLs is a value and equals itself, so
    rows with NULL keys form a group here as in a window, and joins keep them."""
    return F.struct(*keys) if keys else F.lit(0)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str | Column],
    value: Column,
    out: str,
    how: str = "sum",
    inclusive: bool = False,
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` over the rows before the current
    one (and the current one when ``inclusive``), NULL where there is none.

    Rows of NULL keys are a group, a NULL order value comes first: no row is lost."""
    agg = {"sum": F.sum, "max": F.max}[how]
    group, part = _group(keys), F.struct(*keys, chunk.alias("_chunk"))
    base = df.withColumn("_part", part).withColumn("_v", value)
    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = base.withColumn("_in", agg("_v").over(inner))
    before = Window.partitionBy(group).orderBy("_part._chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys, "_part").agg(agg("_v").alias("_t"))
    carry = totals.select(F.col("_part").alias("_of"), agg("_t").over(before).alias("_carry"))
    both = local.join(carry, F.col("_part") == F.col("_of"))
    if how == "sum":
        total = F.when(
            F.col("_in").isNotNull() | F.col("_carry").isNotNull(),
            F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0)),
        )
    else:
        total = F.greatest("_in", "_carry")
    return both.withColumn(out, total).drop("_part", "_of", "_v", "_in", "_carry")


def hash_rank(df: DataFrame, key: Column, salt: str, out: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """0-based position in the order of ``md5(salt:key)``: a seeded shuffle.

    The first 16 bits of the hash are the chunk, so 65,536 even chunks replace
    one global sort.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    ranked = df.withColumn("_h", digest).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running(ranked, keys, F.substring("_h", 1, 4), ["_h"], F.col("_one"), "_before", "sum")
    return ranked.withColumn(out, F.coalesce("_before", F.lit(0)).cast("bigint")).drop("_h", "_one", "_before")


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), bin_width: float = 1.0
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per probability.

    Equal values collapse to counts before the shuffle; the cumulative count is
    chunked by ``floor(value / bin_width)``. Only the few rows around each cut
    reach the last aggregation, so memory does not grow with the group.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    cum = running(counts, by, F.floor(F.col("_x") / F.lit(bin_width)), ["_x"], F.col("_n"), "_below", "sum")
    cum = cum.withColumn("_below", F.coalesce("_below", F.lit(0)))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        rows = cum.join(totals, by)
    else:
        rows = cum.withColumn("_k", F.lit(1)).join(F.broadcast(totals.withColumn("_k", F.lit(1))), "_k")
    aggs = []
    for p in probs:
        target = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(target), F.ceil(target)
        pick = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col("_x")))
        name = f"p{round(p * 100)}"
        frac = F.max(target - lo)
        aggs.append((pick(lo) * (F.lit(1.0) - frac) + pick(hi) * frac).alias(name))
    return rows.groupBy(*by).agg(*aggs)


def streaming_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn, schema: str) -> DataFrame:
    """Run ``fn(state_factory)`` style folds over sorted partitions.

    Rows of one key arrive in order inside one partition and are read batch by
    batch, so a fold that only remembers its last kept row needs constant memory
    however long the group is. ``fn`` maps an iterator of pandas frames (sorted
    by key and order) to an iterator of frames.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(fn, schema=schema)
