"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is one stream of words: its documents in the order of a hash of their
id. The stream is cut into blocks of equal size; reading on past its end starts it
again. The mix is a row of slots. Slot k owns the golden-ratio point k * g mod N,
where N is the number of slots and g the number next to N / phi that shares no
factor with it: the points 0 .. N-1 in an order that fills every interval evenly.
The cumulative slot counts of the sources cut the points into intervals, a slot
belongs to the source its point falls into, and the r-th slot of a source takes the
r-th block of its stream. So every source gets exactly its slots, spread evenly.

Only DataFrame functions are used. No step gathers a source: documents are dealt by
(source, hash prefix), slots by (source, run of slots), and one small row for each
such bucket carries running totals on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbascope.llm.common import word_count
from verbascope.session import materialise

GOLDEN = (math.sqrt(5) - 1) / 2
BLOCK_WORDS = 4096
SLOTS_PER_CHUNK = 4096
POINTS_PER_ROW = 1024


@dataclass
class Mix:
    """rows: the documents, their columns numbered _c0, _c1 .. so that none can clash, with
    _size, _start, _sid, _source_size, _target; slots: the schedule (_sid, slot, source_rank,
    epoch, block, lo, hi) over words of the source's stream; columns: the names by number."""

    rows: DataFrame
    slots: DataFrame
    n_slots: int
    columns: list[str]

    def own(self, columns: list[str]) -> list[Column]:
        """Columns of the documents, by their names."""
        return [F.col(f"_c{self.columns.index(c)}").alias(c) for c in columns]


def source_targets(totals: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets of the sources from (_skey, _source, _size): words by weight, at most
    ``max_epochs`` times a source's own, the excess shared out again by weight.

    With sources in the order of size / weight, a source stops at its limit if its
    share of what is left does; after the first that does not, none does.
    """
    all_of_it = Window.partitionBy(F.lit(1))
    by_name = all_of_it.orderBy(F.col("_source").asc_nulls_last())
    numbered = totals.withColumn("_sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_sid") % len(weights) + 1).cast("long")
    rows = numbered.withColumns({"_w": weight, "_limit": F.col("_size") * max_epochs, "_total": F.sum("_size").over(all_of_it)})
    by_need = all_of_it.orderBy(F.col("_limit") / F.col("_w"), "_sid")
    rows = rows.withColumns(
        {
            "_left": F.col("_total") - F.coalesce(F.sum("_limit").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_rest": F.sum("_w").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("_full", F.col("_left") * F.col("_w") >= F.col("_limit") * F.col("_rest"))
    free = all_of_it.orderBy("_sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_taken": F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0)).over(free), "_sum": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(free)})
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise((F.col("_w") * (F.col("_total") - F.col("_taken"))).cast("double") / F.col("_sum"))
    return rows.select("_skey", "_source", "_sid", "_size", target.alias("_target"))


def golden_step(n: int) -> tuple[int, int]:
    """(g, inverse of g modulo n) for the number g next to n / phi without a common factor."""
    if n == 1:
        return 1, 0
    near = round(n * GOLDEN)
    g = next(x for d in range(n) for x in (near + d, near - d) if 0 < x < n and math.gcd(x, n) == 1)
    return g, pow(g, -1, n)


def schedule(spark: SparkSession, sources: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Slots of (_skey, _sid, _size, _target) rows."""
    s = sources.where("_size > 0").withColumns({"_quota": F.round("_target").cast("long"), "_blocks": F.ceil(F.col("_size") / block)})
    s = s.withColumn("_slots", F.expr("_quota div _size") * F.col("_blocks") + F.ceil(F.col("_quota") % F.col("_size") / block))
    s = s.withColumn("_from", F.sum("_slots").over(Window.partitionBy(F.lit(1)).orderBy("_sid")) - F.col("_slots"))
    n = s.agg(F.sum("_slots")).first()[0] or 0
    _, inverse = golden_step(max(n, 1))
    # Points of a source, a row for each POINTS_PER_ROW first, so that no array grows with the source.
    cut = s.where("_slots > 0").select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(_slots - 1) div {POINTS_PER_ROW}"))).alias("_k")).repartition("_skey", "_k")
    low = F.col("_k") * POINTS_PER_ROW
    points = cut.select("*", F.explode(F.sequence(low, F.least(low + POINTS_PER_ROW, F.col("_slots")) - 1)).alias("_j"))
    slot = ((F.col("_from") + F.col("_j")).cast("decimal(19,0)") * F.lit(inverse).cast("decimal(19,0)") % F.lit(max(n, 1)).cast("decimal(19,0)")).cast("long")
    slots = points.select("_skey", "_sid", "_size", "_quota", "_blocks", slot.alias("slot")).withColumn("_chunk", F.expr(f"slot div {SLOTS_PER_CHUNK}"))
    inside = Window.partitionBy("_skey", "_chunk").orderBy("slot")
    before = Window.partitionBy("_skey").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.groupBy("_skey", "_chunk").count().select("_skey", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_carry"))
    ranked = slots.withColumn("_r", F.row_number().over(inside) - 1).join(carry, ["_skey", "_chunk"]).withColumn("source_rank", F.col("_carry") + F.col("_r"))
    ranked = ranked.withColumns({"epoch": F.expr("source_rank div _blocks"), "block": F.col("source_rank") % F.col("_blocks")}).withColumn("lo", F.col("block") * block)
    left = F.col("_quota") - F.col("epoch") * F.col("_size")
    return ranked.select("_skey", "_sid", "slot", "source_rank", "epoch", "block", "lo", F.least(F.col("lo") + block, F.col("_size"), left).alias("hi")), n


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The schedule that mixes ``docs`` to the weights of their sources, and the rows it takes from.

    Sources in code-point order, NULL last, take the weights in turn. A document's
    size is its number of words (runs of other than ASCII white space), 0 for a NULL
    text. A NULL source is a source; NULL ids and repeated rows are documents of
    their own, ordered by size among equal ids and by a hash of their text among NULL
    ones. Columns may have any names; ``taken_words`` leaves out those that begin with
    an underscore. An empty table gives no slots.
    """
    spark = docs.sparkSession
    at = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    held = docs.toDF(*at.values())
    id_, text, source = at[id_col], at[text_col], at[source_col]
    # Rows without an id are told apart by their texts, or they would share one bucket.
    key = F.md5(F.coalesce(F.col(id_).cast("string"), F.concat(F.lit("text:"), F.xxhash64(text).cast("string"))))
    rows = held.withColumns(
        {
            "_size": word_count(text),
            "_skey": F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), source)),
            "_hash": key,
            "_bucket": F.conv(F.substring(key, 1, 3), 16, 10).cast("int"),
        }
    )
    buckets = materialise(rows.groupBy("_skey", "_bucket").agg(F.sum("_size").alias("_words"), F.first(source).alias("_source")), "mix-buckets")
    totals = buckets.groupBy("_skey").agg(F.first("_source").alias("_source"), F.sum("_words").alias("_size"))
    sources = materialise(source_targets(totals, weights, max_epochs), "mix-sources")
    slots, n = schedule(spark, sources, block)
    before = Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.join(sources.select("_skey", "_sid", F.col("_size").alias("_source_size"), "_target"), "_skey")
    carry = carry.select("_skey", "_bucket", "_sid", "_source_size", "_target", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy("_skey", "_bucket").orderBy("_hash", id_, "_size", F.xxhash64(text))
    placed = rows.withColumns({"_row": F.row_number().over(inside), "_start": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")})
    placed = placed.join(carry, ["_skey", "_bucket"]).withColumn("_start", F.col("_start") + F.col("_carry")).drop("_carry", "_hash")
    return Mix(placed, slots, n, list(at))


def taken_words(m: Mix, block: int = BLOCK_WORDS) -> DataFrame:
    """The rows with ``_words``: the words of each that the mix takes, repeats counted.

    Documents meet the slots block by block, and a block is taken a few times at most.
    """
    piece = m.rows.select("_skey", "_bucket", "_row", "_start", "_size").where("_size > 0")
    first, last = F.expr(f"_start div {block}"), F.expr(f"(_start + _size - 1) div {block}")
    piece = piece.select("*", F.explode(F.sequence(first, last)).alias("block"))
    from_, to = F.greatest("_start", "lo"), F.least(F.col("_start") + F.col("_size"), "hi")
    found = piece.join(m.slots.select("_skey", "block", "lo", "hi"), ["_skey", "block"]).withColumn("_words", F.greatest(to - from_, F.lit(0)))
    words = found.groupBy("_skey", "_bucket", "_row").agg(F.sum("_words").alias("_words"))
    out = m.rows.join(words, ["_skey", "_bucket", "_row"], "left").withColumn("_words", F.coalesce("_words", F.lit(0)))
    return out.select(*m.own([c for c in m.columns if not c.startswith("_")]), *[c for c in out.columns if not c.startswith("_c")])


def mixed_documents(m: Mix, columns: list[str], block: int = BLOCK_WORDS) -> DataFrame:
    """Whole documents, once for every slot that takes their first word (an empty one: the place of it).

    Their columns come back as they were, whatever their names.
    """
    rows = m.rows.withColumn("block", F.least(F.expr(f"_start div {block}"), F.expr(f"greatest(_source_size - 1, 0) div {block}")))
    times = m.slots.select("_skey", "block", "lo", "hi", "slot")
    inside = (F.col("_start") < F.col("hi")) | (F.col("_size") == 0) & (F.col("_start") == F.col("hi"))
    return rows.join(times, ["_skey", "block"]).where(inside).select(*m.own(columns))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    out = taken_words(mix(docs)).select("doc_id", "_size", "_source_size", "_target", "_words")
    return out.toDF("doc_id", "size", "source_size", "target", "taken")
