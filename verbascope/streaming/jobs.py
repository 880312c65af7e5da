"""Structured Streaming jobs, each with a batch twin in ``operators``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from verbascope.operators.evidence import _word_set, similar_words
from verbascope.operators.jobs import _filled, status_rank

# --------------------------------------------------------------------------
# job steps
# --------------------------------------------------------------------------


def step_state(steps: DataFrame, late: str = "1 day", keep: str = "1 day") -> DataFrame:
    """Most advanced status per (job, step) and span of ``keep``, tolerant of order and repeats.

    The rank only grows, so the running maximum is right whatever the order, and the
    most advanced of a step's spans is the step's state. A span leaves the state once
    the watermark passes its end; what comes later than that is dropped.
    """
    rest = [c for c in steps.columns if c not in ("job_id", "name")]
    best = F.max_by(F.struct(*rest), F.struct(status_rank(), _filled(), -F.col("seq")))
    spans = steps.withWatermark("updated_at", late).groupBy(F.window("updated_at", keep).alias("w"), "job_id", "name")
    return spans.agg(best.alias("b")).select("job_id", "name", F.col("w.start").alias("span"), "b.*")


def upsert_steps(state: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write every changed (job, step) with its batch number. Appending keeps a re-run
    batch harmless and needs no lock."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{target}/_epoch_dir={epoch:08d}")

    return state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_steps(spark, target: str) -> DataFrame:
    """The most advanced version of every (job, step) written by ``upsert_steps``, whichever
    batch or span it came from, so that a state begun anew never takes a step back."""
    d = spark.read.option("basePath", target).parquet(target).drop("_epoch_dir", "_epoch", "span")
    rest = [c for c in d.columns if c not in ("job_id", "name")]
    best = F.max_by(F.struct(*rest), F.struct(status_rank(), _filled(), -F.col("seq")))
    return d.groupBy("job_id", "name").agg(best.alias("b")).select("job_id", "name", "b.*")


# --------------------------------------------------------------------------
# counts and ranges
# --------------------------------------------------------------------------


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling counts, emitted once when the watermark passes the window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def activity_ranges(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Ranges of events less than ``gap`` apart (the session gap is exclusive,
    the batch range merge is inclusive)."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("last_at")).select(
        key, F.col("w.start").alias("start"), "last_at", "n"
    )


# --------------------------------------------------------------------------
# frames
# --------------------------------------------------------------------------


class DistinctFrames(StatefulProcessor):
    """Keeps a file's frame when its text differs from the last kept one.

    A micro-batch's frames are laid down in a map state by time slot as they come, then
    read slot by slot in time order, so neither memory nor the order of arrival inside
    the batch depends on how many there are. Frames older than the last one seen are
    dropped. The state of a file that is idle for longer than ``idle_ms`` expires.
    """

    def __init__(self, threshold: float, idle_ms: int, slot: float = 64.0):
        self.threshold, self.idle_ms, self.slot = threshold, idle_ms, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen double, words string", self.idle_ms)
        self.waiting = handle.getMapState("waiting", "slot bigint", "ts array<double>, text array<string>", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, words = self.last.get() if self.last.exists() else (None, None)
        words = None if words is None else frozenset(words.split("\x1f")) - {""}
        slots = set()
        for some in rows:
            if seen is not None:
                some = some[some["ts"] >= seen]
            for at, part in some.groupby((some["ts"] // self.slot).astype("int64")):
                held = self.waiting.getValue((int(at),)) if at in slots else ([], [])
                self.waiting.updateValue((int(at),), (list(held[0]) + part["ts"].astype(float).tolist(), list(held[1]) + part["text"].tolist()))
                slots.add(int(at))
        for at in sorted(slots):
            ts, texts = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            kept = []
            for k in sorted(range(len(ts)), key=lambda k: ts[k]):
                seen = float(ts[k])
                mine = _word_set(texts[k])
                if words is None or similar_words(words, mine) < self.threshold:
                    words = mine
                    kept.append((key[0], seen, texts[k]))
            if kept:
                yield pd.DataFrame(kept, columns=["file_id", "ts", "text"])
        if seen is not None:
            self.last.update((seen, "\x1f".join(sorted(words or ()))))

    def close(self) -> None:
        pass


def distinct_frames_stream(frames: DataFrame, threshold: float = 0.9, idle: str | int = 24 * 3600 * 1000) -> DataFrame:
    """Frames whose text differs from the file's last kept one; ``idle`` in milliseconds.

    The state has to lie in the RocksDB store (see ``rocks_state``).
    """
    one = frames.select("file_id", "ts", "text").groupBy("file_id")
    return one.transformWithStateInPandas(DistinctFrames(threshold, int(idle)), "file_id bigint, ts double, text string", "append", "ProcessingTime")


@contextmanager
def rocks_state(spark):
    """Keeps the state of queries that start inside in RocksDB, which typed states and their expiry need."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


# --------------------------------------------------------------------------
# correction log, pending transcripts
# --------------------------------------------------------------------------


def correction_log(results: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each correction once, however often it is delivered within the watermark."""
    return results.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def pending_transcripts(submitted: DataFrame, completed: DataFrame, wait: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Submissions with their completion within ``wait``, NULL when it never came.

    ``submitted(file_id, submitted_at)``, ``completed(file_id, completed_at)``.
    """
    s = submitted.withWatermark("submitted_at", late).alias("s")
    c = completed.withWatermark("completed_at", late).alias("c")
    on = (
        (F.col("s.file_id") == F.col("c.file_id"))
        & (F.col("c.completed_at") >= F.col("s.submitted_at"))
        & (F.col("c.completed_at") <= F.col("s.submitted_at") + F.expr(f"INTERVAL {wait}"))
    )
    return s.join(c, on, "leftOuter").select(F.col("s.file_id").alias("file_id"), "submitted_at", "completed_at")


# --------------------------------------------------------------------------
# running a stream to its end
# --------------------------------------------------------------------------


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", one_batch: bool = False) -> None:
    """Process what is available into a file sink (exactly once by checkpoint).

    A stream with processing-time expiry always has another batch to run, for what may
    expire; ``one_batch`` takes what is there in one and stops.
    """
    write = stream.writeStream.format(fmt).outputMode(mode).option("path", target).option("checkpointLocation", checkpoint)
    (write.trigger(once=True) if one_batch else write.trigger(availableNow=True)).start().awaitTermination()
