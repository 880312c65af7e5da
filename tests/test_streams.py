"""Streams whose state must leave: late, repeated and out-of-order rows, and expiry."""

import datetime as dt
import random
import time

import pytest

from verbascope import catalog
from verbascope.functions.text import F
from verbascope.operators import jobs as jb
from verbascope.operators.evidence import _word_set, similar_words
from verbascope.streaming import jobs as st

STEPS = "job_id string, seq long, name string, status string, duration_ms double, details string, updated_at timestamp"


def rows_of(spark, table):
    return sorted(tuple(r) for r in table.select("job_id", "name", "seq", "status").collect())


def test_step_state_leaves_after_its_span(spark, tmp_path):
    rng, start = random.Random(1), dt.datetime(2024, 1, 1)
    names, states = ["ocr_extraction", "ml_inference"], ["pending", "running", "completed", "failed"]
    events = [(f"j{k % 9}", k, rng.choice(names), rng.choice(states), None, None, start + dt.timedelta(hours=rng.randint(0, 100))) for k in range(300)]
    rng.shuffle(events)
    src = f"{tmp_path}/in"
    for k in range(0, 300, 100):
        spark.createDataFrame([*events[k : k + 100], *events[k : k + 5]], STEPS).coalesce(1).write.mode("append").parquet(src)
    far = [("last", 999, "ocr_extraction", "running", None, None, start + dt.timedelta(days=30))]
    late = [("j1", 1000, "ocr_extraction", "pending", None, None, start)]  # far behind: dropped, and no step goes back
    stream = spark.readStream.schema(STEPS).parquet(src)
    run = lambda: st.upsert_steps(st.step_state(stream, late="10 days"), f"{tmp_path}/out", f"{tmp_path}/chk")
    run().awaitTermination()
    spark.createDataFrame(far, STEPS).write.mode("append").parquet(src)
    run().awaitTermination()
    spark.createDataFrame(late, STEPS).write.mode("append").parquet(src)
    last = run()
    last.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in last.recentProgress if p["stateOperators"]][-1] == 1  # that of the last event alone
    want = jb.dedupe_steps(spark.createDataFrame([*events, *far], STEPS))
    assert rows_of(spark, st.current_steps(spark, f"{tmp_path}/out")) == rows_of(spark, want)


def fold(frames, threshold=0.9):
    """Kept (file, ts) of batches one after another, each in time order; frames behind the last one seen are late."""
    seen, words, kept = {}, {}, []
    for batch in frames:
        now = dict(seen)
        for f, ts, text in sorted(batch, key=lambda r: r[1]):
            if ts < now.get(f, ts):
                continue
            seen[f], mine = ts, _word_set(text)
            if f not in words or similar_words(words[f], mine) < threshold:
                words[f] = mine
                kept.append((f, ts))
    return sorted(kept)


def test_frames_of_many_batches_late_ones_and_expiry(spark, tmp_path):
    rng = random.Random(2)
    first = [(f, float(t), rng.choice(["a b c", "a b d", "", "x y z"])) for f in (1, 2) for t in range(0, 400, 3)]
    rng.shuffle(first)
    late = [(1, 5.0, "late words"), (1, 500.0, "new words"), (2, 2.0, "late too"), (3, 1.0, "other file")]
    schema, src = "file_id long, ts double, text string", f"{tmp_path}/in"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(src)

    def run(name, rows, idle):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        st.drain(st.distinct_frames_stream(stream, idle=idle), f"{tmp_path}/{name}", f"{tmp_path}/{name}-chk", one_batch=True)
        return sorted((r.file_id, r.ts) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "20")
    try:
        with st.rocks_state(spark):
            assert run("out", first, 3_600_000) == fold([first])
            assert run("out", late, 3_600_000) == fold([first, late])
            run("short", [], 1)
            time.sleep(0.1)
            spark.createDataFrame([(1, 5.0, "late words")], schema).write.mode("append").parquet(src)
            st.drain(st.distinct_frames_stream(stream, idle=1), f"{tmp_path}/short", f"{tmp_path}/short-chk", one_batch=True)
            assert (1, 5.0, "late words") in {tuple(r) for r in spark.read.parquet(f"{tmp_path}/short").select("file_id", F.col("ts"), "text").collect()}
    finally:
        spark.conf.unset(size)


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_a_table_of_one_or_many_files(spark, tmp_path, parts):
    sf, queries = "/root/testdata/sf0.001", catalog.load().QUERIES
    for name in ("pages", "events"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        if parts == 1:
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
        else:
            table.repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    for stream, batch in (("stream_distinct_frames", "distinct_frames"), ("stream_step_state", "deduped_steps")):
        got, want = queries[stream](spark, str(tmp_path)), queries[batch](spark, sf)
        both = [c for c in got.columns if c in want.columns]
        assert sorted(map(repr, got.select(both).collect())) == sorted(map(repr, want.select(both).collect())) != []
