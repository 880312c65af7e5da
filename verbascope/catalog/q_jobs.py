"""Job, step and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbascope.catalog import derive
from verbascope.catalog.registry import query
from verbascope.operators import jobs as jb
from verbascope.session import scratch_dir
from verbascope.streaming import jobs as st

LATEST = "SELECT * FROM d_jobs ORDER BY created_at DESC, job_id DESC LIMIT"


@query("latest_correction_jobs", "SELECT job_id, status FROM d_jobs WHERE job_type = 'correction' ORDER BY created_at DESC, job_id DESC LIMIT 50")
def _(t):
    return jb.latest_jobs(t.jobs, 50, "correction").select("job_id", "status")


@query("latest_single_job", "SELECT job_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM d_jobs WHERE job_type = 'evaluation' ORDER BY created_at DESC, job_id DESC LIMIT 1")
def _(t):
    return jb.latest_jobs(t.jobs, 1, "evaluation").select("job_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


@query(
    "job_page",
    f"""WITH l AS ({LATEST} 500), f AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS place, count(*) OVER () AS total FROM l WHERE status = 'completed')
SELECT job_id, CAST(place AS INT) AS place, total FROM f WHERE place BETWEEN 21 AND 40""",
)
def _(t):
    return jb.job_page(t.jobs, page=2, status="completed").select("job_id", "place", "total")


@query(
    "job_kpis",
    f"""WITH l AS ({LATEST} 200), d AS (SELECT * FROM l WHERE job_type = 'correction' AND status = 'completed')
SELECT (SELECT count(*) FROM l WHERE job_type = 'correction') AS correction_count, COALESCE(sum(corrections_applied), 0)::BIGINT AS total_applied, COALESCE(sum(corrections_attempted), 0)::BIGINT AS total_attempted,
 round(COALESCE(avg(nullif(avg_confidence, 0)), 0), 3) AS avg_confidence, round(COALESCE(avg(nullif(duration_ms, 0)), 0), 1) AS avg_duration_ms, COALESCE(round(sum(corrections_applied)::DOUBLE / nullif(sum(corrections_attempted), 0), 3), 0)::DOUBLE AS success_rate FROM d""",
)
def _(t):
    return jb.job_kpis(t.jobs)


DAILY = """WITH n AS (SELECT CAST(max(created_at) AS DATE) AS today FROM d_jobs), cal AS (SELECT CAST(today - CAST(i AS INT) AS DATE) AS date FROM n, range(0, 7) r(i)),
 c AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM {src} GROUP BY 1), d AS (SELECT cal.date, upper(strftime(cal.date, '%a')) AS day, COALESCE(c.n, 0) AS count FROM cal LEFT JOIN c USING (date))"""


def _now(t):
    return t.jobs.agg(F.max("created_at").alias("now"))


@query("daily_job_counts", DAILY.format(src="d_jobs") + " SELECT * FROM d")
def _(t):
    return jb.daily_counts(t.jobs, _now(t), last=None)


@query("daily_job_counts_latest", DAILY.format(src=f"({LATEST} 500)") + " SELECT * FROM d")
def _(t):
    return jb.daily_counts(t.jobs, _now(t))


@query("daily_bar_heights", DAILY.format(src="d_jobs") + " SELECT date, count, greatest(2, CAST(round(count * 100.0 / (SELECT max(count) FROM d)) AS INT)) AS height_pct FROM d")
def _(t):
    return jb.bar_heights(jb.daily_counts(t.jobs, _now(t), last=None)).select("date", "count", "height_pct")


RANK = "CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 WHEN 'skipped' THEN 2 WHEN 'failed' THEN 3 ELSE 4 END"
DEDUP = f"""dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, name ORDER BY {RANK} DESC, (CASE WHEN duration_ms IS NULL THEN 0 ELSE 1 END + CASE WHEN details IS NULL THEN 0 ELSE 1 END) DESC, seq) AS rn FROM d_steps) WHERE rn = 1)"""
ORDER_SQL = "CASE name WHEN 'vocab_merge' THEN 2 WHEN 'candidate_detection' THEN 3 WHEN 'ocr_extraction' THEN 7 WHEN 'ml_inference' THEN 13 WHEN 'complete' THEN 16 ELSE 1000 END"
OWN = "CASE WHEN name IN ('ml_inference', 'complete') THEN 0 ELSE COALESCE(duration_ms, 0) END"


@query("deduped_steps", f"WITH {DEDUP} SELECT job_id, name, seq, status, duration_ms, details FROM dd")
def _(t):
    return jb.dedupe_steps(t.steps).select("job_id", "name", "seq", "status", "duration_ms", "details")


@query("canonical_steps", f"WITH {DEDUP} SELECT job_id, name, CAST(row_number() OVER (PARTITION BY job_id ORDER BY {ORDER_SQL}, seq) AS INT) AS place FROM dd")
def _(t):
    return jb.canonical_steps(t.steps).select("job_id", "name", "place")


@query(
    "step_time_shares",
    f"""WITH {DEDUP}, x AS (SELECT job_id, sum({OWN}) AS total_ms, greatest(max({OWN}), 1) AS max_ms FROM dd GROUP BY job_id)
SELECT d.job_id, d.name, round(x.total_ms, 4) AS total_ms, round(x.max_ms, 4)::DOUBLE AS max_ms, CASE WHEN name IN ('ml_inference', 'complete') THEN NULL ELSE COALESCE(round(duration_ms / nullif(x.total_ms, 0) * 100, 1), 0) END AS share_pct,
 CAST(row_number() OVER (PARTITION BY d.job_id ORDER BY COALESCE(duration_ms, 0) DESC, seq) AS INT) AS rank FROM dd d JOIN x ON x.job_id = d.job_id""",
)
def _(t):
    return jb.step_shares(t.steps).select("job_id", "name", F.round("total_ms", 4).alias("total_ms"), F.round("max_ms", 4).alias("max_ms"), "share_pct", "rank")


@query(
    "job_status_rollup",
    f"""WITH {DEDUP} SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'pending' END AS status,
 count(*) AS n_steps, round(sum({OWN}), 4) AS total_ms, count(*) FILTER (status = 'completed') AS n_completed FROM dd GROUP BY job_id""",
)
def _(t):
    return jb.job_status(t.steps).withColumn("total_ms", F.round("total_ms", 4))


@query(
    "job_life_cycle",
    """SELECT job_id, job_type, file_id, CASE WHEN status = 'running' THEN 'running' ELSE status END AS status, CASE WHEN status = 'running' THEN NULL ELSE duration_ms END AS duration_ms, CASE WHEN status = 'failed' THEN 'broken' END AS error FROM d_jobs""",
)
def _(t):
    ev = lambda e, at, *f: F.struct(F.lit(e).alias("event") if isinstance(e, str) else e.alias("event"), F.col(at).alias("at"), *f)
    none = lambda ty: F.lit(None).cast(ty)
    created = ev("created", "created_at", F.col("job_type"), F.col("file_id"), none("double").alias("duration_ms"), none("string").alias("error"))
    ended = ev(F.col("status"), "completed_at", none("string").alias("job_type"), none("string").alias("file_id"), F.col("duration_ms"), F.when(F.col("status") == "failed", "broken").alias("error"))
    events = t.jobs.select("job_id", F.inline(F.when(F.col("status") == "running", F.array(created)).otherwise(F.array(created, ended))))
    return jb.fold_jobs(events).select("job_id", "job_type", "file_id", "status", "duration_ms", "error")


@query(
    "latest_correction_per_file",
    """SELECT file_id, job_id, corrections_applied FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, job_id DESC) AS r FROM d_jobs) WHERE r = 1""",
)
def _(t):
    return jb.latest_correction(t.jobs).select("file_id", "job_id", "corrections_applied")


@query("latest_corrections", "SELECT job_id, file_id, corrections_applied FROM d_jobs WHERE status = 'completed' ORDER BY created_at DESC, job_id DESC LIMIT 50")
def _(t):
    return jb.latest_rows(t.jobs.where("status = 'completed'"), 50, tie="job_id").select("job_id", "file_id", "corrections_applied")


@query("applied_stats", "SELECT file_id, count(*) FILTER (status = 'completed') AS applied, count(*) FILTER (status <> 'completed') AS skipped, count(*) AS total FROM d_jobs GROUP BY file_id")
def _(t):
    return jb.applied_stats(t.jobs.select("file_id", (F.col("status") == "completed").alias("applied")))


@query(
    "cached_screen_text_upsert",
    """WITH u AS (SELECT file_id, duration_ms, created_at FROM d_jobs) SELECT file_id, max_by(duration_ms, created_at) AS duration_ms FROM u GROUP BY file_id""",
)
def _(t):
    c = t.jobs.select("file_id", "duration_ms", "created_at")
    cut = F.dayofmonth("created_at") <= 15
    return jb.upsert_latest(c.where(cut), c.where(~cut)).select("file_id", "duration_ms")


@query(
    "evidence_counts",
    """WITH f AS (SELECT DISTINCT file_id FROM d_segments) SELECT f.file_id, (SELECT count(*) FROM d_flagged x WHERE x.file_id = f.file_id) AS flagged, (SELECT count(*) FROM d_ranges x WHERE x.file_id = f.file_id) AS ranges,
 (SELECT count(*) FROM d_frames x WHERE x.file_id = f.file_id) AS frames FROM f""",
)
def _(t):
    return jb.evidence_counts(t.segments, flagged=t.flagged, ranges=t.ranges, frames=t.frames)


# --------------------------------------------------------------------------
# streaming, run to the end over the event table
# --------------------------------------------------------------------------


def _stream_of(t, name):
    """A table as a stream: one file or a folder of files, as it is read in batch.
    A stream takes a plain path for a folder, a pattern for whatever it matches."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def _event_stream(t):
    return _stream_of(t, "events")


def _places(t, name):
    root = scratch_dir(t.spark, name)
    return f"{root}/out", f"{root}/checkpoint"


@query("stream_step_state", f"WITH {DEDUP} SELECT job_id, name, seq, status FROM dd")
def _(t):
    out, chk = _places(t, "steps")
    st.upsert_steps(st.step_state(derive.step_columns(_event_stream(t))), out, chk).awaitTermination()
    return st.current_steps(t.spark, out).select("job_id", "name", "seq", "status")


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM events) GROUP BY ALL")
def _(t):
    """Windows the watermark has closed; the last days are still open."""
    out, chk = _places(t, "daily")
    s = _event_stream(t).withColumn("at", F.col("ts").cast("timestamp"))
    counts = st.windowed_counts(s, "at", ["event_type"])
    st.drain(counts, out, chk)
    return t.spark.read.schema(counts.schema).parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "stream_activity_ranges",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS o FROM events),
 s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def _(t):
    out, chk = _places(t, "ranges")
    s = _event_stream(t).withColumn("at", F.col("ts").cast("timestamp"))
    r = st.activity_ranges(s, "at", "user_id")
    st.drain(r, out, chk)
    return t.spark.read.schema(r.schema).parquet(out).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stream_correction_log", "SELECT event_id, event_type FROM events")
def _(t):
    """The event table delivered twice is written once."""
    out, chk = _places(t, "log")
    s = _event_stream(t).withColumn("at", F.col("ts").cast("timestamp"))
    twice = s.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2)))).select("event_id", "event_type", "at")
    log = st.correction_log(twice, "event_id", "at")
    st.drain(log, out, chk, fmt="json")
    return t.spark.read.schema("event_id bigint, event_type string").json(out)


@query(
    "stream_pending_transcripts",
    """WITH mark AS (SELECT least(max(ts) - INTERVAL 1 HOUR, max(ts) FILTER (WHERE event_type = 'click') - INTERVAL 55 MINUTES) AS at FROM events WHERE event_type IN ('click', 'signup'))
SELECT event_type = 'click' AS done, count(*) AS n FROM events, mark WHERE event_type = 'click' OR event_type = 'signup' AND ts + INTERVAL 1 HOUR < mark.at GROUP BY 1""",
)
def _(t):
    out, chk = _places(t, "pending")
    s = _event_stream(t).withColumn("at", F.col("ts").cast("timestamp"))
    sub = s.where("event_type IN ('click', 'signup')").select(F.col("event_id").alias("file_id"), F.col("at").alias("submitted_at"))
    done = _event_stream(t).withColumn("at", F.col("ts").cast("timestamp")).where("event_type = 'click'").select(F.col("event_id").alias("file_id"), (F.col("at") + F.expr("INTERVAL 5 minutes")).alias("completed_at"))
    j = st.pending_transcripts(sub, done)
    st.drain(j, out, chk)
    return t.spark.read.schema(j.schema).parquet(out).groupBy(F.col("completed_at").isNotNull().alias("done")).agg(F.count("*").alias("n"))


@query(
    "stream_distinct_frames",
    r"""WITH RECURSIVE f AS (SELECT file_id, ts, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))) AS w, row_number() OVER (PARTITION BY file_id ORDER BY ts) AS i FROM d_frames),
 r AS (SELECT file_id, i, ts, w AS kept, true AS keep FROM f WHERE i = 1
  UNION ALL SELECT f.file_id, f.i, f.ts, CASE WHEN j < 0.9 THEN f.w ELSE kept END, j < 0.9 FROM (
   SELECT f.*, r.kept, CASE WHEN len(f.w) = 0 AND len(r.kept) = 0 THEN 1.0 WHEN len(f.w) = 0 OR len(r.kept) = 0 THEN 0.0 ELSE len(list_intersect(f.w, r.kept))::DOUBLE / len(list_distinct(list_concat(f.w, r.kept))) END AS j
   FROM f JOIN r ON f.file_id = r.file_id AND f.i = r.i + 1) f)
SELECT file_id, ts FROM r WHERE keep""",
)
def _(t):
    out, chk = _places(t, "frames")
    pages = _stream_of(t, "pages")

    class Source:
        pass

    src = Source()
    src.pages = pages
    kept = st.distinct_frames_stream(derive.frames(src))
    with st.rocks_state(t.spark):
        st.drain(kept, out, chk, one_batch=True)
    return t.spark.read.schema(kept.schema).parquet(out).select("file_id", "ts")
