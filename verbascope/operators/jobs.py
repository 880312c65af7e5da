"""Job and step statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbascope.functions.text import matches_search, pct

# How far a status has come, and the canonical order of the steps.
STATUS_RANK = {"pending": 0, "running": 1, "skipped": 2, "failed": 3, "completed": 4}
STEP_ORDER = (
    "request_received", "model_load", "vocab_merge", "candidate_detection", "topic_classification",
    "web_vocab_enrichment", "candidate_validation", "ocr_extraction", "ocr_vocab_extraction", "whisper_pass2",
    "avsr_extraction", "avsr_pass2", "llm_reconciliation", "ml_inference", "data_collection",
    "apply_corrections", "complete",
)
# Steps whose duration is the sum of others.
UMBRELLA_STEPS = ("ml_inference", "complete")


def status_rank(col: str = "status") -> Column:
    m = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.col(col)), F.lit(0))


def latest_jobs(jobs: DataFrame, n: int, job_type: str | None = None) -> DataFrame:
    """The newest ``n`` jobs (a bounded top-k, ties by id)."""
    j = jobs if job_type is None else jobs.where(F.col("job_type") == job_type)
    return j.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def latest_rows(df: DataFrame, n: int, order: str = "created_at", tie: str = "file_id") -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).limit(n)


def job_page(jobs: DataFrame, page: int = 1, limit: int = 20, job_type: str | None = None, status: str | None = None, window: int = 500) -> DataFrame:
    """One page of the newest jobs; the status filter comes after the window cut,
    and ``total`` counts only what is left inside it."""
    j = latest_jobs(jobs, window, job_type)
    if status is not None:
        j = j.where(F.col("status") == status)
    w = Window.orderBy(F.desc("created_at"), F.desc("job_id"))  # at most ``window`` rows
    numbered = j.withColumn("place", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))
    return numbered.where((F.col("place") > (page - 1) * limit) & (F.col("place") <= page * limit))


def job_kpis(jobs: DataFrame, last: int = 200) -> DataFrame:
    """Correction KPIs over the latest jobs; zero and missing values do not count
    in the averages."""
    done = (F.col("job_type") == "correction") & (F.col("status") == "completed")
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    mean = lambda c: F.coalesce(F.avg(F.when(done, F.nullif(F.col(c), F.lit(0.0)))), F.lit(0.0))
    agg = latest_jobs(jobs, last).agg(
        F.count_if(F.col("job_type") == "correction").alias("correction_count"),
        total("corrections_applied").alias("total_applied"), total("corrections_attempted").alias("total_attempted"),
        F.round(mean("avg_confidence"), 3).alias("avg_confidence"), F.round(mean("duration_ms"), 1).alias("avg_duration_ms"),
    )
    rate = F.coalesce(F.round(F.col("total_applied") / F.nullif("total_attempted", F.lit(0)), 3), F.lit(0.0))
    return agg.withColumn("success_rate", rate)


def daily_counts(jobs: DataFrame, now: DataFrame, days: int = 7, last: int | None = 500) -> DataFrame:
    """Zero-filled counts of the last days.

    ``now(now)`` is a one-row frame. ``last`` keeps the reference point of view
    (only the newest jobs are counted); None counts all.
    """
    src = jobs if last is None else latest_jobs(jobs, last)
    counts = src.groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("count"))
    today = F.to_date("now")
    cal = now.select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("date"))
    return cal.join(counts, "date", "left").select(
        "date", F.upper(F.date_format("date", "EEE")).alias("day"), F.coalesce("count", F.lit(0)).alias("count")
    )


def bar_heights(daily: DataFrame) -> DataFrame:
    """Counts as a percentage of the peak day, at least 2 (a calendar, so few rows)."""
    peak = F.greatest(F.max("count").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return daily.withColumn("height_pct", F.greatest(F.lit(2), F.round(F.col("count") * 100 / peak).cast("int")))


def _filled() -> Column:
    has = lambda c: F.when(c, 1).otherwise(0)
    return has(F.col("duration_ms").isNotNull()) + has(F.coalesce(F.length("details"), F.lit(0)) > 0)


def dedupe_steps(steps: DataFrame) -> DataFrame:
    """One row per (job, step name): most advanced, then most filled, then first.

    An ordered aggregate instead of a window, so map-side combining removes the
    duplicates of a busy job before the shuffle.
    """
    best = F.max_by(F.struct(*[c for c in steps.columns if c not in ("job_id", "name")]), F.struct(status_rank(), _filled(), -F.col("seq")))
    return steps.where("name IS NOT NULL AND name <> ''").groupBy("job_id", "name").agg(best.alias("b")).select("job_id", "name", "b.*")


def step_position(col: str = "name") -> Column:
    p = F.array_position(F.array(*[F.lit(s) for s in STEP_ORDER]), F.col(col)).cast("int")
    return F.when(p > 0, p - 1).otherwise(F.lit(1000))


def canonical_steps(steps: DataFrame) -> DataFrame:
    """De-duplicated steps numbered in canonical order, unknown names last."""
    d = dedupe_steps(steps).withColumn("order_key", step_position())
    return d.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("order_key", "seq")).cast("int"))


def _own_time() -> Column:
    return F.when(F.col("name").isin(*UMBRELLA_STEPS), F.lit(0.0)).otherwise(F.coalesce("duration_ms", F.lit(0.0)))


def step_shares(steps: DataFrame) -> DataFrame:
    """Time share and rank of every de-duplicated step of a job."""
    d = dedupe_steps(steps).withColumn("_own", _own_time())
    totals = d.groupBy("job_id").agg(F.sum("_own").alias("total_ms"), F.greatest(F.max("_own"), F.lit(1.0)).alias("max_ms"))
    j = d.join(totals, "job_id")
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(F.coalesce("duration_ms", F.lit(0.0))), "seq"))
    return j.select(
        "job_id", "name", "duration_ms", "total_ms", "max_ms",
        F.when(F.col("name").isin(*UMBRELLA_STEPS), F.lit(None)).otherwise(pct("duration_ms", "total_ms", 1)).alias("share_pct"), rank.cast("int").alias("rank"),
    )


def job_status(steps: DataFrame) -> DataFrame:
    """Status of a job from its de-duplicated steps."""
    d = dedupe_steps(steps)
    some = lambda s: F.bool_or(F.col("status") == s)
    return d.groupBy("job_id").agg(
        F.when(some("failed"), "failed").when(some("running"), "running").when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("pending").alias("status"),
        F.count("*").alias("n_steps"), F.sum(_own_time()).alias("total_ms"), F.count_if(F.col("status") == "completed").alias("n_completed"),
    )


def fold_jobs(events: DataFrame) -> DataFrame:
    """Life-cycle events to one row per job.

    ``events(job_id, event, at, job_type, file_id, duration_ms, error)`` with the
    events created / completed / failed; the latest end event decides.
    """
    end = F.col("event").isin("completed", "failed")
    return events.groupBy("job_id").agg(
        F.min_by(F.when(F.col("event") == "created", F.col("job_type")), F.when(F.col("event") == "created", F.col("at"))).alias("job_type"),
        F.min_by(F.when(F.col("event") == "created", F.col("file_id")), F.when(F.col("event") == "created", F.col("at"))).alias("file_id"),
        F.min(F.when(F.col("event") == "created", F.col("at"))).alias("created_at"),
        F.max(F.when(end, F.col("at"))).alias("completed_at"),
        F.coalesce(F.max_by(F.when(end, F.col("event")), F.when(end, F.col("at"))), F.lit("running")).alias("status"),
        F.max_by(F.when(end, F.col("duration_ms")), F.when(end, F.col("at"))).alias("duration_ms"),
        F.max_by(F.when(end, F.col("error")), F.when(end, F.col("at"))).alias("error"),
    )


def job_detail(jobs: DataFrame, steps: DataFrame, job_id: str) -> DataFrame:
    """One job with its canonical steps, times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    j = jobs.where(F.col("job_id") == job_id).select("job_id", "job_type", F.col("status").alias("job_status"), iso("created_at").alias("created_at"))
    s = canonical_steps(steps.where(F.col("job_id") == job_id)).select("job_id", "place", "name", "status", "duration_ms", iso("updated_at").alias("updated_at"))
    return j.join(s, "job_id", "left")


def latest_correction(corrections: DataFrame) -> DataFrame:
    """Newest stored correction of every file (map-side combined); equal times go by job, then by hash."""
    rest = [c for c in corrections.columns if c != "file_id"]
    return corrections.groupBy("file_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", *(["job_id"] if "job_id" in rest else []), F.xxhash64(*rest))).alias("x")).select("file_id", "x.*")


def correction_report(swaps: DataFrame, attempted: DataFrame) -> DataFrame:
    """Attempted and applied per file with the applied swaps as one text list."""
    s = swaps.groupBy("file_id").agg(
        F.count("*").alias("applied"), F.round(F.avg("swap_confidence"), 3).alias("avg_confidence"),
        F.array_sort(F.collect_list(F.struct("segment_id", "k", F.concat_ws(" → ", "old_word", "new_word").alias("t")))).alias("r"),
    )
    j = attempted.join(s, "file_id", "left")
    return j.select(
        "file_id", "attempted", F.coalesce("applied", F.lit(0)).alias("applied"), "avg_confidence",
        F.coalesce(F.transform("r", lambda x: x["t"]), F.array().cast("array<string>")).alias("results"),
    )


def evidence_counts(files: DataFrame, **sources: DataFrame) -> DataFrame:
    """Rows per file of every evidence table, 0 where there are none."""
    out = files.select("file_id").distinct()
    for name, df in sources.items():
        out = out.join(df.groupBy("file_id").agg(F.count("*").alias(name)), "file_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def filtered_corrections(corrections: DataFrame, shown: str = "all", search: str = "") -> DataFrame:
    """Corrections a viewer asked for: ``all``, ``applied`` or ``skipped`` ones whose term, error or category holds the text."""
    c = corrections
    if shown != "all":
        c = c.where(F.coalesce("applied", F.lit(False)) == F.lit(shown == "applied"))
    if search:
        c = c.where(matches_search(search, F.coalesce("term", F.lit("")), F.coalesce("error_found", F.lit("")), F.coalesce("category", F.lit(""))))
    return c


def applied_stats(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("file_id").agg(
        F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"), F.count("*").alias("total")
    )


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Keyed upsert: the row with the newest ``created_at`` per key, of equal ones that of the larger hash."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("created_at", F.xxhash64(*rest))).alias("x")).select(key, "x.*")
