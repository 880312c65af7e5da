"""Sources and sinks: the given tables written in each format and read back, broken documents included."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbascope.catalog.registry import query
from verbascope.functions.text import typed_cell
from verbascope.operators import jobs as jb
from verbascope.operators import training as tr
from verbascope.session import scratch_dir
from verbascope.sources import transcripts as so

BROKEN = "file_id % 10 = 3"


@query(
    "transcript_files",
    f"""WITH d AS (SELECT file_id, string_agg(text, ' ' ORDER BY segment_id, text) AS text, count(*) AS n, sum(length(text))::BIGINT AS chars, max(end_s) AS last_s FROM d_segments GROUP BY file_id)
SELECT CAST(file_id AS VARCHAR) AS file_id, md5(text) AS text_md5, n AS n_segments, chars AS segment_chars, round(last_s, 6) AS last_s FROM d WHERE NOT {BROKEN}
UNION ALL SELECT 'broken', md5(''), 0, 0, NULL FROM d WHERE {BROKEN}""",
)
def _(t):
    """One JSON document a file; a document cut off in the middle is a transcript without a text, named by its file."""
    seg = F.struct(F.col("segment_id").alias("id"), "text", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "speaker")
    docs = t.segments.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "text", seg.alias("s")))).alias("s"))
    docs = docs.select("file_id", F.to_json(F.struct(F.col("file_id").cast("string").alias("file_id"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.transform("s", lambda x: x["s"]).alias("segments"))).alias("value"))
    path = scratch_dir(t.spark, "transcripts")
    broken = F.substr("value", F.lit(1), F.length("value") - 2)
    docs.select(F.when(F.expr(BROKEN), broken).otherwise(F.col("value")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    got = so.read_transcripts(t.spark, path, suffix=".txt")
    known = F.col("file_id").rlike("^[0-9]+$")
    segments = F.coalesce("segments", F.array().cast(got.schema["segments"].dataType))
    chars = F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    return got.select(
        F.when(known, F.col("file_id")).otherwise("broken").alias("file_id"), F.md5("text").alias("text_md5"), F.size(segments).cast("long").alias("n_segments"),
        chars.alias("segment_chars"), F.round(F.array_max(F.transform(segments, lambda s: s["end"])), 6).alias("last_s"),
    )


@query(
    "examples_jsonl",
    """SELECT term, category, error_found, is_negative, applied, count(*) AS n, false AS broken FROM d_examples GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*), true FROM d_examples WHERE example_id % 50 = 7""",
)
def _(t):
    """Examples as JSON lines, with blank lines and cut-off lines between them: the former are skipped, the latter kept apart."""
    e = t.examples
    meta = F.struct("source", "term", "category", "error_found", "applied", "is_negative")
    lines = e.select(F.array(F.struct(F.lit("user").alias("role"), F.col("error_found").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("term").alias("content"))).alias("messages"), meta.alias("metadata"))
    path = scratch_dir(t.spark, "examples")
    so.write_jsonl(lines, f"{path}/whole")
    cut = e.where("example_id % 50 = 7").select(F.concat(F.lit('{"messages": [{"role": "user", "content": "'), "term").alias("value"))
    cut.withColumn("value", F.explode(F.array(F.col("value"), F.lit("")))).write.text(f"{path}/cut")
    got = so.read_examples(t.spark, [f"{path}/whole", f"{path}/cut"])
    m = F.col("metadata")
    out = got.select(m["term"].alias("term"), m["category"].alias("category"), m["error_found"].alias("error_found"), m["is_negative"].alias("is_negative"), m["applied"].alias("applied"), F.col("_raw").isNotNull().alias("broken"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("vocabulary_json", "SELECT term, term_key, category, array_to_string(known_errors, '|') AS known_errors, CAST(row_number() OVER (PARTITION BY category ORDER BY pos) - 1 AS INT) AS pos FROM d_vocab")
def _(t):
    """A vocabulary document for each category, in turn with and without the outer object."""
    one = F.array_sort(F.collect_list(F.struct("pos", "term", "category", "known_errors")))
    docs = t.vocab.groupBy("category").agg(F.transform(one, lambda x: F.struct(x["term"].alias("term"), x["category"].alias("category"), x["known_errors"].alias("known_errors"))).alias("terms"))
    boxed, bare = F.to_json(F.struct("terms")), F.to_json("terms")
    path = scratch_dir(t.spark, "vocabulary")
    docs.select(F.when(F.length("category") % 2 == 0, boxed).otherwise(bare).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return so.read_vocab(t.spark, path).select("term", "term_key", "category", F.array_join("known_errors", "|").alias("known_errors"), "pos")


@query(
    "result_files",
    """SELECT 'file' AS kind, CAST(doc_id AS VARCHAR) AS name, md5(coalesce(text, '')) AS text_md5, CAST(n_chars AS DOUBLE) AS value FROM documents
UNION ALL SELECT 'group', source, md5(lang), count(*)::DOUBLE FROM documents GROUP BY source, lang
UNION ALL SELECT 'summary', 'all', md5(''), sum(n_chars)::DOUBLE FROM documents""",
)
def _(t):
    """Whole texts, with their quotes and line feeds, through the CSV and JSON sinks and back."""
    d = t.documents
    path = scratch_dir(t.spark, "results")
    per_file = d.select(F.col("doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").alias("value"))
    per_group = d.groupBy(F.col("source").alias("name"), F.col("lang").alias("text")).agg(F.count("*").alias("value"))
    total = d.agg(F.struct(F.sum("n_chars").alias("chars")).alias("totals"))
    so.write_results(per_file, per_group, total, path)
    row = lambda kind, df: df.select(F.lit(kind).alias("kind"), "name", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), typed_cell("value")["d"].alias("value"))
    whole = t.spark.read.schema("totals struct<chars: bigint>").json(f"{path}/summary").select(F.lit("summary").alias("kind"), F.lit("all").alias("name"), F.md5(F.lit("")).alias("text_md5"), F.col("totals.chars").cast("double").alias("value"))
    return row("file", so.read_metadata_csv(t.spark, f"{path}/per_file")).unionByName(row("group", so.read_metadata_csv(t.spark, f"{path}/per_group"))).unionByName(whole)


@query(
    "job_step_detail",
    """WITH n AS (SELECT job_id FROM d_steps GROUP BY job_id ORDER BY count(DISTINCT name) DESC, job_id LIMIT 1),
 dd AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.job_id, name ORDER BY CASE status WHEN 'completed' THEN 4 WHEN 'failed' THEN 3 WHEN 'skipped' THEN 3 WHEN 'running' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END DESC) AS rn FROM d_steps s JOIN n USING (job_id)) WHERE rn = 1)
SELECT job_id, name FROM dd""",
)
def _(t):
    """The steps, in their canonical order, of the job that has most kinds of them."""
    kinds = t.steps.where("name <> ''").groupBy("job_id").agg(F.count_distinct("name").alias("n"))
    first = kinds.orderBy(F.desc("n"), "job_id").first()
    jobs = t.steps.groupBy("job_id").agg(F.lit("correction").alias("job_type"), F.lit("running").alias("status"), F.min("updated_at").alias("created_at"))
    return jb.job_detail(jobs, t.steps, first.job_id).select("job_id", "name")


@query(
    "browse_example_fields",
    """SELECT example_key, source, category, term, error_found, applied, is_negative, is_hard_negative FROM d_examples WHERE is_negative ORDER BY example_id, seq LIMIT 20 OFFSET 20""",
)
def _(t):
    """A page of one kind of example, with all fields a browser shows."""
    kind = t.examples.where("is_negative")
    return tr.browse(kind, F.struct("example_id", "seq"), page=2).select("example_key", "source", "category", "term", "error_found", "applied", "is_negative", "is_hard_negative")


@query(
    "filtered_corrections",
    "SELECT example_key, term, error_found FROM d_examples WHERE NOT applied AND contains(lower(term || ' ' || error_found || ' ' || category), 'tech')",
)
def _(t):
    return jb.filtered_corrections(t.examples, "skipped", "TECH").select("example_key", "term", "error_found")
