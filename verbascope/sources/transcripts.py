"""JSON sources and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope import schemas

# File-name endings of a corpus folder; pass others to fit another layout.
TRUTH_SUFFIX = "_ground_truth.txt"
TRANSCRIPT_SUFFIX = "_transcript.json"
PLAIN_SUFFIX = "_asr.txt"
# A quote inside a cell is doubled, and blanks at a cell's ends are its own.
CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "lineSep": "\n"}


def read_transcripts(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """One row per transcript file; the id is the file name without the suffix
    unless the document carries one."""
    d = spark.read.schema(schemas.TRANSCRIPT_JSON).option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(path)
    name = F.replace(F.col("_metadata.file_name"), F.lit(suffix), F.lit(""))
    return d.withColumn("file_id", F.coalesce(F.nullif("file_id", F.lit("")), name)).withColumn("text", F.coalesce("text", F.lit("")))


def read_eval_pairs(spark: SparkSession, root: str, dataset: str, truth: str = TRUTH_SUFFIX, transcript: str = TRANSCRIPT_SUFFIX) -> DataFrame:
    """Ground truth joined with its transcript; files without a partner are skipped."""
    t = spark.read.option("pathGlobFilter", f"*{truth}").text(root, wholetext=True).select(
        F.replace(F.col("_metadata.file_name"), F.lit(truth), F.lit("")).alias("file_id"), F.col("value").alias("gt_text")
    )
    j = spark.read.schema(schemas.TRANSCRIPT_JSON).option("multiLine", True).option("pathGlobFilter", f"*{transcript}").json(root).select(
        F.replace(F.col("_metadata.file_name"), F.lit(transcript), F.lit("")).alias("file_id"), F.coalesce("text", F.lit("")).alias("sa_text")
    )
    return t.join(j, "file_id").select(F.lit(dataset).alias("dataset"), "file_id", "gt_text", "sa_text")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary JSON, either ``{"terms": [...]}`` or a bare array of terms."""
    d = spark.read.text(path, wholetext=True)
    item = "array<struct<term:string,category:string,known_errors:array<string>>>"
    boxed = F.from_json("value", schemas.VOCAB_JSON)["terms"]
    bare = F.from_json(F.concat(F.lit('{"terms":'), "value", F.lit("}")), schemas.VOCAB_JSON)["terms"]
    terms = F.coalesce(boxed, bare).cast(item)
    rows = d.select(F.posexplode(terms).alias("pos", "t"))
    return rows.select(
        "t.term", F.lower("t.term").alias("term_key"), F.coalesce("t.category", F.lit("unknown")).alias("category"),
        F.coalesce("t.known_errors", F.array().cast("array<string>")).alias("known_errors"), "pos",
    )


def read_examples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSONL examples; blank lines are skipped, malformed ones kept in ``_raw``."""
    return (
        spark.read.schema(schemas.EXAMPLE_JSON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").json(path)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines, one file per partition."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_results(per_file: DataFrame, per_group: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-file CSV, per-group CSV and the nested summary as JSON; ``read_metadata_csv`` reads the CSV back."""
    per_file.write.mode("overwrite").options(header=True, **CSV).csv(f"{path}/per_file")
    per_group.write.mode("overwrite").options(header=True, **CSV).csv(f"{path}/per_group")
    summary.write.mode("overwrite").json(f"{path}/summary")


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; ``functions.text.typed_cell`` types them one by one. Cells may hold line feeds."""
    return spark.read.options(header=True, multiLine=True, **CSV).csv(path)


def manifest(spark: SparkSession, root: str, curated: DataFrame, truth: str = TRUTH_SUFFIX, transcript: str = TRANSCRIPT_SUFFIX, plain: str = PLAIN_SUFFIX) -> DataFrame:
    """Files that have ground truth, transcript JSON and plain text, with curated
    attributes (``unknown`` by default). Sizes come from the two text files."""
    texts = spark.read.option("pathGlobFilter", f"*{{{truth},{plain}}}").text(root, wholetext=True).select(
        F.col("_metadata.file_name").alias("n"), F.col("_metadata.file_path").alias("p"), F.length("value").alias("chars")
    )
    docs = spark.read.format("binaryFile").option("pathGlobFilter", f"*{transcript}").load(root).select(
        F.element_at(F.split("path", "/"), -1).alias("n"), F.col("path").alias("p"), F.lit(None).cast("int").alias("chars")
    )
    both = texts.unionByName(docs)
    kind = F.when(F.endswith("n", F.lit(truth)), "truth").when(F.endswith("n", F.lit(transcript)), "doc").when(F.endswith("n", F.lit(plain)), "plain")
    stem = F.regexp_replace("n", "(" + "|".join(x.replace(".", r"\.") for x in (truth, transcript, plain)) + ")$", "")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = both.select(stem.alias("video_id"), kind.alias("kind"), "p", "chars").groupBy("video_id").agg(
        pick("truth", "p").alias("ground_truth_file"), pick("plain", "p").alias("asr_file"), pick("doc", "p").alias("transcript_file"),
        pick("truth", "chars").alias("ground_truth_chars"), pick("plain", "chars").alias("asr_chars"),
    ).where("ground_truth_file IS NOT NULL AND asr_file IS NOT NULL AND transcript_file IS NOT NULL")
    j = wide.join(curated, "video_id", "left")
    return j.withColumn("title", F.coalesce("title", "video_id")).withColumn("accent", F.coalesce("accent", F.lit("unknown"))).withColumn("domain", F.coalesce("domain", F.lit("unknown")))


def select_corpus(meta: DataFrame, dialect: str = "US", max_seconds: int = 1800, min_chars: int = 100, n: int = 10) -> DataFrame:
    """English calls of a dialect, shortest first (a top-k selection).

    ``meta(file_id, dialect, family, duration_s, transcript_chars)``.
    """
    english = F.contains(F.lower(F.coalesce("dialect", F.lit(""))), F.lit(dialect.lower())) | F.contains(F.lower(F.coalesce("family", F.lit(""))), F.lit("english"))
    ok = meta.where(english & (F.coalesce("duration_s", F.lit(0)) <= max_seconds) & (F.col("transcript_chars") >= min_chars))
    return ok.orderBy(F.coalesce("duration_s", F.lit(0)), "file_id").limit(n)
