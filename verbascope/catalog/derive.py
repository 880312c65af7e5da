"""Domain tables derived from the driver tables (the SQL twins are in ``derived_sql``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.functions.text import EDGE_PUNCT, tokens
from verbascope.operators.intervals import overlap_join
from verbascope.operators.ordered import running
from verbascope.operators.ranges import merge_ranges

# Words said this often in the documents are the vocabulary: it grows with the tables.
VOCAB_TIMES = 32

TRIM = lambda c: F.lower(F.btrim(c, F.lit(EDGE_PUNCT)))


def segments(t) -> DataFrame:
    src = t.conversations.select(
        F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("segment_id"),
        F.col("role").alias("speaker"), "text", F.length("text").cast("bigint").alias("_len"),
    )
    placed = running(src, ["file_id"], F.floor(F.col("segment_id") / 1024), ["segment_id"], F.col("_len"), "_before")
    start = F.coalesce("_before", F.lit(0))
    return placed.select(
        "file_id", "segment_id", "speaker", "text",
        (start.cast("double") / 15).alias("start_s"), ((start + F.col("_len")).cast("double") / 15).alias("end_s"),
    )


def words(t) -> DataFrame:
    return t.segments.select(
        "file_id", "segment_id", "start_s", "end_s", "speaker", F.posexplode_outer(tokens("text")).alias("pos", "word")
    ).where("word IS NOT NULL").withColumn("probability", ((F.col("pos") * 11 + F.length("word") * 37) % 100).cast("double") / 100)


def vocab(t) -> DataFrame:
    counted = (
        t.documents.select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word"))
        .where("word IS NOT NULL")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= VOCAB_TIMES)
    )
    chunk = F.struct(-F.col("n"), F.substring("word", 1, 2))
    ranked = running(counted, [], chunk, [F.desc("n"), F.col("word")], F.lit(1), "_before")
    ranked = ranked.withColumn("pos", F.coalesce("_before", F.lit(0)).cast("int"))
    word = F.col("word")
    kinds = F.array(*[F.lit(c) for c in ("person_name", "product_name", "tech_term", "content_word", "feature")])
    return ranked.select(
        word.alias("term"), word.alias("term_key"),
        F.element_at(kinds, (F.length(word) % 5 + 1).cast("int")).alias("category"),
        F.when(F.col("pos") % 3 == 2, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.substring(word, 1, 2), F.substr(word, F.lit(4))))).alias("known_errors"),
        "pos",
    )


def errors(t) -> DataFrame:
    return t.vocab.select(F.explode("known_errors").alias("error_key"), "term", "term_key", "category", "pos")


def noisy_words(t) -> DataFrame:
    e = t.errors.select("error_key", "term_key")
    joined = t.words.withColumn("_k", TRIM(F.col("word"))).join(e, F.col("_k") == F.col("term_key"), "left")
    bad = F.col("error_key").isNotNull() & ((F.col("segment_id") + F.col("pos")) % 3 == 0)
    return joined.select(
        "file_id", "segment_id", "pos", "start_s", "end_s", "speaker", "probability",
        F.col("word").alias("clean_word"), F.when(bad, F.col("error_key")).otherwise(F.col("word")).alias("word"),
    )


def _in_order(value: str):
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("w"))))
    return F.array_join(F.transform(ordered, lambda x: x["w"]), " ")


def noisy_segments(t) -> DataFrame:
    return t.noisy_words.groupBy("file_id", "segment_id").agg(
        F.any_value("speaker").alias("speaker"), F.any_value("start_s").alias("start_s"),
        F.any_value("end_s").alias("end_s"), _in_order("word").alias("text"),
    )


def pairs(t) -> DataFrame:
    trimmed = F.transform(
        F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0)),
        lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    )
    utts = t.documents.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("dataset"), F.col("lang").alias("accent"),
        F.posexplode_outer(F.filter(trimmed, lambda s: s != "")).alias("utt", "ref"),
    ).where("ref IS NOT NULL")

    def noise(w, i):
        k = ((i + 1) * 7 + F.col("utt") * 3 + F.col("file_id")) % 23
        return (
            F.when(k == 0, F.array().cast("array<string>"))
            .when(k == 1, F.array(F.concat(F.lit("zz"), w)))
            .when(k == 2, F.array(w, w))
            .otherwise(F.array(w))
        )

    hyp = F.array_join(F.flatten(F.transform(tokens("ref"), noise)), " ")
    return utts.select("file_id", "utt", "dataset", "accent", "ref", hyp.alias("hyp"))


def frames(t) -> DataFrame:
    lines = F.transform(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n"), lambda s: F.trim(s))
    return t.pages.select(
        F.floor(F.col("page_id") / 20).alias("file_id"), (10 * (F.col("page_id") % 20)).cast("double").alias("ts"),
        F.lit("slide").alias("type"), "page_id", F.array_join(F.filter(lines, lambda s: s != ""), "\n").alias("text"),
    )


def jobs(t) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_id").cast("string").alias("job_id"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "correction").otherwise("evaluation").alias("job_type"),
        F.col("user_id").cast("string").alias("file_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("completed").alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000000)).alias("completed_at"),
        (F.col("value") * 1000).alias("duration_ms"),
        k.alias("corrections_attempted"), F.floor(k / 2).cast("int").alias("corrections_applied"),
        ((k % 11).cast("double") / 10).alias("avg_confidence"),
    )


STEP_NAMES = ("vocab_merge", "candidate_detection", "ocr_extraction", "ml_inference", "custom_check", "complete")


def step_columns(e: DataFrame) -> DataFrame:
    """Step events out of the raw event rows (batch or stream)."""
    names = F.array(*[F.lit(n) for n in STEP_NAMES])
    et = F.col("event_type")
    status = F.when(et == "error", "failed").when(et == "view", "running").when(et == "click", "pending").when(et == "signup", "skipped").otherwise("completed")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("job_id"),
        F.col("event_id").alias("seq"), F.element_at(names, (1 + F.col("event_id") % 6).cast("int")).alias("name"),
        status.alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("value") * 1000).alias("duration_ms"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("details"), ts.alias("updated_at"),
    )


def steps(t) -> DataFrame:
    return step_columns(t.events)


def examples(t) -> DataFrame:
    ws = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))))
    d = t.documents.select("doc_id", "source", F.posexplode_outer(ws).alias("_p", "word")).where("word IS NOT NULL").withColumn("i", F.col("_p") + 1)
    d = d.join(t.labels, "doc_id", "left")
    n, k = F.length("word"), F.col("doc_id") + F.col("i")
    w = F.col("word")
    return d.select(
        F.col("doc_id").alias("example_id"), "source",
        F.when(n % 4 == 0, "proper_noun").when(n % 4 == 1, "content_word").when(n % 4 == 2, "tech_term").otherwise("numeric_term").alias("category"),
        w.alias("term"),
        F.when(k % 5 == 0, w).when(k % 5 == 1, F.concat(w, F.lit(",")))
        .when(k % 5 == 2, F.concat(F.substring(w, 1, 2), F.substr(w, F.lit(4))))
        .when(k % 5 == 3, F.concat(F.lit("x"), w)).otherwise(F.reverse(w)).alias("error_found"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("applied"),
        ((F.coalesce("toxic", F.lit(0)) == 1) | (k % 4 == 0)).alias("is_negative"),
        (k % 8 == 0).alias("is_hard_negative"), F.col("i").cast("int").alias("seq"),
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")).alias("example_key"),
    )


def landmarks(t) -> DataFrame:
    names = ("nose_x", "upper_x", "upper_y", "lower_x", "lower_y", "left_x", "left_y", "right_x", "right_y")
    return t.embeddings.select(
        F.col("label").alias("file_id"), F.floor(F.col("vec_id") / 8).cast("int").alias("segment_id"),
        (F.col("vec_id") % 8).cast("int").alias("frame_no"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )


def _bad_words(t, item) -> DataFrame:
    right = TRIM(F.col("clean_word"))
    return (
        t.noisy_words.where("word <> clean_word")
        .groupBy("file_id", "segment_id")
        .agg(F.count("*").alias("n_bad"), F.array_sort(F.collect_list(F.struct("pos", item(F.col("word"), right).alias("w")))).alias("_a"))
        .withColumn("_items", F.transform("_a", lambda x: x["w"]))
        .drop("_a")
    )


def offsets(t) -> DataFrame:
    from verbascope.operators.positions import with_offsets

    return with_offsets(t.noisy_segments)


def detections(t) -> DataFrame:
    bad = _bad_words(t, lambda w, c: F.concat(F.lit('{"word":"'), w, F.lit('","likely_correct":"'), c, F.lit('"}')))
    s = t.offsets.join(bad, ["file_id", "segment_id"], "left")
    key = F.when(F.col("segment_id") % 3 == 0, "errors").otherwise("suspects")
    body = F.concat(F.lit('{"'), key, F.lit('":['), F.coalesce(F.array_join("_items", ","), F.lit("")), F.lit('],"confidence":0.9}'))
    fenced = F.when(F.col("segment_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return s.select("file_id", "segment_id", F.col("char_offset").cast("int").alias("chunk_start"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), fenced.alias("response"))


def flagged(t) -> DataFrame:
    return t.noisy_words.where("word <> clean_word").select("file_id", "segment_id", "start_s", "end_s").distinct()


def ranges(t) -> DataFrame:
    return merge_ranges(t.flagged, pad=2.0, gap=5.0)


def retranscripts(t) -> DataFrame:
    r = t.ranges.select("file_id", "range_no", "start_s", "end_s")
    s = t.segments.select("file_id", "segment_id", "start_s", "end_s", "text")
    hit = overlap_join(r, s, ["file_id"], closed=False, suffixes=("", "_seg"))
    ordered = F.array_sort(F.collect_list(F.struct("segment_id", "text")))
    return hit.groupBy("file_id", "range_no", "start_s", "end_s").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text")
    )


def answers(t) -> DataFrame:
    bad = _bad_words(t, lambda w, c: F.concat(F.lit('"'), w, F.lit(" → "), c, F.lit('"')))
    clean = t.noisy_words.groupBy("file_id", "segment_id").agg(_in_order("clean_word").alias("text"))
    s = clean.join(bad, ["file_id", "segment_id"])
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    return s.select(
        "file_id", "segment_id",
        F.concat(F.lit('{"text": '), quoted, F.lit(', "swaps": ['), F.array_join("_items", ", "), F.lit('], "confidence": 0.8}')).alias("response"),
    )


DERIVED = {
    f.__name__: f
    for f in (
        segments, words, vocab, errors, noisy_words, noisy_segments, pairs, frames, jobs, steps, examples, landmarks,
        offsets, detections, flagged, ranges, retranscripts, answers,
    )
}
