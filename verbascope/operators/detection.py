"""Finding likely mis-recognised words and turning them into candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbascope.functions import similarity as sim
from verbascope.functions.answers import detection_suspects
from verbascope.functions.text import let, norm_ws, strip_punct
from verbascope.operators import evidence as ev
from verbascope.operators.intervals import first_containing
from verbascope.operators.positions import position_to_time
from verbascope.operators.transcripts import file_texts
from verbascope.operators.vocabulary import error_lookup, known_error_hits, near_miss_terms
from verbascope.session import materialise

FLAG_THRESHOLD = 3.0
LOW_CONFIDENCE = 0.7
KNOWN_ERROR_SCORE = 5.0
NEAR_MISS_SCORE = 3.0
LOW_CONFIDENCE_SCORE = 2.0
BORDERLINE_CAP = 50


def suspect_words(words: DataFrame, vocab: DataFrame, use_phonetic: bool = True, near_miss: bool = True) -> DataFrame:
    """Verdict per *distinct* word: the term it is likely a mis-hearing of.

    ``word_key, term, category, known_errors, base_score, why``. A listed known
    error that passes the plausibility test wins over a near miss.
    """
    keys = words.select(strip_punct("word").alias("word_key")).where("word_key IS NOT NULL").distinct()
    known = known_error_hits(keys, vocab)
    if use_phonetic:
        known = known.withColumn("_e", sim.metaphone_udf("word_key")).withColumn("_t", sim.metaphone_udf(F.lower("term")))
        p = sim.plausibility(F.col("word_key"), F.col("term"), F.col("_e"), F.col("_t"))
    else:
        p = sim.plausibility(F.col("word_key"), F.col("term"))
    known = known.withColumn("p", p).where(F.col("p.score") >= sim.ACCEPT_PLAUSIBILITY)
    why = F.concat(F.array(F.format_string("known_error:%s(plaus=%.2f)", F.col("term"), F.col("p.score"))), F.col("p.reasons"))
    known = known.select("word_key", "term", "category", "known_errors", F.lit(KNOWN_ERROR_SCORE).alias("base_score"), why.alias("why"))
    if not near_miss:
        return known
    rest = keys.join(known.select("word_key"), "word_key", "left_anti").select(F.col("word_key").alias("word"))
    near = near_miss_terms(rest, vocab, use_phonetic=use_phonetic)
    near_why = F.concat(
        F.array(F.format_string("vocab_near_miss:%s(plaus=%.2f)", F.lower("term"), F.col("score"))), F.col("reasons")
    )
    return known.unionByName(
        near.select(F.col("word").alias("word_key"), "term", "category", "known_errors", F.lit(NEAR_MISS_SCORE).alias("base_score"), near_why.alias("why"))
    )


def score_words(words: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Words with ``score``, ``why`` and the matched term (all words are kept)."""
    w = words.withColumn("word_key", strip_punct("word"))
    j = w.join(verdicts, "word_key", "left")
    low = (F.col("probability") < LOW_CONFIDENCE) & F.col("word_key").isNotNull()
    score = F.coalesce("base_score", F.lit(0.0)) + F.when(low, LOW_CONFIDENCE_SCORE).otherwise(0.0)
    none = F.array().cast("array<string>")
    why = F.concat(
        F.coalesce("why", none), F.when(low, F.array(F.format_string("low_confidence:%.2f", F.col("probability")))).otherwise(none)
    )
    return j.withColumn("score", score).withColumn("why", why).drop("base_score")


def segment_analysis(scored: DataFrame) -> DataFrame:
    """Highest score, reasons in word order and evidence needs per segment."""
    is_cand = (F.col("score") >= FLAG_THRESHOLD) & F.col("term").isNotNull()
    reasons = F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.struct("pos", "why"))))
    flag = lambda cats: F.bool_or(is_cand & F.col("category").isin(*cats))
    seg = scored.groupBy("file_id", "segment_id").agg(
        F.max("score").alias("rule_score"), F.flatten(F.transform(reasons, lambda x: x["why"])).alias("reasons"),
        F.count_if(is_cand).alias("n_candidates"), flag(ev.SCREEN_CATEGORIES_RULES).alias("_ocr"), flag(ev.LIP_CATEGORIES).alias("_lip"),
    )
    hot = F.col("rule_score") >= FLAG_THRESHOLD
    ocr, lip = F.coalesce("_ocr", F.lit(False)), F.coalesce("_lip", F.lit(False))
    return seg.select(
        "file_id", "segment_id", "rule_score", "reasons", "n_candidates", hot.alias("needs_correction"),
        (hot & (ocr | ~lip)).alias("needs_ocr"), (hot & lip).alias("needs_avsr"),
    )


def borderline(analysis: DataFrame, cap: int = BORDERLINE_CAP) -> DataFrame:
    """Segments with some signal below the flag, the first ``cap`` per file."""
    r = F.row_number().over(Window.partitionBy("file_id").orderBy("segment_id"))
    low = analysis.where((F.col("rule_score") > 0) & (F.col("rule_score") < FLAG_THRESHOLD))
    return low.withColumn("rank", r).where(F.col("rank") <= cap)


def locate_in_files(items: DataFrame, texts: DataFrame, place, window: int = 80) -> DataFrame:
    """Character position and context of items in their file's text.

    ``items(file_id, item struct)``; ``place(item, text, lowered)`` gives the position in
    the text, which comes lowered too. A file's items travel to its text, so every text is
    moved and lowered once and searched once an item. What is found is stored: positions are
    read several times after.
    """
    by_file = items.groupBy("file_id").agg(F.collect_list("item").alias("_items"))
    rows = by_file.join(texts, "file_id")

    def with_position(item: Column, pos: Column, norm: Column) -> Column:
        lo = F.greatest(pos - window, F.lit(0))
        return F.struct(item.alias("item"), pos.cast("int").alias("char_pos"), F.substr(norm, lo + 1, pos + window - lo).alias("context"))

    bound = let(
        F.struct(F.col("text").alias("t"), F.lower("text").alias("l"), norm_ws("text").alias("n"), F.col("_items").alias("i")),
        lambda b: F.transform(b["i"], lambda item: let(place(item, b["t"], b["l"]), lambda pos: with_position(item, pos, b["n"]))),
    )
    placed = rows.select("file_id", F.explode_outer(bound).alias("x")).select("file_id", "x.item.*", "x.char_pos", "x.context")
    return materialise(placed, "placed")


def _found(position: Column) -> Column:
    """A 1-based position as a 0-based one, NULL where nothing was found; looked for once."""
    return let(position, lambda p: F.when(p > 0, p - 1))


def rule_candidates(scored: DataFrame, segments: DataFrame, texts: DataFrame | None = None, ocr_window: float = 15.0) -> DataFrame:
    """Flat candidates of the rule path.

    The position is the first occurrence of the segment's text in the file plus
    the first occurrence of the word in the segment.
    """
    texts = file_texts(segments, trim=False) if texts is None else texts
    cand = scored.where((F.col("score") >= FLAG_THRESHOLD) & F.col("term").isNotNull()).join(
        segments.select("file_id", "segment_id", F.col("text").alias("seg_text")), ["file_id", "segment_id"]
    )
    item = F.struct("segment_id", "pos", "word", "term", "category", "known_errors", "seg_text")

    def place(x: Column, text: Column, low: Column) -> Column:
        seg_at = F.position(x["seg_text"], text) - 1
        in_seg = F.position(F.lower(x["word"]), F.lower(x["seg_text"])) - 1
        return let(seg_at, lambda at: F.when(at < 0, F.lit(0)).otherwise(at + F.greatest(in_seg, F.lit(0))))

    placed = locate_in_files(cand.select("file_id", item.alias("item")), texts, place)
    timed = position_to_time(placed, segments)
    return timed.select(
        "file_id", "segment_id", "pos", "term", "category", "known_errors", F.col("word").alias("error_found"), F.col("char_pos").alias("char_position"),
        F.greatest(F.col("ts") - ocr_window, F.lit(0.0)).alias("timestamp_start"), (F.col("ts") + ocr_window).alias("timestamp_end"), "context",
    )


def detect_errors_rules(words: DataFrame, segments: DataFrame, vocab: DataFrame, use_phonetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(segment analysis, candidates) of the rule path."""
    scored = score_words(words, suspect_words(words, vocab, use_phonetic))
    return segment_analysis(scored), rule_candidates(scored, segments)


def attach_detections(detections: DataFrame, segments: DataFrame, vocab: DataFrame, texts: DataFrame | None = None, ocr_window: float = 15.0) -> DataFrame:
    """Detector answers as candidates placed in their segments.

    The word is searched from its chunk on, then anywhere, else the chunk start
    stands in. Time comes from the position, the segment from the time, the
    attributes from the vocabulary (``custom`` with the word itself otherwise).
    """
    texts = file_texts(segments, trim=False) if texts is None else texts
    found = detections.select("file_id", "chunk_start", F.explode(detection_suspects("response")).alias("s"))
    item = F.struct("chunk_start", F.col("s.word").alias("word"), F.col("s.likely_correct").alias("likely_correct"), F.col("s.needs_avsr").alias("wants_lips"))

    def place(x: Column, text: Column, low: Column) -> Column:
        w = F.lower(x["word"])
        return F.coalesce(_found(F.position(w, low, x["chunk_start"] + 1)), _found(F.position(w, low)), x["chunk_start"])

    placed = locate_in_files(found.select("file_id", item.alias("item")), texts, place)
    timed = position_to_time(placed, segments)
    spans = segments.select("file_id", "segment_id", "start_s", "end_s")
    keyed = first_containing(timed.select("file_id", "char_pos", "ts").distinct(), "ts", spans, ["file_id"], ["char_pos"], "segment_id")
    seg = timed.join(keyed.select("file_id", "char_pos", "segment_id"), ["file_id", "char_pos"])
    attrs = vocab.groupBy("term_key").agg(F.max_by(F.struct("term", "category", "known_errors"), "pos").alias("v"))
    both = seg.join(attrs, F.lower("likely_correct") == F.col("term_key"), "left")
    return both.select(
        "file_id", "segment_id", F.coalesce("v.term", "likely_correct").alias("term"), F.coalesce("v.category", F.lit("custom")).alias("category"),
        F.coalesce("v.known_errors", F.array("word")).alias("known_errors"), F.col("word").alias("error_found"),
        F.col("char_pos").alias("char_position"), F.greatest(F.col("ts") - ocr_window, F.lit(0.0)).alias("timestamp_start"),
        (F.col("ts") + ocr_window).alias("timestamp_end"), "context", F.coalesce("wants_lips", F.lit(False)).alias("wants_lips"),
        F.concat(F.lit("llm_detected:"), "word", F.lit("→"), "likely_correct").alias("reason"),
    )


def detection_analysis(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Every segment with the detector path's flags; the score is fixed at 5."""
    flags = candidates.groupBy("file_id", "segment_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("category").isin(*ev.SCREEN_CATEGORIES_DETECTOR)).alias("o"),
        F.bool_or(F.col("category").isin(*ev.LIP_CATEGORIES) | F.col("wants_lips")).alias("l"),
        F.array_sort(F.collect_list(F.struct("char_position", "reason"))).alias("r"),
    )
    j = segments.select("file_id", "segment_id").join(flags, ["file_id", "segment_id"], "left")
    return j.select(
        "file_id", "segment_id", F.when(F.col("n") > 0, 5.0).otherwise(0.0).alias("rule_score"),
        F.coalesce(F.transform("r", lambda x: x["reason"]), F.array().cast("array<string>")).alias("reasons"),
        F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("needs_correction"),
        F.coalesce("o", F.lit(False)).alias("needs_ocr"), F.coalesce("l", F.lit(False)).alias("needs_avsr"),
    )


CANDIDATE_COLUMNS = (
    "file_id", "segment_id", "term", "category", "known_errors", "error_found", "char_position", "timestamp_start", "timestamp_end", "context",
)


def rules_of_quiet_files(detected: DataFrame, words: DataFrame, segments: DataFrame, vocab: DataFrame, use_phonetic: bool = True) -> DataFrame:
    """Rule candidates of the files where the detector found nothing. A word's verdict and a
    candidate's place hang on no other file, so the rules read only the words of these."""
    loud = detected.select("file_id").distinct()
    quiet = lambda df: df.join(loud, "file_id", "left_anti")
    return detect_errors_rules(quiet(words), quiet(segments), vocab, use_phonetic)[1]


def with_rule_fallback(detected: DataFrame, by_rules: DataFrame) -> DataFrame:
    """Detector candidates, and rule candidates for files where it found nothing."""
    quiet = by_rules.join(detected.select("file_id").distinct(), "file_id", "left_anti")
    return detected.select(*CANDIDATE_COLUMNS).unionByName(quiet.select(*CANDIDATE_COLUMNS))
