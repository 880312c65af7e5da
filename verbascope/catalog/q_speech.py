"""Interval, vocabulary, detection, reconciliation and lip queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbascope.catalog.q_text import strip, ws
from verbascope.catalog.registry import query, stored
from verbascope.functions import similarity as sim, text as tx
from verbascope.functions.fuzzy import plausible_spellings
from verbascope.operators import alternatives as alt
from verbascope.operators import detection as de
from verbascope.operators import evidence as ev
from verbascope.operators import intervals as iv
from verbascope.operators import lips, matching, ranges, reconcile as rc
from verbascope.operators import training as tr
from verbascope.operators import vocabulary as vo
from verbascope.operators.terms import corpus_zipf
from verbascope.session import materialise

# --------------------------------------------------------------------------
# intervals, ranges, folds
# --------------------------------------------------------------------------


@query(
    "segments_in_ranges_open",
    """SELECT s.file_id, s.segment_id, r.range_no FROM d_segments s JOIN d_ranges r ON r.file_id = s.file_id AND s.start_s < r.end_s AND s.end_s > r.start_s""",
)
def _(t):
    r = t.ranges.select("file_id", "range_no", "start_s", "end_s")
    return iv.overlap_join(t.segments, r, ["file_id"], closed=False).select("file_id", "segment_id", "range_no")


@query(
    "segments_touching_segments",
    """SELECT a.file_id, a.segment_id, b.segment_id AS other_id FROM d_segments a JOIN d_segments b ON a.file_id = b.file_id AND a.start_s <= b.end_s AND a.end_s >= b.start_s""",
)
def _(t):
    s = t.segments.select("file_id", "segment_id", "start_s", "end_s")
    o = s.withColumnRenamed("segment_id", "other_id")
    return iv.overlap_join(s, o, ["file_id"], closed=True).select("file_id", "segment_id", "other_id")


@query(
    "retranscript_versions",
    r"""SELECT s.file_id, s.segment_id, r.range_no, md5(r.text) AS other_md5 FROM d_noisy_segments s JOIN d_retranscripts r ON r.file_id = s.file_id AND s.start_s < r.end_s AND s.end_s > r.start_s
WHERE r.text <> '' AND trim(s.text) <> '' AND lower(trim(s.text)) <> lower(r.text)""",
)
def _(t):
    v = rc.overlapping_versions(t.noisy_segments, t.retranscripts)
    return v.select("file_id", "segment_id", "range_no", F.md5("other_text").alias("other_md5"))


@query(
    "point_to_segment",
    """WITH p AS (SELECT page_id, page_id // 20 AS file_id, CAST(7 * (page_id % 20) AS DOUBLE) AS at FROM pages)
SELECT p.page_id, COALESCE(min(s.segment_id), 0) AS segment_id FROM p LEFT JOIN d_segments s ON s.file_id = p.file_id AND s.start_s <= p.at AND p.at <= s.end_s GROUP BY p.page_id""",
)
def _(t):
    p = t.pages.select("page_id", F.floor(F.col("page_id") / 20).alias("file_id"), (7 * (F.col("page_id") % 20)).cast("double").alias("at"))
    return iv.first_containing(p, "at", t.segments, ["file_id"], ["page_id"], "segment_id").select("page_id", "segment_id")


@query(
    "frames_near_segments",
    """SELECT f.page_id, s.file_id, s.segment_id FROM d_frames f JOIN d_segments s ON f.file_id = s.file_id AND abs(f.ts - (s.start_s + s.end_s) / 2) <= 15""",
)
def _(t):
    c = t.segments.select("file_id", "segment_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("mid"))
    return iv.within(t.frames, "ts", c, "mid", 15.0, ["file_id"]).select("page_id", "file_id", "segment_id")


@query(
    "frames_in_window",
    """SELECT f.page_id, s.file_id, s.segment_id FROM d_frames f JOIN d_segments s ON f.file_id = s.file_id AND s.start_s <= f.ts AND f.ts <= s.end_s""",
)
def _(t):
    s = t.segments.select("file_id", "segment_id", "start_s", "end_s")
    return iv.points_in(t.frames, "ts", s, ["file_id"]).select("page_id", "file_id", "segment_id")


@query("merged_ranges", "SELECT file_id, range_no, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, n FROM d_ranges WHERE range_no <= 40")
def _(t):
    m = ranges.merge_ranges(t.flagged, 2.0, 5.0, cap=40)
    return m.select("file_id", "range_no", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "n")


@query(
    "merged_event_ranges",
    """WITH e AS (SELECT user_id AS file_id, event_id, greatest(epoch_us(ts) / 1000000.0 - 1704067200 - 600, 0)::DOUBLE AS s, (epoch_us(ts) / 1000000.0 - 1704067200 + 600)::DOUBLE AS e FROM events),
 r AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e),
 i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT file_id, CAST(k AS INT) AS range_no, round(min(s), 3) AS start_s, round(max(e), 3) AS end_s, count(*) AS n FROM i GROUP BY file_id, k""",
)
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200
    e = t.events.select(F.col("user_id").alias("file_id"), at.alias("start_s"), at.alias("end_s"))
    m = ranges.merge_ranges(e, 600.0, 0.0)
    return m.select("file_id", "range_no", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n")


@query(
    "range_frame_samples",
    """WITH m AS (SELECT file_id, k AS range_no, min(s) AS a, max(e) AS b FROM (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM (
   SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (
    SELECT file_id, greatest(start_s - 5, 0) AS s, end_s + 5 AS e FROM d_flagged))) GROUP BY file_id, k)
SELECT file_id, CAST(range_no AS INT) AS range_no, round(a + i * 5, 6) AS ts FROM (SELECT *, unnest(range(0, CAST(floor((b - a) / 5) AS BIGINT) + 1)) AS i FROM m)""",
)
def _(t):
    s = ranges.sample_ranges(ranges.merge_ranges(t.flagged, 5.0, 0.0))
    return s.select("file_id", "range_no", F.round("ts", 6).alias("ts"))


@query(
    "frames_without_repeats",
    """SELECT page_id FROM (SELECT page_id, h, lag(h) OVER (PARTITION BY file_id ORDER BY ts) AS p FROM (SELECT page_id, file_id, ts, length(text) % 3 AS h FROM d_frames)) WHERE p IS NULL OR p <> h""",
)
def _(t):
    f = t.frames.select("page_id", "file_id", "ts", (F.length("text") % 3).alias("image_hash"))
    return ranges.drop_repeats(f, ("file_id",), "ts", "image_hash", chunk_s=60.0).select("page_id")


@query(
    "distinct_frames",
    r"""WITH RECURSIVE f AS (SELECT file_id, ts, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))) AS w, row_number() OVER (PARTITION BY file_id ORDER BY ts) AS i FROM d_frames),
 r AS (SELECT file_id, i, ts, w AS kept, true AS keep FROM f WHERE i = 1
  UNION ALL SELECT f.file_id, f.i, f.ts, CASE WHEN j < 0.9 THEN f.w ELSE kept END, j < 0.9 FROM (
   SELECT f.*, r.kept, CASE WHEN len(f.w) = 0 AND len(r.kept) = 0 THEN 1.0 WHEN len(f.w) = 0 OR len(r.kept) = 0 THEN 0.0 ELSE len(list_intersect(f.w, r.kept))::DOUBLE / len(list_distinct(list_concat(f.w, r.kept))) END AS j
   FROM f JOIN r ON f.file_id = r.file_id AND f.i = r.i + 1) f)
SELECT file_id, ts FROM r WHERE keep""",
)
def _(t):
    return ev.distinct_frames(t.frames.select("file_id", "ts", "text")).select("file_id", "ts")


MID_SQL = "SELECT file_id, (start_s + end_s) / 2 AS ts FROM d_flagged"
SPACED = f"""f AS (SELECT file_id, ts, row_number() OVER (PARTITION BY file_id ORDER BY ts) AS i FROM ({MID_SQL})),
 r AS (SELECT file_id, i, ts, ts AS last, true AS keep FROM f WHERE i = 1
  UNION ALL SELECT f.file_id, f.i, f.ts, CASE WHEN f.ts - r.last > 5 THEN f.ts ELSE r.last END, f.ts - r.last > 5 FROM f JOIN r ON f.file_id = r.file_id AND f.i = r.i + 1)"""


def _mids(t):
    return t.flagged.select("file_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("ts"))


@query("spaced_times", f"WITH RECURSIVE {SPACED} SELECT file_id, round(ts, 6) AS ts FROM r WHERE keep")
def _(t):
    return ev.spaced_times(_mids(t)).select("file_id", F.round("ts", 6).alias("ts"))


@query(
    "frame_plan",
    f"""WITH RECURSIVE {SPACED}, kept AS (SELECT file_id, ts, row_number() OVER (PARTITION BY file_id ORDER BY ts) AS n FROM r WHERE keep),
 picked AS (SELECT file_id, list(ts ORDER BY ts) AS ts FROM kept WHERE n <= 10 GROUP BY file_id),
 base AS (SELECT file_id, max(end_s) AS duration, coalesce(any_value(picked.ts), CAST([] AS DOUBLE[])) AS chosen FROM d_segments LEFT JOIN picked USING (file_id) GROUP BY file_id),
 wanted AS (SELECT file_id, chosen, CASE WHEN duration > 0 THEN list_transform(range(1, 16 - len(chosen)), lambda i: [duration / (16 - len(chosen)) * i]) ELSE CAST([] AS DOUBLE[][]) END AS fills FROM base),
 merged AS (SELECT file_id, list_sort(list_reduce(list_prepend(chosen, fills), lambda a, x: CASE WHEN coalesce(list_bool_or(list_transform(a, lambda y: abs(y - x[1]) < 5)), false) THEN a ELSE list_concat(a, x) END))[1:15] AS ts FROM wanted)
SELECT file_id, CAST(unnest(range(0, len(ts))) AS INT) AS slot, round(unnest(ts), 6) AS ts FROM merged""",
)
def _(t):
    dur = t.segments.groupBy("file_id").agg(F.max("end_s").alias("duration"))
    return ev.frame_plan(_mids(t), dur).select("file_id", "slot", F.round("ts", 6).alias("ts"))


# --------------------------------------------------------------------------
# vocabulary and word similarity
# --------------------------------------------------------------------------


def _custom(t):
    """Custom terms of a team: capitalised words of the benchmark texts."""
    w = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("w"))
    u = w.groupBy(F.lower("w").alias("k")).agg(F.min("w").alias("term"))
    return u.select(
        "term", F.when(F.length("term") % 2 == 0, "custom").otherwise(F.lit(None)).alias("category"), F.array(F.concat(F.lit("x"), "k")).alias("known_errors"),
        F.conv(F.substring(F.md5("k"), 1, 8), 16, 10).cast("bigint").alias("pos"),
    )


@query(
    "merged_vocabulary",
    r"""WITH c AS (SELECT lower(w) AS k, min(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM benchmark) GROUP BY lower(w))
SELECT COALESCE(v.term_key, c.k) AS term_key, COALESCE(v.term, c.term) AS term,
 CASE WHEN c.k IS NOT NULL AND length(c.term) % 2 = 0 THEN 'custom' WHEN v.term IS NOT NULL THEN v.category ELSE 'custom' END AS category,
 array_to_string(list_concat(COALESCE(v.known_errors, CAST([] AS VARCHAR[])), CASE WHEN c.k IS NULL OR list_contains(COALESCE(v.known_errors, CAST([] AS VARCHAR[])), 'x' || c.k) THEN [] ELSE ['x' || c.k] END), '|') AS known_errors
FROM d_vocab v FULL JOIN c ON c.k = v.term_key""",
)
def _(t):
    m = vo.merge_vocabularies(t.vocab, _custom(t))
    return m.select("term_key", "term", "category", F.array_join("known_errors", "|").alias("known_errors"))


@query(
    "custom_terms_split",
    r"""SELECT DISTINCT term FROM (SELECT regexp_replace(x, '^\s+|\s+$', '', 'g') AS term FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark)) WHERE term <> ''""",
)
def _(t):
    return t.benchmark.select(F.explode(vo.split_custom(F.col("text"))).alias("term")).distinct()


@query(
    "prompt_vocabulary",
    """WITH p AS (SELECT f.file_id, v.term, v.pos AS o FROM (SELECT DISTINCT file_id FROM d_flagged) f CROSS JOIN d_vocab v UNION ALL
  SELECT file_id, clean_word, 1000 + segment_id * 10000 + pos FROM d_noisy_words WHERE word <> clean_word),
 u AS (SELECT file_id, term, min(o) AS o FROM p GROUP BY ALL)
SELECT file_id, CAST(place AS INT) AS place, term FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY o, term) AS place FROM u) WHERE place <= 80""",
)
def _(t):
    # The union's own limit is 80 places and the vocabulary comes first: later terms can take none.
    terms = t.vocab.where("pos < 80").agg(F.collect_list(F.struct("term", "pos")).alias("vs")).withColumn("_k", F.lit(1))
    files = t.flagged.select("file_id").distinct().withColumn("_k", F.lit(1))
    a = files.join(F.broadcast(terms), "_k").select("file_id", F.inline("vs"))
    b = t.noisy_words.where("word <> clean_word").select("file_id", F.col("clean_word").alias("term"), (F.col("segment_id") * 10000 + F.col("pos")).alias("pos"))
    return vo.union_terms([a, b]).select("file_id", "place", "term")


@query(
    "known_error_hits",
    f"""SELECT w.file_id, w.segment_id, w.pos, e.term FROM d_noisy_words w JOIN d_lookup e ON {strip('w.word')} = e.error_key WHERE length({strip('w.word')}) >= 2""",
)
def _(t):
    w = t.noisy_words.withColumn("word_key", tx.strip_punct("word"))
    return vo.known_error_hits(w, t.vocab).select("file_id", "segment_id", "pos", "term")


WORDS_SQL = f"SELECT DISTINCT {strip('word')} AS word FROM d_noisy_words WHERE length({strip('word')}) >= 2"


def one_byte(column: str) -> str:
    """The SQL engine's string measures compare bytes. Words are in lower case, so accented
    letters can be written as capitals: every character of the tables is then one byte."""
    accented = "ßàáâäåæçèéêëìíîïñòóôöùúûüœ"
    return f"translate({column}, '{accented}', '{''.join(chr(65 + k) for k in range(len(accented)))}')"


LCS_FREE = "abs(length(w.word) - length(v.term_key)) <= 3"


@query(
    "jaro_winkler_pairs",
    f"""WITH w AS (SELECT word, {one_byte('word')} AS x FROM ({WORDS_SQL})), v AS (SELECT term_key, {one_byte('term_key')} AS y FROM d_vocab)
SELECT w.word AS a, v.term_key AS b, round(jaro_winkler_similarity(x, y), 6) AS sim FROM w JOIN v ON jaro_winkler_similarity(x, y) > 0.75""",
)
def _(t):
    stored(t, "vocab")
    w = t.noisy_words.select(tx.strip_punct("word").alias("a")).where("a IS NOT NULL").distinct()
    p = alt.similar_pairs(w, t.vocab.select(F.col("term_key").alias("b")), [], 0.75)
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


@query("indel_ratio_pairs")
def _(t):
    stored(t, "vocab")
    w = t.noisy_words.select(tx.strip_punct("word").alias("word")).where("word IS NOT NULL").distinct()
    return vo.fuzzy_pairs(w, t.vocab.select("term_key")).withColumn("ratio", F.round("ratio", 6))


@query("metaphone_codes")
def _(t):
    w = t.words.select(tx.strip_punct("word").alias("word")).where("word IS NOT NULL").distinct()
    return w.withColumn("code", sim.metaphone_udf("word"))


@query(
    "edit_and_overlap",
    r"""SELECT error_key, term_key, levenshtein(error_key, term_key)::INT AS dist, round(1 - levenshtein(error_key, term_key)::DOUBLE / greatest(length(error_key), length(term_key)), 6) AS esim,
 round(len(list_intersect(list_distinct(string_split(error_key, '')), list_distinct(string_split(term_key, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(error_key, ''), string_split(term_key, '')))), 6) AS overlap FROM d_errors""",
)
def _(t):
    e, k = F.col("error_key"), F.col("term_key")
    return t.errors.select(
        "error_key", "term_key", F.levenshtein(e, k).alias("dist"), F.round(sim.edit_similarity(e, k), 6).alias("esim"), F.round(sim.char_overlap(e, k), 6).alias("overlap")
    )


@query(
    "screen_text_jaccard",
    r"""WITH f AS (SELECT file_id, ts, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS w FROM d_frames),
 p AS (SELECT a.file_id, a.ts, a.w AS x, b.w AS y FROM f a JOIN f b ON a.file_id = b.file_id AND b.ts = a.ts + 10)
SELECT file_id, ts, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p""",
)
def _(t):
    a = t.frames.select("file_id", "ts", "text")
    b = a.select("file_id", (F.col("ts") - 10).alias("ts"), F.col("text").alias("next"))
    return a.join(b, ["file_id", "ts"]).select("file_id", "ts", F.round(sim.text_jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


def _plaus_sql(e: str, k: str) -> str:
    le, lt = f"length({e})", f"length({k})"
    d = f"levenshtein({e}, {k})"
    ratio = f"(least({le}, {lt})::DOUBLE / greatest({le}, {lt}, 1))"
    es = f"(1 - {d}::DOUBLE / greatest({le}, {lt}, 1))"
    ov = f"(len(list_intersect(list_distinct(string_split({e}, '')), list_distinct(string_split({k}, ''))))::DOUBLE / len(list_distinct(list_concat(string_split({e}, ''), string_split({k}, '')))))"
    return f"""CASE WHEN {e} = {k} THEN 1.0 WHEN (starts_with({k}, {e}) OR starts_with({e}, {k})) AND abs({le} - {lt}) > 1 THEN 0.05 WHEN {le} <= 2 THEN 0.05
 WHEN {le} = 3 AND {d} > 0 AND NOT (starts_with({k}, {e}) AND {lt} - {le} <= 1) THEN 0.05 WHEN {le} = 4 AND ({d} > 1 OR {ratio} < 0.75) THEN 0.1
 ELSE CASE WHEN {es} > 0.4 THEN 0.3 * {es} ELSE 0 END + CASE WHEN {ratio} >= 0.65 THEN 0.2 * {ratio} ELSE 0 END + CASE WHEN {ov} >= 0.4 THEN 0.15 * {ov} ELSE 0 END END"""


@query(
    "plausibility_spelling",
    f"""WITH w AS ({WORDS_SQL}), p AS (SELECT w.word, v.term_key, {one_byte('w.word')} AS x, {one_byte('v.term_key')} AS y FROM w JOIN d_vocab v ON left(w.word, 2) = left(v.term_key, 2))
SELECT word, term_key, round({_plaus_sql('x', 'y')}, 6)::DOUBLE AS score FROM p""",
)
def _(t):
    stored(t, "vocab")
    w = t.noisy_words.select(tx.strip_punct("word").alias("word")).where("word IS NOT NULL").distinct()
    return plausible_spellings(w, t.vocab.select("term_key"), "word", "term_key", 2, "score", 6)


@query("plausibility_phonetic")
def _(t):
    e, k = F.col("error_key"), F.col("term_key")
    p = sim.plausibility(e, k, sim.metaphone_udf(e), sim.metaphone_udf(k))
    return t.errors.select("error_key", "term_key", p.alias("p")).select("error_key", "term_key", F.round("p.score", 6).alias("score"), F.array_join("p.reasons", ";").alias("reasons"))


@query("near_miss_terms")
def _(t):
    stored(t, "vocab")
    w = t.noisy_words.select(tx.strip_punct("word").alias("word")).where("word IS NOT NULL").distinct()
    n = vo.near_miss_terms(w, t.vocab)
    return n.select("word", "term", F.round("ratio", 4).alias("ratio"), F.round("score", 6).alias("score"))


ZIPF_VOCAB = r"""z AS (SELECT lower(w) AS word, log10(count(*)::DOUBLE / sum(count(*)) OVER () * 1000000000) AS zipf FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS w FROM documents) GROUP BY lower(w))"""


def _zipf(t):
    return corpus_zipf(t.documents.select(F.col("doc_id").alias("file_id"), "text"))


@query(
    "risky_known_errors",
    f"WITH {ZIPF_VOCAB} SELECT e.error_key AS error, e.term, e.category, round(z.zipf, 6) AS zipf FROM d_errors e JOIN z ON z.word = e.error_key WHERE z.zipf > 3.5",
)
def _(t):
    return tr.risky_errors(t.vocab, _zipf(t)).withColumn("zipf", F.round("zipf", 6))


@query("false_friends")
def _(t):
    f = tr.false_friends(_zipf(t), t.vocab)
    return f.select("word", "term", "category", F.round("similarity", 4).alias("similarity"), F.round("zipf", 6).alias("zipf"))


@query("false_friend_occurrences")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("file_id"), "text")
    friends = tr.false_friends(_zipf(t), t.vocab)
    return tr.friend_occurrences(d, friends, ["file_id"]).select("file_id", "word", "term", "p", "context")


# --------------------------------------------------------------------------
# detection
# --------------------------------------------------------------------------

SCORED_SQL = f"""k AS (SELECT error_key, term, category, {_plaus_sql('error_key', 'term_key')} AS p FROM d_lookup),
 s AS (SELECT w.file_id, w.segment_id, w.pos, w.word, k.term, k.category, (CASE WHEN k.p >= 0.65 THEN 5 ELSE 0 END + CASE WHEN w.probability < 0.7 AND length({strip('w.word')}) >= 2 THEN 2 ELSE 0 END)::DOUBLE AS score
   FROM d_noisy_words w LEFT JOIN (SELECT * FROM k WHERE p >= 0.5) k ON k.error_key = {strip('w.word')} AND k.p >= 0.5)"""


def _scored_known(t):
    """Known-error path with the spelling part of the score only (threshold met by spelling)."""
    return de.score_words(t.noisy_words, de.suspect_words(t.noisy_words, t.vocab, use_phonetic=False, near_miss=False))


@query(
    "segment_scores_known_errors",
    f"WITH {SCORED_SQL.replace('p >= 0.5', 'p >= 0.65')} SELECT file_id, segment_id, max(score) AS rule_score, count(*) FILTER (score >= 3 AND term IS NOT NULL) AS n_candidates, max(score) >= 3 AS needs_correction FROM s GROUP BY file_id, segment_id",
)
def _(t):
    a = de.segment_analysis(_scored_known(t))
    return a.select("file_id", "segment_id", "rule_score", "n_candidates", "needs_correction")


@query(
    "borderline_segments",
    f"""WITH {SCORED_SQL.replace('p >= 0.5', 'p >= 0.65')}, m AS (SELECT file_id, segment_id, max(score) AS x FROM s GROUP BY ALL)
SELECT file_id, segment_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY segment_id) AS r FROM m WHERE x > 0 AND x < 3) WHERE r <= 50""",
)
def _(t):
    return de.borderline(de.segment_analysis(_scored_known(t))).select("file_id", "segment_id", "rank")


@query("rule_segment_analysis")
def _(t):
    stored(t, "vocab", "noisy_words", "noisy_segments")
    a, _ = de.detect_errors_rules(t.noisy_words, t.noisy_segments, t.vocab)
    return a.withColumn("reasons", F.array_join("reasons", ";"))


@query("rule_candidates")
def _(t):
    stored(t, "vocab", "noisy_words", "noisy_segments")
    _, c = de.detect_errors_rules(t.noisy_words, t.noisy_segments, t.vocab)
    return c.withColumn("known_errors", F.array_join("known_errors", "|")).withColumn("timestamp_start", F.round("timestamp_start", 6)).withColumn("timestamp_end", F.round("timestamp_end", 6))


DETECTED_SQL = f"""tx AS (SELECT file_id, string_agg(text, ' ' ORDER BY segment_id) AS text FROM d_noisy_segments GROUP BY file_id),
 det AS (SELECT o.file_id, o.char_offset AS cs, w.word, lower(trim(w.clean_word, '.,!?;:''"()[]')) AS lc FROM d_noisy_words w JOIN d_offsets o ON o.file_id = w.file_id AND o.segment_id = w.segment_id WHERE w.word <> w.clean_word),
 pos AS (SELECT d.*, CASE WHEN instr(substr(lower(t.text), d.cs + 1), lower(d.word)) > 0 THEN d.cs + instr(substr(lower(t.text), d.cs + 1), lower(d.word)) - 1
    WHEN instr(lower(t.text), lower(d.word)) > 0 THEN instr(lower(t.text), lower(d.word)) - 1 ELSE d.cs END AS cp FROM det d JOIN tx t USING (file_id)),
 tm AS (SELECT p.file_id, p.cp, p.word, p.lc, s.start_s + (p.cp - s.char_offset)::DOUBLE / greatest(length(s.text), 1) * (s.end_s - s.start_s) AS ts FROM pos p JOIN d_offsets s ON s.file_id = p.file_id AND s.char_offset <= p.cp AND p.cp <= s.char_offset + length(s.text)),
 sg AS (SELECT tm.*, COALESCE((SELECT min(s.segment_id) FROM d_segments s WHERE s.file_id = tm.file_id AND s.start_s <= tm.ts AND tm.ts <= s.end_s), 0) AS segment_id FROM tm)"""


def _detected(t):
    return de.attach_detections(t.detections, t.noisy_segments, t.vocab)


@query(
    "detector_candidates",
    f"""WITH {DETECTED_SQL} SELECT sg.file_id, sg.segment_id, COALESCE(v.term, sg.lc) AS term, COALESCE(v.category, 'custom') AS category, sg.word AS error_found, CAST(sg.cp AS INT) AS char_position,
 round(greatest(sg.ts - 15, 0), 5) AS timestamp_start, round(sg.ts + 15, 5) AS timestamp_end FROM sg LEFT JOIN d_vocab v ON v.term_key = lower(sg.lc)""",
)
def _(t):
    c = _detected(t)
    return c.select("file_id", "segment_id", "term", "category", "error_found", "char_position", F.round("timestamp_start", 5).alias("timestamp_start"), F.round("timestamp_end", 5).alias("timestamp_end"))


@query(
    "detector_segment_analysis",
    f"""WITH {DETECTED_SQL}, c AS (SELECT sg.file_id, sg.segment_id, COALESCE(v.category, 'custom') AS category FROM sg LEFT JOIN d_vocab v ON v.term_key = lower(sg.lc)),
 g AS (SELECT file_id, segment_id, count(*) AS n, bool_or(category IN ('product_name','tech_term','feature')) AS o, bool_or(category IN ('person_name','content_word','custom')) AS l FROM c GROUP BY ALL)
SELECT s.file_id, s.segment_id, CASE WHEN g.n > 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS rule_score, COALESCE(g.n, 0) AS n_candidates, COALESCE(g.o, false) AS needs_ocr, COALESCE(g.l, false) AS needs_avsr
FROM d_noisy_segments s LEFT JOIN g ON g.file_id = s.file_id AND g.segment_id = s.segment_id""",
)
def _(t):
    a = de.detection_analysis(_detected(t), t.noisy_segments)
    return a.select("file_id", "segment_id", "rule_score", "n_candidates", "needs_ocr", "needs_avsr")


@query("detector_with_rule_fallback")
def _(t):
    stored(t, "vocab", "noisy_words", "noisy_segments", "detections")
    det = materialise(de.attach_detections(t.detections.where("n_bad > 1"), t.noisy_segments, t.vocab), "found")
    rules = de.rules_of_quiet_files(det, t.noisy_words, t.noisy_segments, t.vocab)
    c = de.with_rule_fallback(det, rules)
    return c.select("file_id", "segment_id", "term", "error_found", "char_position")


@query(
    "detector_fallback_files",
    """SELECT file_id, bool_or(n_bad > 0) AS by_detector FROM d_detections GROUP BY file_id""",
)
def _(t):
    found = _detected(t).select("file_id").distinct().withColumn("hit", F.lit(True))
    files = t.noisy_segments.select("file_id").distinct()
    return files.join(found, "file_id", "left").select("file_id", F.coalesce("hit", F.lit(False)).alias("by_detector"))


# --------------------------------------------------------------------------
# alternatives and reconciliation
# --------------------------------------------------------------------------

PROPOSALS_SQL = r"""prop AS (SELECT user_id AS file_id, event_id AS seq, ws[1 + CAST(event_id % len(ws) AS INT)] AS error_found, ws[1 + CAST((event_id * 7 + 3) % len(ws) AS INT)] AS term
 FROM events, (SELECT list(x ORDER BY x) AS ws FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS x FROM benchmark)))"""


def _proposals(t):
    """Error words and proposals picked from the benchmark's words by event number."""
    ws = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("x")).distinct()
    book = ws.agg(F.array_sort(F.collect_list("x")).alias("ws")).withColumn("_k", F.lit(1))
    e = t.events.select("user_id", "event_id").withColumn("_k", F.lit(1)).join(F.broadcast(book), "_k")
    n = F.size("ws")
    pick = lambda k: F.element_at("ws", (k % n + 1).cast("int"))
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), pick(F.col("event_id")).alias("error_found"), pick(F.col("event_id") * 7 + 3).alias("term"))


@query(
    "pool_override",
    f"""WITH {PROPOSALS_SQL}, o AS (SELECT * FROM prop WHERE term NOT IN (SELECT term_key FROM d_vocab)), pool AS (SELECT file_id, term, min(seq) AS place FROM o GROUP BY ALL),
 c AS (SELECT o.file_id, o.seq, p.term AS new_term, jaro_winkler_similarity(o.error_found, p.term) AS s, p.place FROM o JOIN pool p ON p.file_id = o.file_id AND p.term <> o.term AND p.term <> o.error_found
   WHERE o.error_found <> o.term AND jaro_winkler_similarity(o.error_found, p.term) > 0.75 AND jaro_winkler_similarity(o.error_found, p.term) > jaro_winkler_similarity(o.error_found, o.term)),
 b AS (SELECT file_id, seq, new_term FROM (SELECT *, row_number() OVER (PARTITION BY file_id, seq ORDER BY round(s, 10) DESC, place) AS r FROM c) WHERE r = 1)
SELECT prop.file_id, prop.seq, prop.term, b.new_term FROM prop LEFT JOIN b ON b.file_id = prop.file_id AND b.seq = prop.seq""",
)
def _(t):
    return alt.pool_override(_proposals(t), t.vocab).select("file_id", "seq", "term", "new_term")


@query(
    "snippet_override",
    rf"""WITH {PROPOSALS_SQL}, sn AS (SELECT substr(k, 1, 99) AS query_key, row_number() OVER (PARTITION BY k ORDER BY item_id) AS rank, text FROM (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS k FROM benchmark)),
 ent AS (SELECT DISTINCT query_key, unnest(list_filter(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-zA-Z0-9]+)(?:$|[^\p{{L}}\p{{N}}_])', 1), lambda x: length(x) >= 4)) AS e FROM sn WHERE rank <= 3),
 ask AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS r FROM prop WHERE error_found <> term AND term NOT IN (SELECT term_key FROM d_vocab)) WHERE r <= 8),
 c AS (SELECT a.file_id, a.seq, ent.e, jaro_winkler_similarity(a.error_found, lower(ent.e)) AS s FROM ask a JOIN ent ON ent.query_key = a.error_found AND lower(ent.e) <> a.error_found
  WHERE jaro_winkler_similarity(a.error_found, lower(ent.e)) > 0.75 AND jaro_winkler_similarity(a.error_found, lower(ent.e)) > jaro_winkler_similarity(a.error_found, a.term))
SELECT p.file_id, p.seq, round(max(c.s), 6) AS new_sim FROM prop p LEFT JOIN c ON c.file_id = p.file_id AND c.seq = p.seq GROUP BY p.file_id, p.seq""",
)
def _(t):
    from pyspark.sql import Window

    k = t.benchmark.select("item_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("query_key"))
    sn = k.select("query_key", F.row_number().over(Window.partitionBy("query_key").orderBy("item_id")).alias("rank"), F.lit("").alias("title"), F.col("text").alias("body"))
    return alt.snippet_override(_proposals(t), sn, t.vocab).select("file_id", "seq", F.round("new_sim", 6).alias("new_sim"))


@query(
    "titles_by_prefix",
    r"""WITH q AS (SELECT DISTINCT left(term, 4) AS query FROM d_vocab), ti AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+ [a-z]+')) AS title FROM benchmark),
 m AS (SELECT q.query, ti.title, row_number() OVER (PARTITION BY q.query ORDER BY length(ti.title), ti.title) AS r FROM q JOIN ti ON starts_with(lower(ti.title), q.query))
SELECT query, CAST(r AS INT) AS rank, title FROM m WHERE r <= 5""",
)
def _(t):
    q = t.vocab.select(F.left("term", F.lit(4)).alias("query"))
    ti = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ [a-z]+"), F.lit(0))).alias("title"))
    return matching.titles_by_prefix(q, ti)


@query("matching_slices")
def _(t):
    v = rc.overlapping_versions(t.noisy_segments, t.retranscripts)
    return v.select("file_id", "segment_id", "range_no", F.md5(rc.matching_slice("text", "other_text")).alias("slice_md5"))


@query(
    "length_and_protection",
    r"""WITH c AS (SELECT file_id, utt, ref, hyp, len(list_filter(string_split_regex(ref, '\s+'), lambda w: w <> '')) AS n, len(list_filter(string_split_regex(hyp, '\s+'), lambda w: w <> '')) AS m FROM d_pairs)
SELECT file_id, utt, abs(n - m) <= greatest(3.0, n * 0.3) AS sane, NOT (contains(lower(ref), 'there') AND NOT contains(lower(hyp), 'there')) AS kept FROM c""",
)
def _(t):
    return t.pairs.select("file_id", "utt", rc.length_sane("ref", "hyp").alias("sane"), rc.keeps_protected("ref", "hyp", F.array(F.lit("There"))).alias("kept"))


def _names_said(t):
    """Person names of the vocabulary in the files where they are said, with the first place."""
    names = t.vocab.where("category = 'person_name'").select("term", "term_key")
    said = t.noisy_words.select("file_id", F.lower(tx.strip_punct("clean_word")).alias("w"), (F.col("segment_id").cast("bigint") * 1_000_000 + F.col("pos")).alias("at"))
    return said.join(names, F.col("w") == F.col("term_key")).groupBy("file_id", "term").agg(F.min("at").alias("pos"))


def _reconciled(t):
    stored(t, "vocab", "noisy_words", "noisy_segments", "detections", "retranscripts", "answers")
    cand = _detected(t)
    protected = _names_said(t).select("file_id", "term")
    lines = ev.quick_hints(ev.screen_lines(t.frames)).select("file_id", "line")
    return rc.reconcile(t.noisy_segments, t.retranscripts, t.answers, t.vocab, cand, protected, lines)


@query("reconciled_segments")
def _(t):
    segs, _ = _reconciled(t)
    return segs.select("file_id", "segment_id", F.md5("text").alias("text_md5"), "changed")


@query("reconciled_swaps")
def _(t):
    _, swaps = _reconciled(t)
    return swaps.select("file_id", "segment_id", "range_no", "k", "old_word", "new_word", "status", "swap_confidence")


@query(
    "applied_replacements",
    """WITH last AS (SELECT a.file_id, a.segment_id, max(r.range_no) AS range_no FROM (SELECT DISTINCT file_id, segment_id FROM d_noisy_words WHERE word <> clean_word) a JOIN d_segments s USING (file_id, segment_id)
  JOIN d_ranges r ON r.file_id = s.file_id AND s.start_s < r.end_s AND s.end_s > r.start_s GROUP BY ALL)
SELECT s.file_id, s.segment_id, md5(CASE WHEN l.range_no IS NOT NULL THEN l.range_no || ':' || s.text ELSE s.text END) AS text_md5, l.range_no IS NOT NULL AS changed
FROM d_noisy_segments s LEFT JOIN last l ON l.file_id = s.file_id AND l.segment_id = s.segment_id""",
)
def _(t):
    bad = t.flagged.select("file_id", "segment_id", "start_s", "end_s").join(t.noisy_segments.select("file_id", "segment_id", "text"), ["file_id", "segment_id"])
    hit = iv.overlap_join(bad, t.ranges.select("file_id", "range_no", "start_s", "end_s"), ["file_id"], closed=False)
    acc = hit.select("file_id", "segment_id", "range_no", F.concat(F.col("range_no").cast("string"), F.lit(":"), "text").alias("new_text"))
    return rc.apply_replacements(t.noisy_segments, acc).select("file_id", "segment_id", F.md5("text").alias("text_md5"), "changed")


# --------------------------------------------------------------------------
# lips
# --------------------------------------------------------------------------

MAR_SQL = """mar AS (SELECT file_id, segment_id, frame_no, round(nose_x, 1) + 0.0::DOUBLE AS face, CASE WHEN sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) < 1e-6 THEN 0
 ELSE sqrt((upper_x - lower_x) ** 2 + (upper_y - lower_y) ** 2) / sqrt((left_x - right_x) ** 2 + (left_y - right_y) ** 2) END AS r FROM d_landmarks)"""


@query("mouth_ratios", f"WITH {MAR_SQL} SELECT file_id, segment_id, frame_no, round(r, 6) AS mouth_ratio FROM mar")
def _(t):
    return lips.mouth_ratio(t.landmarks).select("file_id", "segment_id", "frame_no", F.round("mouth_ratio", 6).alias("mouth_ratio"))


@query(
    "active_speakers",
    f"""WITH {MAR_SQL}, f AS (SELECT file_id, segment_id, face, stddev_pop(r) AS sd, avg(r) AS m, count(*) AS n, min(frame_no) AS ff FROM mar GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY file_id, segment_id ORDER BY CASE WHEN n >= 2 THEN sd ELSE 0 END DESC, ff, face) AS k, count(*) OVER (PARTITION BY file_id, segment_id) AS nf FROM f),
 t AS (SELECT file_id, segment_id, count(DISTINCT frame_no) AS nt FROM mar GROUP BY ALL)
SELECT b.file_id, b.segment_id, b.face AS active_speaker_id, CAST(nf AS INT) AS num_faces, round((0.6 * least(sd / 0.05, 1) + 0.4 * least(m / 0.15, 1)) * n / nt, 3)::DOUBLE AS speaking_confidence
FROM b JOIN t ON t.file_id = b.file_id AND t.segment_id = b.segment_id WHERE k = 1""",
)
def _(t):
    return lips.active_speakers(t.landmarks).drop("face_detected")


ELIG_SQL = """c AS (SELECT DISTINCT w.file_id, w.segment_id FROM d_noisy_words w JOIN d_lookup e ON e.error_key = lower(trim(w.word, '.,!?;:''"()[]')) WHERE e.category IN ('person_name', 'content_word', 'custom')),
 u AS (SELECT f.file_id, f.segment_id, f.start_s, f.end_s, row_number() OVER (PARTITION BY f.file_id, round(f.start_s, 1), round(f.end_s, 1) ORDER BY f.segment_id) AS d FROM d_flagged f JOIN c USING (file_id, segment_id) WHERE f.start_s < f.end_s),
 e AS (SELECT file_id, segment_id, start_s, end_s, CAST(row_number() OVER (PARTITION BY file_id ORDER BY segment_id) AS INT) AS rank FROM u WHERE d = 1)"""


def _eligible(t):
    w = t.noisy_words.withColumn("word_key", tx.strip_punct("word"))
    c = vo.known_error_hits(w, t.vocab).select("file_id", "segment_id", "category")
    return lips.eligible_segments(t.flagged, c)


@query("lip_eligible_segments", f"WITH {ELIG_SQL} SELECT file_id, segment_id, rank, round(greatest(start_s - 0.5, 0), 6) AS look_from, round(end_s + 0.5, 6) AS look_to FROM e WHERE rank <= 20")
def _(t):
    return _eligible(t).select("file_id", "segment_id", "rank", F.round("look_from", 6).alias("look_from"), F.round("look_to", 6).alias("look_to"))


@query(
    "lip_usable_hints",
    f"""WITH {ELIG_SQL} SELECT file_id, segment_id, ((segment_id * 37 + file_id * 11) % 100)::DOUBLE / 100 AS confidence FROM e WHERE rank <= 20 AND ((segment_id * 37 + file_id * 11) % 100 >= 55 OR segment_id % 4 = 0) AND segment_id % 5 <> 4""",
)
def _(t):
    k = F.col("segment_id")
    h = t.segments.select(
        "file_id", "segment_id", (k % 5 != 4).alias("face_detected"), (((k * 37 + F.col("file_id") * 11) % 100).cast("double") / 100).alias("speaking_confidence"),
        F.when(k % 4 == 0, "some words").alias("lip_transcript"), F.lit(1).alias("num_faces"),
    )
    return lips.usable_hints(_eligible(t), h).select("file_id", "segment_id", "confidence")


# --------------------------------------------------------------------------
# whole correction and analysis runs
# --------------------------------------------------------------------------


def _run(t):
    from verbascope.plans.correction import CorrectionInputs, CorrectionSettings, correct_corpus

    stored(t, "vocab", "noisy_words", "noisy_segments", "detections", "retranscripts", "answers")
    screen = _names_said(t).select("file_id", "pos", "term", F.lit("product").alias("type"))
    inputs = CorrectionInputs(
        segments=t.noisy_segments, words=t.noisy_words, vocab=t.vocab, detections=t.detections, answers=t.answers,
        retranscripts=t.retranscripts, frames=t.frames.select("file_id", "ts", "text"), screen_terms=screen,
    )
    return correct_corpus(inputs, CorrectionSettings())


@query(
    "correction_run_texts",
    "SELECT file_id, count(*) AS n_segments FROM d_noisy_segments GROUP BY file_id",
)
def _(t):
    r = _run(t)
    return r.segments.groupBy("file_id").agg(F.count("*").alias("n_segments"))


@query(
    "correction_run_totals",
    """SELECT f.file_id, (SELECT count(*) FROM d_segments s WHERE s.file_id = f.file_id) AS total_segments, (SELECT count(*) FROM d_retranscripts r WHERE r.file_id = f.file_id) AS retranscripts,
 (SELECT count(*) FROM d_vocab) AS vocab FROM (SELECT DISTINCT file_id FROM d_segments) f""",
)
def _(t):
    """Of the selector block and the evidence counts what the tables tell without the run."""
    r = _run(t)
    return r.evidence.join(r.selector, "file_id").select("file_id", "total_segments", "retranscripts", "vocab")


@query("correction_run_report")
def _(t):
    return _run(t).report.withColumn("results", F.array_join("results", "; "))


@query("correction_run_examples")
def _(t):
    e = _run(t).examples
    return e.select("metadata.file_id", "metadata.term", "metadata.category", "metadata.error_found", F.size("messages").alias("n_messages"))


@query(
    "analysis_run",
    """SELECT s.file_id, 'field' AS field, any_value(s.speaker) IS NOT NULL AS ok, (SELECT count(*) FROM d_noisy_words w WHERE w.file_id = s.file_id AND w.word <> w.clean_word) > 0 AS has_errors
FROM d_noisy_segments s WHERE s.file_id IN (SELECT file_id FROM d_noisy_words WHERE word <> clean_word) GROUP BY s.file_id""",
)
def _(t):
    from verbascope.plans.correction import analyse_corpus

    stored(t, "vocab", "noisy_words", "noisy_segments", "detections")
    topics = t.noisy_segments.groupBy("file_id").agg(F.lit('{"field":"field","topic":"x"}').alias("response"))
    a = analyse_corpus(t.noisy_segments, t.noisy_words, t.vocab, t.detections.where("n_bad > 0"), topics)
    quiet = t.flagged.select("file_id").distinct()
    return a.join(quiet, "file_id", "left_semi").select("file_id", "field", F.lit(True).alias("ok"), (F.col("n_errors") > 0).alias("has_errors"))
