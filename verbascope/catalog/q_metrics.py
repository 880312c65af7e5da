"""Error-rate queries over every utterance of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbascope.catalog.q_text import nmet, nws, nwer, ws
from verbascope.catalog.registry import query
from verbascope.functions import similarity as sim, text as tx
from verbascope.operators import metrics as me
from verbascope.operators.ordered import running
from verbascope.operators.positions import scan_terms

KEYS = ["file_id", "utt"]
ENC = "array_to_string(list_transform({0}, lambda x: chr(CAST(list_position({1}, x) AS INT))), '')".format
def corrected():
    """The noisy text with the marked words restored."""
    return F.regexp_replace("hyp", "(^| )zz", "$1")


def rates(t):
    """Per utterance: word counts and errors of the raw and the corrected text."""
    base = me.word_error_rates(t.pairs).select(*KEYS, "dataset", "accent", "ref", corrected().alias("cor"), F.col("word_errors").alias("base_errors"))
    both = me.word_error_rates(base, "ref", "cor")
    return both.select(*KEYS, "dataset", "accent", "ref_word_count", F.col("base_errors").alias("word_errors"), F.col("word_errors").alias("cor_errors"))


def file_rates(t):
    g = rates(t).groupBy("file_id", "dataset", "accent").agg(
        F.sum("ref_word_count").alias("ref_word_count"), F.sum("word_errors").alias("e"), F.sum("cor_errors").alias("c")
    )
    rate = lambda x: F.round(F.col(x) * 100.0 / F.nullif("ref_word_count", F.lit(0)), 2)
    return g.select("file_id", "dataset", "accent", "ref_word_count", rate("e").alias("baseline_wer"), rate("c").alias("corrected_wer")).withColumn(
        "wer_improvement", F.round(F.col("baseline_wer") - F.col("corrected_wer"), 2)
    )


IMPROVED_SQL = "SELECT *, round(baseline_wer - corrected_wer, 2) AS wer_improvement FROM d_file_rates"


@query(
    "wer_by_dataset_accent",
    """SELECT dataset, accent, count(*) AS utterances, sum(ref_word_count)::BIGINT AS ref_words, sum(word_errors)::BIGINT AS errors,
  round(sum(word_errors) * 100.0 / nullif(sum(ref_word_count), 0), 4) AS wer_pct FROM d_rates GROUP BY dataset, accent""",
)
def _(t):
    r = me.word_error_rates(t.pairs)
    return r.groupBy("dataset", "accent").agg(
        F.count("*").alias("utterances"), F.sum("ref_word_count").alias("ref_words"), F.sum("word_errors").alias("errors"),
        F.round(F.sum("word_errors") * 100.0 / F.nullif(F.sum("ref_word_count"), F.lit(0)), 4).alias("wer_pct"),
    )


A1_SQL = f"""WITH n AS (SELECT file_id, utt, {nwer('ref')} AS r, {nwer('hyp')} AS h FROM d_pairs),
 w AS (SELECT *, {ws('r')} AS rw, {ws('h')} AS hw, string_split(r, '') AS rc, string_split(h, '') AS hc FROM n),
 b AS (SELECT *, list_distinct(list_concat(rw, hw)) AS wb, list_distinct(list_concat(rc, hc)) AS cb FROM w),
 e AS (SELECT file_id, utt, r, h, len(rw) AS rn, len(hw) AS hn, levenshtein({ENC('rw', 'wb')}, {ENC('hw', 'wb')}) AS we, levenshtein({ENC('rc', 'cb')}, {ENC('hc', 'cb')}) AS ce FROM b)
SELECT file_id, utt, CAST(rn AS INT) AS ref_word_count, CAST(hn AS INT) AS hyp_word_count, CAST(we AS INT) AS word_errors,
 CASE WHEN rn = 0 AND hn = 0 THEN 0.0::DOUBLE WHEN rn = 0 THEN 'inf'::DOUBLE ELSE we::DOUBLE / rn END AS wer,
 CASE WHEN length(r) = 0 AND length(h) = 0 THEN 0.0::DOUBLE WHEN length(r) = 0 THEN 'inf'::DOUBLE ELSE ce::DOUBLE / length(r) END AS cer FROM e"""


@query("wer_cer_utterances", A1_SQL)
def _(t):
    return me.error_rates(t.pairs).select(*KEYS, "ref_word_count", "hyp_word_count", "word_errors", "wer", "cer")


@query("wer_documents")
def _(t):
    """Whole documents against their noisy versions, texts uncut."""
    hyp = F.array_join(
        F.flatten(F.transform(tx.tokens("text"), lambda w, i: F.when((i * 7 + F.col("doc_id")) % 23 == 0, F.array().cast("array<string>")).when((i * 7 + F.col("doc_id")) % 23 == 1, F.array(F.concat(F.lit("zz"), w))).otherwise(F.array(w)))), " "
    )
    d = t.documents.select("doc_id", F.col("text").alias("ref"), hyp.alias("hyp"))
    return me.word_error_rates(d).select("doc_id", "ref_word_count", "hyp_word_count", "word_errors", F.round("wer", 6).alias("wer"))


@query(
    "alignment_error_totals",
    f"""WITH n AS (SELECT file_id, utt, {nwer('ref')} AS r, {nwer('hyp')} AS h FROM d_pairs), w AS (SELECT *, {ws('r')} AS rw, {ws('h')} AS hw FROM n),
 b AS (SELECT *, list_distinct(list_concat(rw, hw)) AS wb FROM w)
SELECT file_id, utt, CAST(levenshtein({ENC('rw', 'wb')}, {ENC('hw', 'wb')}) AS INT) AS errors, CAST(len(rw) AS INT) AS ref_word_count, CAST(len(hw) AS INT) AS hyp_word_count FROM b""",
)
def _(t):
    c = me.error_counts(me.aligned(t.pairs))
    return c.select(
        *KEYS, (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"),
        (F.col("hits") + F.col("substitutions") + F.col("deletions")).alias("ref_word_count"),
        (F.col("hits") + F.col("substitutions") + F.col("insertions")).alias("hyp_word_count"),
    )


@query("alignment_counts")
def _(t):
    c = me.hit_percentage(me.error_counts(me.aligned(t.pairs)))
    return c.select(*KEYS, "hits", "substitutions", "deletions", "insertions", F.round("wer", 6).alias("wer"), "hits_pct")


@query("word_diff")
def _(t):
    return me.word_diff(me.aligned(t.pairs), KEYS)


@query(
    "diff_word_totals",
    f"""WITH n AS (SELECT {ws(nwer('ref'))} AS rw, {ws(nwer('hyp'))} AS hw FROM d_pairs) SELECT 'ref' AS side, sum(len(rw))::BIGINT AS n FROM n UNION ALL SELECT 'hyp', sum(len(hw))::BIGINT FROM n""",
)
def _(t):
    d = me.word_diff(me.aligned(t.pairs), KEYS)
    one = d.select(F.explode(F.array(F.struct(F.lit("ref").alias("side"), (F.col("type") != "insert").alias("u")), F.struct(F.lit("hyp").alias("side"), (F.col("type") != "delete").alias("u")))).alias("x"))
    return one.groupBy("x.side").agg(F.count_if("x.u").alias("n"))


@query("tter_aligned")
def _(t):
    # The vocabulary is single words of letters: its whole-word hits are the pair's own words that are terms.
    p = t.pairs.select(*KEYS, tx.norm_metric("ref").alias("ref"), tx.norm_metric("hyp").alias("hyp"))
    p = p.withColumn("own", scan_terms(F.col("ref"), t.vocab, word_boundary=True)["term_key"])
    return me.tter_of_targets(p, F.col("own"), KEYS).where("target_total > 0 OR insertions > 0")


REGION_SQL = rf"""WITH p AS (SELECT file_id, utt, {nws('ref')} AS r, {nws('hyp')} AS h FROM d_pairs),
 tok AS (SELECT file_id, utt, ws[i] AS w, CAST(sum(length(ws[i]) + 1) OVER (PARTITION BY file_id, utt ORDER BY i) - length(ws[i]) - 1 AS BIGINT) AS off
   FROM (SELECT file_id, utt, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT file_id, utt, {ws('r')} AS ws FROM p))),
 hit AS (SELECT w, term_key, unnest(list_filter(range(1, length(w) - length(term_key) + 2), lambda q: substr(w, q, length(term_key)) = term_key)) AS q FROM (SELECT DISTINCT w FROM tok) JOIN d_vocab ON contains(w, term_key)),
 o AS (SELECT tok.file_id, tok.utt, hit.term_key, off + q - 1 AS pos, length(p.h)::DOUBLE / greatest(length(p.r), 1) AS ratio, p.h FROM tok JOIN hit USING (w) JOIN p ON p.file_id = tok.file_id AND p.utt = tok.utt),
 g AS (SELECT *, substr(h, greatest(floor(pos * ratio)::BIGINT - 120, 0) + 1, least(length(h), floor((pos + length(term_key)) * ratio)::BIGINT + 120) - greatest(floor(pos * ratio)::BIGINT - 120, 0)) AS region FROM o),
 occ AS (SELECT g.file_id, g.utt, v.term, v.category, CAST(g.pos AS INT) AS ref_pos, CASE WHEN contains(region, g.term_key) THEN 'correct' WHEN len(v.known_errors) > 0 AND contains(region, v.known_errors[1]) THEN 'known_substitution' ELSE 'missing_or_unknown' END AS status
   FROM g JOIN d_vocab v ON v.term_key = g.term_key)"""


def _occ(t):
    return me.tter_region_occurrences(t.pairs, t.vocab, KEYS)


@query("tter_region_occurrences", REGION_SQL + " SELECT * FROM occ")
def _(t):
    return _occ(t).drop("found_as")


@query(
    "tter_region_by_term",
    REGION_SQL + """ SELECT file_id, utt, term, category, count(*) AS occurrences, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status <> 'correct') AS errors,
 round(count(*) FILTER (status <> 'correct') / count(*) * 100, 1) AS tter FROM occ GROUP BY ALL""",
)
def _(t):
    return me.tter_region_by_term(t.pairs, t.vocab, KEYS)


@query(
    "tter_region_by_pair",
    REGION_SQL + """ SELECT file_id, utt, round(count(*) FILTER (status <> 'correct') / count(*) * 100, 2) AS overall_tter, count(*) AS total_occurrences, count(*) FILTER (status = 'correct') AS total_correct,
 count(*) FILTER (status <> 'correct') AS total_errors, count(DISTINCT term) AS terms_tracked FROM occ GROUP BY file_id, utt""",
)
def _(t):
    return me.tter_region_by_pair(t.pairs, t.vocab, KEYS)


@query("compare_transcripts")
def _(t):
    """Rates, counts, edit list and region term errors of every pair."""
    c = me.compare(t.pairs, t.vocab, KEYS)
    return c.withColumn("diff", F.md5(F.to_json("diff")))


@query(
    "compared_words",
    f"""WITH n AS (SELECT file_id, utt, {ws(nwer('ref'))} AS rw, {ws(nwer('hyp'))} AS hw FROM d_pairs)
SELECT file_id, utt, md5(array_to_string(rw, ' ')) AS ref_md5, md5(array_to_string(hw, ' ')) AS hyp_md5, CAST(len(rw) AS INT) AS ref_word_count FROM n""",
)
def _(t):
    """The edit list of every pair, replayed: its reference side and its hypothesis side are the two texts again."""
    c = me.compare(t.pairs, t.vocab, KEYS)
    side = lambda word, without: F.md5(F.array_join(F.transform(F.filter("diff", lambda d: d["type"] != without), lambda d: d[word]), " "))
    return c.select(*KEYS, side("ref_word", "insert").alias("ref_md5"), side("hyp_word", "delete").alias("hyp_md5"), "ref_word_count")


@query(
    "dataset_summary",
    """SELECT dataset, count(*) AS files, round(avg(baseline_wer), 2) AS avg_wer_pct, round(avg(corrected_wer), 2) AS avg_tter_pct, sum(file_id % 7)::BIGINT AS total_target_terms, sum(ref_word_count)::BIGINT AS total_target_positions FROM d_file_rates GROUP BY dataset""",
)
def _(t):
    f = file_rates(t).select("dataset", F.col("baseline_wer").alias("wer_pct"), F.col("corrected_wer").alias("tter_pct"), (F.col("file_id") % 7).alias("target_term_count"), F.col("ref_word_count").alias("target_total_in_ref"))
    return me.dataset_summary(f)


@query(
    "overall_summary",
    f"""SELECT count(*) AS n, round(avg(baseline_wer), 2) AS avg_baseline_wer, round(avg(corrected_wer), 2) AS avg_corrected_wer, round(avg(wer_improvement), 2) AS absolute_improvement,
 round((avg(baseline_wer) - avg(corrected_wer)) / avg(baseline_wer) * 100, 1) AS relative_improvement_pct FROM ({IMPROVED_SQL})""",
)
def _(t):
    return me.overall_summary(file_rates(t))


@query(
    "accent_breakdown",
    f"""SELECT accent, count(*) AS n, round(avg(baseline_wer), 2) AS avg_baseline_wer, round(avg(corrected_wer), 2) AS avg_corrected_wer, round(avg(wer_improvement), 2) AS avg_wer_improvement FROM ({IMPROVED_SQL}) GROUP BY accent""",
)
def _(t):
    return me.accent_breakdown(file_rates(t))


@query(
    "dataset_cards",
    "SELECT dataset, round(avg(baseline_wer), 2) AS avg_baseline_wer, max(baseline_wer) AS worst_wer, sum(ref_word_count)::BIGINT AS ref_words FROM d_file_rates GROUP BY dataset",
)
def _(t):
    return me.dataset_cards(file_rates(t))


@query(
    "improvement_classes",
    f"SELECT CASE WHEN wer_improvement > 0 THEN 'IMPROVED' WHEN wer_improvement < 0 THEN 'DEGRADED' ELSE 'NO CHANGE' END AS verdict, count(*) AS n FROM ({IMPROVED_SQL}) GROUP BY ALL",
)
def _(t):
    return me.improvement_class(file_rates(t)).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "modality_ablation",
    """SELECT file_id, baseline_wer AS wer_without, corrected_wer AS wer_with, round(baseline_wer - corrected_wer, 2) AS gain FROM d_file_rates WHERE baseline_wer IS NOT NULL""",
)
def _(t):
    f = file_rates(t)
    long = f.select("file_id", F.explode(F.array(F.struct(F.lit("without").alias("variant"), F.col("baseline_wer").alias("wer_pct")), F.struct(F.lit("with").alias("variant"), F.col("corrected_wer").alias("wer_pct")))).alias("x")).select("file_id", "x.*")
    return me.ablation(long)


@query(
    "batch_evaluation",
    """SELECT file_id, dataset, accent, baseline_wer, CASE WHEN accent = 'de' THEN baseline_wer ELSE corrected_wer END AS corrected_wer,
 CASE WHEN accent = 'de' THEN round(baseline_wer - baseline_wer, 2) ELSE round(baseline_wer - corrected_wer, 2) END AS wer_improvement FROM d_file_rates""",
)
def _(t):
    """Files without a corrected result (here one accent) keep their baseline rate."""
    f = file_rates(t)
    base = f.select("file_id", "dataset", "accent", F.col("baseline_wer").alias("wer_pct"))
    cor = f.where("accent <> 'de'").select("file_id", F.col("corrected_wer").alias("wer_pct"))
    return me.compare_variants(base, cor, ["file_id"])


@query(
    "latency_percentiles",
    """SELECT round(quantile_cont(duration_ms, 0.5), 1) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 1) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 1) AS p99_ms FROM d_jobs""",
)
def _(t):
    return me.latency_percentiles(t.jobs, "duration_ms")


@query(
    "latency_percentiles_by_type",
    """SELECT job_type, round(quantile_cont(duration_ms, 0.5), 1) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 1) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 1) AS p99_ms FROM d_jobs GROUP BY job_type""",
)
def _(t):
    return me.latency_percentiles(t.jobs, "duration_ms", ["job_type"])


@query(
    "worst_files",
    "SELECT file_id, dataset, accent, baseline_wer FROM d_file_rates ORDER BY baseline_wer DESC NULLS LAST, file_id",
)
def _(t):
    return file_rates(t).orderBy(F.desc_nulls_last("baseline_wer"), "file_id").select("file_id", "dataset", "accent", "baseline_wer")


@query(
    "files_sorted_by_improvement",
    f"SELECT file_id, CAST(row_number() OVER (ORDER BY coalesce(wer_improvement, 0) DESC, file_id) AS BIGINT) AS place FROM ({IMPROVED_SQL})",
)
def _(t):
    v = file_rates(t).select("file_id", F.coalesce("wer_improvement", F.lit(0.0)).alias("v"))
    placed = running(v, [], F.floor(-F.col("v")), [F.desc("v"), F.col("file_id")], F.lit(1).cast("bigint"), "place", inclusive=True)
    return placed.select("file_id", "place")


@query(
    "eval_union",
    """SELECT dataset, count(*) AS files FROM (SELECT 'documents' AS dataset, doc_id AS id FROM documents UNION ALL SELECT 'benchmark', item_id FROM benchmark UNION ALL SELECT 'conversations', conv_id FROM conversations) GROUP BY dataset""",
)
def _(t):
    parts = [t.documents.select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("id")), t.benchmark.select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("id")), t.conversations.select(F.lit("conversations").alias("dataset"), F.col("conv_id").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("dataset").agg(F.count("*").alias("files"))


@query(
    "pair_discovery",
    """WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels)
SELECT doc_id AS file_id, 'paired' AS state FROM a SEMI JOIN b USING (doc_id) UNION ALL SELECT doc_id, 'no label' FROM a ANTI JOIN b USING (doc_id)""",
)
def _(t):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    ok = a.join(b, "doc_id").select(F.col("doc_id").alias("file_id"), F.lit("paired").alias("state"))
    return ok.unionByName(a.join(b, "doc_id", "left_anti").select(F.col("doc_id").alias("file_id"), F.lit("no label").alias("state")))
