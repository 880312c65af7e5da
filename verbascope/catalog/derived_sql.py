"""The derivation rules of ``derive`` once more, as DuckDB SQL."""

DERIVED_SQL = {
    "d_segments": r"""
SELECT conv_id AS file_id, CAST(turn AS INT) AS segment_id, role AS speaker, text,
       CAST(COALESCE(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 15 AS start_s,
       CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 15 AS end_s
FROM conversations""",
    "d_words": r"""
SELECT file_id, segment_id, CAST(i - 1 AS INT) AS pos, ws[i] AS word, start_s, end_s, speaker,
       CAST(((i - 1) * 11 + length(ws[i]) * 37) % 100 AS DOUBLE) / 100 AS probability
FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (
  SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM d_segments))""",
    "d_vocab": r"""
SELECT term, term AS term_key, category, known_errors, pos FROM (
  SELECT word AS term, CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS INT) AS pos,
    CASE length(word) % 5 WHEN 0 THEN 'person_name' WHEN 1 THEN 'product_name' WHEN 2 THEN 'tech_term'
         WHEN 3 THEN 'content_word' ELSE 'feature' END AS category,
    CASE WHEN (row_number() OVER (ORDER BY n DESC, word) - 1) % 3 = 2 THEN CAST([] AS VARCHAR[]) ELSE [substr(word, 1, 2) || substr(word, 4)] END AS known_errors
  FROM (SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents) GROUP BY word HAVING count(*) >= 32))""",
    "d_errors": "SELECT unnest(known_errors) AS error_key, term, term_key, category, pos FROM d_vocab",
    "d_lookup": "SELECT error_key, max_by(term, pos) AS term, max_by(category, pos) AS category, max_by(term_key, pos) AS term_key FROM d_errors GROUP BY error_key",
    "d_noisy_words": r"""
SELECT w.file_id, w.segment_id, w.pos, w.start_s, w.end_s, w.speaker, w.probability, w.word AS clean_word,
       CASE WHEN e.error_key IS NOT NULL AND (w.segment_id + w.pos) % 3 = 0 THEN e.error_key ELSE w.word END AS word
FROM d_words w LEFT JOIN d_errors e ON lower(trim(w.word, '.,!?;:''"()[]')) = e.term_key""",
    "d_noisy_segments": r"""
SELECT file_id, segment_id, any_value(speaker) AS speaker, any_value(start_s) AS start_s, any_value(end_s) AS end_s,
       string_agg(word, ' ' ORDER BY pos) AS text
FROM d_noisy_words GROUP BY file_id, segment_id""",
    "d_pairs": r"""
SELECT file_id, utt, dataset, accent, ref,
  array_to_string(flatten(list_transform(list_filter(string_split_regex(ref, '\s+'), lambda w: w <> ''),
    lambda w, i: CASE (i * 7 + utt * 3 + file_id) % 23 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['zz' || w] WHEN 2 THEN [w, w] ELSE [w] END)), ' ') AS hyp
FROM (SELECT doc_id AS file_id, source AS dataset, lang AS accent, CAST(k - 1 AS INT) AS utt, us[k] AS ref FROM (
  SELECT *, unnest(range(1, len(us) + 1)) AS k FROM (
    SELECT doc_id, source, lang, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
      lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS us FROM documents)))""",
    "d_frames": r"""
SELECT page_id // 20 AS file_id, CAST(10 * (page_id % 20) AS DOUBLE) AS ts, 'slide' AS type, page_id,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS text
FROM pages""",
    "d_jobs": r"""
SELECT CAST(event_id AS VARCHAR) AS job_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'correction' ELSE 'evaluation' END AS job_type,
  CAST(user_id AS VARCHAR) AS file_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status,
  ts AS created_at, ts + to_microseconds(CAST(floor(value * 1000000) AS BIGINT)) AS completed_at, value * 1000 AS duration_ms,
  CAST(json_extract(props, '$.k') AS INT) AS corrections_attempted, CAST(json_extract(props, '$.k') AS INT) // 2 AS corrections_applied,
  CAST(CAST(json_extract(props, '$.k') AS INT) % 11 AS DOUBLE) / 10 AS avg_confidence
FROM events""",
    "d_steps": r"""
SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS job_id, event_id AS seq,
  ['vocab_merge', 'candidate_detection', 'ocr_extraction', 'ml_inference', 'custom_check', 'complete'][1 + CAST(event_id % 6 AS INT)] AS name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' WHEN 'signup' THEN 'skipped' ELSE 'completed' END AS status,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 1000 END AS duration_ms,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS details, ts AS updated_at
FROM events""",
    "d_examples": r"""
SELECT d.doc_id AS example_id, d.source, CASE length(word) % 4 WHEN 0 THEN 'proper_noun' WHEN 1 THEN 'content_word' WHEN 2 THEN 'tech_term' ELSE 'numeric_term' END AS category,
  word AS term, CASE CAST(d.doc_id + i AS INT) % 5 WHEN 0 THEN word WHEN 1 THEN word || ',' WHEN 2 THEN substr(word, 1, 2) || substr(word, 4) WHEN 3 THEN 'x' || word ELSE reverse(word) END AS error_found,
  COALESCE(l.quality, 0) = 1 AS applied, COALESCE(l.toxic, 0) = 1 OR CAST(d.doc_id + i AS INT) % 4 = 0 AS is_negative,
  CAST(d.doc_id + i AS INT) % 8 = 0 AS is_hard_negative, CAST(i AS INT) AS seq,
  CAST(d.doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) AS example_key
FROM (SELECT doc_id, source, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
  SELECT doc_id, source, lang, list_distinct_sorted AS ws FROM (
    SELECT doc_id, source, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS list_distinct_sorted FROM documents))) d
CROSS JOIN LATERAL (SELECT d.ws[d.i] AS word)
LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "d_landmarks": r"""
SELECT label AS file_id, CAST(vec_id // 8 AS INT) AS segment_id, CAST(vec_id % 8 AS INT) AS frame_no,
  CAST(embedding[1] AS DOUBLE) AS nose_x, CAST(embedding[2] AS DOUBLE) AS upper_x, CAST(embedding[3] AS DOUBLE) AS upper_y,
  CAST(embedding[4] AS DOUBLE) AS lower_x, CAST(embedding[5] AS DOUBLE) AS lower_y, CAST(embedding[6] AS DOUBLE) AS left_x,
  CAST(embedding[7] AS DOUBLE) AS left_y, CAST(embedding[8] AS DOUBLE) AS right_x, CAST(embedding[9] AS DOUBLE) AS right_y
FROM embeddings""",
    "d_detections": r"""
SELECT file_id, segment_id, CAST(sum(length(text) + 1) OVER (PARTITION BY file_id ORDER BY segment_id) - length(text) - 1 AS INT) AS chunk_start, n_bad,
  CASE WHEN segment_id % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS response
FROM (SELECT s.file_id, s.segment_id, s.text, COALESCE(b.n_bad, 0) AS n_bad,
   '{"' || CASE WHEN s.segment_id % 3 = 0 THEN 'errors' ELSE 'suspects' END || '":[' || COALESCE(b.items, '') || '],"confidence":0.9}' AS body
 FROM d_noisy_segments s LEFT JOIN (
   SELECT file_id, segment_id, count(*) AS n_bad, string_agg('{"word":"' || word || '","likely_correct":"' || lower(trim(clean_word, '.,!?;:''"()[]')) || '"}', ',' ORDER BY pos) AS items
   FROM d_noisy_words WHERE word <> clean_word GROUP BY file_id, segment_id) b ON b.file_id = s.file_id AND b.segment_id = s.segment_id)""",
    "d_offsets": r"""
SELECT *, CAST(COALESCE(sum(length(text) + 1) OVER (PARTITION BY file_id ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset
FROM d_noisy_segments""",
    "d_flagged": r"""
SELECT DISTINCT file_id, segment_id, start_s, end_s FROM d_noisy_words WHERE word <> clean_word""",
    "d_ranges": r"""
SELECT file_id, CAST(island AS INT) AS range_no, min(s) AS start_s, max(e) AS end_s, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e, segment_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (
      SELECT file_id, segment_id, greatest(start_s - 2, 0) AS s, end_s + 2 AS e FROM d_flagged)))
GROUP BY file_id, island""",
    "d_retranscripts": r"""
SELECT r.file_id, r.range_no, r.start_s, r.end_s, string_agg(s.text, ' ' ORDER BY s.segment_id) AS text
FROM d_ranges r JOIN d_segments s ON s.file_id = r.file_id AND s.start_s < r.end_s AND s.end_s > r.start_s
GROUP BY r.file_id, r.range_no, r.start_s, r.end_s""",
    "d_answers": r"""
SELECT s.file_id, s.segment_id, '{"text": ' || to_json(c.text) || ', "swaps": [' || b.swaps || '], "confidence": 0.8}' AS response
FROM d_noisy_segments s JOIN (SELECT file_id, segment_id, string_agg(clean_word, ' ' ORDER BY pos) AS text FROM d_noisy_words GROUP BY file_id, segment_id) c
  ON c.file_id = s.file_id AND c.segment_id = s.segment_id
JOIN (SELECT file_id, segment_id, string_agg('"' || word || ' → ' || lower(trim(clean_word, '.,!?;:''"()[]')) || '"', ', ' ORDER BY pos) AS swaps
  FROM d_noisy_words WHERE word <> clean_word GROUP BY file_id, segment_id) b ON b.file_id = s.file_id AND b.segment_id = s.segment_id""",
    "d_rates": r"""
SELECT file_id, utt, dataset, accent, CAST(len(rw) AS INT) AS ref_word_count, CAST(len(hw) AS INT) AS hyp_word_count, CAST(len(cw) AS INT) AS cor_word_count,
  levenshtein(enc(rw, book), enc(hw, book)) AS word_errors, levenshtein(enc(rw, book), enc(cw, book)) AS cor_errors
FROM (SELECT *, list_distinct(list_concat(list_concat(rw, hw), cw)) AS book FROM (
  SELECT file_id, utt, dataset, accent, wl(nm(ref)) AS rw, wl(nm(hyp)) AS hw, wl(nm(regexp_replace(hyp, '(^| )zz', '\1', 'g'))) AS cw FROM d_pairs))""",
    "d_file_rates": """
SELECT file_id, dataset, accent, sum(ref_word_count)::BIGINT AS ref_word_count, CASE WHEN sum(ref_word_count) = 0 THEN NULL ELSE round(sum(word_errors) * 100.0 / sum(ref_word_count), 2) END AS baseline_wer,
  CASE WHEN sum(ref_word_count) = 0 THEN NULL ELSE round(sum(cor_errors) * 100.0 / sum(ref_word_count), 2) END AS corrected_wer
FROM d_rates GROUP BY file_id, dataset, accent""",
}
# Shorthands used in the texts above.
SHORT = {
    "nm": r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))",
    "wl": r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')",
    "enc": "array_to_string(list_transform({0}, lambda x: chr(CAST(list_position({1}, x) AS INT))), '')",
}


def _expand(text: str) -> str:
    """Replace ``name(args)`` of every shorthand by its SQL."""
    import re

    for name, body in SHORT.items():
        while m := re.search(rf"\b{name}\(", text):
            depth, i = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                i += 1
            inner = text[m.end() : i - 1]
            args, level, cur = [], 0, ""
            for ch in inner:
                level += {"(": 1, ")": -1}.get(ch, 0)
                if ch == "," and level == 0 and name == "enc":
                    args.append(cur.strip())
                    cur = ""
                else:
                    cur += ch
            args.append(cur.strip())
            text = text[: m.start()] + body.format(*args) + text[i:]
    return text


DERIVED_SQL = {k: _expand(v) for k, v in DERIVED_SQL.items()}
