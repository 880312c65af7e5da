"""Text, screen-text and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbascope.catalog.registry import query
from verbascope.functions import answers, text as tx
from verbascope.operators import evidence as ev
from verbascope.operators import positions, transcripts, vocabulary
from verbascope.operators.intervals import first_containing
from verbascope.operators.terms import acronym_terms, corpus_zipf, find_terms, keyword_terms, rare_words, target_summary
from verbascope.sources import lines as src
from verbascope.sources.screen_text import frames_to_xml, parse_frames

# SQL spelling of the shared normalisations.
NORM_WS = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
NORM_WER = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}'' ]', '', 'g'), ' +', ' ', 'g'))"
NORM_METRIC = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"
STRIP = r"lower(trim({0}, '.,!?;:''\"()[]'))".replace('\\"', '"')
WS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
nws, nwer, nmet, strip, ws = (s.format for s in (NORM_WS, NORM_WER, NORM_METRIC, STRIP, WS))


@query(
    "normalise_text",
    f"""SELECT doc_id, md5({nws('text')}) AS ws_md5, md5({nwer('text')}) AS wer_md5, md5({nmet('text')}) AS metric_md5,
  CAST(length({nmet('text')}) AS INT) AS metric_len FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id", F.md5(tx.norm_ws("text")).alias("ws_md5"), F.md5(tx.norm_wer("text")).alias("wer_md5"),
        F.md5(tx.norm_metric("text")).alias("metric_md5"), F.length(tx.norm_metric("text")).alias("metric_len"),
    )


@query(
    "term_occurrences_substring",
    rf"""WITH tok AS (SELECT doc_id, ws[i] AS w, CAST(sum(length(ws[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(ws[i]) - 1 AS BIGINT) AS off
     FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, {ws(nws('text'))} AS ws FROM documents))),
   hit AS (SELECT w, term_key, unnest(list_filter(range(1, length(w) - length(term_key) + 2), lambda p: substr(w, p, length(term_key)) = term_key)) AS p
     FROM (SELECT DISTINCT w FROM tok) JOIN d_vocab ON contains(w, term_key))
 SELECT doc_id AS file_id, term_key, count(*) AS n, CAST(min(off + p - 1) AS INT) AS first_pos, CAST(max(off + p - 1) AS INT) AS last_pos
 FROM tok JOIN hit USING (w) GROUP BY doc_id, term_key""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("file_id"), tx.norm_ws("text").alias("text"))
    hits = find_terms(docs, t.vocab.select("term_key"), ["file_id"])
    return hits.select(
        "file_id", "term_key", F.size("positions").cast("bigint").alias("n"),
        F.array_min("positions").alias("first_pos"), F.array_max("positions").alias("last_pos"),
    )


@query(
    "term_occurrences_whole_word",
    rf"""WITH tok AS (SELECT doc_id AS file_id, unnest(regexp_extract_all({nws('text')}, '[\p{{L}}\p{{N}}_]+')) AS w FROM documents)
 SELECT file_id, term_key, count(*) AS n FROM tok JOIN d_vocab ON w = term_key GROUP BY file_id, term_key""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("file_id"), tx.norm_ws("text").alias("text"))
    hits = find_terms(docs, t.vocab.select("term_key"), ["file_id"], word_boundary=True)
    return hits.select("file_id", "term_key", F.size("positions").cast("bigint").alias("n"))


@query(
    "context_slices",
    rf"""SELECT doc_id, md5(substr({nws('text')}, greatest(p - 80, 0) + 1, p + 80 - greatest(p - 80, 0))) AS norm80,
  md5(substr(text, greatest(p - 80, 0) + 1, p + 80 - greatest(p - 80, 0))) AS raw80,
  md5('...' || substr({nws('text')}, greatest(p - 60, 0) + 1, p + 60 - greatest(p - 60, 0)) || '...') AS dotted60
FROM (SELECT doc_id, text, length(text) // 3 AS p FROM documents)""",
)
def _(t):
    d = t.documents.withColumn("p", F.floor(F.length("text") / 3).cast("int"))
    return d.select(
        "doc_id", F.md5(tx.context("text", "p")).alias("norm80"), F.md5(tx.raw_context("text", "p")).alias("raw80"),
        F.md5(tx.dotted_context("text", "p")).alias("dotted60"),
    )


@query(
    "running_offsets",
    "SELECT file_id, segment_id, char_offset FROM d_offsets",
)
def _(t):
    return t.offsets.select("file_id", "segment_id", "char_offset")


POSITIONS_SQL = """SELECT file_id, char_offset + length(text) // 2 AS char_pos FROM d_offsets
 UNION ALL SELECT file_id, sum(length(text) + 1) + 50 AS char_pos FROM d_offsets GROUP BY file_id"""


@query(
    "position_times",
    f"""WITH p AS ({POSITIONS_SQL}),
 hit AS (SELECT p.file_id, p.char_pos, min_by(s.start_s + CAST(p.char_pos - s.char_offset AS DOUBLE) / greatest(length(s.text), 1) * (s.end_s - s.start_s), s.segment_id) AS ts
   FROM p JOIN d_offsets s ON s.file_id = p.file_id AND s.char_offset + length(s.text) >= p.char_pos GROUP BY p.file_id, p.char_pos),
 las AS (SELECT file_id, max_by(end_s, segment_id) AS e FROM d_offsets GROUP BY file_id)
SELECT p.file_id, CAST(p.char_pos AS BIGINT) AS char_pos, round(COALESCE(hit.ts, las.e), 6) AS ts
FROM p LEFT JOIN hit ON hit.file_id = p.file_id AND hit.char_pos = p.char_pos JOIN las ON las.file_id = p.file_id""",
)
def _(t):
    o = t.offsets
    mid = o.select("file_id", (F.col("char_offset") + F.floor(F.length("text") / 2)).alias("char_pos"))
    past = o.groupBy("file_id").agg((F.sum(F.length("text") + 1) + 50).cast("bigint").alias("char_pos"))
    out = positions.position_to_time(mid.unionByName(past), t.noisy_segments)
    return out.select("file_id", "char_pos", F.round("ts", 6).alias("ts"))


@query(
    "rebuild_text",
    r"""SELECT file_id, string_agg(x, ' ' ORDER BY segment_id) AS text
FROM (SELECT file_id, segment_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM d_segments) WHERE x <> '' GROUP BY file_id""",
)
def _(t):
    return transcripts.file_texts(t.segments)


@query(
    "strip_punct_words",
    f"SELECT w, count(*) AS n FROM (SELECT {strip('word')} AS w FROM d_words) WHERE length(w) >= 2 GROUP BY w",
)
def _(t):
    return t.words.select(tx.strip_punct("word").alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("n"))


def chunk_sql(size: int, overlap: int, look_back: int) -> str:
    """Chunks one after the other: each begins where the one before was cut."""

    def end(start: str) -> str:
        low = f"greatest({start} + {size - look_back}, {start} + 1)"
        part = f"substr(text, {low} + 1, {start} + {size} - {low})"
        marks = (("'. '", "' .'"), ("'? '", "' ?'"), ("'! '", "' !'"), ("chr(10)", "chr(10)"))
        ends = ", ".join(f"CASE WHEN contains({part}, {m}) THEN {low} + length({part}) - position({r} IN reverse({part})) + 1 END" for m, r in marks)
        return f"CASE WHEN length(text) - {start} <= {size} THEN length(text) ELSE COALESCE({ends}, {start} + {size}) END"

    return f"""WITH RECURSIVE c AS (
 SELECT doc_id, text, 0::BIGINT AS chunk_no, 0::BIGINT AS a, ({end("0")})::BIGINT AS z FROM documents
 UNION ALL SELECT doc_id, text, chunk_no + 1, n, ({end("n")})::BIGINT FROM (SELECT *, greatest(z - {overlap}, a + 1) AS n FROM c WHERE length(text) - a > {size}))
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(a AS INT) AS start, CAST(z AS INT) AS "end", md5(substr(text, a + 1, z - a)) AS md5 FROM c"""


@query("sentence_chunks", chunk_sql(5000, 200, 500))
def _(t):
    return src.sentence_chunks(t.documents.select("doc_id", "text"), ["doc_id"], "text").select(
        "doc_id", "chunk_no", "start", "end", F.md5("text").alias("md5")
    )


@query("sentence_chunks_no_overlap", chunk_sql(2000, 0, 300))
def _(t):
    return src.sentence_chunks(t.documents.select("doc_id", "text"), ["doc_id"], "text", 2000, 0, 300).select(
        "doc_id", "chunk_no", "start", "end", F.md5("text").alias("md5")
    )


@query(
    "word_chunks",
    rf"""WITH d AS (SELECT doc_id, {ws('text')} AS ws FROM documents)
SELECT doc_id, CAST(k - 1 AS INT) AS chunk_no, md5(cs[k]) AS md5 FROM (
  SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS k FROM (
    SELECT doc_id, list_concat(list_transform(range(0, len(ws) - 49, 40), lambda s: array_to_string(ws[s + 1 : s + 50], ' ')),
      CASE WHEN len(ws) > 50 AND len(ws) % 40 > 25 THEN [array_to_string(ws[len(ws) - 49 : len(ws)], ' ')] ELSE [] END) AS cs FROM d))""",
)
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.word_chunks("text")).alias("chunk_no", "c")).select(
        "doc_id", "chunk_no", F.md5("c").alias("md5")
    )


def _cut_sql(text: str, n: int) -> str:
    def at(mark: str) -> str:
        m = "chr(10)" if mark == "\n" else f"'{mark}'"
        return f"(CASE WHEN contains(h, {m}) THEN length(h) - instr(reverse(h), reverse({m})) - {len(mark)} + 1 ELSE -1 END)"

    arms = " ".join(f"WHEN {at(m)} >= {n * 0.6} THEN substr(h, 1, {at(m)} + 1)" for m in (". ", "! ", "? ", "; ", "\n"))
    return f"CASE WHEN length({text}) <= {n} THEN {text} {arms} WHEN {at(' ')} > 0 THEN substr(h, 1, {at(' ')}) ELSE h END"


@query(
    "truncate_at_sentence",
    f"SELECT doc_id, md5({_cut_sql('text', 300)}) AS cut_md5 FROM (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", F.md5(tx.truncate_at_sentence("text", 300)).alias("cut_md5"))


@query(
    "timestamps_mmss",
    r"""WITH s AS (SELECT file_id, segment_id, CAST(floor(start_s) AS INT) AS sec FROM d_segments),
 f AS (SELECT *, lpad(CAST(sec // 60 AS VARCHAR), CAST(greatest(2, length(CAST(sec // 60 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS mmss FROM s)
SELECT file_id, segment_id, mmss, CAST(CAST(split_part(mmss, ':', 1) AS INT) * 60 + CAST(split_part(mmss, ':', 2) AS INT) AS DOUBLE) AS back,
  CAST(3600 + CAST(split_part(mmss, ':', 1) AS INT) * 60 + CAST(split_part(mmss, ':', 2) AS INT) AS DOUBLE) AS with_hour FROM f""",
)
def _(t):
    s = t.segments.select("file_id", "segment_id", tx.format_mmss("start_s").alias("mmss"))
    return s.select("*", tx.parse_mmss("mmss").alias("back"), tx.parse_mmss(F.concat(F.lit("1:"), "mmss")).alias("with_hour"))


XML_SQL = r"""SELECT file_id, '<ocr-extraction>' || chr(10) || string_agg('  <frame timestamp="' || lpad(CAST(CAST(ts AS INT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(ts AS INT) % 60 AS VARCHAR), 2, '0')
  || '" type="slide">' || chr(10) || '    <text>' || {esc} || '</text>' || chr(10) || '  </frame>', chr(10) ORDER BY ts) || chr(10) || '</ocr-extraction>' AS xml FROM d_frames GROUP BY file_id"""
ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
XML_PLAIN = XML_SQL.format(esc=ESC)


@query("screen_xml_sink", XML_SQL.format(esc=f"replace({ESC}, '\"', '&quot;')"))
def _(t):
    return frames_to_xml(t.frames)


@query("screen_xml_sink_plain", XML_PLAIN)
def _(t):
    return frames_to_xml(t.frames, quotes=False)


@query(
    "screen_xml_source",
    rf"""WITH x AS ({XML_PLAIN}),
 f AS (SELECT file_id, unnest(regexp_extract_all(xml, '(?s)<frame\s+timestamp="([^"]+)"\s+type="([^"]+)">\s*(.*?)\s*</frame>', 1)) AS stamp,
   unnest(regexp_extract_all(xml, '(?s)<frame\s+timestamp="([^"]+)"\s+type="([^"]+)">\s*(.*?)\s*</frame>', 3)) AS body FROM x)
SELECT file_id, CAST(CAST(split_part(stamp, ':', 1) AS INT) * 60 + CAST(split_part(stamp, ':', 2) AS INT) AS DOUBLE) AS ts,
  md5(regexp_replace(regexp_extract(body, '(?s)<text>\s*(.*?)\s*</text>', 1), '^\s+|\s+$', '', 'g')) AS text_md5
FROM f WHERE regexp_extract(body, '(?s)<text>\s*(.*?)\s*</text>', 1) <> ''""",
)
def _(t):
    parsed = parse_frames(frames_to_xml(t.frames, quotes=False), "xml", ["file_id"])
    return parsed.select("file_id", "ts", F.md5("text").alias("text_md5"))


@query(
    "screen_xml_from_pages",
    r"""WITH b AS (SELECT page_id, replace(replace(unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)), '<b>', '<text>'), '</b>', '</text>') AS body FROM pages)
SELECT page_id, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM (
 SELECT page_id, CASE WHEN regexp_matches(body, '(?s)<text>.*?</text>') THEN regexp_replace(regexp_extract(body, '(?s)<text>\s*(.*?)\s*</text>', 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace(body, '^\s+|\s+$', '', 'g') END AS body FROM b)
WHERE body <> '' GROUP BY page_id""",
)
def _(t):
    from verbascope.sources.screen_text import frame_body

    body = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    rows = t.pages.select("page_id", F.explode(body).alias("b"))
    tagged = F.replace(F.replace(F.col("b"), F.lit("<b>"), F.lit("<text>")), F.lit("</b>"), F.lit("</text>"))
    texts = rows.select("page_id", frame_body(tagged).alias("body")).where("body <> ''")
    return texts.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("body")).cast("bigint").alias("chars"))


UI_RE = "(?i)^(" + "|".join(tx.UI_PHRASES) + ")"
FRAG_SQL = " OR ".join(f"contains(line, '{f}')" for f in tx.NOISE_FRAGMENTS)
LINES_SQL = r"SELECT file_id, ts, CAST(i - 1 AS INT) AS line_no, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d_frames))"


@query(
    "screen_line_noise",
    f"""WITH l AS ({LINES_SQL})
SELECT file_id, count(*) AS n_lines, count(*) FILTER (length(line) <= 1 OR regexp_matches(line, '{UI_RE}')) AS ui_noise,
  count(*) FILTER (length(line) <= 3 OR length(line) > 80 OR {FRAG_SQL}) AS fragment_noise FROM l GROUP BY file_id""",
)
def _(t):
    return ev.screen_lines(t.frames).groupBy("file_id").agg(
        F.count("*").alias("n_lines"), F.count_if(tx.is_ui_noise("line")).alias("ui_noise"),
        F.count_if(tx.is_fragment_noise("line")).alias("fragment_noise"),
    )


@query(
    "quick_screen_hints",
    f"""WITH l AS ({LINES_SQL}) SELECT file_id, line, min(ts) AS first_ts FROM l
WHERE NOT (length(line) <= 3 OR length(line) > 80 OR {FRAG_SQL}) GROUP BY file_id, line""",
)
def _(t):
    return ev.quick_hints(ev.screen_lines(t.frames)).select("file_id", "line", F.col("at.ts").alias("first_ts"))


@query(
    "hints_near_segments",
    f"""WITH l AS ({LINES_SQL}), c AS (SELECT file_id, segment_id, (start_s + end_s) / 2 AS center_s FROM d_segments),
 h AS (SELECT c.file_id, c.segment_id, l.line, min(l.ts * 100000 + l.line_no) AS pl FROM c JOIN l ON l.file_id = c.file_id AND abs(l.ts - c.center_s) <= 15
   WHERE length(line) > 1 AND NOT regexp_matches(line, '{UI_RE}') GROUP BY c.file_id, c.segment_id, l.line)
SELECT file_id, segment_id, CAST(rank AS INT) AS rank, line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, segment_id ORDER BY pl) AS rank FROM h) WHERE rank <= 15""",
)
def _(t):
    centers = t.segments.select("file_id", "segment_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("center_s"))
    return ev.hints_near(t.frames, centers, ["segment_id"])


@query(
    "word_categories",
    r"""SELECT CASE WHEN regexp_matches(word, '^\p{Lu}') AND length(word) > 1 THEN 'proper_noun'
  WHEN length(word) >= 2 AND regexp_matches(word, '\p{Lu}') AND NOT regexp_matches(word, '\p{Ll}') THEN 'tech_acronym'
  WHEN regexp_matches(word, '\p{Nd}') THEN 'numeric_term' ELSE 'content_word' END AS category, count(*) AS n
FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS word FROM documents) GROUP BY ALL""",
)
def _(t):
    w = t.documents.select(F.explode(tx.tokens("text")).alias("word"))
    return w.groupBy(tx.word_category("word").alias("category")).agg(F.count("*").alias("n"))


@query(
    "caps_and_acronyms",
    r"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '\p{Lu}')) AS u, len(regexp_extract_all(text, '\p{L}')) AS l FROM documents),
 a AS (SELECT doc_id, COALESCE(u / nullif(l, 0) > 0.6, false) AS caps, list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(text, '([^\p{L}\p{N}_-])', '\1\1', 'g'), '-([^\d])', '--\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z]{2,}(?:-?\d+)?)(?:$|[^\p{L}\p{N}_])', 1)),
   lambda x: NOT list_contains(['THE','AND','FOR','YOU','BUT','NOT','ALL','ANY','CAN'], x)) AS found FROM c)
SELECT doc_id, caps, CASE WHEN caps THEN '' ELSE array_to_string(list_sort(found), ' ') END AS acronyms FROM a""",
)
def _(t):
    return t.documents.select(
        "doc_id", tx.caps_dominant("text").alias("caps"), F.array_join(F.array_sort(tx.acronyms("text")), " ").alias("acronyms")
    )


KEYWORDS_SQL = "SELECT term_key AS kw FROM d_vocab WHERE category = 'tech_term'"


def _keywords(t):
    return t.vocab.where("category = 'tech_term'").select(F.col("term_key").alias("keyword"))


TOK_SQL = r"SELECT doc_id AS file_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS w FROM documents"


@query(
    "keyword_terms",
    f"SELECT DISTINCT file_id, w AS term FROM ({TOK_SQL}) JOIN ({KEYWORDS_SQL}) ON lower(w) = kw",
)
def _(t):
    return keyword_terms(t.documents.select(F.col("doc_id").alias("file_id"), "text"), _keywords(t))


ZIPF_SQL = f"SELECT lower(w) AS word, count(*) AS n, log10(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 1000000000) AS zipf FROM ({TOK_SQL}) GROUP BY lower(w)"


@query("corpus_zipf", f"SELECT word, n, round(zipf, 6) AS zipf FROM ({ZIPF_SQL})")
def _(t):
    z = corpus_zipf(t.documents.select(F.col("doc_id").alias("file_id"), "text"))
    return z.select("word", "n", F.round("zipf", 6).alias("zipf"))


COMMON_SQL = ", ".join(f"'{w}'" for w in sorted(__import__("verbascope.operators.terms", fromlist=["x"]).COMMON_NAMES))
RARE_SQL = rf"""SELECT DISTINCT file_id, w AS term FROM ({TOK_SQL}) t JOIN ({ZIPF_SQL}) z ON lower(t.w) = z.word
 WHERE regexp_matches(w, '^\p{{L}}{{4,}}$') AND zipf <= 3.5 AND lower(w) NOT IN ({COMMON_SQL})"""


@query("rare_word_terms", RARE_SQL)
def _(t):
    d = t.documents.select(F.col("doc_id").alias("file_id"), "text")
    return rare_words(d, corpus_zipf(d))


@query(
    "target_terms_per_file",
    rf"""WITH k AS (SELECT DISTINCT file_id, w AS term FROM ({TOK_SQL}) JOIN ({KEYWORDS_SQL}) ON lower(w) = kw),
 a AS (SELECT doc_id AS file_id, unnest(list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(text, '([^\p{{L}}\p{{N}}_-])', '\1\1', 'g'), '-([^\d])', '--\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])([A-Z]{{2,}}(?:-?\d+)?)(?:$|[^\p{{L}}\p{{N}}_])', 1)),
   lambda x: NOT list_contains(['THE','AND','FOR','YOU','BUT','NOT','ALL','ANY','CAN'], x))) AS term FROM documents
   WHERE NOT COALESCE(len(regexp_extract_all(text, '\p{{Lu}}')) / nullif(len(regexp_extract_all(text, '\p{{L}}')), 0) > 0.6, false)),
 u AS (SELECT * FROM k UNION SELECT * FROM a UNION ({RARE_SQL})),
 lowered AS (SELECT DISTINCT file_id, lower(term) AS term FROM u),
 ref AS (SELECT doc_id AS file_id, unnest({ws(nmet('text'))}) AS w FROM documents),
 tot AS (SELECT ref.file_id, count(*) AS n FROM ref JOIN lowered ON lowered.file_id = ref.file_id AND lowered.term = ref.w GROUP BY ref.file_id)
SELECT u.file_id, count(*) AS target_terms, COALESCE(any_value(tot.n), 0) AS target_positions FROM u LEFT JOIN tot ON tot.file_id = u.file_id GROUP BY u.file_id""",
)
def _(t):
    return target_summary(t.documents.select(F.col("doc_id").alias("file_id"), "text"), _keywords(t))


@query(
    "entity_words",
    r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(w, ' ' ORDER BY w) AS words FROM (
 SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-zA-Z0-9]+)(?:$|[^\p{L}\p{N}_])', 1), lambda w: length(w) >= 4))) AS w FROM documents) GROUP BY doc_id""",
)
def _(t):
    w = t.documents.select("doc_id", tx.entity_words("text").alias("a")).where(F.size("a") > 0)
    return w.select("doc_id", F.size("a").cast("bigint").alias("n"), F.array_join(F.array_sort("a"), " ").alias("words"))


@query(
    "known_forms",
    r"""SELECT DISTINCT label, form FROM (SELECT lang AS label, lower(w) AS form FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-zA-Z]+-[a-zA-Z]+')) AS w FROM documents)
 UNION ALL SELECT lang AS label, replace(lower(w), '-', '') AS form FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-zA-Z]+-[a-zA-Z]+')) AS w FROM documents))""",
)
def _(t):
    w = t.documents.select(F.col("lang").alias("label"), F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+-[a-zA-Z]+"), F.lit(0))).alias("term"))
    return vocabulary.known_forms(w, ["label"])


@query(
    "gating_flags",
    """WITH c AS (SELECT w.file_id, w.segment_id, v.category FROM d_noisy_words w JOIN d_errors v ON lower(w.word) = v.error_key)
SELECT file_id, segment_id, bool_or(category IN ('product_name','tech_term','feature','metric','brand','tool')) OR (NOT bool_or(category IN ('product_name','tech_term','feature','metric','brand','tool')) AND NOT bool_or(category IN ('person_name','content_word','custom'))) AS needs_ocr,
  bool_or(category IN ('person_name','content_word','custom')) AS needs_avsr FROM c GROUP BY file_id, segment_id""",
)
def _(t):
    c = t.noisy_words.join(t.errors.select("error_key", "category"), F.lower("word") == F.col("error_key"))
    return ev.evidence_flags(c, ["file_id", "segment_id"], ev.SCREEN_CATEGORIES_RULES, default_screen=True)


@query(
    "detector_answers",
    """SELECT w.file_id, w.segment_id, w.word, lower(trim(w.clean_word, '.,!?;:''"()[]')) AS likely_correct, count(*) AS n
FROM d_noisy_words w WHERE w.word <> w.clean_word GROUP BY ALL""",
)
def _(t):
    rows = t.detections.select("file_id", "segment_id", F.explode(answers.detection_suspects("response")).alias("s"))
    return rows.groupBy("file_id", "segment_id", F.col("s.word").alias("word"), F.col("s.likely_correct").alias("likely_correct")).agg(F.count("*").alias("n"))


@query(
    "reconciled_answers",
    r"""WITH c AS (SELECT file_id, segment_id, string_agg(clean_word, ' ' ORDER BY pos) AS text,
   count(*) FILTER (word <> clean_word) AS n_swaps,
   string_agg(CASE WHEN word <> clean_word THEN word || '>' || lower(trim(clean_word, '.,!?;:''"()[]')) END, ' ' ORDER BY pos) AS swaps FROM d_noisy_words GROUP BY file_id, segment_id)
SELECT file_id, segment_id, md5(text) AS text_md5, n_swaps, swaps, 0.8::DOUBLE AS confidence FROM c WHERE n_swaps > 0""",
)
def _(t):
    s = t.answers.select("file_id", "segment_id", answers.reconciled_answer("response", F.lit("")).alias("a"))
    return s.select(
        "file_id", "segment_id", F.md5("a.text").alias("text_md5"), F.size("a.swaps").cast("bigint").alias("n_swaps"),
        F.array_join(F.transform("a.swaps", lambda x: F.concat(x["old"], F.lit(">"), x["new"])), " ").alias("swaps"),
        F.col("a.confidence").alias("confidence"),
    )


def _array_answers(t):
    """A term-array answer per document: plain, fenced, unclosed or broken at the end."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    objs = F.transform(w, lambda x: F.concat(F.lit('{"term":"'), x, F.lit('","category":"tech_term"}')))
    body = F.concat(F.lit("["), F.array_join(objs, ","))
    k = F.col("doc_id") % 4
    raw = (
        F.when(k == 0, F.concat(body, F.lit("]")))
        .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("]\n```")))
        .when(k == 2, body)
        .otherwise(F.concat(body, F.lit(',{"term":"cut]')))
    )
    # The first word tells that there is one; all are taken once, below.
    return t.documents.where(F.rlike("text", F.lit("[A-Za-z]{3,}"))).select(F.col("doc_id").alias("file_id"), raw.alias("raw"))


TERMS_SQL = r"SELECT doc_id AS file_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS ws FROM documents"


@query(
    "term_array_answers",
    f"SELECT file_id, CAST(len(ws) AS INT) AS n, array_to_string(ws, ' ') AS terms FROM ({TERMS_SQL}) WHERE len(ws) > 0",
)
def _(t):
    p = _array_answers(t).select("file_id", answers.term_array("raw").alias("a"))
    return p.select("file_id", F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: x["term"]), " ").alias("terms"))


@query(
    "correction_answers",
    r"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE w END AS corrected, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_changes,
  CASE WHEN doc_id % 3 = 0 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence, doc_id % 3 = 0 AS need_lip
FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-z]+'), ' ') AS w FROM documents)""",
)
def _(t):
    w = F.array_join(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), " ")
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Sure: {"corrected":"'), w, F.lit('","changes":["a"],"confidence":0.7,"need_lip":true} ok')))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"corrected":"'), w, F.lit('"}')))
        .otherwise(F.lit("no answer"))
    )
    a = t.documents.select("doc_id", answers.correction_answer(raw).alias("a"))
    return a.select(
        "doc_id", F.coalesce("a.corrected", F.lit("")).alias("corrected"), F.size("a.changes").alias("n_changes"),
        F.col("a.confidence").alias("confidence"), F.col("a.need_lip").alias("need_lip"),
    )


@query(
    "topic_answers",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS field, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'unknown' END AS topic,
 '' AS description, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS INT) AS n_vocab FROM documents""",
)
def _(t):
    raw = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit('{"field":"'), "source", F.lit('","topic":"'), "lang", F.lit('","suggested_vocab":["a","b"]}')),
    ).otherwise("broken {")
    a = t.documents.select("doc_id", answers.topic_answer(raw).alias("a"))
    return a.select("doc_id", "a.field", "a.topic", "a.description", F.size("a.suggested_vocab").alias("n_vocab"))


PROPOSED_SQL = r"""SELECT doc_id % 50 AS file_id, CAST(doc_id * 1000000 + i AS BIGINT) AS pos, ws[i] AS term, ['', 'tech_term', 'bogus', 'person_name'][1 + CAST((doc_id + i) % 4 AS INT)] AS category,
  ['person', 'product', 'place', 'TOOL'][1 + CAST((doc_id + i) % 4 AS INT)] AS type
FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))"""


def _proposed(t):
    ws = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    d = t.documents.select("doc_id", F.posexplode(ws).alias("p", "term")).withColumn("i", F.col("p") + 1)
    k = (F.col("doc_id") + F.col("i")) % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    return d.select(
        (F.col("doc_id") % 50).alias("file_id"), (F.col("doc_id") * 1_000_000 + F.col("i")).alias("pos"), "term",
        pick("", "tech_term", "bogus", "person_name").alias("category"), pick("person", "product", "place", "TOOL").alias("type"),
    )


@query(
    "web_term_gate",
    f"""WITH p AS ({PROPOSED_SQL}), f AS (SELECT file_id, lower(term) AS k, min(pos) AS fp FROM p WHERE length(term) BETWEEN 3 AND 40 AND category <> 'bogus' GROUP BY ALL)
SELECT p.file_id, p.pos, p.term, CASE WHEN category = '' THEN 'domain_term' ELSE category END AS category,
 CASE WHEN length(term) NOT BETWEEN 3 AND 40 THEN 'bad_length' WHEN fp < pos THEN 'duplicate' WHEN category = 'bogus' THEN 'bad_category' ELSE 'accepted' END AS status
FROM p LEFT JOIN f ON f.file_id = p.file_id AND f.k = lower(p.term)""",
)
def _(t):
    return ev.gate_web_terms(_proposed(t))


@query(
    "screen_term_gate",
    f"""WITH p AS ({PROPOSED_SQL}) SELECT file_id, pos, term, type FROM (
 SELECT file_id, pos, term, lower(type) AS type, row_number() OVER (PARTITION BY file_id, lower(term) ORDER BY pos) AS rn FROM p WHERE length(term) >= 2 AND type <> 'place') WHERE rn = 1""",
)
def _(t):
    return ev.gate_screen_terms(_proposed(t))


@query(
    "even_line_sample",
    f"""WITH l AS (SELECT source AS grp, doc_id, k, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id * 10000 + k) - 1 AS BIGINT) AS rn, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT source, doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents))
SELECT grp, doc_id, CAST(k AS INT) AS k FROM l WHERE n <= 150 OR (rn % (n // 150) = 0 AND rn // (n // 150) < 150)""",
)
def _(t):
    l = t.documents.select(F.col("source").alias("grp"), "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    l = l.withColumn("o", F.col("doc_id") * 10000 + F.col("k"))
    return ev.even_sample(l, ["grp"], "o", F.floor(F.col("doc_id") / 64)).select("grp", "doc_id", "k")


@query(
    "snippet_context",
    f"""SELECT source, md5({_cut_sql('text', 2500)}) AS context_md5, CAST(length(text) AS INT) AS full_len FROM (
  SELECT source, text, substr(text, 1, 2500) AS h FROM (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents WHERE text <> '' GROUP BY source))""",
)
def _(t):
    s = t.documents.select("source", F.col("doc_id").alias("rank"), F.col("text").alias("body"))
    size = s.where("body <> ''").groupBy("source").agg((F.sum(F.length("body") + 1) - 1).cast("int").alias("full_len"))
    return ev.snippet_context(s, ["source"]).join(size, "source").select("source", F.md5("context").alias("context_md5"), "full_len")


@query(
    "retranscription_prompt",
    r"""WITH l AS (SELECT lang, list_sort(list_distinct(flatten(list(regexp_extract_all(text, '[A-Z][a-z]{5,}'))))) AS ws FROM documents GROUP BY lang),
 f AS (SELECT lang, 'Speakers: ' || array_to_string(ws[1:10], ', ') || '. Key terms: ' || array_to_string(ws[1:30], ', ') || '. Topics: ' || array_to_string(ws[1:20], ', ') || '. Related: ' || array_to_string(ws[1:15], ', ') || '.' AS p FROM l)
SELECT lang, CASE WHEN length(p) > 896 THEN regexp_replace(substr(p, 1, 896), ' [^ ]*$', '') || '.' ELSE p END AS prompt FROM f""",
)
def _(t):
    w = t.documents.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    # Thirty terms are the most any part of the prompt may show.
    from pyspark.sql import Window

    top = w.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("w"))).where("r <= 30")
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return lists.select("lang", ev.retranscription_prompt("ws", "ws", "ws", "ws").alias("prompt"))


@query(
    "evidence_packs",
    r"""WITH s AS (SELECT file_id, segment_id, md5(text) AS original FROM d_noisy_segments),
 v AS (SELECT file_id, segment_id, list(word ORDER BY pos) AS suspects FROM d_noisy_words WHERE word <> clean_word GROUP BY ALL)
SELECT s.file_id, s.segment_id, s.original, CAST(least(len(v.suspects), 10) AS INT) AS n_suspects, v.suspects[1] AS first_suspect FROM s JOIN v ON v.file_id = s.file_id AND v.segment_id = s.segment_id""",
)
def _(t):
    # Ten suspects are the most a pack shows; the rank limit is applied before collecting.
    from pyspark.sql import Window

    bad = t.noisy_words.where("word <> clean_word").withColumn("r", F.row_number().over(Window.partitionBy("file_id", "segment_id").orderBy("pos")))
    sus = bad.where("r <= 10").groupBy("file_id", "segment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("suspects"))
    none = F.array().cast("array<string>")
    pack = t.noisy_segments.join(sus, ["file_id", "segment_id"]).select(
        "file_id", "segment_id", ev.evidence_pack("text", F.lit(None).cast("string"), none, "suspects", none, none).alias("j")
    )
    p = F.from_json("j", "original string, suspects array<string>")
    return pack.select("file_id", "segment_id", p.alias("p")).select(
        "file_id", "segment_id", F.md5("p.original").alias("original"), F.size("p.suspects").alias("n_suspects"), F.col("p.suspects")[0].alias("first_suspect")
    )


@query(
    "labels_and_search",
    r"""SELECT page_id, CASE WHEN contains(lower(url || ' ' || html), 'example.com') THEN 'hit' ELSE 'miss' END AS found,
  upper(substr(host, 1, 1)) || lower(substr(host, 2)) AS label, substr(url, 1, 20) AS short
FROM (SELECT page_id, url, html, regexp_extract(url, '//([a-z]+)', 1) AS host FROM pages)""",
)
def _(t):
    return t.pages.select(
        "page_id", F.when(tx.matches_search("Example.COM", "url", "html"), "hit").otherwise("miss").alias("found"),
        tx.clean_label(F.regexp_extract("url", "//([a-z]+)", 1)).alias("label"), F.substring("url", 1, 20).alias("short"),
    )


@query(
    "typed_cells",
    r"""SELECT event_id, v, CASE WHEN regexp_matches(v, '^\s*[+-]?\d+\s*$') THEN 'int' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'string' END AS kind,
 CASE WHEN regexp_matches(v, '^\s*[+-]?\d+\s*$') THEN TRY_CAST(v AS BIGINT) END AS i, TRY_CAST(v AS DOUBLE) AS d
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) || '.5' ELSE event_type END AS v FROM events)""",
)
def _(t):
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    v = t.events.select("event_id", F.when(k == 0, u).when(k == 1, F.concat(u, F.lit(".5"))).otherwise(F.col("event_type")).alias("v"))
    return v.select("event_id", "v", tx.typed_cell("v").alias("c")).select("event_id", "v", "c.kind", "c.i", "c.d")


@query(
    "display_times",
    r"""WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_id, ts, date_diff('microsecond', ts, now) // 60000000 AS m FROM events, n)
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %H:%M') AS shown,
 CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago'
  WHEN m // 10080 < 4 THEN (m // 10080) || 'w ago' ELSE strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y') END AS age FROM e""",
)
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.lit(1))
    now = e.agg(F.max("ts").alias("now")).withColumn("k", F.lit(1))
    e = e.join(F.broadcast(now), "k")  # one row
    return e.select("event_id", tx.local_time("ts").alias("shown"), tx.time_ago("ts", "now").alias("age"))


@query(
    "iso_timestamps",
    r"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""",
)
def _(t):
    iso = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", F.date_format(tx.parse_iso(iso), "yyyy-MM-dd").alias("day"))


@query(
    "lip_hint_texts",
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'No face detected in video segment'
  WHEN doc_id % 5 = 1 THEN 'Visual speech suggests: ''' || w || ''' (confidence: ' || c || ')' || s
  WHEN doc_id % 100 > 50 THEN 'Speaker detected and actively speaking (confidence: ' || c || ')' || s ELSE 'Face detected but low speaking activity (confidence: ' || c || ')' || s END AS hint
FROM (SELECT doc_id, regexp_extract(text, '[a-z]+ [a-z]+') AS w, printf('%.2f', (doc_id % 100) / 100) AS c,
  CASE WHEN doc_id % 3 > 1 THEN ' [active speaker from ' || (doc_id % 3) || ' faces]' ELSE '' END AS s FROM documents WHERE regexp_matches(text, '[a-z]+ [a-z]+'))""",
)
def _(t):
    d = t.documents.where(F.col("text").rlike("[a-z]+ [a-z]+"))
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        tx.speaking_hint(k % 5 != 0, (k % 100).cast("double") / 100, F.when(k % 5 == 1, F.regexp_extract("text", "[a-z]+ [a-z]+", 0)), k % 3).alias("hint"),
    )
