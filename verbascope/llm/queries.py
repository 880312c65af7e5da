"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm import toxicity
from verbascope.llm.centroids import cluster_vectors
from verbascope.llm.chat import ANY_CONTROL, CLOSE, OPEN, canonical_turns, chat_digests, format_chat
from verbascope.llm.decontaminate import find_passages
from verbascope.llm.line_dedup import dedup_lines
from verbascope.llm.lm_score import score_documents
from verbascope.llm.merkle import lower_ascii, manifest
from verbascope.llm.mixing import mixed_sizes
from verbascope.llm.near_copies import near_copies
from verbascope.llm.neighbours import nearest
from verbascope.llm.quality import classify
from verbascope.llm.registry import ORACLES, QUERIES, query, table
from verbascope.llm.token_counts import count_tokens
from verbascope.llm.token_files import read_token_files, write_token_files
from verbascope.session import scratch_dir

__all__ = ["ORACLES", "QUERIES", "token_file_digests"]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), needs AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
  FROM sources
), filled AS (SELECT *, rest * w >= 3 * source_size * w_rest AS full_up FROM needs),
targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN (3 * source_size)::DOUBLE
         ELSE (w * (total - coalesce(sum(3 * source_size) FILTER (WHERE full_up) OVER (), 0)))::DOUBLE / sum(w) FILTER (WHERE NOT full_up) OVER () END AS target
  FROM filled
), placed AS (
  SELECT sized.*, source_size, target, round(target)::BIGINT AS quota,
         sum(size) OVER (PARTITION BY sized.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(least(start + size, quota % source_size) - start, 0) END::BIGINT AS taken
FROM placed
"""


@query("op1_mixed_sources", OP1_SQL)
def op1_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(OPEN) + len(CLOSE) + 2} + length(url_encode(role)) + length(text)
           + len(regexp_extract_all(text, '{ANY_CONTROL}')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are records of one turn; conversation -1 comes as a messages record."""
    rows = table(spark, sf_dir, "conversations")
    records = rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]})
    records = records.unionAll(spark.range(1).select(F.lit(-1).cast("long"), F.lit(extra)))
    return chat_digests(format_chat(canonical_turns(records)))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT lines.*, coalesce(doc_id <> last, false) AS gone FROM lines LEFT JOIN shared USING (key)) GROUP BY doc_id
"""


@query("op4_line_dedup", OP4_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


@query("op6_benchmark_passages")
def op6_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH words AS (
  SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS p
  FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents))
), counted AS (
  SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS others,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
         count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY doc_id, p, w) AS c2
  FROM words
), ready AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY pos) AS c1_before FROM counted),
scored AS (
  SELECT doc_id, CASE WHEN p IS NOT NULL AND c2 > 0 THEN log10(c2 / c1_before)
                      WHEN c1 > 0 THEN CASE WHEN p IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END + log10(c1 / others)
                      ELSE CASE WHEN p IS NULL THEN 1 ELSE 2 END * log10(0.4::DOUBLE) - log10(others + 1) END AS s
  FROM ready
)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, round(mean, 6) AS score
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_words, avg(s) AS mean FROM scored GROUP BY doc_id) USING (doc_id)
"""


@query("op8_lm_scores", OP8_SQL)
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 6).alias("score"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_file_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, read them back and digest each document."""
    path = scratch_dir(spark, "token-files")
    write_token_files(docs, path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(spark, table(spark, sf_dir, "documents"))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _moved(k: int) -> str:
    """The round's nearest centroids and their floors of means, named by its number."""
    return f"""
near{k} AS (
  SELECT rid, any_value(v.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS best
  FROM kept v, centre{k} c GROUP BY rid
), mean{k} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x
  FROM (SELECT best.c AS c, j, sum(xj) AS s, count(*) AS n FROM (SELECT best, unnest(x) AS xj, generate_subscripts(x, 1) AS j FROM near{k}) GROUP BY ALL) GROUP BY c
), centre{k + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM centre{k} c LEFT JOIN mean{k} m ON c.c = m.c)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), centre0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16),{",".join(_moved(k) for k in range(3))},
last AS (
  SELECT vec_id, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS best
  FROM kept v, centre3 c GROUP BY rid, vec_id
)
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(centre3.x, ',')) AS centroid_sha256
FROM last JOIN centre3 ON best.c = centre3.c
"""


@query("op12_clusters", OP12_SQL)
def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64).drop("centroid")


def _crc32_sql(text: str) -> str:
    """Bit by bit; a step takes the low bit out and folds the polynomial in."""
    bits = f"list_transform(range(8 * len({text})), lambda j: (ord(substr({text}, j // 8 + 1, 1)) >> (j % 8)::INT)::BIGINT & 1)"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _tree_sql(name: str, key: str, levels: int) -> str:
    """Nodes ``name``K (key, i, h, n) of each level over ``name``0, and what lies beside each in its run."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}{k}s AS MATERIALIZED (
  SELECT {key}, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k} WINDOW w AS (PARTITION BY {key}, i // 8 ORDER BY i)
), {name}{k + 1} AS MATERIALIZED (
  SELECT {key}, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n
  FROM {name}{k} GROUP BY {key}, i // 8, n
)""")
    return ",".join(out)


def _fold_sql(name: str, key: str, levels: int, source: str, out: str) -> str:
    """Carry (own, proof) of every row of ``source`` up the levels of a tree; ``place`` is its leaf's number."""
    steps = []
    for k in range(levels):
        before = source if k == 0 else f"{out}{k - 1}"
        steps.append(f"""
{out}{k} AS (
  SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.before || own || s.after) ELSE own END AS own, proof || CASE WHEN s.n > 1 THEN s.before || s.after ELSE '' END AS proof)
  FROM {before} f JOIN {name}{k}s s ON f.{key} IS NOT DISTINCT FROM s.{key} AND f.place // {8**k} = s.i
)""")
    return ",".join(steps)


_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13_SQL = f"""
WITH hashed AS MATERIALIZED (
  SELECT doc_id, lang, sha256({_LEAF} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_LEAF} || coalesce(strlen(text) || ':' || {_LOWER}, '-')) END AS read
  FROM documents
), leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
a0 AS (SELECT lang, place AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves),{_tree_sql("a", "lang", 7)},
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS seat FROM a7),
b0 AS (SELECT 0 AS one, seat AS i, subroot AS h, count(*) OVER () AS n FROM subroots),{_tree_sql("b", "one", 3)},
start AS (SELECT doc_id, lang, leaf, place, coalesce(read, leaf) AS own, '' AS proof FROM leaves),{_fold_sql("a", "lang", 7, "start", "up")},
middle AS (SELECT up6.* REPLACE (seat AS place), subroot, 0 AS one FROM up6 JOIN subroots ON up6.lang IS NOT DISTINCT FROM subroots.lang),{_fold_sql("b", "one", 3, "middle", "top")}
SELECT doc_id, lang, leaf, subroot, b3.h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = b3.h AS verified FROM top2, b3
"""


@query("op13_manifest", OP13_SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by checksum of its id, is read back with its letters lowered."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), tamper=F.when(third, lower_ascii(F.col("text"))).otherwise(F.col("text")))
