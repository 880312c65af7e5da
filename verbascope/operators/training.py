"""Correction examples: building, balancing, filtering, splitting, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbascope.functions.text import (
    clean_label,
    let,
    raw_context,
    tokens,
    unit_hash,
    word_category,
    word_chunks,
)
from verbascope.operators.alignment import picked_steps
from verbascope.operators.ordered import hash_rank, running
from verbascope.operators.terms import corpus_zipf
from verbascope.operators.vocabulary import fuzzy_pairs

SYSTEM_TEXT = "You correct speech transcripts: find misheard key terms with the given evidence and return the corrected text."
MARKER = "ASR transcript: "

# Written words and what a recogniser commonly emits instead.
HOMOPHONES = {
    "their": ["there", "they're"], "there": ["their", "they're"], "they're": ["their", "there"],
    "your": ["you're", "ur"], "you're": ["your"], "its": ["it's"], "it's": ["its"], "than": ["then"],
    "then": ["than"], "affect": ["effect"], "effect": ["affect"], "accept": ["except"], "except": ["accept"],
    "whether": ["weather"], "weather": ["whether"], "which": ["witch"], "right": ["write"], "write": ["right"],
    "know": ["no"], "no": ["know"], "new": ["knew"], "knew": ["new"], "here": ["hear"], "hear": ["here"],
    "would": ["wood"], "through": ["threw"], "two": ["to", "too"], "to": ["two", "too"], "too": ["to", "two"],
    "where": ["were", "wear"], "were": ["where", "wear"], "break": ["brake"], "quite": ["quiet"],
    "lose": ["loose"], "principal": ["principle"], "principle": ["principal"],
}

# Categories whose corrections are always worth keeping.
GOOD_CATEGORIES = (
    "person_name", "product_name", "company_name", "tech_term", "ai_model", "tech_library", "domain_term",
    "proper_noun", "tech_acronym", "feature", "custom",
)

# Everyday words that are rarely mis-hearings of a term.
EVERYDAY_WORDS = (
    "going", "the", "and", "but", "have", "will", "can", "did", "around", "about", "want", "need", "time", "know",
    "think", "look", "come", "make", "take", "give", "call", "put", "screen", "cash", "walk", "cool", "fear",
    "piano", "clock", "queue", "login", "parallel", "index", "sort", "types",
)


# --------------------------------------------------------------------------
# building examples
# --------------------------------------------------------------------------


def chat_messages(text: Column, vocab: Column, category: Column, corrected: Column, changes: Column, confidence: Column, need_lip: Column, hints: Column | None = None) -> Column:
    """System / user / assistant messages of one example."""
    none = F.array().cast("array<string>")
    user = F.concat(
        F.lit("Correct the transcript segment with the evidence below.\n\n"), F.lit(MARKER), text,
        F.lit("\nCustom vocabulary: "), F.to_json(vocab), F.lit("\nCategory: "), category,
        F.lit("\nOCR hints: "), F.to_json(none if hints is None else hints), F.lit("\nLip reading hint: null"),
    )
    answer = F.to_json(
        F.struct(corrected.alias("corrected"), changes.alias("changes"), confidence.alias("confidence"), need_lip.alias("need_lip"))
    )
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(msg("system", F.lit(SYSTEM_TEXT)), msg("user", user), msg("assistant", answer))


def metadata(source, term, category, error_found, file_id, applied, is_negative, is_hard_negative=None) -> Column:
    hard = F.lit(False) if is_hard_negative is None else is_hard_negative
    return F.struct(
        source.alias("source"), applied.alias("applied"), term.alias("term"), category.alias("category"),
        error_found.alias("error_found"), file_id.cast("string").alias("file_id"), is_negative.alias("is_negative"), hard.alias("is_hard_negative"),
    )


def corrections_to_examples(results: DataFrame) -> DataFrame:
    """Applied corrections (``file_id, term, category, error_found, context,
    corrected_text, confidence, need_lip, applied``) as chat examples."""
    change = F.array(F.concat_ws(" → ", "error_found", "term"))
    return results.select(
        chat_messages(F.col("context"), F.array("term"), F.col("category"), F.col("corrected_text"), change, F.col("confidence"), F.col("need_lip")).alias("messages"),
        metadata(F.lit("corrections"), F.col("term"), F.col("category"), F.col("error_found"), F.col("file_id"), F.col("applied"), F.lit(False)).alias("metadata"),
    )


def alignment_examples(pairs: DataFrame, keys: list[str], source: str, truth: str = "ref", heard: str = "hyp", negative_rate: float = 0.1, seed: int = 42) -> DataFrame:
    """Flat positive and negative examples out of the alignment of raw texts.

    A substituted word that differs by more than case gives a positive; one in
    ten equal words of three or more characters, chosen by hash, a negative. The
    context is cut around the first occurrence of the word in the heard text. All of
    it is made in the row of the pair.
    """
    picked = picked_steps(tokens(truth), tokens(heard), F.concat_ws(":", *keys, F.lit("")), negative_rate, f"neg{seed}")
    by_pair = pairs.select(*keys, F.col(heard).alias("_text"), picked.alias("xs")).withColumn(
        "xs", F.filter("xs", lambda x: x["is_negative"] | (F.lower(x["hyp_word"]) != F.lower(x["ref_word"])))
    )

    def item(x: Column, text: Column) -> Column:
        ctx = raw_context(text, F.position(x["hyp_word"], text) - 1)
        return x.withField("context", ctx)

    rows = by_pair.select(*keys, F.explode_outer(let(F.struct(F.col("xs").alias("xs"), F.col("_text").alias("t")), lambda b: F.transform(b["xs"], lambda x: item(x, b["t"])))).alias("x")).where("x IS NOT NULL")
    at = F.position(F.col("x.hyp_word"), F.col("x.context"))
    fixed = F.when(at > 0, F.overlay("x.context", "x.ref_word", at, F.length("x.hyp_word"))).otherwise(F.col("x.context"))
    return rows.select(
        *keys, F.col("x.pos").alias("pos"), F.lit(source).alias("source"), F.col("x.ref_word").alias("term"), word_category("x.ref_word").alias("category"),
        F.col("x.hyp_word").alias("error_found"), F.col("x.is_negative").alias("is_negative"), (~F.col("x.is_negative")).alias("applied"),
        F.col("x.context").alias("context"), fixed.alias("corrected"),
    )


def examples_to_chat(flat: DataFrame, file_id: str) -> DataFrame:
    """Flat examples as chat examples."""
    none = F.array().cast("array<string>")
    change = F.when(F.col("is_negative"), none).otherwise(F.array(F.concat_ws(" → ", "error_found", "term")))
    conf = F.when(F.col("is_negative"), F.lit(0.99)).otherwise(F.lit(0.95))
    return flat.select(
        chat_messages(F.col("context"), F.array("term"), F.col("category"), F.col("corrected"), change, conf, F.lit(False)).alias("messages"),
        metadata(F.col("source"), F.col("term"), F.col("category"), F.col("error_found"), F.col(file_id), F.col("applied"), F.col("is_negative")).alias("metadata"),
    )


def inject_errors(text: Column, key: Column, rate: float = 0.05, seed: int = 42) -> Column:
    """Reproducible recogniser-like errors: a hash per (key, word place) decides.

    A hit word with a homophone is swapped (its capital kept); otherwise it is
    dropped (30 %), doubled (20 % of the rest) or left alone.
    """
    table = F.create_map(*[x for k, v in HOMOPHONES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])

    def draw(i: Column, name: str) -> Column:
        return unit_hash(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(name)), f"err{seed}")

    def corrupt(w: Column, i: Column) -> Column:
        options = F.try_element_at(table, F.lower(w))
        pick = F.element_at(options, (F.floor(draw(i, "pick") * F.size(options)) + 1).cast("int"))
        capital = F.concat(F.upper(F.left(pick, F.lit(1))), F.substr(pick, F.lit(2)))
        swapped = F.when(w.rlike(r"^\p{Lu}"), capital).otherwise(pick)
        none = F.array().cast("array<string>")
        return (
            F.when(draw(i, "hit") >= rate, F.array(w))
            .when(options.isNotNull(), F.array(swapped))
            .when(draw(i, "drop") < 0.3, none)
            .when(draw(i, "dup") < 0.2, F.array(w, w))
            .otherwise(F.array(w))
        )

    return F.array_join(F.flatten(F.transform(tokens(text), corrupt)), " ")


def _chunk_hash(chunk_key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"chunk{seed}:"), chunk_key.cast("string")))


def sample_chunks(chunks: DataFrame, key: str, chunk_key: Column, limit: int = 20, seed: int = 42) -> DataFrame:
    """At most ``limit`` chunks per meeting in hash order (a sampling operator)."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(_chunk_hash(chunk_key, seed)))
    return chunks.withColumn("_r", r).where(F.col("_r") <= limit).drop("_r")


def meeting_pairs(meetings: DataFrame, size: int = 50, limit: int = 20, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Clean and corrupted chunk pairs per meeting: chunk, sample, corrupt, and
    drop chunks that stayed as they were."""
    key = lambda no: F.concat_ws("/", F.col("meeting_id").cast("string"), no.cast("string"))
    # What is not among the first of its row is not among the first of its meeting: it need not be shuffled.
    hashed = F.transform(word_chunks("text", size), lambda c, i: F.struct(_chunk_hash(key(i), seed).alias("h"), i.alias("chunk_no"), c.alias("ref")))
    first = F.slice(F.array_sort(hashed), 1, limit)
    c = meetings.select("meeting_id", F.explode_outer(first).alias("x")).where("x IS NOT NULL").select("meeting_id", "x.chunk_no", "x.ref")
    key = key(F.col("chunk_no"))
    c = sample_chunks(c, "meeting_id", key, limit, seed)
    # Behind an explode, so that the filter does not corrupt a chunk once more.
    noisy = F.explode_outer(F.array(inject_errors(F.col("ref"), key, rate, seed))).alias("hyp")
    return c.select("*", noisy).where("hyp <> ref")


def hard_negatives_from_seeds(seeds: DataFrame) -> DataFrame:
    """``seeds(transcript, wrong_word, correct_word, vocab, category)`` to flat
    examples that teach to leave the word alone."""
    return seeds.select(
        F.lit("hard_negative_generated").alias("source"), F.col("correct_word").alias("term"), "category", F.col("correct_word").alias("error_found"),
        F.col("wrong_word").alias("wrong_replacement"), F.lit(True).alias("is_negative"), F.lit(True).alias("is_hard_negative"), F.lit(False).alias("applied"),
        F.col("transcript").alias("context"), F.col("transcript").alias("corrected"),
    )


def mine_hard_negatives(examples: DataFrame, everyday: tuple[str, ...] = EVERYDAY_WORDS, cap: int = 200) -> DataFrame:
    """Applied corrections of everyday words, turned into hard negatives.

    The transcript is read out of the user message after the marker. The first
    ``cap`` by example key are kept (the operator's own limit, a top-k).
    """
    e = F.lower(F.btrim("error_found", F.lit(".,!?'\" ")))
    line = F.regexp_extract("user_content", r"(?s)" + MARKER + r"([^\n]*)", 1)
    hit = examples.where("applied").withColumn("_e", e).where(F.col("_e").isin(*everyday) & (F.col("_e") != F.lower("term")) & F.contains(F.col("user_content"), F.lit(MARKER)))
    seeds = hit.orderBy("example_key").limit(cap).select(
        "example_key", F.trim(line).alias("transcript"), F.col("term").alias("wrong_word"), F.col("_e").alias("correct_word"), "category"
    )
    return seeds


# --------------------------------------------------------------------------
# quality, balance, splits
# --------------------------------------------------------------------------


def example_verdict() -> Column:
    """Why an example is dropped, or ``keep``."""
    strip = lambda c: F.btrim(F.lower(c), F.lit(".,!?'\" "))
    bare = lambda c: F.lower(F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit("."), F.lit("")))
    e, t = F.coalesce("error_found", F.lit("")), F.coalesce("term", F.lit(""))
    trivial = (F.abs(F.length(e) - F.length(t)) <= 2) & (F.lower(F.left(e, F.lit(3))) == F.lower(F.left(t, F.lit(3))))
    return (
        F.when(F.col("is_negative"), "keep")
        .when((e == "") | (t == ""), "empty")
        .when(strip(e) == strip(t), "no_change")
        .when(bare(e) == bare(t), "punctuation_only")
        .when((F.length(e) < 2) | (F.length(t) < 2), "too_short")
        .when(F.col("category").isin(*GOOD_CATEGORIES), "keep")
        .when((F.col("category") == "content_word") & trivial, "trivial_change")
        .when(F.col("category") == "content_word", "keep")
        .when(F.col("applied"), "keep")
        .otherwise("not_applied")
    )


def filter_examples(examples: DataFrame) -> DataFrame:
    return examples.withColumn("_v", example_verdict()).where("_v = 'keep'").drop("_v")


def filter_funnel(examples: DataFrame) -> DataFrame:
    """Before, after and removed in one pass."""
    kept = F.count_if(example_verdict() == "keep")
    n = F.count("*")
    return examples.agg(
        n.alias("before"), kept.alias("after"), (n - kept).alias("removed"), F.round((n - kept) / F.greatest(n, F.lit(1)) * 100, 0).cast("int").alias("removed_pct")
    )


def upsample(examples: DataFrame, times: Column) -> DataFrame:
    """Repeat each example ``times`` times, numbered by ``copy``."""
    return examples.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def balance_negatives(examples: DataFrame, key: Column, max_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """All positives and at most ``pos · r / (1 - r)`` negatives in hash order."""
    pos = examples.where("NOT is_negative")
    neg = hash_rank(examples.where("is_negative"), key, f"balance{seed}", "_rank")
    room = pos.agg(F.floor(F.count("*") * max_ratio / (1 - max_ratio)).alias("_room")).withColumn("_k", F.lit(1))
    kept = neg.withColumn("_k", F.lit(1)).join(F.broadcast(room), "_k").where("_rank < _room").drop("_k", "_room", "_rank")
    return pos.unionByName(kept)


def split_train_valid(examples: DataFrame, key: Column, ratio: float = 0.85, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``split``: the first ⌊ratio·n⌋ in hash order are ``train``.

    Rows of equal key fall on one side except at the cut itself; split distinct
    examples where copies must stay together. With ``by`` the split is stratified.
    """
    by = list(by)
    ranked = hash_rank(examples, key, f"split{seed}", "_rank", by)
    n = examples.groupBy(*by).agg(F.floor(F.count("*") * ratio).alias("_cut"))
    if by:
        j = ranked.join(n, by)
    else:
        j = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return j.withColumn("split", F.when(F.col("_rank") < F.col("_cut"), "train").otherwise("valid")).drop("_rank", "_cut")


def merge_sources(sources: dict[str, DataFrame], upsampled: tuple[str, ...] = (), factor: int = 3, max_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """Union, up-sample, cap the negatives, split by example key."""
    parts = []
    for name, df in sources.items():
        times = factor if name in upsampled else 1
        parts.append(upsample(df.withColumn("source", F.lit(name)), F.lit(times)))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    example = F.concat_ws("/", "source", "example_key")
    balanced = balance_negatives(both, F.concat_ws("/", example, F.col("copy").cast("string")), max_ratio, seed)
    # Examples are split, not rows: the copies of one follow it to its side.
    sides = split_train_valid(balanced.select("source", "example_key").distinct(), example, seed=seed)
    same = [balanced[c].eqNullSafe(sides[c]) for c in ("source", "example_key")]
    return balanced.join(sides, same).select(balanced["*"], sides["split"])


# --------------------------------------------------------------------------
# statistics
# --------------------------------------------------------------------------


def merged_counts(examples: DataFrame, by: list[str]) -> DataFrame:
    hard = F.coalesce("is_hard_negative", F.lit(False))
    return examples.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_negative")).alias("positive"),
        F.count_if(F.col("is_negative") & ~hard).alias("negative"), F.count_if(hard).alias("hard_negative"),
    )


def dataset_totals(examples: DataFrame) -> DataFrame:
    """Line counts per (dataset, file) with totals per dataset and overall."""
    return examples.rollup("dataset", "file").agg(F.count("*").alias("n"))


def class_balance(examples: DataFrame, top: int = 5) -> DataFrame:
    """Positives, negatives, negative share and the top categories per source."""
    base = examples.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_negative")).alias("positive"), F.count_if("is_negative").alias("negative"),
        F.round(F.count_if("is_negative") / F.count("*") * 100, 0).cast("int").alias("negative_pct"),
    )
    cats = examples.groupBy("source", "category").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "category"))
    best = cats.withColumn("r", r).where(F.col("r") <= top).groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "category", "n"))), lambda x: F.concat(x["category"], F.lit("="), x["n"].cast("string"))), ",").alias("top_categories")
    )
    return base.join(best, "source")


def top_with_other(examples: DataFrame, column: str, top: int = 12) -> DataFrame:
    """Counts of the ``top`` values, the rest under ``other``."""
    counts = examples.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    head = counts.orderBy(F.desc("n"), "value").limit(top).select("value", F.lit(True).alias("_in"))
    j = counts.join(head, "value", "left")
    return j.groupBy(F.when(F.col("_in"), F.col("value")).otherwise("other").alias("value")).agg(F.sum("n").alias("n"))


def contingency(examples: DataFrame, rows: str = "source", cols: str = "category", top_rows: int = 8, top_cols: int = 10) -> DataFrame:
    """Zero-filled counts of the top rows × top columns in long form."""
    counts = examples.groupBy(clean_label(rows).alias("row"), F.col(cols).alias("col")).agg(F.count("*").alias("n"))
    tr = counts.groupBy("row").agg(F.sum("n").alias("row_total")).orderBy(F.desc("row_total"), "row").limit(top_rows)
    tc = counts.groupBy("col").agg(F.sum("n").alias("col_total")).orderBy(F.desc("col_total"), "col").limit(top_cols)
    # The column list (at most ten values) is carried to each row, not cross-joined.
    col_list = tc.agg(F.collect_list(F.struct("col", "col_total")).alias("cs")).withColumn("_k", F.lit(1))
    grid = tr.withColumn("_k", F.lit(1)).join(F.broadcast(col_list), "_k").select("row", "row_total", F.explode("cs").alias("c")).select("row", "row_total", "c.col", "c.col_total")
    return grid.join(counts, ["row", "col"], "left").select("row", "row_total", "col", "col_total", F.coalesce("n", F.lit(0)).alias("n"))


def run_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Best validation loss and its iteration, last train loss, mean throughput."""
    s = lambda name: F.when(F.col("series") == name, F.col("value"))
    it = lambda name: F.when(F.col("series") == name, F.col("iter"))
    return log.groupBy(*keys).agg(
        F.min(s("val")).alias("best_val"), F.min_by(it("val"), F.when(F.col("series") == "val", F.struct("value", "iter"))).alias("best_iter"),
        F.max_by(s("train"), it("train")).alias("last_train"), F.max(it("train")).alias("last_iter"), F.round(F.avg(s("throughput")), 4).alias("mean_throughput"),
    )


def moving_average(log: DataFrame, keys: list[str], chunk: int = 100_000) -> DataFrame:
    """Mean over the last w points, w = max(1, min(5, n div 4)); the first w-1
    points have no full window and are dropped."""
    n = log.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.count("*") / 4))).cast("int").alias("w"))
    placed = running(log.withColumn("_one", F.lit(1).cast("bigint")), keys, F.floor(F.col("iter") / chunk), ["iter"], F.col("_one"), "_i")
    placed = placed.withColumn("_i", F.coalesce("_i", F.lit(0))).join(n, keys)
    # Each point is sent to the windows it belongs to (five at most).
    sent = placed.select(*keys, "w", "value", F.explode(F.sequence(F.col("_i"), F.col("_i") + F.col("w") - 1)).alias("_i"))
    means = sent.groupBy(*keys, "_i").agg(F.avg("value").alias("smoothed"), F.count("*").alias("_c"), F.any_value("w").alias("_w")).where("_c = _w")
    return placed.join(means.select(*keys, "_i", "smoothed"), [*keys, "_i"]).select(*keys, "iter", "smoothed")


def browse(examples: DataFrame, order: Column, page: int = 1, limit: int = 20) -> DataFrame:
    """One page of examples in order."""
    return examples.orderBy(order).offset((page - 1) * limit).limit(limit)


def risky_errors(vocab: DataFrame, zipf: DataFrame, min_zipf: float = 3.5) -> DataFrame:
    """Known errors that are common words, most common first."""
    e = vocab.select("term", "category", F.explode("known_errors").alias("error"))
    key = F.btrim(F.lower("error"), F.lit(".,!?"))
    return e.withColumn("word", key).join(zipf.where(F.col("zipf") > min_zipf).select("word", "zipf"), "word").select("error", "term", "category", "zipf")


def false_friends(zipf: DataFrame, vocab: DataFrame, min_zipf: float = 3.0, min_ratio: float = 60.0, min_len: int = 3) -> DataFrame:
    """Common words that look like a term: ``word, term, category, similarity, zipf``."""
    w = zipf.where((F.col("zipf") >= min_zipf) & (F.length("word") >= min_len)).select("word", "zipf")
    pairs = fuzzy_pairs(w.select("word"), vocab.select("term_key").distinct(), min_ratio)
    return pairs.join(w, "word").join(vocab.select("term", "term_key", "category"), "term_key").select("word", "term", "category", F.col("ratio").alias("similarity"), "zipf")


def friend_occurrences(texts: DataFrame, friends: DataFrame, keys: list[str], per_pair: int = 10, window: int = 80, min_context: int = 20) -> DataFrame:
    """First ``per_pair`` whole-word occurrences of every (word, term) with context."""
    from verbascope.operators.terms import find_terms

    low = texts.select(*keys, F.lower("text").alias("text"))
    words = friends.select(F.col("word").alias("term_key")).distinct()
    hits = find_terms(low, words, keys, word_boundary=True).withColumnRenamed("term_key", "word")
    at = hits.select(*keys, "word", F.explode("positions").alias("p"))
    # The first ten per word are enough for every term, so cut before joining terms.
    r = F.row_number().over(Window.partitionBy("word").orderBy(*keys, "p"))
    ctx_len = lambda n: F.least(F.col("p") + window, n) - F.greatest(F.col("p") - window, F.lit(0))
    sized = at.join(texts.select(*keys, F.length("text").alias("_n")), keys).where(ctx_len(F.col("_n")) >= min_context)
    first = sized.withColumn("r", r).where(F.col("r") <= per_pair).select(*keys, "word", "p", "r")
    ctx = first.join(texts.select(*keys, "text"), keys).select(*keys, "word", "p", "r", raw_context("text", "p", window).alias("context"))
    return ctx.join(friends.select("word", "term"), "word")


def human_edits(words: DataFrame) -> DataFrame:
    """Edited words: ``file_id, segment_id, pos, original, corrected``."""
    return words.where("corrected IS NOT NULL AND corrected <> ''").select("file_id", "segment_id", "pos", F.col("word").alias("original"), "corrected")


def edited_segments(words: DataFrame) -> DataFrame:
    """Segments with at least one edit, original and corrected text."""
    fixed = F.coalesce(F.nullif("corrected", F.lit("")), F.col("word"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("word").alias("w"), fixed.alias("c"))))
    seg = words.groupBy("file_id", "segment_id").agg(
        ordered.alias("a"), F.count_if((F.coalesce("corrected", F.lit("")) != "")).alias("n_edits")
    ).where("n_edits > 0")
    join = lambda f: F.array_join(F.transform("a", lambda x: x[f]), " ")
    return seg.select("file_id", "segment_id", "n_edits", join("w").alias("original_text"), join("c").alias("corrected_text"))
