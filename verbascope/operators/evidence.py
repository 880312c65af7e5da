"""Evidence preparation: screen lines, quality gates, sampling, prompt packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbascope.functions.text import (
    is_fragment_noise,
    is_ui_noise,
    norm_ws,
    strip_ws,
    truncate_at_sentence,
)
from verbascope.operators.intervals import within
from verbascope.operators.ordered import hash_rank, running, streaming_fold

# Categories whose terms are likely on screen, for the rule path
# and for the detector path, and categories where lip reading helps.
SCREEN_CATEGORIES_RULES = ("product_name", "tech_term", "feature", "metric", "brand", "tool")
SCREEN_CATEGORIES_DETECTOR = (
    "product_name", "tech_term", "feature", "metric", "brand", "tool", "tech_acronym", "cloud_service",
    "ai_model", "platform", "compliance", "business_term", "business_metric", "domain_term",
)
LIP_CATEGORIES = ("person_name", "content_word", "custom")
# Categories a web term and a screen term may carry.
WEB_CATEGORIES = ("product_name", "tech_term", "person_name", "company_name", "domain_term", "tech_acronym")
SCREEN_TERM_TYPES = ("person", "product", "company", "tool")


def screen_lines(frames: DataFrame) -> DataFrame:
    """``file_id, ts, line_no, line`` of the frames' texts, trimmed."""
    return frames.select(
        "file_id", "ts", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("line", strip_ws("line"))


def clean_screen_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that are no interface text."""
    return lines.where(~is_ui_noise(line))


def quick_hints(lines: DataFrame) -> DataFrame:
    """First appearance per file of every line that carries no noise fragment."""
    ok = lines.where(~is_fragment_noise("line"))
    return ok.groupBy("file_id", "line").agg(F.min(F.struct("ts", "line_no")).alias("at"))


def hints_near(frames: DataFrame, centers: DataFrame, center_key: list[str], center: str = "center_s", window: float = 15.0, cap: int = 15) -> DataFrame:
    """First ``cap`` distinct clean lines of the frames near each centre, in frame order."""
    keys = ["file_id", *center_key]
    near = within(frames.select("file_id", "ts", "text"), "ts", centers, center, window, ["file_id"])
    lines = near.select(*keys, "ts", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", strip_ws("line"))
    firsts = clean_screen_lines(lines).groupBy(*keys, "line").agg(F.min(F.struct("ts", "line_no")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= cap).select(*keys, "rank", "line")


def gate_web_terms(terms: DataFrame) -> DataFrame:
    """Verdict per proposed term: ``accepted`` or the reason against it.

    Input ``file_id, pos, term, category``. The first acceptable spelling of a
    lower-cased term wins; later ones are duplicates.
    """
    t = terms.withColumn("term", strip_ws(F.coalesce("term", F.lit("")))).withColumn(
        "category", F.lower(strip_ws(F.coalesce("category", F.lit(""))))
    )
    n = F.length("term")
    known = (F.col("category") == "") | F.col("category").isin(*WEB_CATEGORIES)
    good = n.between(3, 40) & known
    firsts = t.where(good).groupBy("file_id", F.lower("term").alias("key")).agg(F.min("pos").alias("first_pos"))
    both = t.withColumn("key", F.lower("term")).join(firsts, ["file_id", "key"], "left")
    status = (
        F.when(n == 0, "empty_term")
        .when(~n.between(3, 40), "bad_length")
        .when(F.col("first_pos") < F.col("pos"), "duplicate")
        .when(~known, "bad_category")
        .otherwise("accepted")
    )
    label = F.when(F.col("category") == "", "domain_term").otherwise(F.col("category"))
    return both.select("file_id", "pos", "term", label.alias("category"), status.alias("status"))


def gate_screen_terms(terms: DataFrame) -> DataFrame:
    """Accepted screen terms: two characters or more, known type, first spelling."""
    t = terms.select("file_id", "pos", strip_ws("term").alias("term"), F.lower(strip_ws("type")).alias("type"))
    ok = t.where((F.length("term") >= 2) & F.col("type").isin(*SCREEN_TERM_TYPES))
    return ok.groupBy("file_id", F.lower("term").alias("key")).agg(F.min_by(F.struct("pos", "term", "type"), "pos").alias("f")).select(
        "file_id", "f.pos", "f.term", "f.type"
    )


def even_sample(rows: DataFrame, keys: list[str], order: str, chunk: Column, limit: int = 150) -> DataFrame:
    """When a group has more than ``limit`` rows, every (n div limit)-th, ``limit`` at most."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    numbered = running(rows.withColumn("_one", F.lit(1).cast("bigint")), keys, chunk, [order], F.col("_one"), "_rn")
    numbered = numbered.withColumn("_rn", F.coalesce("_rn", F.lit(0))).join(n, keys)
    step = F.greatest(F.floor(F.col("_n") / limit), F.lit(1))
    kept = (F.col("_n") <= limit) | ((F.col("_rn") % step == 0) & (F.floor(F.col("_rn") / step) < limit))
    return numbered.where(kept).drop("_rn", "_n", "_one")


def snippet_context(snippets: DataFrame, keys: list[str], max_chars: int = 2500, at_sentence: bool = True) -> DataFrame:
    """Search-result bodies joined in rank order and cut.

    Only bodies that begin within the cut are collected, so a group's row stays as
    short as the result however many bodies the group has.
    """
    bodies = snippets.where("body <> ''").withColumn("_len", (F.length("body") + 1).cast("bigint"))
    placed = running(bodies, keys, F.floor(F.col("rank") / 1024), ["rank", "body"], F.col("_len"), "_at")
    near = placed.where(F.coalesce("_at", F.lit(0)) <= max_chars + 1)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "body")))
    text = near.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["body"]), " ").alias("t"))
    cut = truncate_at_sentence("t", max_chars) if at_sentence else F.substring("t", 1, max_chars)
    return text.select(*keys, cut.alias("context"))


def evidence_flags(candidates: DataFrame, keys: list[str], screen: tuple[str, ...], default_screen: bool) -> DataFrame:
    """Which evidence a segment needs, from the categories of its candidates."""
    needs = candidates.groupBy(*keys).agg(
        F.bool_or(F.col("category").isin(*screen)).alias("needs_ocr"),
        F.bool_or(F.col("category").isin(*LIP_CATEGORIES)).alias("needs_avsr"),
    )
    if default_screen:
        needs = needs.withColumn("needs_ocr", F.col("needs_ocr") | (~F.col("needs_ocr") & ~F.col("needs_avsr")))
    return needs


def retranscription_prompt(ocr_names, custom, topic, web, max_chars: int = 896) -> Column:
    """Vocabulary prompt from four lists (arrays), most specific first.

    Caps 10 / 30 / 20 / 15; a prompt above the limit is cut at its last blank and
    closed with a full stop.
    """

    def part(label: str, terms, cap: int) -> Column:
        c = F.col(terms) if isinstance(terms, str) else terms
        return F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, cap), ", "), F.lit(".")))

    full = F.concat_ws(" ", part("Speakers", ocr_names, 10), part("Key terms", custom, 30), part("Topics", topic, 20), part("Related", web, 15))
    head = F.substring(full, 1, max_chars)
    cut = F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("."))
    return F.when(F.length(full) > max_chars, cut).otherwise(full)


def evidence_pack(text, other, vocab, candidates, screen, lips, topic=None) -> Column:
    """One JSON evidence record per segment with the caps 80 / 10 / 15 / 3."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    fields = [
        c(text).alias("original"),
        c(other).alias("retranscription"),
        F.slice(c(vocab), 1, 80).alias("vocabulary"),
        F.slice(c(candidates), 1, 10).alias("suspects"),
        F.slice(c(screen), 1, 15).alias("screen"),
        F.slice(c(lips), 1, 3).alias("lips"),
    ]
    if topic is not None:
        fields.append(c(topic).alias("topic"))
    return F.to_json(F.struct(*fields))


# --------------------------------------------------------------------------
# folds over "the last row that was kept"
# --------------------------------------------------------------------------


def _word_set(text: str) -> frozenset:
    return frozenset((text or "").lower().split())


def similar_words(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


def distinct_frames(frames: DataFrame, threshold: float = 0.9, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Keep a frame when its text differs enough from the last kept one.

    Sorted partitions are streamed through with the last kept word set as the
    only state, so a file with millions of frames needs no more memory than one.
    """

    def fold(batches):
        key, last = None, None
        for batch in batches:
            keep = []
            for k, text in zip(batch["file_id"], batch["text"]):
                words = _word_set(text)
                fresh = k != key or similar_words(last, words) < threshold
                if fresh:
                    key, last = k, words
                keep.append(fresh)
            yield batch[keep]

    return streaming_fold(frames, ["file_id"], list(order), fold, frames.schema.simpleString()[7:-1].replace(":", " "))


def spaced_times(times: DataFrame, min_gap: float = 5.0) -> DataFrame:
    """Greedy thinning: keep a time more than ``min_gap`` after the last kept one."""

    def fold(batches):
        key, last = None, None
        for batch in batches:
            keep = []
            for k, ts in zip(batch["file_id"], batch["ts"]):
                fresh = k != key or ts - last > min_gap
                if fresh:
                    key, last = k, ts
                keep.append(fresh)
            yield batch[keep]

    src = times.select("file_id", "ts")
    return streaming_fold(src, ["file_id"], ["ts"], fold, f"file_id {src.schema['file_id'].dataType.simpleString()}, ts double")


def frame_plan(targets: DataFrame, durations: DataFrame, budget: int = 15, min_gap: float = 5.0) -> DataFrame:
    """Frame times per file: thinned targets first, evenly spaced fills after.

    Targets take at most two thirds of the budget; a fill is skipped when it is
    closer than ``min_gap`` to any time already chosen. At most ``budget`` rows
    per file enter the fold. Files without targets still get their fills.
    """
    thin = spaced_times(targets, min_gap)
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("ts"))
    head = thin.withColumn("r", rank).where(F.col("r") <= int(budget * 0.67))
    chosen = head.groupBy("file_id").agg(F.array_sort(F.collect_list("ts")).alias("picked"))
    base = durations.join(chosen, "file_id", "full").withColumn(
        "picked", F.coalesce("picked", F.array().cast("array<double>"))
    )
    left = F.lit(budget) - F.size("picked")
    fills = F.when(
        (left > 0) & (F.coalesce("duration", F.lit(0.0)) > 0),
        F.transform(F.sequence(F.lit(1), left), lambda i: F.col("duration") / (left + 1) * i),
    ).otherwise(F.array().cast("array<double>"))
    merged = F.aggregate(
        fills,
        F.col("picked"),
        lambda acc, ts: F.when(F.exists(acc, lambda x: F.abs(x - ts) < min_gap), acc).otherwise(F.concat(acc, F.array(ts))),
    )
    return base.select("file_id", F.posexplode(F.slice(F.array_sort(merged), 1, budget)).alias("slot", "ts"))


