"""Vocabulary merging and look-ups of words against the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.functions import similarity as sim
from verbascope.functions.fuzzy import IndelRatio, fuzzy_word_join
from verbascope.functions.text import strip_ws, term_variants
from verbascope.session import materialise

def merge_vocabularies(domain: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """One row per lower-cased term.

    The first spelling wins, error lists are appended in order without repeats,
    a custom category replaces the domain one, new custom terms are appended.
    Inputs: ``term, category, known_errors, pos``; output adds ``term_key``.
    """
    d = domain.select("term", "category", "known_errors", F.col("pos").cast("bigint").alias("pos"), F.lit(0).alias("prio"))
    both = d
    if custom is not None:
        both = d.unionByName(
            custom.select("term", "category", "known_errors", F.col("pos").cast("bigint").alias("pos"), F.lit(1).alias("prio"))
        )
    both = both.withColumn("term_key", F.lower("term")).where("term_key <> ''")
    rank = F.struct("prio", "pos")
    heads = both.groupBy("term_key").agg(
        F.min_by("term", rank).alias("term"),
        F.min(rank).alias("rank"),
        F.min_by(F.struct("category"), rank).getField("category").alias("first_category"),
        F.max_by(
            F.when((F.col("prio") == 1) & (F.coalesce("category", F.lit("")) != ""), F.col("category")),
            F.when((F.col("prio") == 1) & (F.coalesce("category", F.lit("")) != ""), rank),
        ).alias("custom_category"),
    )
    # Each (term, error) pair is reduced to its first place before it is collected.
    errs = (
        both.select("term_key", "prio", "pos", F.posexplode("known_errors").alias("k", "error"))
        .groupBy("term_key", "error")
        .agg(F.min(F.struct("prio", "pos", "k")).alias("at"))
        .groupBy("term_key")
        .agg(F.array_sort(F.collect_list(F.struct("at", "error"))).alias("e"))
        .select("term_key", F.transform("e", lambda x: x["error"]).alias("known_errors"))
    )
    default = F.when(F.col("rank.prio") == 1, F.lit("custom")).otherwise(F.lit("unknown"))
    return heads.join(errs, "term_key", "left").select(
        "term",
        "term_key",
        F.coalesce("custom_category", "first_category", default).alias("category"),
        F.coalesce("known_errors", F.array().cast("array<string>")).alias("known_errors"),
        F.col("rank.prio").alias("prio"),
        F.col("rank.pos").alias("pos"),
    )


def error_lookup(vocab: DataFrame) -> DataFrame:
    """``error_key -> term`` with the last vocabulary entry winning on a repeat."""
    errs = vocab.select(F.posexplode("known_errors").alias("k", "error"), "term", "category", "known_errors", "pos")
    at = F.struct("pos", "k")
    return errs.groupBy(F.lower("error").alias("error_key")).agg(
        F.max_by(F.struct("term", "category", "known_errors"), at).alias("hit")
    ).select("error_key", "hit.*")


def known_error_hits(words: DataFrame, vocab: DataFrame, word_key: str = "word_key") -> DataFrame:
    """Words that are a listed mis-hearing of a term."""
    return words.join(error_lookup(vocab), F.col(word_key) == F.col("error_key")).drop("error_key")


def fuzzy_pairs(words: DataFrame, terms: DataFrame, min_ratio: float = 60.0) -> DataFrame:
    """Distinct (word, term) pairs with an indel ratio of at least ``min_ratio``.

    ``words(word)`` and ``terms(term_key)`` hold distinct lower-case values. A pair
    at that ratio shares at least ``min_ratio``/200 of its characters; blocks of words
    meet blocks of terms, and pairs within the bound are scored together.
    """
    met = fuzzy_word_join(words, "word", terms, "term_key", IndelRatio(min_ratio), "ratio")
    return met.where(F.col("word") != F.col("term_key"))


def near_miss_terms(words: DataFrame, vocab: DataFrame, top: int = 3, min_ratio: float = 60.0, use_phonetic: bool = True) -> DataFrame:
    """For each distinct word the first plausible of its ``top`` nearest terms.

    Output ``word, term, category, known_errors, ratio, score, reasons``. The exact match
    takes one of the places (it is nearest) but is never a proposal.
    """
    terms = vocab.select("term", "term_key", "category", "known_errors", "pos")
    distinct_words = words.select("word").distinct()
    # One more than the places, as the word itself may be among the terms. A term without a place sorts first.
    earliest = terms.groupBy("term_key").agg(F.min(F.coalesce(F.col("pos").cast("bigint"), F.lit(-(2**62)))).alias("_at"))
    pairs = fuzzy_word_join(distinct_words, "word", earliest, "term_key", IndelRatio(min_ratio), "ratio", top + 1, "_at")
    pairs = pairs.where(F.col("word") != F.col("term_key"))
    ranked = pairs.join(terms, "term_key")
    # A word that is itself a term fills the first of the places.
    own = terms.select(F.col("term_key").alias("word"), F.lit(1).alias("own"))
    ranked = ranked.join(own, "word", "left")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("ratio"), "pos"))
    kept = ranked.withColumn("place", place).where(F.col("place") <= top).where(
        F.col("place") + F.coalesce("own", F.lit(0)) <= top
    )
    # Read three times below; the join of all words with all terms is to run once.
    kept = materialise(kept, "near_terms")
    if use_phonetic:
        codes = lambda df, c, out: df.select(c).distinct().withColumn(out, sim.metaphone_udf(c))
        kept = kept.join(codes(kept, "word", "word_code"), "word").join(codes(kept, "term_key", "term_code"), "term_key")
        plaus = sim.plausibility(F.col("word"), F.col("term"), F.col("word_code"), F.col("term_code"))
    else:
        plaus = sim.plausibility(F.col("word"), F.col("term"))
    scored = kept.withColumn("p", plaus).where(F.col("p.score") >= sim.ACCEPT_PLAUSIBILITY)
    best = scored.groupBy("word").agg(
        F.min_by(F.struct("term", "category", "known_errors", "ratio", "p"), F.col("place")).alias("b")
    )
    return best.select("word", "b.term", "b.category", "b.known_errors", "b.ratio", F.col("b.p.score").alias("score"), F.col("b.p.reasons").alias("reasons"))


def split_custom(text) -> "F.Column":
    """Newline-separated custom terms to an array of trimmed, non-empty terms."""
    return F.filter(F.transform(F.split(text, "\n"), strip_ws), lambda x: x != "")


def known_forms(terms: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """Distinct lower-case spellings of a term list, with and without hyphens."""
    return terms.select(*keys, F.explode(term_variants(term)).alias("form")).where("form <> ''").distinct()


def union_terms(parts: list[DataFrame], cap: int = 80) -> DataFrame:
    """Ordered union per file, first spelling kept (case-sensitive), first ``cap``.

    Each part has ``file_id, term, pos``; earlier parts come first.
    """
    from functools import reduce

    from pyspark.sql import Window

    tagged = [p.select("file_id", "term", F.col("pos").cast("bigint").alias("pos"), F.lit(i).alias("part")) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    firsts = both.groupBy("file_id", "term").agg(F.min(F.struct("part", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("at", "term"))
    return firsts.withColumn("place", place).where(F.col("place") <= cap).select("file_id", "term", "place")
