"""Evaluation and training-set builds over a corpus as lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.operators import metrics as me
from verbascope.operators import training as tr


def evaluate(pairs: DataFrame, corrected: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and corrected error rates per file.

    ``pairs(keys, ref, hyp)``; ``corrected(keys, hyp)`` may lack failed files,
    which then keep their baseline.
    """

    def rates(p: DataFrame) -> DataFrame:
        r = me.error_rates(p)
        t = me.tter_region(me.tter_region_occurrences(p, vocab, keys), keys)[1].select(*keys, F.col("overall_tter").alias("tter_pct"))
        return r.join(t, keys, "left").select(
            *keys, F.round(F.col("wer") * 100, 2).alias("wer_pct"), F.round(F.col("cer") * 100, 2).alias("cer_pct"), F.coalesce("tter_pct", F.lit(0.0)).alias("tter_pct")
        )

    fixed = pairs.drop("hyp").join(corrected.select(*keys, "hyp"), keys)
    return me.compare_variants(rates(pairs), rates(fixed), keys)


def build_training_set(clean: DataFrame, matched: DataFrame, corrections: DataFrame, seed: int = 42) -> DataFrame:
    """Synthetic meeting pairs, matched real pairs and logged corrections merged,
    filtered, balanced and split.

    ``clean(meeting_id, text)``, ``matched(file_id, ref, hyp)``, ``corrections``
    flat examples with an ``example_key``.
    """
    cols = ["example_key", "term", "category", "error_found", "is_negative", "applied"]
    key = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c]).alias("example_key")
    synth = tr.alignment_examples(tr.meeting_pairs(clean, seed=seed), ["meeting_id", "chunk_no"], "meetings")
    real = tr.alignment_examples(matched, ["file_id"], "matched")
    sources = {
        "meetings": synth.select(key("meeting_id", "chunk_no", "pos"), *cols[1:]),
        "matched": real.select(key("file_id", "pos"), *cols[1:]),
        "corrections": corrections.select(*cols),
    }
    good = {n: tr.filter_examples(d) for n, d in sources.items()}
    return tr.merge_sources(good, upsampled=("corrections",), seed=seed)
