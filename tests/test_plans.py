"""Composed evaluation and training-set builds."""

import pytest

from verbascope.catalog.registry import DEALT_BY, Tables
from verbascope.plans.evaluation import build_training_set, evaluate


def test_evaluate_falls_back_to_the_baseline(spark):
    pairs = spark.createDataFrame([(1, "we use qdrant here", "we use quadrant here"), (2, "all good now", "all bad now")], "file_id int, ref string, hyp string")
    fixed = spark.createDataFrame([(1, "we use qdrant here")], "file_id int, hyp string")
    vocab = spark.createDataFrame([("Qdrant", "product_name", ["quadrant"], 0)], "term string, category string, known_errors array<string>, pos int")
    r = {x.file_id: x for x in evaluate(pairs, fixed, vocab, ["file_id"]).collect()}
    assert (r[1].baseline_wer, r[1].corrected_wer, r[1].wer_improvement, r[1].tter_improvement) == (25.0, 0.0, 25.0, 100.0)
    assert r[2].baseline_wer == pytest.approx(33.33) and r[2].wer_improvement == 0.0


def test_training_set_build(spark):
    words = "their plan is to write new code here and know which way is right for the two teams".split()
    clean = spark.createDataFrame([(m, " ".join(words * 20)) for m in range(3)], "meeting_id int, text string")
    matched = spark.createDataFrame([(9, "we deploy Qdrant today", "we deploy quadrant today")], "file_id int, ref string, hyp string")
    log = spark.createDataFrame([("k1", "Groq", "product_name", "grok", False, True)], "example_key string, term string, category string, error_found string, is_negative boolean, applied boolean")
    out = build_training_set(clean, matched, log).collect()
    assert {r.source for r in out} == {"meetings", "matched", "corrections"}
    assert sum(r.source == "corrections" for r in out) == 3
    pos, neg = sum(not r.is_negative for r in out), sum(r.is_negative for r in out)
    assert neg <= pos * 0.3 / 0.7 and {r.split for r in out} == {"train", "valid"}


def test_texts_of_one_row_group_are_dealt_to_all_tasks(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for name in DEALT_BY:
        stored = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        assert getattr(t, name).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
        assert getattr(t, name).exceptAll(stored).count() == stored.exceptAll(getattr(t, name)).count() == 0
