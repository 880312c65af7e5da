"""Error rates on golden rows."""

import math

import pytest
from pyspark.sql import functions as F

from verbascope.operators import metrics as me
from verbascope.operators import terms as te

CASES = [
    # reference, hypothesis, targets, substitutions, deletions, insertions, total, rate
    ("Anna ran the build on Cloudbase today", "Anna ran the build on Cloudbase today", ["Anna", "Cloudbase"], 0, 0, 0, 2, 0.0),
    ("Anna moved to Cloudbase", "Anna moved to Cloudways", ["Anna", "Cloudbase"], 1, 0, 0, 2, 0.5),
    ("Anna ran the job", "Anna ran a job", ["Anna"], 0, 0, 0, 1, 0.0),
    ("Anna and Bert met", "Anna met", ["Anna", "Bert"], 0, 1, 0, 2, 0.5),
    ("we ran the job", "we ran Kubelet the job", ["Kubelet"], 0, 0, 1, 0, 0.0),
    ("Anna met Bert", "Anna quickly met Bert", ["Anna", "Bert"], 0, 0, 0, 2, 0.0),
    ("the cat sat on the mat", "the cat on mat", [], 0, 0, 0, 0, 0.0),
    ("Anna moved to cloudbase", "Anna moved to CloudBase", ["Cloudbase"], 0, 0, 0, 1, 0.0),
]


def test_aligned_target_term_rate(spark):
    pairs = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "id int, ref string, hyp string")
    terms = spark.createDataFrame([(i, t) for i, c in enumerate(CASES) for t in c[2]], "id int, term string")
    got = {r.id: r for r in me.tter_aligned(pairs, terms, ["id"]).collect()}
    for i, c in enumerate(CASES):
        r = got[i]
        assert (r.substitutions, r.deletions, r.insertions, r.target_total) == c[3:7], c
        assert r.tter == pytest.approx(c[7])


def test_error_rate_edges(spark):
    rows = [(1, "", ""), (2, "", "a b"), (3, "a b", ""), (4, "Don't stop-now", "dont stopnow"), (5, "a b c", "a x c")]
    r = {x.id: x for x in me.error_rates(spark.createDataFrame(rows, "id int, ref string, hyp string")).collect()}
    assert r[1].wer == 0.0 and math.isinf(r[2].wer) and r[3].wer == 1.0 and r[3].cer == 1.0
    assert r[4].wer == pytest.approx(0.5) and r[5].wer == pytest.approx(1 / 3)


def test_region_rate(spark):
    pairs = spark.createDataFrame([(1, "we use qdrant and qdrant", "we use quadrant and qdrant"), (2, "we use qdrant", "nothing here")], "id int, ref string, hyp string")
    vocab = spark.createDataFrame([("Qdrant", "product_name", ["quadrant"], 0)], "term string, category string, known_errors array<string>, pos int")
    occ = me.tter_region_occurrences(pairs, vocab, ["id"])
    assert {(r.id, r.status) for r in occ.collect()} == {(1, "correct"), (2, "missing_or_unknown")}
    per = {r.id: r for r in me.tter_region(occ, ["id"])[1].collect()}
    assert per[1].overall_tter == 0.0 and per[2].overall_tter == 100.0


def test_target_terms(spark):
    texts = spark.createDataFrame(
        [(1, "The CVPR paper shows a CNN for GPU inference."), (2, "THE cat sat on THE mat AND looked FOR food."), (3, ""), (4, "WE PRESENT OUR PAPER IN CVPR AND APPLY RELU")],
        "file_id int, text string",
    )
    acr = {(r.file_id, r.term) for r in te.acronym_terms(texts).collect()}
    assert {(1, "CVPR"), (1, "CNN"), (1, "GPU")} == acr
    kw = {(r.file_id, r.term) for r in te.keyword_terms(texts, spark.createDataFrame([("inference",), ("relu",), ("api",)], "keyword string")).collect()}
    assert (1, "inference") in kw and (4, "RELU") in kw


def test_percentiles_are_exact(spark):
    from verbascope.operators.ordered import exact_percentiles

    d = spark.range(1001).select((F.col("id") * 0.37).alias("v"), (F.col("id") % 3).alias("g"))
    want = d.agg(F.percentile("v", [0.5, 0.95, 0.99]).alias("p")).first().p
    got = exact_percentiles(d, "v", (0.5, 0.95, 0.99)).first()
    assert list(got) == pytest.approx(want)
    assert exact_percentiles(d, "v", (0.5,), ["g"]).count() == 3


def test_comparison_is_made_where_the_pair_is(spark):
    """rates, edit list and term errors of a pair shuffle neither words nor occurrences."""
    pairs = spark.createDataFrame([(1, "we use qdrant and qdrant daily", "we use quadrant qdrant daily so"), (2, "", "")], "id int, ref string, hyp string")
    vocab = spark.createDataFrame([("Qdrant", "product_name", ["quadrant"], 0)], "term string, category string, known_errors array<string>, pos int")
    c = me.compare(pairs, vocab, ["id"])
    plan = c._jdf.queryExecution().executedPlan().toString() + me.tter_region_by_pair(pairs, vocab, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    r = {x.id: x for x in c.collect()}
    assert [(d.pos, d.type, d.ref_word, d.hyp_word, d.grp) for d in r[1].diff if d.type != "equal"] == [
        (2, "substitute", "qdrant", "quadrant", 0), (3, "delete", "and", "", 1), (6, "insert", "", "so", 2)
    ]
    assert r[1].overall_tter == 0.0 and r[2].overall_tter is None and r[2].diff == []
    per = {x.id: x for x in me.tter_region_by_pair(pairs, vocab, ["id"]).collect()}
    whole = {x.id: x for x in me.tter_region(me.tter_region_occurrences(pairs, vocab, ["id"]), ["id"])[1].collect()}
    assert per == whole


def test_long_texts_leave_the_built_in_distance(spark):
    """F1, F32, F35: the table of the built-in distance grows with the square of a text."""
    import random
    import time

    from verbascope.operators.alignment import distance

    draw = random.Random(3)
    ref = [draw.choice(["anna", "ran", "the", "build", "on", "cloud"]) + str(draw.randrange(40)) for _ in range(9000)]
    hyp = [w if draw.random() < 0.7 else "zz" + w for w in ref]
    short = spark.createDataFrame([(1, " ".join(ref[:150]), " ".join(hyp[:150]))], "id int, ref string, hyp string")
    r = short.select(F.levenshtein("ref", "hyp").alias("c"), "ref", "hyp").first()
    assert r.c == distance(r.ref, r.hyp) and distance("", "ab") == 2 and distance("ab", "") == 2
    long = spark.createDataFrame([(1, " ".join(ref), " ".join(hyp))], "id int, ref string, hyp string")
    t0 = time.time()
    x = me.error_rates(long).first()
    assert x.word_errors == sum(a != b for a, b in zip(ref, hyp)) and time.time() - t0 < 15


def test_word_distances_of_many_pairs_are_exact(spark):
    import random

    import pyarrow as pa

    from verbascope.operators import alignment as al

    rng = random.Random(3)
    refs = [[rng.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 2, 9, 63, 64, 65, 90, 300) * 12]
    hyps = [[w if rng.random() > 0.2 else rng.choice("xyz") for w in x if rng.random() > 0.1] if k % 5 else ["x"] * (k % 7) for k, x in enumerate(refs)]
    # More than 127 distinct words, as one byte no longer holds their number.
    refs, hyps = [*refs, [f"w{k}" for k in range(200)]], [*hyps, [f"w{k}" if k % 9 else f"v{k}" for k in range(200)]]
    kind = pa.list_(pa.string())
    want = [al.distance(x, y) for x, y in zip(refs, hyps)]
    assert al.word_distances(pa.array(refs, kind), pa.array(hyps, kind)).tolist() == want
    d = spark.createDataFrame([*zip(refs, hyps), (None, ["a"])], "a array<string>, b array<string>")
    assert [x.d for x in d.coalesce(1).select(al.words_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [*want, None]


def test_terms_of_a_pair_are_summed_where_the_pair_is(spark):
    """no occurrence is shuffled to be counted by term."""
    texts = ["we use qdrant and qdrant daily with kafka", "", "kafka kafka kafka", None, "nothing here", "qdrant"]
    pairs = spark.createDataFrame([(k, x, "we use quadrant qdrant daily so" if k % 2 else "kafka") for k, x in enumerate(texts)], "id int, ref string, hyp string")
    vocab = spark.createDataFrame([("Qdrant", "product_name", ["quadrant"], 0), ("kafka", None, [], 1), ("QDRANT", "tech_term", None, 2)], "term string, category string, known_errors array<string>, pos int")
    got = me.tter_region_by_term(pairs, vocab, ["id"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = me.tter_region(me.tter_region_occurrences(pairs, vocab, ["id"]), ["id"])[0]
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() == 6
