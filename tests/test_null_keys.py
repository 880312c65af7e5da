"""Rows with NULL keys, NULL order values and copies are neither lost nor torn apart."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from verbascope.operators import training as tr
from verbascope.operators.alternatives import snippet_override
from verbascope.operators.ordered import hash_rank, running
from verbascope.operators.positions import with_offsets
from verbascope.operators.ranges import drop_repeats, merge_ranges
from verbascope.sources.lines import cut_points


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_running_keeps_null_rows(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([1, 2, None]), k if rnd.random() < 0.9 else None, k) for k in range(300)]
    d = spark.createDataFrame(data, "k int, o int, v int")
    for how, agg in (("sum", F.sum), ("max", F.max)):
        w = Window.partitionBy("k").orderBy("o", "v").rowsBetween(Window.unboundedPreceding, -1)
        got = running(d, ["k"], F.floor(F.col("o") / 16), ["o", "v"], F.col("v"), "r", how)
        assert rows_of(got) == rows_of(d.withColumn("r", agg("v").over(w)))
    assert rows_of(running(d, [], F.floor(F.col("o") / 16), ["o", "v"], F.col("v"), "r").select("v"))[:1] and running(d, [], F.col("o"), ["o", "v"], F.col("v"), "r").count() == 300


def test_ranks_offsets_and_repeats_keep_null_rows(spark):
    d = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    assert sorted(r.rank for r in hash_rank(d, F.col("k"), "x").collect()) == [0, 1, 2]
    s = spark.createDataFrame([(None, 0, "ab"), (1, 0, "abc"), (None, 1, "x")], "file_id long, segment_id int, text string")
    assert with_offsets(s).count() == 3
    f = spark.createDataFrame([(None, 0.0, "a"), (None, 9.0, "a"), (None, 4000.0, "b"), (1, None, "a"), (1, 5.0, "a"), (1, 9000.0, "a")], "file_id long, ts double, text string")
    assert rows_of(drop_repeats(f, ("file_id",), "ts", "text")) == [(1, None, "a"), (None, 0.0, "a"), (None, 4000.0, "b")]
    r = spark.createDataFrame([(None, 0.0, 1.0), (None, 2.0, 3.0), (1, 50.0, 60.0)], "file_id long, start_s double, end_s double")
    assert merge_ranges(r).count() == 2


def test_copies_stay_on_one_side(spark):
    d = spark.range(400).select(F.col("id").cast("string").alias("example_key"), (F.col("id") % 3 == 0).alias("is_negative"))
    m = tr.merge_sources({"a": d, "b": d.where("id % 2 = 0") if "id" in d.columns else d.limit(100)}, upsampled=("b",))
    sides = m.groupBy("source", "example_key").agg(F.count_distinct("split").alias("n"), F.count("*").alias("c"))
    assert sides.where("n > 1").count() == 0 and sides.where("c = 3").count() > 50
    assert 0.75 < m.where("split = 'train'").count() / m.count() < 0.95


def test_vocabulary_terms_are_not_overridden(spark):
    c = spark.createDataFrame([(1, 1, "quadrant", "Qdrant"), (1, 2, "quadrent", "Qdrantz")], "file_id int, seq int, error_found string, term string")
    found = spark.createDataFrame([("quadrant", 1, "", "Quadrants rule"), ("quadrent", 1, "", "Quadrants rule")], "query_key string, rank int, title string, body string")
    vocab = spark.createDataFrame([("Qdrant",)], "term string")
    assert {r.seq: r.new_term for r in snippet_override(c, found, vocab).collect()} == {1: None, 2: "Quadrants"}


def test_chunks_follow_their_rule():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "b ", ". ", "? ", "! ", "\n", "."]) for _ in range(rnd.randint(0, 120)))
        size, look = rnd.randint(12, 30), rnd.randint(1, 10)
        overlap = rnd.randint(0, size - look - 2) if size - look > 2 else 0
        cuts = list(cut_points(text, size, overlap, look))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
        for (a, b), (c, _) in zip(cuts, cuts[1:]):
            assert a < b <= a + size and c == max(b - overlap, a + 1)
            low = max(a + size - look, a + 1)
            ends = [max((k + len(m) for k in range(low, a + size - len(m) + 1) if text.startswith(m, k)), default=None) for m in (". ", "? ", "! ", "\n")]
            assert b == next((e for e in ends if e), a + size)
