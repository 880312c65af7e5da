"""Work on a pair is done in its row: texts and words are not shuffled."""

from pyspark.sql import functions as F

from verbascope.operators import metrics as me
from verbascope.operators import terms as te
from verbascope.operators import training as tr

PAIRS = [(1, "Anna moved to Cloudbase", "Anna moved to Cloudways"), (None, "Anna and Bert met", "Anna met"), (2, None, "so we met")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_examples_are_made_in_the_row_of_a_pair(spark):
    pairs = spark.createDataFrame(PAIRS, "id int, ref string, hyp string")
    e = tr.alignment_examples(pairs, ["id"], "x", negative_rate=1.0)
    assert exchanges(e) == 0
    got = {(r.id, r.pos): (r.term, r.error_found, r.is_negative, r.corrected) for r in e.collect()}
    assert got[1, 3] == ("Cloudbase", "Cloudways", False, "Anna moved to Cloudbase")
    # A pair without a key is a pair, too.
    assert got[None, 0] == ("Anna", "Anna", True, "Anna met") and len(got) == 5


def test_target_rates_are_made_in_the_row_of_a_pair(spark):
    pairs = spark.createDataFrame(PAIRS, "id int, ref string, hyp string").withColumn("own", F.array(F.lit("cloudbase"), F.lit("bert")))
    d = me.tter_of_targets(pairs, F.col("own"), ["id"])
    assert exchanges(d) == 0
    got = {r.id: (r.substitutions, r.deletions, r.insertions, r.target_total, r.tter) for r in d.collect()}
    assert got == {1: (1, 0, 0, 1, 1.0), None: (0, 1, 0, 1, 1.0), 2: (0, 0, 0, 0, 0.0)}


def test_chunks_are_sampled_before_they_are_shuffled(spark):
    words = "their plan is to write new code here and know which way is right for the two teams".split()
    # Two rows of one meeting share its places.
    m = spark.createDataFrame([(1, " ".join(words * 150)), (1, " ".join(words * 160)), (2, " ".join(words * 90))], "meeting_id int, text string")
    p = tr.meeting_pairs(m)
    assert exchanges(p) == 1
    per = {r.meeting_id: r["count"] for r in p.groupBy("meeting_id").count().collect()}
    assert set(per) == {1, 2} and max(per.values()) <= 20
    assert "slice(array_sort(" in p._jdf.queryExecution().executedPlan().toString()


def test_target_summary_counts_the_terms_of_files(spark):
    rows = [(1, "the NASA-7 probe, Probe and probe of monday"), (2, "THE ALL"), (3, "the the state-run Kubelet"), (4, None), (5, "monday the")]
    texts = spark.createDataFrame(rows + [(9, "the " * 2000)], "file_id int, text string")
    keywords = spark.createDataFrame([("monday",), ("the",), ("state-run",)], "keyword string")
    terms = te.target_terms(texts, keywords, te.corpus_zipf(texts))
    want = {r.file_id: r["count"] for r in terms.groupBy("file_id").count().collect()}
    at = {r.file_id: r.target_positions for r in te.target_positions(texts, terms).collect()}
    d = te.target_summary(texts.repartition(4, "file_id"), keywords)
    assert {r.file_id: (r.target_terms, r.target_positions) for r in d.collect()} == {f: (n, at.get(f, 0)) for f, n in want.items()}
    # Beside the word counts the texts are dealt by file alone.
    assert "SortMergeJoin [file_id" not in d._jdf.queryExecution().executedPlan().toString()


def test_scripts_of_many_pairs_are_those_of_single_ones():
    """pairs are aligned together, with the ties of the walk of one pair."""
    import random

    import pyarrow as pa

    from verbascope.operators import alignment as al

    rng, kind = random.Random(2), pa.list_(pa.string())
    refs, hyps = [[], None, ["a"], None], [[], ["a"], None, None]
    for n in (0, 1, 2, 3, 5, 9, 20, 63, 64, 65, 90) * 30:
        book = rng.choice(["ab", "abc", "abcdefgh"])
        x = [rng.choice(book) for _ in range(n)]
        y = [w if rng.random() > 0.2 else rng.choice("abcxyz") for w in x for _ in range(rng.choice([1, 1, 1, 2])) if rng.random() > 0.1]
        refs, hyps = [*refs, x, x], [*hyps, y, [rng.choice(book) for _ in range(rng.choice([0, 1, 3, 70]))]]
    want = [al.edit_script(x or [], y or []) for x, y in zip(refs, hyps)]
    assert al.edit_scripts(pa.array(refs, kind), pa.array(hyps, kind)) == want
    assert al.edit_scripts(pa.array([["q"], *refs], kind)[1:], pa.array([[], *hyps], kind)[1:]) == want
