"""Operators against brute force, plan shapes, folds and streams."""

import random

import pytest
from pyspark.sql import functions as F

from verbascope.operators import evidence as ev
from verbascope.operators import intervals as iv
from verbascope.operators import matching as ma
from verbascope.operators import reconcile as rc
from verbascope.operators import training as tr
from verbascope.operators.ranges import merge_ranges
from verbascope.operators.vocabulary import merge_vocabularies
from verbascope.plans.correction import CorrectionSettings
from test_kernels import distance


def spans(spark, seed, n, name):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = round(rnd.random() * 300, 1)
        rows.append((rnd.randint(0, 2), i, s, round(s + rnd.choice([0.0, 5.0, 40.0]), 1)))
    return rows, spark.createDataFrame(rows, f"file_id int, {name} int, start_s double, end_s double")


@pytest.mark.parametrize("closed", [True, False])
def test_overlap_join_equals_brute_force(spark, closed):
    a_rows, a = spans(spark, 1, 60, "a")
    b_rows, b = spans(spark, 2, 60, "b")
    got = sorted((r.a, r.b) for r in iv.overlap_join(a, b, ["file_id"], closed).collect())
    lt = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    want = sorted((x[1], y[1]) for x in a_rows for y in b_rows if x[0] == y[0] and lt(x[2], y[3]) and lt(y[2], x[3]))
    assert got == want


def test_joins_have_no_nested_loop(spark):
    _, a = spans(spark, 1, 10, "a")
    _, b = spans(spark, 2, 10, "b")
    d = spark.createDataFrame([(1, "some words here for you now")], "id int, text string")
    plans = [
        iv.overlap_join(a, b, ["file_id"], True), iv.within(a, "start_s", b.withColumnRenamed("start_s", "c").select("file_id", "b", "c"), "c", 15.0, ["file_id"]),
        ma.match_texts(d.withColumnRenamed("id", "hyp_id"), d.withColumnRenamed("id", "ref_id")),
    ]
    for p in plans:
        text = p._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_merge_ranges_disjoint_and_covering(spark):
    rows, a = spans(spark, 4, 80, "a")
    got = merge_ranges(a, 2.0, 5.0, chunk_s=30.0).collect()
    for f in {r[0] for r in rows}:
        padded = sorted((max(s - 2, 0), e + 2) for x, _, s, e in rows if x == f)
        want = []
        for s, e in padded:
            if want and s <= want[-1][1] + 5:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        mine = sorted([r.start_s, r.end_s] for r in got if r.file_id == f)
        assert mine == pytest.approx(want) if not mine else [x for y in mine for x in y] == pytest.approx([x for y in want for x in y])


def test_frame_folds(spark):
    t = [0.0, 3.0, 5.0, 5.1, 9.0, 11.0, 30.0]
    d = spark.createDataFrame([(1, x) for x in t] + [(2, 1.0)], "file_id bigint, ts double")
    assert sorted((r.file_id, r.ts) for r in ev.spaced_times(d).collect()) == [(1, 0.0), (1, 5.1), (1, 11.0), (1, 30.0), (2, 1.0)]
    plan = ev.frame_plan(d, spark.createDataFrame([(1, 60.0), (3, 8.0)], "file_id bigint, duration double"), budget=6).collect()
    one = [r.ts for r in plan if r.file_id == 1]
    assert one == sorted(one) and len(one) <= 6 and {0.0, 5.1, 11.0, 30.0} <= set(one)
    assert [r.ts for r in plan if r.file_id == 3] == pytest.approx([8 / 7, 8 / 7 * 6])


def test_match_texts_equals_brute_force(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eps", "the", "of"]
    refs = [(i, "common head " * (i % 2) + " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12)))) for i in range(60)]
    hyps = [(i, " ".join(w for w in t.split() if rnd.random() > 0.15) or "none at all") for i, t in refs]
    got = {r.hyp_id: (r.ref_id, round(r.wer, 9), r["pass"]) for r in ma.match_texts(spark.createDataFrame(hyps, "hyp_id int, text string"), spark.createDataFrame(refs, "ref_id int, text string")).collect()}
    want = {}
    firsts = {}
    for i, t in refs:
        firsts.setdefault(t.strip(), i)
    for h, t in hyps:
        t = " ".join(t.lower().split())
        if len(t) < 10:
            continue
        same = [i for i, r in refs if " ".join(r.split()) == t]
        if same:
            want[h] = (min(same), 0.0, 1)
            continue
        rate = lambda r: distance(r.split(), t.split()) / len(r.split())
        distinct = {}
        for i, r in refs:
            distinct.setdefault(" ".join(r.split()), i)
        p2 = [(rate(r), i) for r, i in distinct.items() if r[:10] == t[:10] and len(r) >= 10 and len(t) <= 2 * len(r) and len(r) <= 2 * len(t)]
        p2 = [x for x in p2 if x[0] <= 0.5]
        p3 = [(rate(r), i) for r, i in distinct.items() if abs(len(r) - len(t)) <= len(t) * 0.5]
        p3 = [x for x in p3 if x[0] <= 0.5]
        best, no = (min(p2), 2) if p2 else (min(p3), 3) if p3 else (None, 0)
        if best:
            want[h] = (best[1], round(best[0], 9), no)
    assert got == want


def test_vocabulary_merge_is_idempotent(spark):
    ddl = "term string, category string, known_errors array<string>, pos int"
    dom = spark.createDataFrame([("Groq", "company_name", ["grok", "groc"], 0), ("groq", "tech_term", ["grock", "grok"], 1), ("RAG", None, [], 2)], ddl)
    cus = spark.createDataFrame([("GROQ", "custom", ["gruck"], 0), ("Newt", None, ["nude"], 1)], ddl)
    m = {r.term_key: r for r in merge_vocabularies(dom, cus).collect()}
    assert m["groq"].term == "Groq" and m["groq"].category == "custom" and m["groq"].known_errors == ["grok", "groc", "grock", "gruck"]
    assert m["newt"].category == "custom" and m["rag"].known_errors == []
    again = merge_vocabularies(merge_vocabularies(dom, cus))
    assert {r.term_key for r in again.collect()} == set(m)


def test_reconcile_end_to_end(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 4.0, "we use quadrant for search"), (1, 1, 4.0, 8.0, "all good here")], "file_id bigint, segment_id int, start_s double, end_s double, text string")
    ret = spark.createDataFrame([(1, 1, 0.0, 5.0, "we use Qdrant for search all good here")], "file_id bigint, range_no int, start_s double, end_s double, text string")
    ans = spark.createDataFrame(
        [(1, 0, '{"text": "we use Qdrant for search", "swaps": ["quadrant → Qdrant", "a → a", "x y → z"]}'), (1, 1, '{"text": "all bad here", "swaps": ["good → bad"]}')],
        "file_id bigint, segment_id int, response string",
    )
    vocab = spark.createDataFrame([("Qdrant", "qdrant", "product_name", ["quadrant"], 0)], "term string, term_key string, category string, known_errors array<string>, pos int")
    cand = spark.createDataFrame([(1, "quadrant", "Qdrant", 0.0, 16.0)], "file_id bigint, error_found string, term string, timestamp_start double, timestamp_end double")
    none = spark.createDataFrame([], "file_id bigint, term string")
    hints = spark.createDataFrame([(1, "Welcome to Search")], "file_id bigint, line string")
    out, swaps = rc.reconcile(seg, ret, ans, vocab, cand, none, hints)
    assert {r.segment_id: r.text for r in out.collect()} == {0: "we use Qdrant for search", 1: "all good here"}
    assert [(r.old_word, r.new_word, r.status, r.swap_confidence) for r in swaps.collect()] == [("quadrant", "Qdrant", "candidate", 0.95)]


def test_split_is_disjoint_and_complete(spark):
    d = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    s = tr.split_train_valid(d, F.col("k"))
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 850, "valid": 150} and s.select("k").distinct().count() == 1000


def test_settings_whitelist():
    s = CorrectionSettings.merged({"enable_avsr": False, "nonsense": 1})
    assert s.enable_avsr is False and s.enable_ocr_extraction is True


@pytest.mark.parametrize("name", ["stream_step_state", "normalise_text", "merged_ranges", "wer_by_dataset_accent", "job_kpis", "detector_candidates"])
def test_query_equals_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from check import TABLES, rows

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, rel.fetchall())
