"""One pass for all terms against a search for each."""

import random

from verbascope.operators import positions as ps
from verbascope.operators.terms import find_terms


def texts_and_terms(seed, n=60):
    rng = random.Random(seed)
    part = ["a", "ab", "aab", "é", "日", " ", " ", "-", "_", "'", "b", "Ab", "ß", "😀"]
    make = lambda most: "".join(rng.choice(part) for _ in range(rng.randint(1, most)))
    return [make(40) for _ in range(n)] + ["", " ", None, "aa" * 300], sorted({make(4).strip() for _ in range(40)} - {""})


def plain(texts, terms, find):
    return {(n, w): p for n, t in enumerate(texts) if t for w in terms if (p := find(t, w))}


def scanned(array):
    return {(n, h["term_key"]): h["positions"] for n, hits in enumerate(array.to_pylist()) for h in hits}


def test_scan_finds_what_single_searches_find():
    for seed in range(5):
        texts, terms = texts_and_terms(seed)
        assert scanned(ps.TermScan(terms, False).search(texts)) == plain(texts, terms, ps._starts)
        assert scanned(ps.TermScan(terms, True).search(texts)) == plain(texts, terms, ps._whole_words)
    assert ps.TermScan([], False).search(["a", None]).to_pylist() == [[], []] and ps.TermScan(["a"], True).search([]).to_pylist() == []


def test_terms_in_parts(spark, monkeypatch):
    texts, terms = texts_and_terms(9)
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "file_id int, text string").repartition(3)
    vocab = spark.createDataFrame([(w,) for w in [*terms, *terms, "", " x", None]], "term_key string")
    whole_table = spark.createDataFrame([(0, "x")], "file_id int, text string")
    for at_once in (100_000, 7):
        monkeypatch.setattr(ps, "TERMS_AT_ONCE", at_once)
        for whole, find in ((False, ps._starts), (True, ps._whole_words)):
            got = {(r.file_id, r.term_key): r.positions for r in find_terms(df, vocab, ["file_id"], whole).collect()}
            assert got == plain(texts, terms, find)
    assert find_terms(df, vocab.limit(0), ["file_id"]).count() == 0
    assert "Exchange" not in find_terms(whole_table, vocab, ["file_id"])._jdf.queryExecution().sparkPlan().toString()
