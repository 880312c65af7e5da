"""Kernels against plain dynamic programming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbascope import catalog
from verbascope.catalog.registry import Tables
from verbascope.functions import fuzzy
from verbascope.functions import similarity as sim
from verbascope.functions.text import strip_punct
from verbascope.operators import alignment as al
from verbascope.operators import vocabulary as vo
from verbascope.operators.alternatives import similar_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("trace_bits", [1 << 28, 64])
def test_edit_script_is_optimal(monkeypatch, trace_bits):
    monkeypatch.setattr(al, "TRACE_BITS", trace_bits)
    rnd = random.Random(7)
    for _ in range(600):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 15))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 15))]
        s = al.edit_script(a, b)
        i = j = 0
        for c in s:
            if c in "es":
                assert (a[i] == b[j]) == (c == "e")
            i += c != "i"
            j += c != "d"
        assert (i, j) == (len(a), len(b))
        assert sum(c != "e" for c in s) == distance(a, b)


def test_indel_ratio_matches_lcs():
    rnd = random.Random(3)
    for _ in range(300):
        a = "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12)))
        b = "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 12)))
        assert sim.indel_ratio(a, b) == pytest.approx(200.0 * lcs(a, b) / (len(a) + len(b)))


def test_known_codes():
    assert sim.metaphone("metaphone") == "MTFN"
    assert sim.metaphone("quadrant") == sim.metaphone("qdrant")
    assert sim.metaphone("thumb") == "0M"
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert sim.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_word_distance_in_jvm_equals_plain_dp(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        a = [rnd.choice(["été", "to", "of", "straße", "x"]) for _ in range(rnd.randint(1, 90))]
        b = [w for w in a if rnd.random() > 0.2] or ["x"]
        rows.append((k, a, b, distance(a, b)))
    d = spark.createDataFrame(rows, "k int, a array<string>, b array<string>, want int")
    assert d.where(sim.word_distance(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_fuzzy_blocking_loses_no_pair(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefg-é1") for _ in range(rnd.randint(1, 9)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)})
    l = spark.createDataFrame([(w,) for w in left], "word string")
    r = spark.createDataFrame([(w,) for w in right], "term_key string")
    got = {(x.word, x.term_key) for x in vo.fuzzy_pairs(l, r).collect()}
    assert got == {(a, b) for a in left for b in right if a != b and sim.indel_ratio(a, b) >= 60}
    jw = similar_pairs(l.withColumnRenamed("word", "a"), r.withColumnRenamed("term_key", "b"), [], 0.75)
    assert {(x.a, x.b) for x in jw.collect()} == {(a, b) for a in left for b in right if sim.jaro_winkler(a, b) > 0.75}


def test_batch_kernels_are_the_scalar_ones():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé日") for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 20, 63, 64, 65, 90])))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    assert sim.jaro_winklers(a, b).tolist() == [sim.jaro_winkler(x, y) for x, y in zip(a, b)]
    assert sim.indel_ratios(a, b).tolist() == [sim.indel_ratio(x, y) for x, y in zip(a, b)]


def test_limit_is_not_rounded():
    assert sim.jaro_winkler("erbleanatingble", "ention") > 0.75


def test_edit_script_is_the_same_at_any_length(monkeypatch):
    rnd = random.Random(8)
    pairs = [([rnd.choice("abc") for _ in range(rnd.randint(0, 40))], [rnd.choice("abc") for _ in range(rnd.randint(0, 40))]) for _ in range(500)]
    whole = [al.edit_script(a, b) for a, b in pairs]
    for bits in (0, 40, 700):
        monkeypatch.setattr(al, "TRACE_BITS", bits)
        assert [al.edit_script(a, b) for a, b in pairs] == whole


def test_word_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK_WORDS", 7)
    left, right = [f"word{k}" for k in range(30)] + [None], [f"ward{k}" for k in range(20)]
    l, r = spark.createDataFrame([(x,) for x in left], "word string"), spark.createDataFrame([(x,) for x in right], "term_key string")
    got = [(x.word, x.term_key) for x in vo.fuzzy_pairs(l, r, 80.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in left[:-1] for b in right if sim.indel_ratio(a, b) >= 80}
    assert vo.fuzzy_pairs(l.limit(0), r).count() == 0


def test_plausibility_guards(spark):
    rows = [("quadrant", "Qdrant"), ("and", "Andre"), ("is", "IT"), ("but", "Bud"), ("groq", "Groq")]
    d = spark.createDataFrame(rows, "e string, t string")
    p = sim.plausibility(F.col("e"), F.col("t"), sim.metaphone_udf("e"), sim.metaphone_udf(F.lower("t")))["score"]
    s = {r.e: r.s for r in d.select("e", p.alias("s")).collect()}
    assert s["quadrant"] >= sim.ACCEPT_PLAUSIBILITY
    assert s["and"] == 0.05 and s["is"] == 0.05 and s["but"] == 0.05 and s["groq"] == 1.0


ODD_WORDS = ["", "a", "é" * 70, "x" * 64, "x" * 65, "naïve", "ab" * 40, "日本語", "日本", "aaaaaaa", "aaaa", "mississippi", "misisipi", "ΑΒΓ", "abcdefghij" * 6]


@pytest.mark.parametrize(
    ("measure", "plain"),
    [(fuzzy.IndelRatio(60.0), sim.indel_ratio), (fuzzy.IndelRatio(85.0), sim.indel_ratio), (fuzzy.JaroWinkler(0.75), sim.jaro_winkler), (fuzzy.JaroWinkler(0.9), sim.jaro_winkler)],
)
def test_bounds_lose_no_pair(measure, plain):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrsté") for _ in range(rng.randint(1, 12))) for _ in range(150)] + ODD_WORDS
    for left, right in ((words, words[::2]), (ODD_WORDS, ["z"]), ([], words), (words, [])):
        want = {(i, j): v for i, a in enumerate(left) for j, b in enumerate(right) if measure.accept(v := plain(a, b))}
        i, j, value, _ = fuzzy.close_pairs(left, right, measure)
        assert {(a, b): v for a, b, v in zip(i.tolist(), j.tolist(), value.tolist())} == want and len(i) == len(want)


@pytest.fixture(scope="module")
def said_and_terms(spark):
    """All words and terms of a table, as the catalogue's queries take them."""
    t = Tables(spark, "/root/testdata/sf0.01")
    words = sorted(w for (w,) in t.noisy_words.select(strip_punct("word")).distinct().collect() if w is not None)
    return words, sorted(k for (k,) in t.vocab.select("term_key").collect())


@pytest.mark.parametrize(("measure", "share"), [(fuzzy.IndelRatio(60.0), 0.05), (fuzzy.JaroWinkler(0.75), 0.08)])
def test_few_pairs_are_scored(said_and_terms, measure, share):
    """Of Jaro-Winkler 3.2 % of all pairs are results here."""
    words, terms = said_and_terms
    i, j, value, scored = fuzzy.close_pairs(words, terms, measure)
    assert len(i) <= scored < share * len(words) * len(terms)
    plain = sim.indel_ratios if isinstance(measure, fuzzy.IndelRatio) else sim.jaro_winklers
    got = set(zip(i.tolist(), j.tolist(), value.tolist()))
    for first in range(0, len(words), 1000):
        some = words[first : first + 1000]
        all_ = plain([w for w in some for _ in terms], terms * len(some))
        assert {(a, b, v) for a, b, v in got if first <= a < first + 1000} == {(first + k // len(terms), k % len(terms), v) for k, v in enumerate(all_.tolist()) if measure.accept(v)}


def test_nearest_pairs_are_the_first_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.choice([1, 4, 6, 7, 9, 70])))
    left, right = sorted({word() for _ in range(60)}), sorted({word() for _ in range(150)})
    order = list(range(len(right)))
    rnd.shuffle(order)
    pairs = [(a, b, sim.indel_ratio(a, b), o) for a in left for b, o in zip(right, order) if sim.indel_ratio(a, b) >= 60]
    want = {(a, b) for w in left for a, b, _, _ in sorted((p for p in pairs if p[0] == w), key=lambda p: (-p[2], p[3]))[:3]}
    i, j, _, scored = fuzzy.nearest_pairs(left, right, fuzzy.IndelRatio(60.0), 3, np.array(order))
    assert {(left[a], right[b]) for a, b in zip(i, j)} == want and len(i) == len(want)
    # Of each block only its first ones leave the task.
    monkeypatch.setattr(fuzzy, "BLOCK_WORDS", 50)
    l = spark.createDataFrame([(x,) for x in left], "a string")
    r = spark.createDataFrame(list(zip(right, order)), "b string, o long")
    met = fuzzy.fuzzy_word_join(l, "a", r, "b", fuzzy.IndelRatio(60.0), "v", 3, "o").collect()
    assert want <= {(x.a, x.b) for x in met} and len(met) < len(pairs) and len(met) <= len(left) * 3 * 3


def test_plausibility_score_is_that_of_the_verdict(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.choice([0, 1, 3, 4, 6, 9, 66])))
    rows = [(a, rnd.choice([a, a + word(), a[:-1], word()])) for a in (word() for _ in range(2000))] + [(None, "ab"), ("ab", None)]
    p = spark.createDataFrame(rows, "e string, t string")
    got = p.select(sim.plausibility("e", "t")["score"].alias("a"), sim.plausibility_score(F.col("e"), F.col("t")).alias("b"))
    assert got.where("NOT (a <=> b)").count() == 0


def test_pairs_of_few_words_are_made_by_all_tasks(spark):
    pairs = catalog.load().QUERIES["plausibility_spelling"](spark, "/root/testdata/sf0.001")
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_a_word_meets_all_terms_of_its_beginning(spark):
    """Every pair of one beginning once, with the score of the verdict, and no pair is measured by itself."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 16, 17, 64, 65, 70])))
    terms = sorted({word() for _ in range(300)})
    words = sorted({x for t in terms[:120] for x in (t, t[:-1] or "a", t + "b", t[:2] + word())} | {word() for _ in range(100)})
    w, t = (spark.createDataFrame([(x,) for x in side], f"{c} string") for side, c in ((words, "w"), (terms, "t")))
    got = {(x.w, x.t): x.s for x in fuzzy.plausible_spellings(w, t, "w", "t", 2, "s", 6).collect()}
    met = w.crossJoin(t).where("left(w, 2) = left(t, 2)")
    want = {(x.w, x.t): x.s for x in met.select("w", "t", F.round(sim.plausibility("w", "t")["score"], 6).alias("s")).collect()}
    assert got == want and len(set(want.values())) > 50
    plan = catalog.load().QUERIES["plausibility_spelling"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan.split("Physical Plan")[1]


def test_a_word_meets_a_block_of_words_at_once():
    """Common characters of all pairs are exact, and only pairs of enough of them are measured."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aeinrsté") for _ in range(rng.choice([1, 3, 8, 16, 17, 40, 64]))) for _ in range(120)} - {""})
    held = fuzzy.sides(words)
    assert [s.kind for s in held] == [np.uint16, np.uint64] and sorted(k for s in held for k in s.at) == list(range(len(words)))
    measure = fuzzy.IndelRatio(60.0)
    for a in words[:40]:
        for side in held:
            j, common = measure.meet(a, side, np.zeros(len(side.at), dtype=np.uint8))
            got = [200.0 * int(n) / (len(a) + len(words[k])) for k, n in zip(side.at[j], common)]
            assert len(j) == len(side.at) and got == pytest.approx([sim.indel_ratio(a, words[k]) for k in side.at])
    i, _, _, scored = fuzzy.close_pairs(words, words, measure)
    assert scored == len(i) < len(words) ** 2 / 2
