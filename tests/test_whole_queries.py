"""Catalogue queries on small tables that hold what a cut would lose."""

import pytest

from verbascope.catalog import load
from verbascope.functions.similarity import jaro_winkler

# Length 9 is dealt the kind 'feature', length 6 'product_name'.
TERMS = ["dashboard", "resume"]
SAID = ["résumé", "resumé", "re-sume", "resume2", "l'resume", "resume", "straße", "дом", "dashboards"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    frames = {
        "documents": ([(k, " ".join(TERMS), "en", "s") for k in range(32)], "doc_id long, text string, lang string, source string"),
        "conversations": (
            [(1, 0, "user", "dashboard is what we see here"), (1, 1, "user", "so we look at it"), (2, 0, "user", " ".join(f"({w})," for w in SAID))],
            "conv_id long, turn long, role string, text string",
        ),
        "pages": (
            [(1, "https://a.org/x", "<html><body>" + "long before " * 9 + "see EXAMPLE.com</body></html>"), (2, "https://b.org/x", "<p>nothing</p>"), (3, "https://example.com/", "")],
            "page_id long, url string, html string",
        ),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def run(spark, tables, name):
    return [tuple(r) for r in load().QUERIES[name](spark, tables).collect()]


def said():
    """The words as the noisy table has them: the first one is said wrongly."""
    return {*SAID, *"dahboard is what we see here so we look at it".split()}


def test_jaro_winkler_pairs_take_words_of_any_characters(spark, tables):
    got = {(a, b): s for a, b, s in run(spark, tables, "jaro_winkler_pairs")}
    want = {(a, b): round(s, 6) for a in said() for b in TERMS if (s := jaro_winkler(a, b)) > 0.75}
    assert got == want
    assert {"résumé", "resumé", "re-sume", "resume2", "l'resume"} <= {a for a, _ in got}


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


def spelling(e, k):
    d, le, lk = edits(e, k), len(e), len(k)
    ratio, same = min(le, lk) / max(le, lk), 1 - d / max(le, lk)
    both = len(set(e) & set(k)) / len(set(e) | set(k))
    if e == k:
        return 1.0
    if (k.startswith(e) or e.startswith(k)) and abs(le - lk) > 1 or le <= 2 or le == 3:
        return 0.05
    if le == 4 and (d > 1 or ratio < 0.75):
        return 0.1
    return 0.3 * same * (same > 0.4) + 0.2 * ratio * (ratio >= 0.65) + 0.15 * both * (both >= 0.4)


def test_plausibility_takes_words_of_any_characters(spark, tables):
    got = {(w, k): s for w, k, s in run(spark, tables, "plausibility_spelling")}
    words = ["resumé", "re-sume", "resume2", "resume", "dashboards", "dahboard"]
    assert {p for p in got if p[0] in words} == {(w, k) for w in words for k in TERMS if w[:2] == k[:2]}
    assert all(s == pytest.approx(spelling(w, k), abs=2e-6) for (w, k), s in got.items())


def test_search_reads_whole_pages(spark, tables):
    assert {p: found for p, found, *_ in run(spark, tables, "labels_and_search")} == {1: "hit", 2: "miss", 3: "hit"}


def test_features_are_reconciled_as_candidates(spark, tables):
    assert run(spark, tables, "reconciled_swaps") == [(1, 0, 1, 0, "dahboard", "dashboard", "candidate", 0.95)]
    assert {(f, s): c for f, s, _, c in run(spark, tables, "reconciled_segments")}[1, 0]
