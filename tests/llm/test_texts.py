import hashlib
import math
import random
import string
from collections import Counter, defaultdict

import pytest
from helpers import SF, classes, edge_docs, edits_within, plain, shingle_set
from pyspark.sql import functions as F

from verbascope.llm import decontaminate, line_dedup, lm_score, near_copies


def brute_lines(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    last = {k: max((i for i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    rng = random.Random(batches)
    lines = ["Short", "  A line that several hold ", "a LINE that several hold", "Ä line that several hold", "", "another line of some length"]
    docs = edge_docs(spark, ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(40)])
    docs = docs.withColumn("text", F.when(F.col("doc_id").isNull(), lines[1]).otherwise(F.col("text")))
    got = line_dedup.dedup_lines(docs, min_chars=12, min_docs=3, batches=batches)
    want = brute_lines(plain(docs, "doc_id", "text"), 12, 3)
    assert sorted(plain(got, "doc_id", "n_lines", "n_dropped", "text"), key=repr) == want
    assert {"id", "line", "set"} <= set(got.columns) and sum(w[2] for w in want) > 20
    assert line_dedup.dedup_lines(docs.limit(0), batches=batches).count() == 0


def test_runs_are_compacted_and_tell_new_lines(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    for k in range(5):
        lines = spark.createDataFrame([(10 * k + d, f"l{x}".encode()) for d in range(3) for x in range(k, k + 3)], "id long, line binary")
        runs.add(lines)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    rows = runs.rows()
    assert rows.where("fresh").count() == rows.select("line").distinct().count() == 7
    assert {bytes(r.line): (r.docs, r.last) for r in line_dedup.merge(rows).collect()} == {f"l{x}".encode(): (3 * len(ks := [k for k in range(5) if k <= x <= k + 2]), 10 * max(ks) + 2) for x in range(7)}


def test_passages_against_alignment():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrstth") for _ in range(rng.randint(1, 8)))
    items = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(12)] + ["", "a", "ab cd ef"]
    passages = decontaminate.Passages(items, decontaminate.Budget())
    texts, kinds = [], []
    for _ in range(60):
        i = rng.randrange(12)
        x = list(items[i].upper())
        for _ in range(rng.randint(0, max(1, len(x) // 7))):
            k = rng.randrange(len(x))
            x[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        texts.append(" ".join(word() for _ in range(rng.choice([0, 30]))) + "--" + "".join(x).replace(" ", rng.choice([" ", "\n", " - "])) + "!! " + " ".join(word() for _ in range(rng.choice([0, 20]))))
        kinds.append(i)
    found = {(t, i): (e, a, b) for t, i, e, a, b in passages.find(["", *texts, ""])}
    for t, text in enumerate(texts, 1):
        for i in range(12):
            edits = edits_within(items[i], text)
            if edits <= passages.edits[i]:
                e, a, b = found[t, i]
                assert e == edits and edits_within(items[i], text[a:b]) <= 2 * edits
            else:
                assert (t, i) not in found


def test_hits_without_end_are_counted_in_batches(monkeypatch):
    text = "x1 " + "0" * 3000 + " y2 " + "0" * 90 + "7" * 400
    items = ["0" * 120, "0" * 60 + "7" * 60, "x1" + "0" * 100]
    want = decontaminate.Passages(items, decontaminate.Budget()).find([text, "0" * 50, text])
    assert {(t, i) for t, i, *_ in want} == {(t, i) for t in (0, 2) for i in range(3)}
    most, seen = 5000, []
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", most)
    passages = decontaminate.Passages(items, decontaminate.Budget())
    bands = passages._bands
    monkeypatch.setattr(passages, "_bands", lambda spot, k, n, *rest: seen.append(int(n.sum())) or bands(spot, k, n, *rest))
    assert passages.find([text, "0" * 50, text]) == want
    assert len(seen) > 20 and max(seen) <= most + 400


def test_short_items_have_a_tenth_of_their_letters_as_edits():
    rng = random.Random(8)
    items = ["".join(rng.choice("abcdefghij") for _ in range(m)) for m in (8, 9, 10, 15, 19, 20, 25, 29, 30, 31, 32, 40)]
    index = decontaminate.PassageIndex([*items, "short", ""], decontaminate.Budget())
    texts = []
    for x in items:
        y = list(x)
        for k in rng.sample(range(len(x)), len(x) // 10):
            y[k] = "z"
        texts.append("of " + "".join(y) + " it")
    found = {(t, i): e for t, i, e, _, _ in index.find(texts)}
    for n, x in enumerate(items):
        assert found[n, n] == edits_within(x, texts[n]) <= len(x) // 10


def test_find_and_remove_passages(spark):
    item = "A passage of the benchmark that is long enough to be told from others, by far."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (None, "Another passage of the same benchmark, of nearly the same length.")], "item_id long, text string")
    docs = edge_docs(spark, [f"before {item} after", "nothing", item.upper().replace(" ", "\n"), item[:40]])
    got = sorted(plain(decontaminate.find_passages(docs, bench), "doc_id", "item_id", "edits", "start", "end"))
    assert got == [(0, 1, 0, 7, 6 + len(item)), (0, 4, 0, 7, 6 + len(item)), (2, 1, 0, 0, len(item) - 1), (2, 4, 0, 0, len(item) - 1)]
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(plain(left, "doc_id"), key=repr) == sorted([(i,) for (i,) in plain(docs, "doc_id") if i not in (0, 2)], key=repr)
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0 and decontaminate.find_passages(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    blocks = list(decontaminate.item_blocks(bench, "item_id", "text", 8, 60))
    assert len(blocks) > 1 and sorted(x for ids, _ in blocks for x in ids if x) == [1, 4]


def test_table_passages(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    held = {(i, b) for i, t in plain(docs, "doc_id", "text") for b, x in plain(bench, "item_id", "text") if x in t}
    assert held and {r for r in plain(decontaminate.find_passages(docs, bench).where("edits = 0"), "doc_id", "item_id")} >= held


@pytest.mark.parametrize("tile", [3, 256])
def test_near_copies(spark, tile):
    rng = random.Random(tile)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 30)) for _ in range(40)) for _ in range(6)]
    texts = []
    for k in range(60):
        words = base[k % 6].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 3)}"
        texts.append(rng.choice([" ", "\n", ", "]).join(words).title())
    docs = edge_docs(spark, [*texts, "three words only", "Three words; only", "!?"])
    rows = plain(docs, "doc_id", "text")
    head, links = classes([shingle_set(t) for _, t in rows])
    least = {}
    for (i, _), h in zip(rows, head):
        least[h] = min((x for x in (least.get(h), i) if x is not None), default=None)
    want = sorted(((i, least[h], n) for (i, _), h, n in zip(rows, head, links)), key=repr)
    got = near_copies.near_copies(docs, tile_texts=tile)
    assert sorted(plain(got, "doc_id", "class_id", "n_links"), key=repr) == want
    assert max(n for _, _, n in want) > 5


def test_near_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(plain(docs, "doc_id", "text"))
    head, links = classes([shingle_set(t) for _, t in rows])
    assert sorted(plain(near_copies.near_copies(docs), "doc_id", "class_id", "n_links")) == [(i, rows[h][0], n) for (i, _), h, n in zip(rows, head, links)]
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(i for (i,) in plain(kept, "doc_id")) == sorted({rows[h][0] for h in head})
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_one_of_each_of_repeated_rows_and_ids(spark):
    texts = ["the first text of all that is said here", "a text of its own that nobody else says", "!?"]
    docs = edge_docs(spark, texts)
    more = [(902, "three more words under one id"), (0, texts[1]), (1, texts[0]), (None, "said by nobody"), (None, "said by nobody"), (None, "no id at all for this"), (905, ""), (905, "")]
    docs = docs.unionAll(spark.createDataFrame([(i, t, f"s{k}", 7, "x", 1, "y", "z") for k, (i, t) in enumerate(more)], docs.schema))
    rows = plain(docs, "doc_id", "text")
    head, _ = classes([shingle_set(t) for _, t in rows])
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())
    want = [min((r for r, h in zip(rows, head) if h == c), key=order) for c in set(head) if shingle_set(rows[c][1])]
    want += [r for r in rows if not shingle_set(r[1])]
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(plain(kept, "doc_id", "text"), key=repr) == sorted(want, key=repr)
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    b = near_copies.band_count(0.8, 4, 0.999)
    assert (1 - 0.8**4) ** b <= 0.001 < (1 - 0.8**4) ** (b - 1)


def test_labels_follow_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    assert dict(plain(near_copies.components(spark, edges), "node", "root")) == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def brute_scores(rows, order):
    texts = [(t or "").encode().lower().split() for _, t in rows]
    grams = [Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)) for w in texts]
    total, size = sum(grams, Counter()), sum(map(len, texts))
    out = []
    for w, own in zip(texts, grams):
        logs = []
        for i in range(len(w)):
            steps = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if total[g] - own[g] > 0:
                    below = total[g[:-1]] - own[g[:-1]] if n > 1 else size - len(w)
                    logs.append(steps * math.log10(0.4) + math.log10((total[g] - own[g]) / below))
                    break
                steps += 1
            else:
                logs.append(steps * math.log10(0.4) - math.log10(size - len(w) + 1))
        out.append((len(w), sum(logs)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rng = random.Random(order)
    docs = edge_docs(spark, [" ".join(rng.choice("The the cat Dog ran sat on a mat é".split()) for _ in range(rng.randint(1, 30))) for _ in range(30)])
    rows = plain(docs, "doc_id", "text")
    want = sorted((repr(i), n, round(s, 8)) for (i, _), (n, s) in zip(rows, brute_scores(rows, order)))
    got = lm_score.score_documents(docs, order=order, block_bytes=300, slice_grams=100)
    assert sorted((repr(i), n, round(s, 8)) for i, n, s in plain(got, "doc_id", "n_words", "log10_score")) == want
    assert got.where("n_words = 0 AND score IS NULL").count() == 3
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def test_hash_of_kept_text_is_utf8(spark):
    docs = spark.createDataFrame([(1, "é\nb")], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs).select(F.sha2("text", 256)).first()[0]
    assert out == hashlib.sha256("é\nb".encode()).hexdigest()
