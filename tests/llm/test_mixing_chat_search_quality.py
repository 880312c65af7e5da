import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import SF, edge_docs, plain
from pyspark.sql import functions as F

from verbascope.llm import chat, mixing, neighbours, quality


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) for s in capped} | share
        capped |= over


def test_mix(spark):
    docs = edge_docs(spark, [f"w{k} " * (k % 17) for k in range(200)])
    m = mixing.mix(docs, block=16)
    rows = mixing.taken_words(m, block=16).select("doc_id", "source", "_size", "_source_size", "_target", "_words").collect()
    assert len(rows) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["_size"]
        taken[r.source] += r["_words"]
        assert 0 <= r["_words"] <= 3 * r["_size"]
    want = fill(sizes)
    assert {r.source: r["_source_size"] for r in rows} == dict(sizes)
    assert all(abs(r["_target"] - want[r.source]) < 1e-6 for r in rows)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes) and sum(taken.values()) > 0
    slots = sorted(m.slots.collect(), key=lambda s: s.slot)
    assert [s.slot for s in slots] == list(range(m.n_slots))
    by = defaultdict(list)
    for s in slots:
        by[s["_sid"]].append(s)
    for own in by.values():
        assert [s.source_rank for s in own] == list(range(len(own)))
        for r, s in enumerate(own):  # evenly spread at every length
            assert abs((r + 1) - (s.slot + 1) * len(own) / len(slots)) <= 4
    again = mixing.taken_words(mixing.mix(docs.repartition(5), block=16), block=16)
    assert sorted(plain(again, "doc_id", "_size", "_words"), key=repr) == sorted(((r.doc_id, r["_size"], r["_words"]) for r in rows), key=repr)
    empty = mixing.mix(docs.limit(0))
    assert empty.n_slots == 0 and mixing.taken_words(empty).count() == 0


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed_documents(mixing.mix(docs), docs.columns)
    assert out.columns == docs.columns
    words = mixing.word_count("text")
    had = dict(plain(docs.groupBy("source").agg(F.sum(words).alias("n")), "source", "n"))
    got = dict(plain(out.groupBy("source").agg(F.sum(words).alias("n")), "source", "n"))
    longest = docs.agg(F.max(words)).first()[0]
    for s, t in fill(had).items():
        assert abs(got.get(s, 0) - t) <= 2 * longest
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_columns_of_any_names_come_back_from_the_mix(spark):
    rows = [(k, f"w{k} " * (k % 9), f"s{k % 2}" if k % 5 else None, k, -k, f"h{k}", k * 2, k * 3, float(k)) for k in range(60)]
    docs = spark.createDataFrame([*rows, (None, "no id", "s1", 1, 2, "n", 4, 5, 6.0), (None, None, "s1", 1, 2, "n", 4, 5, 6.0)], "doc_id long, text string, source string, block long, slot long, lo string, hi long, _size long, `_x.y` double")
    out = mixing.mixed_documents(mixing.mix(docs, block=8), docs.columns, block=8)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()} and out.count() > 30


def test_golden_step():
    for n in (1, 2, 3, 4, 10, 97, 4096, 99_991):
        g, inverse = mixing.golden_step(n)
        assert sorted(k * g % n for k in range(n)) == list(range(n)) and (n == 1 or g * inverse % n == 1)


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "meta": {"x": [1, {"role": 2}]}}),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}),
        (3, {"instruction": "i", "input": "", "output": "o"}),
        (4, {"completion": "c", "prompt": "p", "id": 3}),
        (5, {"instruction": "i", "input": "n", "output": "o"}),
        (6, {"system": "s", "prompt": "p", "completion": "c"}),
        (7, {"turn": 4, "role": None, "text": "t"}),
        (8, {"other": 1}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(9, "{no json"), (10, None), (None, json.dumps(records[3][1]))], "conv_id long, record string")
    got = defaultdict(list)
    for i, t, r, x in sorted(plain(chat.canonical_turns(df), "conv_id", "turn", "role", "text"), key=repr):
        got[i].append((t, r, x))
    assert got == {
        1: [(0, "user", "a"), (1, "assistant", "")], 2: [(0, "user", "q"), (1, "assistant", "r")], 3: [(0, "user", "i"), (1, "assistant", "o")],
        4: [(0, "user", "p"), (1, "assistant", "c")], 5: [(0, "user", "i\nn"), (1, "assistant", "o")], 6: [(0, "system", "s"), (1, "user", "p"), (2, "assistant", "c")],
        7: [(4, "", "t")], 8: [(None, None, None)], 9: [(None, None, None)], 10: [(None, None, None)], None: [(0, "user", "p"), (1, "assistant", "c")],
    }
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_long_turns_and_rows_that_name_their_role(spark):
    long = "long <s> text é " * 1_500_000
    records = [
        (1, {"turn": 0, "role": "human", "text": "q"}), (1, {"turn": 1, "role": "assistant", "text": long}), (2, {"messages": [{"role": "gpt", "content": long}, {"role": "user", "content": None}]}),
        (3, {"prompt": "p", "completion": long}), (4, {"instruction": "i", "input": "", "output": long}), (5, {"turn": None, "role": None, "text": long}), (6, {"other": long}),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records], "conv_id long, record string").repartition(4)
    turns = chat.canonical_turns(df)
    got = sorted(plain(turns.select("conv_id", "turn", "role", F.md5("text").alias("m")), "conv_id", "turn", "role", "m"), key=repr)
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = [(1, 0, "human", "q"), (1, 1, "assistant", long), (2, 0, "assistant", long), (2, 1, "user", ""), (3, 0, "user", "p"), (3, 1, "assistant", long), (4, 0, "user", "i"), (4, 1, "assistant", long), (5, None, "", long)]
    assert got == sorted([*((i, t, r, digest(x)) for i, t, r, x in want), (6, None, None, None)], key=repr)


def test_template_is_reversible(spark):
    texts = ["", "a\\", "\\<s>", "<s>\\", f"\\\\{chat.OPEN}x\n{chat.CLOSE}", f"\n{chat.CLOSE}", chat.OPEN * 2, "<|turn_end|", "x" * 50_000, "é\n\n[INST]\\[/INST]"]
    rows = [(k, n, role, t) for k, t in enumerate(texts) for n, role in enumerate(["user", "assistant", "odd\nrole <s>%"])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chat(turns)
    for r in done.select("conv_id", "formatted", "segments", chat.parse_chat(F.col("formatted")).alias("turns")).collect():
        assert [(t.role, t.text) for t in r.turns] == [(role, texts[r.conv_id]) for role in ("user", "assistant", "odd\nrole <s>%")]
        assert "".join(s.text for s in r.segments) == r.formatted and sum(s.loss for s in r.segments) == 1
    assert {r.conv_id: r.loss_chars for r in chat.chat_digests(done).collect()} == {k: len(t) for k, t in enumerate(texts)}


def test_search_against_all_rows(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {i: np.array(v, dtype=np.float64) for i, v in plain(vectors, "vec_id", "embedding")}
    got = defaultdict(dict)
    for q, r, i, s in plain(neighbours.nearest(vectors, F.col("id") % 20 == 0), "query_id", "rank", "vec_id", "score"):
        got[q][r] = i
        assert abs(s - x[q] @ x[i]) < 1e-12
    assert sorted(got) == [i for i in sorted(x) if i % 20 == 0] and all(sorted(g) == list(range(1, 21)) for g in got.values())
    want = {q: sorted((i for i in x if i != q), key=lambda i: (-(x[q] @ x[i]), i))[:20] for q in got}
    assert np.mean([len(set(want[q]) & set(got[q].values())) for q in got]) / 20 >= 0.9


def test_search_on_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v int")
    got = sorted(plain(neighbours.nearest(df, F.col("id").isin(0, 5), k=20), "query_id", "rank", "vec_id", "score"))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (0, 4, 9, -1.0)]
    assert [r[2] for r in sorted(plain(neighbours.nearest(df, F.col("id") == 2, k=2), "query_id", "rank", "vec_id"))] == [0, 1]
    assert neighbours.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_codes_in_the_radius_are_all_found():
    rng = np.random.default_rng(3)
    x = neighbours.unit(rng.normal(size=(600, 16)))
    codes = neighbours.learn(x, nearest=5, rotations=2)
    bits = codes.of(x)
    apart = np.bitwise_count(bits[:50, None, :] ^ bits[None, :, :]).sum(axis=2)
    q, i, _ = neighbours.search(np.arange(50) + 1000, x[:50], np.arange(600), x, codes, k=600)
    assert set(zip((q - 1000).tolist(), i.tolist())) >= {(a, b) for a, b in zip(*np.nonzero(apart <= codes.radius))}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = dict(plain(labels, "doc_id", "quality"))
    rows = plain(quality.classify(docs, labels), "doc_id", "held_out", "score", "predicted")
    assert len(rows) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in rows)
    held = [(known[i], p) for i, h, _, p in rows if h and i in known]
    assert np.mean([a == b for a, b in held]) >= 0.95 and any(a == 0 for a, _ in held)


def test_quality_of_hard_rows(spark):
    docs = edge_docs(spark, ["Some words in a plain sentence.", "A B C " * 3000])
    labels = spark.createDataFrame([(0, 1), (0, None), (1, 0), (1, 0), (1, 1), (902, 0), (902, 1), (None, 1)], "doc_id long, quality int")
    rows = plain(quality.classify(docs, labels), "doc_id", "score")
    assert len(rows) == docs.count() and all(0 <= s <= 1 for _, s in rows)
    assert len({s for i, s in rows if i == 902}) == 1
    none = plain(quality.classify(docs, labels.limit(0)), "score", "predicted")
    assert set(none) == {(0.5, 1)}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=20)
    assert np.mean((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)) > 0.9


def test_a_group_of_k_rows_does_not_shorten_a_result():
    rng = np.random.default_rng(5)
    x = neighbours.unit(rng.normal(size=(400, 64)))
    x[:20] = x[0]
    codes = neighbours.learn(x, nearest=5, rotations=2)
    codes.radius, codes.widths = 0, np.zeros_like(codes.widths)
    q, i, _ = neighbours.search(np.arange(20), x[:20], np.arange(400), x, codes, k=20)
    assert np.bincount(q).tolist() == [20] * 20 and (q != i).all()
    assert all({*range(20)} - {n} <= set(i[q == n].tolist()) for n in range(20))
