import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF, edge_docs, plain
from pyspark.sql import functions as F

from verbascope.llm import centroids, merkle, toxicity

LEXICON = {"idiot$": 4.0, "lowei": 4.0}


def readings(text):
    return [(toxicity.READINGS[r], w) for r, w, _ in toxicity.Reader(LEXICON).matches(text)[0]]


def test_clauses_not_words():
    assert readings("an idiot") == [("plain", 4.0)] and readings("You total idiot!") == [("aimed", 4.0)]
    assert readings("you, idiot") == [("plain", 4.0)]  # the target is of another clause
    assert readings("you are not an idiot") == [("negated", 4.0)] and readings("not at all, idiot") == [("plain", 4.0)]
    assert readings("not one in all was ever an idiot") == [("plain", 4.0)]  # out of the negation's reach
    assert readings('He wrote: "you idiot". You idiot') == [("reported", 4.0), ("aimed", 4.0)]
    assert readings("she said he is an idiot. idiot") == [("reported", 4.0), ("plain", 4.0)]
    assert readings('an "idiot" at\nidiot') == [("reported", 4.0), ("plain", 4.0)]
    assert readings('"never closed\nidiot') == [("plain", 4.0)]  # a quotation ends with its line
    assert readings("i will kill you") == [("threat", 3.0)] and readings("kill the process") == []
    assert readings("I won't hurt you") == [("negated", 3.0)] and readings("they said kill him now") == [("reported", 3.0)]
    assert readings("LOWEIxyz Lowe IDIOTS") == [("plain", 4.0)]
    assert readings(None) == readings("") == readings(" .,\n") == []


def test_composition_does_what_the_parts_do_in_turn():
    parts = [toxicity.reported_speech(), toxicity.negation(), toxicity.aiming(), toxicity.threatening()]
    grammar, rng = toxicity.Grammar.build(), np.random.default_rng(2)
    for _ in range(300):
        states, at = [p.start for p in parts], 0
        for c in rng.integers(0, len(toxicity.CLASSES), size=30):
            symbol = toxicity.CLASSES[c]
            for k, p in enumerate(parts):
                states[k], symbol = p.step(states[k], symbol)
            got, at = grammar.reading[at][c], grammar.next[at][c]
            name = None if got < 0 else toxicity.READINGS[got] if got < 5 else f"threat:{toxicity.READINGS[got - 5]}"
            assert name == (symbol if symbol in toxicity.READINGS or str(symbol).startswith("threat:") else None)


def test_long_texts_read_in_runs_alike():
    text = 'you are not "an idiot, say" idiot.\nkill them. ' * 40 + "x" * 300 + " idiot"
    whole = [w for some in toxicity.tokens(text) for w in some]
    for run in (7, 50, 333):
        assert [w for some in toxicity.tokens(text, run) for w in some] == whole


def test_words_that_only_share_texts_with_insults_are_not_learned():
    held = [([0, 1], 1)] * 40 + [([0], 1)] * 40 + [([2], 1)] * 20 + [([3], 0)] * 300
    assert sorted(toxicity.cover(held, ["idiot$", "bystander$", "lowei", "calm$"])) == ["bystander$", "idiot$", "lowei"]
    held[:40] = [([0, 1, 4, 5], 1)] * 8 + [([0, 4, 5], 1)] * 32
    assert "bystander$" not in toxicity.cover(held, ["idiot$", "bystander$", "lowei", "calm$", "moron$", "scum$"])


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic IS NOT NULL").select("doc_id", "toxic")
    some = docs.join(known.select("doc_id"), "doc_id", "left_semi")
    rows = plain(toxicity.classify(some, labels).join(known, "doc_id"), "doc_id", "held_out", "score", "predicted", "toxic")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p, _ in rows)
    held = [(t, p) for _, h, _, p, t in rows if h]
    caught = [p for t, p in held if t]
    assert len(caught) > 50 and np.mean(caught) >= 0.88 and np.mean([p for t, p in held if not t]) <= 0.01


def test_toxicity_of_hard_rows(spark):
    docs = edge_docs(spark, ["A plain sentence.", "idiot " * 5000, "you idiot"])
    labels = spark.createDataFrame([(0, 1), (0, None), (1, 0), (1, 0), (1, 1), (902, 0), (902, 1), (None, 1)], "doc_id long, toxic int")
    rows = plain(toxicity.classify(docs, labels), "doc_id", "held_out", "score", "predicted")
    assert len(rows) == docs.count() and all(0 <= s <= 1 for _, _, s, _ in rows) and not any(h for i, h, _, _ in rows if i is None)
    assert len({s for i, _, s, _ in rows if i == 902}) == 1
    assert {p for _, _, _, p in plain(toxicity.classify(docs, labels.limit(0)), "doc_id", "held_out", "score", "predicted")} <= {0, 1}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_outward_search_is_exact():
    rng = np.random.default_rng(1)
    for size in (2, 40, 1 << 26):
        c = rng.integers(-size, size, size=(16, 64))
        c[5] = c[2]  # a tie goes to the smaller number
        x = np.r_[rng.integers(-size, size, size=(300, 64)), c, c + rng.integers(-1, 2, size=c.shape)]
        which, apart, measured = centroids.Centroids(c).nearest(x)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (which == d.argmin(axis=1)).all() and (apart == d.min(axis=1)).all() and measured <= d.size
    far = np.arange(16)[:, None] * 100 + np.zeros((16, 64), dtype=np.int64)
    assert centroids.Centroids(far).nearest(far + 1)[2] == 16  # the bounds leave one centroid a vector


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centre = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centre = [[sum(c) // len(c) for c in zip(*own[n])] if own[n] else old for n, old in enumerate(centre)]
    return sorted(((i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, centre[near(v)[1]])).encode()).hexdigest()) for i, v in kept), key=repr)


@pytest.mark.parametrize("k", [3, 16])
def test_clusters(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=64)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (61, None), (62, []), (63, [0.5] * 63), (64, [float("nan")] + [0.1] * 63), (65, [float("inf")] + [0.1] * 63), (66, [None] + [0.1] * 63)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int, x string")
    got = centroids.cluster_vectors(df, k=k)
    assert sorted(plain(got, "vec_id", "cluster", "distance", "centroid_sha256"), key=repr) == brute_clusters(rows, k, 3)
    per = defaultdict(int)
    for c, d, own, every in (out := plain(got, "cluster", "distance", "cluster_inertia", "inertia")):
        per[c] += d
    assert all(own == per[c] and every == sum(per.values()) for c, _, own, every in out)
    few = centroids.cluster_vectors(df.where("vec_id < 2"), k=k)
    assert sorted(plain(few, "vec_id", "distance")) == [(0, 0), (1, 0)]
    assert centroids.cluster_vectors(df.where("vec_id > 60")).count() == 0 and centroids.cluster_vectors(df.limit(0)).count() == 0
    assert plain(centroids.cluster_vectors(df.where("vec_id IS NULL")), "vec_id", "distance") == [(None, 0)]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root and, for each leaf, its (before, after) steps."""
    nodes, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for leaf, k in enumerate(at):
            run = runs[k // 8]
            steps[leaf].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            at[leaf] = k // 8
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], steps


def brute_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text); every text is read back in lower case."""
    sized = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by, out = defaultdict(list), []
    for r in rows:
        read = (*r[:4], None if r[4] is None else r[4].translate({c: c + 32 for c in range(65, 91)}))
        by[r[2]].append((r[0] is not None, r[0] or 0, h("".join(map(sized, r))), h("".join(map(sized, read))), r[0]))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in order}
    root, above = brute_tree([trees[g][0] for g in order])
    for g, higher in zip(order, above):
        for (_, _, leaf, read, i), own in zip(sorted(by[g], key=lambda x: x[:3]), trees[g][1]):
            steps, folded = own + higher, read
            for before, after in steps:
                folded = h(before + folded + after)
            out.append((i, leaf, trees[g][0], root, h("".join(b + a for b, a in steps)), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    sizes = {None: 1, "de": 9, "en": 150, "Z": 64, "é": 8, "fr": 2} | {f"l{k}": 1 for k in range(7)}
    rows = [(k, f"s{k % 3}" if k % 5 else None, g, k % 7 if k % 4 else None, f"Text {k} of {g}" if k % 6 else (None, "", "lower")[k % 3]) for g, n in sizes.items() for k in range(n)]
    rows += [(3, "s", "en", 1, "Twice")] * 20 + [(None, None, "en", None, None), (None, "s", "en", 1, "A")]
    df = spark.createDataFrame([(*r, "g", 7, "b") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, n int, block string")
    got = merkle.manifest(df, tamper=merkle.lower_ascii(F.col("text")))
    assert sorted(plain(got, *COLUMNS), key=repr) == brute_manifest(rows)
    whole = merkle.manifest(df)
    assert whole.count() == len(rows) and whole.where("NOT verified").count() == 0
    assert merkle.manifest(df.limit(0)).count() == 0
    one = merkle.manifest(df.where("lang = 'l1'"))
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.proof_sha256) for r in one.collect()] == [(True, h(""))]


def test_manifest_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = plain(docs, "doc_id", "source", "lang", "n_chars", "text")
    got = merkle.manifest(docs.repartition(7), tamper=merkle.lower_ascii(F.col("text")))
    assert sorted(plain(got, *COLUMNS), key=repr) == brute_manifest(rows)


def test_witnesses_grow_with_later_siblings():
    tree, leaves, nodes = merkle.WitnessTree(), [h(json.dumps(k)) for k in range(100)], []
    for k, leaf in enumerate(leaves):
        nodes.append(tree.append(leaf))
        assert len(list(nodes[0].witness())) == (k >= 7) + (k >= 63)  # complete runs alone have extended it
        assert sum(map(len, tree.open)) <= 7 * len(tree.open)
    root, steps = brute_tree(leaves)
    assert tree.close().digest == root and [list(n.witness()) for n in nodes] == steps
    assert {merkle.fold(x, s) for x, s in zip(leaves, steps)} == {root} and merkle.WitnessTree().close() is None
