import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
vocabularies = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from helpers import SF, classes, edits_within, plain, shingle_set  # noqa: E402

from verbascope.llm import mixing, quality  # noqa: E402


def test_stages_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(plain(docs, "doc_id", "text"))
    good = {i for i, p in plain(quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")), "doc_id", "predicted") if p}
    after = stages["quality classifier"](spark, docs, SF)
    assert after.columns == docs.columns and {i for (i,) in plain(after, "doc_id")} == good and 0 < len(good) < len(texts)

    rows = sorted(good)
    head, _ = classes([shingle_set(texts[i]) for i in rows])
    single = {rows[h] for h in head}
    after = stages["n-gram Jaccard join"](spark, docs.where(docs.doc_id.isin(rows)), SF)
    assert after.columns == docs.columns and {i for (i,) in plain(after, "doc_id")} == single

    items = [x for (x,) in plain(spark.read.parquet(f"{SF}/benchmark.parquet"), "text")]
    left = docs.where(docs.doc_id.isin(sorted(single)))
    after = stages["benchmark decontamination"](spark, left, SF)
    clean = {i for (i,) in plain(after, "doc_id")}
    assert after.columns == docs.columns and single - clean and not any(x in texts[i] for i in clean for x in items)
    letters = lambda x: sum(c.isalnum() for c in x)
    assert all(any(edits_within(x, texts[i]) <= letters(x) // 10 for x in items) for i in single - clean)

    left = docs.where(docs.doc_id.isin(sorted(clean)))
    mixed = stages["mixing sources to target weights"](spark, left, SF)
    times = {i: n for i, n in plain(mixed.groupBy("doc_id").count(), "doc_id", "count")}
    assert mixed.columns == docs.columns and set(times) <= clean and max(times.values()) <= 3
    taken = plain(mixing.mixed_sizes(left), "doc_id", "size", "taken")
    assert all(times.get(i, 0) == round(n / s) or s > mixing.BLOCK_WORDS or abs(times.get(i, 0) - n / s) <= 1 for i, s, n in taken if s)

    library, at = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json")), 0
    got = sorted(plain(corpus_pipeline.run(spark, SF), "start", "doc_id", "n_tokens", "ids_crc32"))
    want = [i for i in sorted(times) for _ in range(times[i])]
    assert [r[1] for r in got] == want
    for start, i, n, crc in got:
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
