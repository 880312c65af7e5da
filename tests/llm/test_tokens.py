import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
vocabularies = pytest.importorskip("public_tokenizers")

from helpers import SF, edge_docs, plain  # noqa: E402

from verbascope.llm.token_counts import TextCounter, count_tokens  # noqa: E402
from verbascope.llm.token_files import CachedEncoder, from_planes, pieces_of, read_token_files, text_bytes, to_planes, write_token_files  # noqa: E402

PIECES, BYTES = vocabularies.path("piece_bpe_32k.model"), vocabularies.path("byte_bpe_50k.json")


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", " ", "\n", "\t", "<|endoftext|>", "</s>", "<s>", "▁", "é", "ß", "!", "'s", "  ", "\x1c", "\xa0", "12", "日", "😀", "\r", ".", ",", ");\r", "aaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


LONG = ["", " ", "a" * 5000, "ab" * 3000, "aab" * 999, " " * 700, "=-" * 400 + "=" * 777, "thethe" * 800, "x\n" * 500, "\n\n a"]


def test_merging_is_the_librarys():
    texts = odd_texts(4000, 1) + LONG
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert TextCounter(PIECES).counts(texts) == [len(x) for x in model.encode(texts)]


def test_count_tokens(spark):
    docs = edge_docs(spark, ["one two", "x" * 9000 + " \n end", "</s> [INST]"])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in plain(docs, "doc_id", "text")), key=repr)
    got = count_tokens(docs, PIECES, limit=3)
    assert sorted(plain(got, "doc_id", "n_bytes", "n_tokens"), key=repr) == want
    assert all(over == (n > 3) for n, over in plain(got, "n_tokens", "over_limit"))
    assert count_tokens(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("run", [40, 1 << 30])
def test_encoder_is_the_librarys(run):
    texts = odd_texts(4000, 2) + LONG + ["Ab\u2003 c\u3000\nd", "é.\nÉté, ", "“a” b\xa0 c", "no.space,here .", None]
    library, encoder = tokenizers.Tokenizer.from_file(BYTES), CachedEncoder(BYTES)
    data, bounds = text_bytes(pa.array(["left out", *texts])[1:])
    cuts, owner = pieces_of(data, bounds, run)
    ids, counts = encoder.encode(data, cuts)
    assert (len(owner) > len(texts)) == (run == 40)
    ends = np.cumsum(np.bincount(owner, counts, minlength=len(texts))).astype(int)
    for text, own, want in zip(texts, np.split(ids, ends[:-1]), library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert own.tolist() == want.ids, text


def test_planes_round_trip():
    for ids in ([], [0], [2**32 - 1, 5, 70000], list(range(5000))):
        assert from_planes(to_planes(np.array(ids, dtype="<u4"))).tolist() == ids


@pytest.mark.parametrize(("chunk_ids", "part_ids"), [(7, 20), (7, 4_000_000), (65536, 1)])
def test_files_round_trip(spark, tmp_path, chunk_ids, part_ids):
    docs = edge_docs(spark, ["one two", "<|endoftext|> in a text", "line\nline", "w " * 400])
    write_token_files(docs, f"{tmp_path}/f", BYTES, docs_per_shard=3, chunk_ids=chunk_ids, part_ids=part_ids)
    library = tokenizers.Tokenizer.from_file(BYTES)
    got = sorted(read_token_files(spark, f"{tmp_path}/f").collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda i: (i is not None, i or 0))
    want = sorted((repr(i), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in plain(docs, "doc_id", "text"))
    assert sorted((repr(r.doc_id), zlib.crc32(r.ids)) for r in got) == want
    index = spark.read.parquet(f"{tmp_path}/f").where("kind = 'index'")
    assert index.selectExpr("sum(n)").first()[0] == at and all(len(p) == 4 for (p,) in plain(index, "plane_bytes"))
    write_token_files(docs.limit(0), f"{tmp_path}/none", BYTES)
    assert read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_files_of_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write_token_files(docs, f"{tmp_path}/f", BYTES, docs_per_shard=64)
    library, at = tokenizers.Tokenizer.from_file(BYTES), 0
    got = {r.doc_id: r for r in read_token_files(spark, f"{tmp_path}/f").collect()}
    for i, t in sorted(plain(docs, "doc_id", "text")):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (at, len(ids), ids.tobytes())
        at += len(ids)
