"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Documents are dealt to blocks. A block counts its distinct n-grams and asks for their
counts in the corpus: the requests go, by ranges of the n-gram hash, to the tables of
counts, where all blocks' counts of an n-gram meet and add up; the totals go back to
the blocks that asked. Each block then scores its documents and sums their words. A
frequent n-gram comes once from each block, however often it occurs.

A document is scored against all others: its own n-grams are taken off the counts, or
every n-gram would be known.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import M1, kept, mix64, need, pieces, word_hashes

ORDER = 2
BACKOFF = 0.4
BLOCK_BYTES = 8_000_000
SLICE_GRAMS = 2_000_000
BYTES_PER_WORD = 4  # for sizing only


@kept
def folded() -> bytes:
    """ASCII white space becomes a space, A-Z becomes a-z."""
    return bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number of each word, hashes of the n-grams of 1..order words that end there; 0 where
    the text has too few words before)."""
    text, word = word_hashes([(t or "").encode().translate(folded()) for t in texts])
    out = np.zeros((order, len(word)), dtype=np.uint64)
    if not len(word):
        return text, out
    start = np.r_[True, text[1:] != text[:-1]]
    place = np.arange(len(word)) - np.maximum.accumulate(np.where(start, np.arange(len(word)), 0))
    running = word
    out[0] = mix64(word + np.uint64(1))
    for k in range(1, order):
        longer = np.zeros_like(word)
        longer[1:] = running[:-1] * M1 + word[1:]
        running = mix64(longer)
        out[k] = np.where(place >= k, mix64(running + np.uint64(k + 1)), np.uint64(0))
    return text, out


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, where each gram is among them, how often each occurs.

    Hash 0, the n-gram of no words, stands for every word: its count is the corpus size.
    """
    found, at, n = np.unique(grams, return_inverse=True, return_counts=True)
    at = at.reshape(grams.shape)
    if not len(found) or found[0] != 0:
        found, n, at = np.r_[np.uint64(0), found], np.r_[0, n], at + 1
    n[0] = grams.shape[1]
    return found, at, n


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes; sorted ones as differences leave their high planes empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def log_scores(text: np.ndarray, at: np.ndarray, total: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log10 scores) of each text, by the counts of its n-grams in all other texts."""
    order = len(at)
    words = np.bincount(text, minlength=n_texts)
    others = total[0] - words[text]
    elsewhere = []
    for row in at:
        _, which, own = np.unique(text * len(total) + row, return_inverse=True, return_counts=True)
        elsewhere.append(total[row] - own[which])
    score = np.zeros(len(text))
    open_ = np.ones(len(text), dtype=bool)
    for k in range(order - 1, -1, -1):
        there = at[k] != 0
        below = others if k == 0 else np.r_[0, elsewhere[k - 1][:-1]]
        hit = open_ & there & (elsewhere[k] > 0)
        score[hit] += np.log10(elsewhere[k][hit] / below[hit])
        open_ &= ~hit
        score[open_ & there] += math.log10(BACKOFF)
    score[open_] -= np.log10(others[open_] + 1.0)
    return words, np.bincount(text, score, minlength=n_texts)


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, slice_grams: int = SLICE_GRAMS) -> DataFrame:
    """(id, n_words, log10_score, score) of every row; ``score`` is the mean over its words.

    Words are runs of other than ASCII white space, A-Z in lower case. A word scores
    count(n-gram) / count(context) for the longest n-gram that other rows hold, times
    0.4 for each step down; one that no other row holds scores 0.4 / (their words + 1)
    after its steps. NULL and empty texts have no words, a sum of 0 and a NULL mean.
    Repeated rows are other rows to each other; NULL ids are kept.
    """
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = pieces(size, block_bytes)
    slices = pieces(size // BYTES_PER_WORD * order, slice_grams)
    # Rows that repeat are dealt by their place in the table too, or they would be one block.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    cuts = np.array([(k << 64) // slices for k in range(1, slices)], dtype=np.uint64)

    def ask(block: pa.Table) -> pa.Table:
        found, _, n = distinct(ngrams(block.column("text").to_pylist(), order)[1])
        ends = np.r_[0, np.searchsorted(found, cuts), len(found)]
        used = [k for k in range(slices) if ends[k + 1] > ends[k]]
        parts = [slice(ends[k], ends[k + 1]) for k in used]
        number = block.column("block")[0].as_py()
        held = [pack(np.diff(found[p], prepend=np.uint64(0))) for p in parts], [pack(n[p]) for p in parts]
        return pa.table({"slice": pa.array(used, pa.int32()), "block": pa.array([number] * len(used), pa.int32()), "grams": pa.array(held[0], pa.binary()), "times": pa.array(held[1], pa.binary())})

    def count(asked: pa.Table) -> pa.Table:
        grams = [np.cumsum(unpack(g.as_py()), dtype=np.uint64) for g in asked.column("grams")]
        times = np.concatenate([unpack(t.as_py()) for t in asked.column("times")]).astype(np.float64)
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(at, times)[at].astype(np.uint64)  # whole numbers, exact below 2**53
        ends = np.cumsum([0, *(len(g) for g in grams)])
        back = [pack(total[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"block": asked.column("block"), "slice": asked.column("slice"), "total": pa.array(back, pa.binary())})

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        texts = block.column("text").to_pylist()
        text, grams = ngrams(texts, order)
        found, at, n = distinct(grams)
        del grams, found, n  # what follows needs the places alone
        turn = np.argsort(answers.column("slice").to_numpy())
        total = np.concatenate([unpack(answers.column("total")[int(k)].as_py()) for k in turn]).astype(np.int64)
        words, logs = log_scores(text, at, total, len(texts))
        return pa.table({"id": block.column("id"), "n_words": pa.array(words, pa.int64()), "log10_score": pa.array(logs, pa.float64())})

    asked = rows.groupBy("block").applyInArrow(ask, "slice int, block int, grams binary, times binary")
    answers = asked.groupBy("slice").applyInArrow(count, "block int, slice int, total binary")
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind}, n_words long, log10_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "log10_score", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")).alias("score"))
