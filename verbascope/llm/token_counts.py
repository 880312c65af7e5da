"""Token counts of a piece vocabulary by rank-synchronous merging of ragged arrays.

Texts are cut where no piece of the vocabulary reaches across: before every run of
spaces and around line feeds. The distinct pre-tokens of a batch lie in one flat
numpy array with a sequence number for each symbol. In every round each sequence
applies its own lowest-rank pair, all sequences at once, until none has a pair
left; what survives is counted. A pre-token is merged once per worker and then
looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import need, text_runs, worker_cache

SPACE = "▁"
BIG = np.int64(1) << 60
OTHER = 1 << 20  # ids of characters outside the vocabulary start here
WIDTH = np.int64(1) << 22
CACHE_ENTRIES = 1_000_000


class PieceMerger:
    """Counts the pieces of pre-tokens by the ranks of a sentencepiece BPE model.

    The model's pieces and scores are read through its library; the merging is done
    here. Ties of score go to the leftmost pair, as the library has it.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        piece = {model.id_to_piece(i): i for i in ids}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in piece):
            raise ValueError("a piece reaches across a pre-token")
        score = {p: model.get_score(i) for p, i in piece.items()}
        order = {s: k for k, s in enumerate(sorted({score[p] for p in piece}, reverse=True))}
        symbol = dict(piece)
        for p in piece:
            for c in p:
                symbol.setdefault(c, OTHER + ord(c))
        rows = {}
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    rows[a * int(WIDTH) + b] = (order[score[p]], i)
        self._index(rows)
        self.of_char = np.arange(0x110000, dtype=np.int64) + OTHER
        for p, i in piece.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i

    def _index(self, rows: dict[int, tuple[int, int]]) -> None:
        """Pairs by hash: a few slots for each value, as many as the fullest needs."""
        keys = np.array(list(rows), dtype=np.int64)
        value = np.array(list(rows.values()), dtype=np.int64)
        self.shift = np.uint64(64 - max(14, (4 * len(keys)).bit_length()))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        keys, value, slot = keys[order], value[order], slot[order]
        depth = np.arange(len(slot)) - np.maximum.accumulate(np.where(np.r_[True, slot[1:] != slot[:-1]], np.arange(len(slot)), 0))
        self.table = np.full((depth.max() + 1, 1 << (64 - int(self.shift))), -1, dtype=np.int64)
        self.at = np.zeros(self.table.shape, dtype=np.int32)
        self.table[depth, slot] = keys
        self.at[depth, slot] = np.arange(len(keys))
        self.rank, self.made = value[:, 0], value[:, 1]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (BIG where it makes no piece) and the piece it makes."""
        key = a * WIDTH + b
        rank, made = np.full(len(key), BIG), np.zeros(len(key), dtype=np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        for table, at in zip(self.table, self.at):
            there = table[slot]
            hit = np.flatnonzero(there == key[left])
            row = at[slot[hit]]
            rank[left[hit]], made[left[hit]] = self.rank[row], self.made[row]
            more = np.flatnonzero((there >= 0) & (there != key[left]))
            left, slot = left[more], slot[more]
            if not len(left):
                break
        return rank, made

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token, spaces already written as U+2581."""
        out = np.zeros(len(words), dtype=np.int64)
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        for end, seq in self.merged(sym, np.repeat(np.arange(len(words)), [len(w) for w in words])):
            code = end - OTHER
            width = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
            out += np.bincount(seq, weights=width, minlength=len(words)).astype(np.int64)
        return out

    def merged(self, sym: np.ndarray, seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(symbols, sequence numbers) of sequences as they come to have no pair left.

        A pair's rank is looked up when one of its symbols is new, and carried along else.
        """
        rank, made = np.full(len(sym), BIG), np.zeros(len(sym), dtype=np.int64)
        fresh = np.flatnonzero(seq[:-1] == seq[1:])
        while len(sym):
            rank[fresh], made[fresh] = self._pair(sym[fresh], sym[fresh + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            done = least == BIG
            if done.any():
                yield sym[done], seq[done]
                live = np.flatnonzero(~done)
                sym, seq, rank, made, least = sym[live], seq[live], rank[live], made[live], least[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            # Of pairs that overlap every second one counts, from the left.
            run = np.r_[True, np.diff(at) > 1]
            if not run.all():
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            at = at[self._until_better(sym, seq, made, least, at)]
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            new = at - np.arange(len(at))
            rank[new] = BIG
            fresh = np.concatenate([new, new[new > 0] - 1])
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[seq[fresh] == seq[fresh + 1]]

    def _until_better(self, sym, seq, made, least, at) -> np.ndarray:
        """Of each sequence's occurrences the ones up to the first whose new pair comes
        before the remaining occurrences: beyond it the order of merging may matter."""
        new, n = made[at], len(sym)
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1)
        before = sym[left].copy()
        joined = np.r_[False, at[1:] - at[:-1] == 2]
        before[joined] = new[:-1][joined[1:]]
        to_left = np.where((at > 0) & (seq[left] == seq[at]), self._pair(before, new)[0], BIG)
        to_right = np.where((at + 2 < n) & (seq[right] == seq[at]), self._pair(new, sym[right])[0], BIG)
        better = (np.minimum(to_left, to_right) <= least[at]).astype(np.int64)
        seen = np.cumsum(better) - better
        first = np.r_[True, seq[at][1:] != seq[at][:-1]]
        return seen == np.maximum.accumulate(np.where(first, seen, 0))


class TextCounter:
    """Counts whole texts, with the counts of pre-tokens kept between batches."""

    def __init__(self, model_file: str):
        self.merger = PieceMerger(model_file)
        self.known: dict[str, int] = {}

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """Pre-tokens; one that begins with neither a line feed nor the space mark follows one space.

        A text begins as if a space came before it; an empty one has no token.
        """
        if not text:
            return []
        if SPACE in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return re.findall(f"\\n[^{SPACE}\\n]*|{SPACE}*[^{SPACE}\\n]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        return text.replace("\n", " \n").split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        words = [self.pre_tokens(t) for t in texts]
        fresh = set().union(*words) - self.known.keys()
        if len(self.known) + len(fresh) > CACHE_ENTRIES:
            self.known = {}
            fresh = set().union(*words)
        if fresh:
            fresh = list(fresh)
            self.known.update(zip(fresh, self.merger.counts([w if w[:1] in (SPACE, "\n") and w else SPACE + w for w in fresh]).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, w)) for w in words]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in no other order or number.

    A NULL text counts as empty: no bytes, no tokens. Special strings in a text are
    ordinary text. Repeated rows are counted each, NULL ids are kept, an empty table
    gives an empty table. ``model_file`` must be readable on every executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("token_counts")
        if model_file not in kept:
            kept[model_file] = TextCounter(model_file)
        counter = kept[model_file]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [c for _, some in text_runs(texts) for c in counter.counts(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
