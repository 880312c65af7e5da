"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Texts and items are compared by their letters and digits in lower case. A passage
within e edits of an item of m letters keeps at least m - q + 1 - q * e of its q-grams,
on diagonals (text place minus item place) that lie within e of each other. So shared
q-grams are counted in bands of 2W diagonals that overlap by W > e: only a band that
meets the count can hold the passage, and it is verified by alignment in that band.

The benchmark is a stated query set: it goes to the tasks in blocks of bounded size, a
pass over the documents for each block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import kept, need, text_runs, worker_cache

Q = 8
SHORT, SHORT_Q = 32, 5  # items under 32 letters have a tenth of them as edits by grams of five
HITS_AT_ONCE = 1_000_000
EDIT_SHARE = 0.1
BLOCK_CHARS = 1_000_000
ALIGNED_AT_ONCE = 256
STOP = np.uint32(0xFFFFFFFF)
BITS = 22
STEP, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@kept
def fold_table() -> np.ndarray:
    """Code point to the code of its lower-case letter or digit, 0 for all else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalnum():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(letters: np.ndarray, q: int) -> np.ndarray:
    n = len(letters) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = letters[:n].astype(np.uint64)
    for k in range(1, q):
        h *= STEP
        h += letters[k : n + k]
    return h * SPREAD


@dataclass(frozen=True)
class Budget:
    """Edits that an item of ``m`` letters may differ by: a share, and few enough for the lemma to bound anything."""

    q: int = Q
    share: float = EDIT_SHARE

    def edits(self, m: int) -> int:
        return max(0, min(int(self.share * m), (m - self.q) // self.q))


class Passages:
    """One block of items, indexed by q-gram."""

    def __init__(self, items: list[str], budget: Budget):
        self.q, self.table = budget.q, fold_table()
        self.letters = [self.fold(codes(t))[0] for t in items]
        self.size = np.array([len(x) for x in self.letters], dtype=np.int64)
        self.edits = np.array([budget.edits(m) for m in self.size], dtype=np.int64)
        self.least = self.size - self.q + 1 - self.q * self.edits
        self.half = np.array([1 << int(e).bit_length() for e in self.edits], dtype=np.int64)
        grams = [gram_hashes(x, self.q) for x in self.letters]
        hashes = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, dtype=np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        self.there = np.zeros(1 << BITS, dtype=bool)
        self.there[self.hashes >> np.uint64(64 - BITS)] = True

    def fold(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters of a text and their places in it."""
        low = self.table[c]
        at = np.flatnonzero(low)
        return low[at], at

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end): the best passage of each item in each text.

        ``end`` is the code point behind the passage, ``start`` is exact but for the edits.
        """
        if not len(self.hashes) or not texts:
            return []
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        letters, at = self.fold(codes("".join(texts)))
        text_end = np.searchsorted(at, np.cumsum(sizes))  # in letters
        text_start = np.r_[0, text_end[:-1]]
        h = gram_hashes(letters, self.q)
        spot = np.flatnonzero(self.there[h >> np.uint64(64 - BITS)])
        k = np.searchsorted(self.hashes, h[spot])
        real = k < len(self.hashes)
        real[real] = self.hashes[k[real]] == h[spot[real]]
        spot, k = spot[real], k[real]
        n = self.first[k + 1] - self.first[k]
        low = -int(self.size.max(initial=0)) - 2
        wide = len(letters) - low + 2
        found, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        # A gram that repeats in text and item has hits without end; they are counted a bounded number at a time.
        edge = np.searchsorted(np.cumsum(n), np.arange(HITS_AT_ONCE, int(n.sum()) + HITS_AT_ONCE, HITS_AT_ONCE))
        for first, last in itertools.pairwise(np.unique(np.r_[0, edge, len(n)]).tolist()):
            held.append(self._bands(spot[first:last], k[first:last], n[first:last], text_end, low, wide))
            if sum(len(f) for f, _ in held) > HITS_AT_ONCE or last == len(n):
                keys, times = (np.concatenate(v) for v in zip((found, count), *held))
                found, at_ = np.unique(keys, return_inverse=True)
                count, held = np.bincount(at_, times, minlength=len(found)).astype(np.int64), []
        pair, band = found // wide, found % wide + low
        text, item = pair // len(self.size), pair % len(self.size)
        good = count >= self.least[item]
        text, item, band = text[good], item[good], band[good]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for some in np.array_split(np.arange(len(text)), -(-len(text) // ALIGNED_AT_ONCE)) if len(text) else []:
            edits, end = self.align(letters, text_start[text[some]], text_end[text[some]], item[some], band[some])
            for t, i, e, z in zip(text[some].tolist(), item[some].tolist(), edits.tolist(), end.tolist()):
                if e <= self.edits[i]:
                    z = min(max(z, text_start[t] + 1), text_end[t])
                    a = max(text_start[t], z - self.size[i])
                    shift = int(sizes[:t].sum())
                    best[t, i] = min(best.get((t, i), (e, 1 << 62, 0)), (e, int(at[a]) - shift, int(at[z - 1]) + 1 - shift))
        return [(t, i, *v) for (t, i), v in sorted(best.items())]

    def _bands(self, spot, k, n, text_end, low: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(band key, hits) of the grams at these spots; every hit counts in two overlapping bands."""
        row = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.item[row], np.repeat(spot, n)
        text = np.searchsorted(text_end, place, side="right")
        inside = place + self.q <= text_end[text]
        band = (place - self.place[row])[inside] // self.half[item[inside]]
        key = (text[inside] * len(self.size) + item[inside]) * wide + (band - low)
        return np.unique(np.r_[key, key - 1], return_counts=True)

    def align(self, letters, start, end, item, band) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each item to any stretch of its text's band, and where that stretch ends.

        Row i of the table holds the diagonals of the band at item letter i; a step down
        a diagonal is a match or an exchange, across diagonals a letter more or less.
        """
        half, slack, m = self.half[item], self.edits[item], self.size[item]
        low = band * half - slack
        width = int((2 * half + 2 * slack + 1).max())
        deep = int(m.max())
        where = low[:, None] + np.arange(width + deep)
        held = (where >= start[:, None]) & (where < end[:, None])
        region = np.where(held, letters[np.clip(where, 0, len(letters) - 1)], STOP)
        wanted = np.zeros((len(item), deep), dtype=np.uint32)
        for r, i in enumerate(item):
            wanted[r, : self.size[i]] = self.letters[i]
        across = np.arange(width, dtype=np.int32)
        cost = np.zeros((len(item), width), dtype=np.int32)
        edits, stop = np.full(len(item), 1 << 30), np.zeros(len(item), dtype=np.int64)
        for i in range(deep):
            step = cost + (region[:, i : i + width] != wanted[:, i, None])
            np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
            cost = np.minimum.accumulate(step - across, axis=1) + across
            done = np.flatnonzero(m == i + 1)
            if len(done):
                best = cost[done].argmin(axis=1)
                edits[done] = cost[done, best]
                stop[done] = low[done] + best + i + 1
        return edits, stop


class PassageIndex:
    """The items of a block, short ones by shorter grams.

    The lemma bounds e edits of m letters by m - q + 1 - q e common grams; that leaves
    items under ``SHORT`` letters fewer edits than a tenth unless their grams are shorter.
    """

    def __init__(self, items: list[str], budget: Budget):
        fold = fold_table()
        size = [int(np.count_nonzero(fold[codes(t)])) for t in items]
        short = [n for n, m in enumerate(size) if budget.q <= m < SHORT and budget.q == Q]
        long = [n for n, m in enumerate(size) if not (budget.q <= m < SHORT and budget.q == Q)]
        self.parts = [(own, Passages([items[n] for n in own], b)) for own, b in ((long, budget), (short, Budget(SHORT_Q, budget.share))) if own]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        return sorted((t, own[i], e, a, z) for own, p in self.parts for t, i, e, a, z in p.find(texts))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, q: int, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, in blocks of about ``block_chars`` together.

    Items with fewer than ``q`` letters and digits hold no q-gram and are no passage.
    """
    items = need(benchmark, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= q)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield [r.id for r in some], [r.text for r in some]


def _passages(texts: list[str], budget: Budget) -> PassageIndex:
    """The index of a block, built once in a Python worker."""
    built = worker_cache("passages")
    key = hash((tuple(texts), budget))
    if key not in built:
        built.clear()
        built[key] = PassageIndex(texts, budget)
    return built[key]


def find_passages(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item id, edits, start, end): every pair of a document and an item it holds a passage of.

    A passage is within a tenth of the item's letters of it, by edit distance. NULL and
    empty texts hold nothing, NULL ids are reported, repeated rows each. The whole of
    every text is searched. An empty table on either side gives no rows.
    """
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for ids, items in item_blocks(benchmark, item_col, item_text_col, budget.q, block_chars):

        def run(batches: Iterable[pa.RecordBatch], ids=ids, items=items) -> Iterator[pa.RecordBatch]:
            passages = _passages(items, budget)
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for first, some in text_runs(texts):
                    found = passages.find(some)
                    t, i, e, a, z = (list(c) for c in zip(*found)) if found else ([], [], [], [], [])
                    at = pa.array([first + k for k in t], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([ids[k] for k in i], item_type), *(pa.array(c, pa.int64()) for c in (e, a, z))], ["id", "item", "edits", "start", "end"])

        item_type = pa.int64() if kinds[1] == "bigint" else None
        found = rows.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, edits long, start long, end long")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {kinds[0]}, item {kinds[1]}, edits long, start long, end long")
    return out.toDF(id_col, item_col, "edits", "start", "end")


def holds_passage(text: Column, items: list[str], budget: Budget = Budget()) -> Column:
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        passages, out = _passages(items, budget), np.zeros(len(texts), dtype=bool)
        for first, some in text_runs([t or "" for t in texts]):
            out[[first + f[0] for f in passages.find(some)]] = True
        return pd.Series(out)

    return hit(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: Budget = Budget(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no passage of any item, with all their columns; nothing is shuffled."""
    for _, items in item_blocks(benchmark, item_col, item_text_col, budget.q, BLOCK_CHARS):
        docs = docs.where(~holds_passage(F.col(f"`{text_col}`"), items, budget))
    return docs
