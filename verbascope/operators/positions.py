"""Character positions of a rebuilt transcript: offsets, times, occurrences."""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbascope.operators.intervals import points_in
from verbascope.operators.ordered import running
from verbascope.session import materialise

# Segments per chunk of the running offset, characters per join bucket.
CHUNK_SEGMENTS = 1024
CHAR_BUCKET = 4096.0


def with_offsets(segments: DataFrame) -> DataFrame:
    """Add ``char_offset``: where each segment starts in the blank-joined text."""
    chunk = F.floor(F.col("segment_id") / CHUNK_SEGMENTS)
    placed = running(
        segments, ["file_id"], chunk, ["segment_id"], (F.length("text") + 1).cast("bigint"), "_before"
    )
    return placed.withColumn("char_offset", F.coalesce("_before", F.lit(0)).cast("bigint")).drop("_before")


def position_to_time(positions: DataFrame, segments: DataFrame, pos: str = "char_pos", out: str = "ts") -> DataFrame:
    """Interpolated media time of character positions.

    The first segment whose end reaches the position carries it; past the last
    segment it is the end of the file, and 0 for a file without segments.
    """
    spans = with_offsets(segments).select(
        "file_id", "char_offset", F.length("text").alias("_len"), (F.col("char_offset") + F.length("text")).alias("char_end"), "start_s", "end_s"
    )
    keyed = positions.select("file_id", pos).distinct()
    hit = points_in(keyed, pos, spans, ["file_id"], span=("char_offset", "char_end"), width=CHAR_BUCKET)
    ratio = (F.col(pos) - F.col("char_offset")) / F.greatest(F.col("_len"), F.lit(1))
    at = hit.select("file_id", pos, (F.col("start_s") + ratio * (F.col("end_s") - F.col("start_s"))).alias("_at"))
    last = segments.groupBy("file_id").agg(F.max_by("end_s", "segment_id").alias("_last"))
    joined = positions.join(at, ["file_id", pos], "left").join(last, "file_id", "left")
    return joined.withColumn(out, F.coalesce("_at", "_last", F.lit(0.0))).drop("_at", "_last")


def _starts(text: str, term: str) -> list[int]:
    found, at = [], text.find(term)
    while at >= 0:
        found.append(at)
        at = text.find(term, at + 1)
    return found


def _wordish(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def _whole_words(text: str, term: str) -> list[int]:
    """Hits with a word edge on both sides, leftmost first, not overlapping."""
    kept, free_from, n = [], 0, len(term)
    edge = lambda i: (i > 0 and _wordish(text[i - 1])) != (i < len(text) and _wordish(text[i]))
    for at in _starts(text, term):
        if at >= free_from and edge(at) and edge(at + n):
            kept.append(at)
            free_from = at + n
    return kept


# Terms that one automaton holds; more are searched in as many passes as they fill.
TERMS_AT_ONCE = 100_000
_HITS = T.ArrayType(
    T.StructType([T.StructField("term_key", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
)


class TermScan:
    """All occurrences of many terms in one pass over a text, by an automaton over the terms."""

    def __init__(self, terms: list[str], word_boundary: bool, values: list | None = None):
        import ahocorasick

        self.terms, self.whole = pa.array(terms, pa.string()), word_boundary
        self.sizes = np.array([len(w) for w in terms], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for k, w in enumerate(terms):
            self.automaton.add_word(w, k if values is None else values[k])
        self.automaton.make_automaton()

    def _whole_words(self, text: str, ends: list[int], which: list[int]) -> tuple[list[int], list[int]]:
        """Hits with a word edge on both sides; of hits of a term that overlap the leftmost ones."""
        n, free_from, kept = len(text), {}, ([], [])
        edge = lambda i: (i > 0 and _wordish(text[i - 1])) != (i < n and _wordish(text[i]))
        for end, k in zip(ends, which):
            start = end + 1 - int(self.sizes[k])
            if start >= free_from.get(k, 0) and edge(start) and edge(end + 1):
                free_from[k] = end + 1
                kept[0].append(end)
                kept[1].append(k)
        return kept

    def search(self, texts: list[str | None]) -> pa.Array:
        """For every text the (term, start positions) of the terms it holds; NULL holds none."""
        ends, which, counts = [], [], np.zeros(len(texts), dtype=np.int64)
        for n, text in enumerate(texts):
            if text and len(self.sizes):
                hits = list(self.automaton.iter(text))
                if hits:
                    own = [e for e, _ in hits], [k for _, k in hits]
                    if self.whole:
                        own = self._whole_words(text, *own)
                    ends += own[0]
                    which += own[1]
                    counts[n] = len(own[0])
        row, term = np.repeat(np.arange(len(texts)), counts), np.array(which, dtype=np.int64)
        start = np.array(ends, dtype=np.int64) + 1 - (self.sizes[term] if len(term) else 0)
        turn = np.lexsort((start, term, row))
        row, term, start = row[turn], term[turn], start[turn]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])][: len(row)])
        inner = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(start, pa.int32()))
        pair = pa.StructArray.from_arrays([self.terms.take(pa.array(term[first])), inner], ["term_key", "positions"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(texts) + 1)), pa.int32()), pair)


def _scanner(name: str, make) -> TermScan:
    """The scan of this name, built once a Python worker; the last few are kept."""
    held = vars(sys).setdefault("_verbascope_scans", {})
    if name not in held:
        while len(held) >= 4:
            held.pop(next(iter(held)))
        held[name] = make()
    return held[name]


def _term_parts(terms: DataFrame) -> list[list]:
    """The rows of a vocabulary in parts that one automaton holds, cut by ``term_key``."""
    # A term whose first word is empty begins with a blank and is none of a normalised text.
    found = terms.where(F.split_part("term_key", F.lit(" "), F.lit(1)) != "")
    few = found.limit(TERMS_AT_ONCE + 1).collect()
    if len(few) <= TERMS_AT_ONCE:
        return [few]
    stored = materialise(found, "terms")
    n = -(-stored.count() * 5 // (4 * TERMS_AT_ONCE))
    return [stored.where(F.pmod(F.xxhash64("term_key"), F.lit(n)) == k).collect() for k in range(n)]


def scan_terms(text: Column, terms: DataFrame, word_boundary: bool = False) -> Column:
    """Array of (term_key, start positions) of the terms a text holds, each text read once.

    The distinct terms are sent to every task, at most ``TERMS_AT_ONCE`` of them in one
    automaton; a longer list is sent and searched in parts. Overlapping hits count unless
    ``word_boundary`` asks for whole words.
    """
    spark = terms.sparkSession
    parts = _term_parts(terms.select("term_key").distinct())

    def search(rows) -> Column:
        sent, name = spark.sparkContext.broadcast([r.term_key for r in rows]), uuid.uuid4().hex

        @F.arrow_udf(_HITS)
        def run(texts: pa.Array) -> pa.Array:
            return _scanner(name, lambda: TermScan(sent.value, word_boundary)).search(texts.to_pylist())

        return run(text)

    return F.concat(*[search(rows) for rows in parts]) if len(parts) > 1 else search(parts[0])


_REGION_HITS = "array<struct<term:string,category:string,ref_pos:int,status:string,found_as:string>>"
STATUSES = ("correct", "known_substitution", "missing_or_unknown")


def scan_regions(ref: Column, hyp: Column, vocab: DataFrame, margin: int) -> Column:
    """Array of (term, category, ref_pos, status, found_as): the occurrences of the terms in a
    reference, each looked up in the region of the hypothesis that the length ratio gives.

    ``vocab(term_key, term, category, _errs, known_errors)`` goes to the tasks as the terms of
    ``scan_terms`` do, so neither texts nor regions are copied or shuffled for an occurrence.
    """
    spark = vocab.sparkSession

    def search(rows) -> Column:
        sent, name = spark.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex

        def make():
            book = {}
            for k, (key, _, _, errs, _) in enumerate(sent.value):
                book.setdefault(key, []).append((k, [(n, e) for n, e in enumerate(errs or []) if e is not None]))
            column = lambda n: pa.array([r[n] for r in sent.value], pa.string())
            known = [list(r[4] or []) for r in sent.value]
            first = np.cumsum([0] + [len(x) for x in known])
            spelt = pa.array([e for x in known for e in x], pa.string())
            scan = TermScan(list(book), False, [(key, len(key), entries) for key, entries in book.items()])
            return scan, book, first, (column(1), column(2), spelt)

        @F.arrow_udf(_REGION_HITS)
        def run(refs: pa.Array, hyps: pa.Array) -> pa.Array:
            scan, book, first, (terms, categories, spelt) = _scanner(name, make)
            ends, which, place, kind, found_as = [0], [], [], [], []
            for text, heard in zip(refs.to_pylist(), hyps.to_pylist()):
                n = len(heard or "")
                ratio = n / max(len(text or ""), 1)
                for end, (key, size, entries) in scan.automaton.iter(text) if text and book else ():
                    p = end + 1 - size
                    lo, hi = max(int(p * ratio) - margin, 0), min(int((end + 1) * ratio) + margin, n)
                    right = heard is not None and lo <= hi and heard.find(key, lo, hi) >= 0
                    for k, errs in entries:
                        e = None if right or heard is None else next((i for i, x in errs if x in heard[lo : max(lo, hi)]), None)
                        which.append(k)
                        place.append(p)
                        kind.append(0 if right else 2 if e is None else 1)
                        found_as.append(None if e is None else int(first[k]) + e)
                ends.append(len(which))
            rows, kinds = pa.array(which, pa.int64()), pa.array(kind, pa.int64())
            term = terms.take(rows)
            said = pc.if_else(pc.equal(kinds, 0), term, spelt.take(pa.array(found_as, pa.int64())))
            columns = [term, categories.take(rows), pa.array(place, pa.int32()), pa.array(STATUSES).take(kinds), said]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "category", "ref_pos", "status", "found_as"]))

        return run(ref, hyp)

    parts = [search(rows) for rows in _term_parts(vocab)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def counts_by_term(occ: Column) -> Column:
    """Array of (term, category, occurrences, correct): the occurrences that ``scan_regions`` gives a pair, by term."""

    @F.arrow_udf("array<struct<term:string,category:string,occurrences:bigint,correct:bigint>>")
    def run(lists: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        row, flat = np.repeat(np.arange(len(lists)), sizes), lists.flatten()
        term, category = flat.field("term").cast(pa.string()), flat.field("category").cast(pa.string())
        codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in (term, category)]
        right = pc.equal(flat.field("status"), STATUSES[0]).to_numpy(zero_copy_only=False)
        turn = np.lexsort((codes[1], codes[0], row))
        new = np.ones(len(turn), dtype=bool)
        for c in (row, *codes):
            new[1:] &= c[turn][1:] == c[turn][:-1]
        new[1:] = ~new[1:]
        start = np.flatnonzero(new)
        n = np.diff(np.r_[start, len(turn)])
        good = np.diff(np.r_[0, np.cumsum(right[turn])][np.r_[start, len(turn)]])
        at = pa.array(turn[start])
        ends = np.searchsorted(row[turn[start]], np.arange(len(lists) + 1))
        columns = [term.take(at), category.take(at), pa.array(n, pa.int64()), pa.array(good, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "category", "occurrences", "correct"]))

    return run(occ)


def find_each(text: Column, terms: Column, word_boundary: bool = False) -> Column:
    """Array of (term, start positions) for the terms that occur in a text."""
    find = _whole_words if word_boundary else _starts

    @F.pandas_udf(_HITS)
    def run(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(t, ws):
            hits = ((w, find(t, w)) for w in ws if w)
            return [{"term_key": w, "positions": p} for w, p in hits if p]

        return pd.Series([one(t, ws) for t, ws in zip(texts, wanted)])

    return run(text, terms)


def occurrences(text: Column, term: Column) -> Column:
    """Start positions of every occurrence of one term, overlapping ones included."""
    return F.coalesce(F.try_element_at(find_each(text, F.array(term)), F.lit(1))["positions"], F.array().cast("array<int>"))


def bounded_occurrences(text: Column, term: Column) -> Column:
    """Start positions of whole-word occurrences of one term, not overlapping."""
    return F.coalesce(
        F.try_element_at(find_each(text, F.array(term), word_boundary=True), F.lit(1))["positions"], F.array().cast("array<int>")
    )
