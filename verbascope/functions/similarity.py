"""Word and text similarity.

What Spark has built in stays in the JVM (edit distance, set overlap). The rest
are small Arrow-batched kernels meant for *distinct* pairs: callers de-duplicate
first. All edit-distance kernels are bit-parallel over arbitrary-length integers
(Myers 1999, Hyyrö 2003), so a pair costs O(n·m/64).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbascope.functions.text import let

# --------------------------------------------------------------------------
# JVM-side measures
# --------------------------------------------------------------------------


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)), F.lit(0.0))


def chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def set_jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; NULL when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def char_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(set_jaccard(F.array_distinct(chars(a)), F.array_distinct(chars(b))), F.lit(0.0))


def line_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def text_jaccard(a: Column, b: Column) -> Column:
    """Token-set overlap of two screen texts: both empty 1, one empty 0."""
    wa, wb = line_words(a), line_words(b)
    return (
        F.when((F.size(wa) == 0) & (F.size(wb) == 0), F.lit(1.0))
        .when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0))
        .otherwise(set_jaccard(wa, wb))
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Exact character distance, cheap for near texts of any length.

    The threshold form of the built-in works on a band and answers -1 beyond it,
    so growing thresholds cost O(n·d) instead of O(n·m); ``coalesce`` is lazy.
    """
    longest = F.greatest(F.length(a), F.length(b))
    steps = [F.nullif(F.levenshtein(a, b, t), F.lit(-1)) for t in (32, 256, 2048, 16384)]
    banded = F.coalesce(*steps, F.levenshtein(a, b))
    return F.when(longest <= 64, F.levenshtein(a, b)).otherwise(banded)


def word_distance(ref_words: Column, hyp_words: Column) -> Column:
    """Exact word-level edit distance without leaving the JVM.

    Each distinct word of the pair is given one code point, both word lists
    become strings over these code points, and the built-in character distance
    is the word distance. Code points in the surrogate range are skipped, which
    leaves room for a million distinct words per pair.
    """

    def encode(words: Column, book: Column) -> Column:
        def code(w: Column) -> Column:
            k = F.array_position(book, w)
            return F.lpad(F.hex(F.when(k < 0xD700, k).otherwise(k + 0x900)), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")

    both = let(
        F.array_distinct(F.concat(ref_words, hyp_words)),
        lambda book: F.struct(encode(ref_words, book).alias("r"), encode(hyp_words, book).alias("h")),
    )
    return let(both, lambda x: edit_distance(x["r"], x["h"]))


# --------------------------------------------------------------------------
# bit-parallel helpers (plain Python, used inside Arrow batches)
# --------------------------------------------------------------------------


def _masks(seq) -> dict:
    table: dict = {}
    bit = 1
    for item in seq:
        table[item] = table.get(item, 0) | bit
        bit <<= 1
    return table


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    table = _masks(a)
    full = (1 << len(a)) - 1
    row = full
    for item in b:
        hit = row & table.get(item, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 · 2·LCS / (|a| + |b|); two empty words are equal."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with the prefix bonus (four characters at 0.1 each),
    the bonus only above 0.7."""
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = [False] * lb
    mine = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if m == 0:
        return 0.0
    theirs = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    score = (m / la + m / lb + (m - swaps) / m) / 3.0
    if score > 0.7:
        prefix = 0
        while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
            prefix += 1
        score += prefix * 0.1 * (1.0 - score)
    return score


# Words up to this many characters fit one machine word of the batch kernels.
WORD_BITS = 64


def char_rows(words: list[str], width: int, pad: int) -> np.ndarray:
    """One row of code points per word, padded."""
    out = np.full((len(words), width), pad, dtype=np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _where_equal(rows: np.ndarray, char: np.ndarray) -> np.ndarray:
    """Bit j of a row's result: its j-th character is the given one."""
    packed = np.packbits(rows == char[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 8 - packed.shape[1])))).view(np.uint64).ravel()


def low_bits(n: np.ndarray) -> np.ndarray:
    """The lowest n bits set, n from 0 to 64."""
    shift = np.minimum(n, WORD_BITS - 1).astype(np.uint64)
    return np.where(n >= WORD_BITS, ~np.uint64(0), (np.uint64(1) << shift) - np.uint64(1))


def _in_words(kernel, scalar, a: list[str], b: list[str]) -> np.ndarray:
    """Batch kernel where both words fit a machine word, the scalar one elsewhere."""
    la, lb = (np.array([len(w) for w in x], dtype=np.int64) for x in (a, b))
    out = np.zeros(len(a))
    fits = np.flatnonzero((la <= WORD_BITS) & (lb <= WORD_BITS))
    if len(fits):
        out[fits] = kernel([a[k] for k in fits], [b[k] for k in fits], la[fits], lb[fits])
    for k in np.flatnonzero((la > WORD_BITS) | (lb > WORD_BITS)):
        out[k] = scalar(a[k], b[k])
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``indel_ratio`` of many pairs at once: one step of bit vectors for each character of b."""

    def kernel(a, b, la, lb):
        rows, cols = char_rows(a, max(1, int(la.max())), 0), char_rows(b, max(1, int(lb.max())), 0xFFFFFFFF)
        full = low_bits(la)
        row = full.copy()
        for j in range(int(lb.max())):
            hit = row & _where_equal(rows, cols[:, j])
            row = ((row + hit) | (row - hit)) & full
        total = la + lb
        return np.where(total == 0, 100.0, 200.0 * (la - np.bitwise_count(row)) / np.maximum(total, 1))

    return _in_words(kernel, indel_ratio, a, b)


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler`` of many pairs at once, with the same order of operations."""

    def kernel(a, b, la, lb):
        n = np.arange(len(a))
        rows, cols = char_rows(a, max(1, int(la.max())), 0), char_rows(b, max(1, int(lb.max())), 0xFFFFFFFF)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        used, m = np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.int64)
        mine, theirs = np.zeros_like(rows), np.zeros_like(rows)
        for i in range(int(la.max())):
            window = low_bits(np.minimum(lb, i + reach + 1)) & ~low_bits(np.maximum(i - reach, 0))
            free = _where_equal(cols, rows[:, i]) & window & ~used
            free[i >= la] = 0
            low = free & (~free + np.uint64(1))
            hit = low != 0
            used |= low
            mine[n[hit], m[hit]] = rows[hit, i]
            m += hit
        at = np.zeros(len(a), dtype=np.int64)
        for j in range(int(lb.max())):
            hit = (used >> np.uint64(j)) & np.uint64(1) != 0
            theirs[n[hit], at[hit]] = cols[hit, j]
            at += hit
        swaps = (mine != theirs).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3.0, 0.0)
        width = min(rows.shape[1], cols.shape[1], 4)
        prefix = np.cumprod(rows[:, :width] == cols[:, :width], axis=1).sum(axis=1)
        score = np.where(score > 0.7, score + prefix * 0.1 * (1.0 - score), score)
        return np.where([x == y and x != "" for x, y in zip(a, b)], 1.0, score)

    return _in_words(kernel, jaro_winkler, a, b)


# --------------------------------------------------------------------------
# Metaphone (Philips 1990)
# --------------------------------------------------------------------------

_VOWELS = frozenset("AEIOU")
_FRONT = frozenset("EIY")
# Initial letter pairs whose first letter is silent.
_SILENT_START = ("KN", "GN", "PN", "WR", "AE")
# Letters that keep their own code.
_PLAIN = frozenset("FJLMNR")


def metaphone(word: str) -> str:
    """Phonetic code of a word; blanks are kept, other characters ignored."""
    s = word.upper()
    if s[:2] in _SILENT_START:
        s = s[1:]
    n = len(s)
    out: list[str] = []

    def at(k: int) -> str:
        return s[k] if 0 <= k < n else ""

    i = 0
    while i < n:
        ch, nxt, nxt2, prev = s[i], at(i + 1), at(i + 2), at(i - 1)
        if ch == prev and ch != "C":
            i += 1
            continue
        step = 1
        if ch in _VOWELS:
            if i == 0 or prev == " ":
                out.append(ch)
        elif ch == "B":
            if not (prev == "M" and (nxt == "" or nxt == " ")):
                out.append("B")
        elif ch == "C":
            if nxt == "I" and nxt2 == "A" or (nxt == "H" and prev != "S"):
                out.append("X")
                step = 2 if nxt == "H" else 1
            elif nxt in _FRONT and nxt:
                out.append("S" if prev != "S" else "")
            else:
                out.append("K")
                step = 2 if nxt == "H" else 1
        elif ch == "D":
            if nxt == "G" and nxt2 in _FRONT and nxt2:
                out.append("J")
                step = 3
            else:
                out.append("T")
        elif ch == "G":
            if nxt == "H" and not (i + 2 >= n or nxt2 in _VOWELS):
                pass
            elif nxt == "N" and (i + 2 >= n or s[i + 2 :] == "ED"):
                pass
            elif nxt in _FRONT and nxt and prev != "G":
                out.append("J")
            else:
                out.append("K")
                step = 2 if nxt == "H" else 1
        elif ch == "H":
            if nxt in _VOWELS and nxt and prev not in tuple("CSPTG"):
                out.append("H")
        elif ch == "K":
            if prev != "C":
                out.append("K")
        elif ch == "P":
            if nxt == "H":
                out.append("F")
                step = 2
            else:
                out.append("P")
        elif ch == "Q":
            out.append("K")
        elif ch == "S":
            if nxt == "H":
                out.append("X")
                step = 2
            elif nxt == "I" and nxt2 in ("O", "A"):
                out.append("X")
            elif nxt == "C" and nxt2 == "H":
                out.append("SK")
                step = 3
            else:
                out.append("S")
        elif ch == "T":
            if nxt == "I" and nxt2 in ("O", "A"):
                out.append("X")
            elif nxt == "H":
                out.append("0")
                step = 2
            elif not (nxt == "C" and nxt2 == "H"):
                out.append("T")
        elif ch == "V":
            out.append("F")
        elif ch == "W":
            if i == 0 and nxt == "H":
                out.append("W")
                step = 2
            elif nxt in _VOWELS and nxt:
                out.append("W")
        elif ch == "X":
            out.append("S" if i == 0 else "KS")
        elif ch == "Y":
            if nxt in _VOWELS and nxt:
                out.append("Y")
        elif ch == "Z":
            out.append("S")
        elif ch in _PLAIN:
            out.append(ch)
        elif ch == " ":
            if out and out[-1] != " ":
                out.append(" ")
        i += step
    return "".join(out)


# --------------------------------------------------------------------------
# Arrow-batched UDFs
# --------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winklers(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(T.StringType())
def metaphone_udf(word: pd.Series) -> pd.Series:
    return word.map(metaphone)


# --------------------------------------------------------------------------
# plausibility of "this word is a mis-hearing of that term"
# --------------------------------------------------------------------------

ACCEPT_PLAUSIBILITY = 0.65
# Fixed output format: the reasons of a verdict, tag and figures.
REASONS = {
    "phonetic": "phonetic:%s≈%s(%.2f)",
    "edit_sim": "edit_sim:%.2f",
    "len_ratio": "len_ratio:%.2f",
    "char_overlap": "char_overlap:%.2f",
    "prefix": "substring_penalty:diff=%d",
    "tiny": "tiny_word_blocked:len=%d",
    "three": "very_short_word:len=%d,edit=%d",
    "four": "short_word:len=%d,edit=%d,ratio=%.2f",
}


def _measured(error: Column, term: Column, error_code: Column | None, term_code: Column | None, body) -> Column:
    """``body`` of the measures of a pair, each worked out once however often it is used."""
    bare = F.regexp_replace(F.lower(error), r"^[.,!?;:'\"()\[\]]+|[.,!?;:'\"()\[\]]+$", "")
    coded = error_code is not None and term_code is not None
    codes = [error_code.alias("ec"), term_code.alias("tc")] if coded else []

    def measures(w: Column) -> Column:
        e, t = w["e"], w["t"]
        le, lt = F.length(e), F.length(t)
        psim = F.lit(0.0)
        if coded:
            longest = F.greatest(F.length(w["ec"]), F.length(w["tc"]))
            psim = F.when(
                (w["ec"] != "") & (w["tc"] != ""),
                F.lit(1.0) - F.levenshtein(w["ec"], w["tc"]) / F.greatest(longest, F.lit(1)),
            ).otherwise(F.lit(0.0))
        kept = [e.alias("e"), t.alias("t"), *([w["ec"].alias("ec"), w["tc"].alias("tc")] if coded else [])]
        return F.struct(
            *kept, le.alias("le"), lt.alias("lt"), F.levenshtein(e, t).alias("dist"), char_overlap(e, t).alias("overlap"),
            (F.least(le, lt) / F.greatest(le, lt, F.lit(1))).alias("ratio"), psim.alias("psim"),
        )

    return let(F.struct(bare.alias("e"), F.lower(term).alias("t"), *codes), lambda w: let(measures(w), body))


def _verdicts(m, guard, rest) -> Column:
    """The guards in order, then ``rest``; ``guard(value, reason)`` makes one verdict."""
    e, t, le, lt, dist, ratio = (m[c] for c in ("e", "t", "le", "lt", "dist", "ratio"))
    gap = F.abs(le - lt)
    one_more = t.startswith(e) & (lt - le <= 1)
    return (
        F.when((le == 0) | (lt == 0), guard(0.0))
        .when(e == t, guard(1.0, F.lit("exact_match")))
        .when((t.startswith(e) | e.startswith(t)) & (gap > 1), guard(0.05, F.format_string(REASONS["prefix"], gap)))
        .when(le <= 2, guard(0.05, F.format_string(REASONS["tiny"], le)))
        .when((le == 3) & (dist > 0) & ~one_more, guard(0.05, F.format_string(REASONS["three"], le, dist)))
        .when((le == 4) & ((dist > 1) | (ratio < 0.75)), guard(0.1, F.format_string(REASONS["four"], le, dist, ratio)))
        .otherwise(rest)
    )


def _edit_share(m) -> Column:
    return F.lit(1.0) - m["dist"] / F.greatest(m["le"], m["lt"], F.lit(1))


def _score(m) -> Column:
    esim = _edit_share(m)
    return (
        F.when(m["psim"] > 0.3, 0.35 * m["psim"]).otherwise(F.lit(0.0))
        + F.when(esim > 0.4, 0.30 * esim).otherwise(F.lit(0.0))
        + F.when(m["ratio"] >= 0.65, 0.20 * m["ratio"]).otherwise(F.lit(0.0))
        + F.when(m["overlap"] >= 0.4, 0.15 * m["overlap"]).otherwise(F.lit(0.0))
    )


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance of many pairs at once, a step of bit vectors for each character of b."""

    def scalar(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    def kernel(a, b, la, lb):
        rows, cols = char_rows(a, max(1, int(la.max())), 0), char_rows(b, max(1, int(lb.max())), 0xFFFFFFFF)
        one = np.uint64(1)
        full, top = low_bits(la), low_bits(la) ^ low_bits(np.maximum(la - 1, 0))
        up, down, dist = full.copy(), np.zeros_like(full), la.copy()
        for j in range(int(lb.max())):
            match = _where_equal(rows, cols[:, j])
            diag = (((match & up) + up) ^ up) | match | down
            right_up, right_down = down | ~(diag | up), up & diag
            step = ((right_up & top) != 0).astype(np.int64) - ((right_down & top) != 0)
            dist += np.where(j < lb, step, 0)
            right_up, right_down = (right_up << one) | one, right_down << one
            up, down = (right_down | ~(diag | right_up)) & full, right_up & diag & full
        return np.where(la == 0, lb, dist)

    return _in_words(kernel, scalar, a, b).astype(np.int64)


def _letter_sets(words: list[str], bit: dict[str, int]) -> np.ndarray:
    """One row of 64-bit masks a word: the characters it has."""
    out = np.zeros((len(words), max(1, -(-len(bit) // 64))), dtype=np.uint64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(words)), np.array([len(w) for w in words], dtype=np.int64))
    known, at = np.unique(codes, return_inverse=True)
    place = np.array([bit[chr(c)] for c in known.tolist()], dtype=np.int64)[at] if len(known) else np.zeros(0, dtype=np.int64)
    np.bitwise_or.at(out, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return out


@F.pandas_udf(T.StructType([T.StructField("dist", T.IntegerType()), T.StructField("overlap", T.DoubleType())]))
def _spelling_udf(e: pd.Series, t: pd.Series) -> pd.DataFrame:
    """Edit distance and overlap of the characters, many pairs at once; NULL where a side is."""
    none = (e.isna() | t.isna()).to_numpy()
    a, b = e.fillna("").tolist(), t.fillna("").tolist()
    bit = {c: k for k, c in enumerate(sorted(set("".join(set(a))) | set("".join(set(b)))))}
    x, y = _letter_sets(a, bit), _letter_sets(b, bit)
    both, any_ = np.bitwise_count(x & y).sum(axis=1), np.bitwise_count(x | y).sum(axis=1)
    overlap = np.where(any_ > 0, both / np.maximum(any_, 1), 0.0)
    return pd.DataFrame({"dist": pd.Series(edit_distances(a, b)).astype("Int32").mask(none), "overlap": overlap})


def plausibility_score(error: Column, term: Column) -> Column:
    """The score of ``plausibility`` by spelling alone, without its reasons.

    ``error`` has no edge punctuation and both are in lower case, so a pair's measures
    come from batches of pairs.
    """
    le, lt, spelling = F.length(error), F.length(term), _spelling_udf(error, term)
    ratio = F.least(le, lt) / F.greatest(le, lt, F.lit(1))
    m = {"e": error, "t": term, "le": le, "lt": lt, "dist": spelling["dist"], "overlap": spelling["overlap"], "ratio": ratio, "psim": F.lit(0.0)}
    return _verdicts(m, lambda value, *why: F.lit(value), _score(m))


def plausibility(error: Column, term: Column, error_code: Column | None = None, term_code: Column | None = None) -> Column:
    """struct(score, reasons) for an (error word, term) pair.

    The phonetic part needs the Metaphone codes of both sides; without them the
    score is the spelling part only. Guards come first: a word that is a plain
    prefix of the term (or the reverse) with a length gap above one, and words
    of up to four characters, are almost never real mis-hearings.
    """
    coded = error_code is not None and term_code is not None

    def verdict(value, *why: Column) -> Column:
        why_arr = F.array(*why) if why else F.array().cast("array<string>")
        return F.struct(F.lit(value).cast("double").alias("score"), why_arr.alias("reasons"))

    def body(m: Column) -> Column:
        esim = _edit_share(m)
        phonetic = F.when(m["psim"] > 0.3, F.format_string(REASONS["phonetic"], m["ec"], m["tc"], m["psim"])) if coded else F.lit(None).cast("string")
        reasons = F.array_compact(
            F.array(
                phonetic,
                F.when(esim > 0.4, F.format_string(REASONS["edit_sim"], esim)),
                F.when(m["ratio"] >= 0.65, F.format_string(REASONS["len_ratio"], m["ratio"])),
                F.when(m["overlap"] >= 0.4, F.format_string(REASONS["char_overlap"], m["overlap"])),
            )
        )
        return _verdicts(m, verdict, F.struct(_score(m).alias("score"), reasons.alias("reasons")))

    return _measured(error, term, error_code, term_code, body)
