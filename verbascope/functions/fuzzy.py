"""Exact joins of distinct words by indel ratio or Jaro-Winkler similarity.

At the limits in use about two in a hundred of all pairs are results, so no index can
leave most pairs untouched; what it can do is to make a pair cheap. Where all accepted
pairs are asked for, a word meets all words of a block at once: for each character the
block holds a vector with a bit mask of places for every word, of 16 or 64 bits as the
words are long, so a character of the word is a few operations on vectors and no
pair is looked up. That gives the common characters of every pair exactly; only pairs
that have enough of them are measured to the end.

Where only the nearest are asked for, words are packed with a bit signature of their
characters, and a pair is taken through bounds of growing cost:

1. *count* - common bits of the signatures bound the common characters;
2. *position* - characters that find an equal one within the reach of the measure;
3. the measure itself, by bit vectors over the packed rows.

Every bound is an upper bound of the measure, so the result is that of scoring all
pairs. Words of more than 64 characters are scored one pair at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbascope.functions.similarity import WORD_BITS, edit_distances, indel_ratio, jaro_winkler, low_bits
from verbascope.session import materialise

# Words of either side that one task of a join holds, and pairs it takes through the bounds at once.
BLOCK_WORDS = 4096
PAIRS_AT_ONCE = 400_000
TERMS_AT_ONCE = 4 * BLOCK_WORDS  # right words of one task where all accepted pairs are asked for: longer vectors, fewer calls
MOST_TASKS = 4096  # beyond it a task takes several pairs of blocks
SIGNATURE_WORDS = 3  # of 64 bits


class Side:
    """Words in order, none longer than the bits of ``kind``: for each character the places it has in every word."""

    def __init__(self, words: list[str], at: list[int], kind: type):
        at = sorted(at, key=words.__getitem__)
        self.at, self.kind, self.bits = np.array(at, dtype=np.int64), kind, np.dtype(kind).itemsize * 8
        own = [words[k] for k in at]
        self.size = np.array([len(w) for w in own], dtype=np.int64)
        self.full = low_bits(self.size).astype(kind)
        self.masks: dict[str, np.ndarray] = {c: np.zeros(len(own), dtype=kind) for c in set().union(*own)}
        self.starts: dict[str, list[int]] = {}
        for n, w in enumerate(own):
            for place, c in enumerate(w):
                self.masks[c][n] |= kind(1 << place)
            # Words of one beginning stand together: from the first to behind the last.
            for k in range(1, min(len(w), 4) + 1):
                self.starts.setdefault(w[:k], [n, n])[1] = n + 1
        self.room = [np.empty(len(own), dtype=kind) for _ in range(3)]
        self.steps = np.empty((WORD_BITS, len(own)), dtype=kind)

    def windows(self, n: int) -> list[np.ndarray]:
        """For each place of a word of ``n`` characters the places of every word within the reach of Jaro's measure."""
        reach = [max(max(n, m) // 2 - 1, 0) for m in range(self.bits + 1)]
        out = []
        for s in range(n):
            table = [((1 << (s + r + 1)) - (1 << max(s - r, 0))) & ((1 << self.bits) - 1) for r in reach]
            out.append(np.array(table, dtype=self.kind)[self.size])
        return out


def sides(words: list[str]) -> list[Side]:
    """The words of at most 64 characters by the bits that hold a place of theirs."""
    out, least = [], -1
    for kind in (np.uint16, np.uint64):
        most = np.dtype(kind).itemsize * 8
        at = [k for k, w in enumerate(words) if least < len(w) <= most]
        if at:
            out.append(Side(words, at, kind))
        least = most
    return out


class Packed:
    """Words of at most 64 characters over the alphabet of the right side of a join."""

    def __init__(self, words: list[str], alphabet: dict[str, int], tokens: dict[tuple[int, int], int]):
        other = len(alphabet)  # a character the other side has not
        self.words, self.size = words, np.array([len(w) for w in words], dtype=np.int64)
        width = max(1, int(self.size.max(initial=0)))
        # Two paddings, one a side, that are equal to nothing.
        self.codes = np.full((len(words), width), other, dtype=np.int64)
        flat = np.fromiter((alphabet.get(c, other) for w in words for c in w), dtype=np.int64, count=int(self.size.sum()))
        row = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.codes[row, place] = flat
        self.masks = np.zeros((len(words), other + 1), dtype=np.uint64)
        np.bitwise_or.at(self.masks, (row, flat), np.uint64(1) << place.astype(np.uint64))
        self.masks[:, other] = 0
        self.signature = np.zeros((len(words), SIGNATURE_WORDS), dtype=np.uint64)
        held = np.zeros(len(words), dtype=np.int64)
        counts = np.bitwise_count(self.masks[:, :other])
        for (c, k), bit in tokens.items():
            has = counts[:, c] >= k
            held += has
            self.signature[has, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        # Tokens that share a bit with another of the word, which the bound must allow for.
        self.folded = held - np.bitwise_count(self.signature).sum(axis=1)


def packed(left: list[str], right: list[str]) -> tuple[Packed, Packed]:
    alphabet = {c: k for k, c in enumerate(sorted(set().union(*right)))}
    most: dict[str, int] = {}
    for w in right:
        for c in set(w):
            most[c] = max(most.get(c, 0), w.count(c))
    pairs = sorted(((k, alphabet[c]) for c, n in most.items() for k in range(1, n + 1)))
    tokens = {(c, k): n % (64 * SIGNATURE_WORDS) for n, (k, c) in enumerate(pairs)}
    return Packed(left, alphabet, tokens), Packed(right, alphabet, tokens)


def _lowest(x: np.ndarray) -> np.ndarray:
    """The lowest bit that is set, 0 where none is."""
    return x & (~x + np.uint64(1))


def _windows(reach: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Bits ``s - reach`` to ``s + reach`` for s = 0, 1, ..."""
    window = low_bits(np.minimum(reach + 1, 64))
    for s in range(n):
        yield window
        window = (window << np.uint64(1)) | (s + 1 <= reach).astype(np.uint64)


def _meeting(x: Packed, i: np.ndarray, y: Packed, j: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many characters of x find an equal one in y within reach, one of y serving any number."""
    out = np.zeros(len(i), dtype=np.int64)
    for s, window in enumerate(_windows(reach, x.codes.shape[1])):
        out += (y.masks[j, x.codes[i, s]] & window) != 0
    return out


@dataclass(frozen=True)
class IndelRatio:
    """100 · 2·LCS / (|a| + |b|) of at least ``least``."""

    least: float

    def need(self, la: np.ndarray, lb: np.ndarray, same_first: bool) -> np.ndarray:
        """Common characters a pair of these lengths must have, whose first ones are equal or not."""
        return np.ceil((la + lb) * (self.least / 200.0) - 1e-9).astype(np.int64)

    def bound(self, common: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """The greatest value a pair of so many common characters can have."""
        return 200.0 * np.minimum(common, np.minimum(la, lb)) / np.maximum(la + lb, 1) + 1e-9

    def limits(self, side: Side, n: int) -> np.ndarray:
        return self.need(np.int64(n), side.size, True).astype(np.uint8)

    def meet(self, word: str, side: Side, need: np.ndarray) -> tuple[np.ndarray, ...]:
        """(places, longest common subsequence) of the words of a side that have enough in common with a word."""
        hit, less, row = side.room
        row[:] = side.full
        for c in word:
            mask = side.masks.get(c)
            if mask is not None:
                # What is carried beyond a word's last bit never comes back below it.
                np.bitwise_and(row, mask, out=hit)
                np.subtract(row, hit, out=less)
                np.add(row, hit, out=row)
                np.bitwise_or(row, less, out=row)
        np.bitwise_and(row ^ side.full, side.full, out=row)
        common = np.bitwise_count(row)
        j = np.flatnonzero(common >= need)
        return j, common[j]

    def value(self, la: np.ndarray, lb: np.ndarray, common: np.ndarray) -> np.ndarray:
        total = la + lb
        return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))

    def scalar(self, a: str, b: str) -> float:
        return indel_ratio(a, b)

    def accept(self, value):
        return value >= self.least

    def score(self, x: Packed, i: np.ndarray, y: Packed, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, values) of the accepted pairs, and how many were scored to the end.

        A pair leaves on the way once what is left of its right word cannot make up the need.
        """
        la, lb = x.size[i], y.size[j]
        need, at = self.need(la, lb, True), np.arange(len(i))
        full = low_bits(la)
        row = full.copy()
        for s in range(y.codes.shape[1]):
            hit = row & x.masks[i, y.codes[j, s]]
            row = ((row + hit) | (row - hit)) & full
            if s >= 2:
                open_ = la - np.bitwise_count(row) + np.maximum(lb - s - 1, 0) >= need
                if open_.mean() < 0.9:
                    i, j, la, lb, need, at, full, row = (v[open_] for v in (i, j, la, lb, need, at, full, row))
            if not len(i):
                break
        total = la + lb
        value = np.where(total == 0, 100.0, 200.0 * (la - np.bitwise_count(row)) / np.maximum(total, 1))
        good = self.accept(value)
        return at[good], value[good], len(at)


@dataclass(frozen=True)
class JaroWinkler:
    """Jaro-Winkler similarity above ``over``, which must be 0.7 at least: below it no prefix counts."""

    over: float

    def _common(self, la: np.ndarray, lb: np.ndarray, prefix) -> np.ndarray:
        # A prefix of p lifts a Jaro value v by 0.1 p (1 - v), one of 0.7 and less not at all.
        least = np.maximum(0.7, (self.over - 0.1 * prefix) / (1 - 0.1 * prefix))
        return np.ceil((3 * least - 1) * la * lb / np.maximum(la + lb, 1) - 1e-9).astype(np.int64)

    def need(self, la: np.ndarray, lb: np.ndarray, same_first: bool) -> np.ndarray:
        return self._common(la, lb, 4 if same_first else 0)

    def limits(self, side: Side, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For words of ``n`` characters the windows, and the matches needed with a prefix of 0 to 4."""
        need = [self._common(np.int64(n), np.arange(side.bits + 1), p).astype(np.uint8)[side.size] for p in range(5)]
        return side.windows(n), need

    def meet(self, word: str, side: Side, limits: tuple) -> tuple[np.ndarray, ...]:
        """(places, matches, swapped matches, prefix) of the words of a side that have enough matches with a word."""
        windows, needs = limits
        low, back, free = side.room
        free[:] = side.full
        met = [(m, windows[s]) for s, c in enumerate(word) if (m := side.masks.get(c)) is not None]
        steps = side.steps if len(met) <= len(side.steps) else np.empty((len(met), len(free)), dtype=side.kind)
        for step, (mask, window) in zip(steps, met):
            # The first place that is free, within the window and of the same character.
            np.bitwise_and(mask, window, out=low)
            np.bitwise_and(low, free, out=low)
            np.negative(low, out=back)
            np.bitwise_and(low, back, out=step)
            np.bitwise_xor(free, step, out=free)
        np.bitwise_xor(free, side.full, out=free)
        matches, need = np.bitwise_count(free), needs[0].copy()
        ranges = [side.starts[word[:k]] for k in range(1, min(len(word), 4) + 1) if word[:k] in side.starts]
        for k, (a, b) in enumerate(ranges, 1):
            need[a:b] = needs[k][a:b]
        j = np.flatnonzero(matches >= need)
        prefix, swapped, left = np.zeros(len(j), dtype=np.uint8), np.zeros(len(j), dtype=np.uint8), free[j]
        for k, (a, b) in enumerate(ranges, 1):
            prefix[np.searchsorted(j, a) : np.searchsorted(j, b)] = k
        for step, (mask, _) in zip(steps, met):
            # The matches of both words in order: the next one of the other word is to be the same character.
            hit, first = step[j] != 0, left & -left
            first *= hit
            swapped += hit & ((mask[j] & first) == 0)
            left ^= first
        return j, matches[j], swapped, prefix

    def value(self, la: np.ndarray, lb: np.ndarray, m: np.ndarray, swapped: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        m, swaps, prefix = m.astype(np.int64), swapped // 2, prefix.astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3.0, 0.0)
        # Equal words have all matched and none swapped, and come to 1 as they are.
        return np.where(value > 0.7, value + prefix * 0.1 * (1.0 - value), value)

    def scalar(self, a: str, b: str) -> float:
        return jaro_winkler(a, b)

    def accept(self, value):
        return value > self.over

    def score(self, x: Packed, i: np.ndarray, y: Packed, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        la, lb = x.size[i], y.size[j]
        # The exact prefix sharpens the need; then characters must meet within reach.
        width = min(4, x.codes.shape[1], y.codes.shape[1])
        same = (x.codes[i, :width] == y.codes[j, :width]) & (np.arange(width) < np.minimum(la, lb)[:, None])
        prefix = np.cumprod(same & (x.codes[i, :width] < x.masks.shape[1] - 1), axis=1).sum(axis=1)
        need, reach, at = self._common(la, lb, prefix), np.maximum(np.maximum(la, lb) // 2 - 1, 0), np.arange(len(i))
        for p, u, q, v in ((x, 0, y, 1), (y, 1, x, 0)):
            both = (i, j)
            kept = np.flatnonzero(_meeting(p, both[u], q, both[v], reach) >= need)
            i, j, la, lb, reach, prefix, need, at = (c[kept] for c in (i, j, la, lb, reach, prefix, need, at))
        used, mine = np.zeros(len(i), dtype=np.uint64), np.zeros(len(i), dtype=np.uint64)
        for s, window in enumerate(_windows(reach, x.codes.shape[1])):
            low = _lowest(y.masks[j, x.codes[i, s]] & window & ~used)
            used |= low
            mine |= (low != 0).astype(np.uint64) << np.uint64(s)
        # What is matched is exact; only pairs that have enough of it are put in order.
        m = np.bitwise_count(used).astype(np.int64)
        kept = np.flatnonzero(m >= need)
        i, j, la, lb, prefix, at, used, mine, m = (c[kept] for c in (i, j, la, lb, prefix, at, used, mine, m))
        swaps = np.zeros(len(i), dtype=np.int64)
        a, b = mine, used
        for k in range(int(m.max(initial=0))):
            p, q = _lowest(a), _lowest(b)
            left = x.codes[i, np.minimum(np.bitwise_count(p - np.uint64(1)), x.codes.shape[1] - 1)]
            right = y.codes[j, np.minimum(np.bitwise_count(q - np.uint64(1)), y.codes.shape[1] - 1)]
            swaps += (left != right) & (k < m)
            a, b = a ^ p, b ^ q
        swaps //= 2
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3.0, 0.0)
        value = np.where(value > 0.7, value + prefix * 0.1 * (1.0 - value), value)
        value = np.where((prefix >= 0) & (la == lb) & (m == la) & (la > 0) & (swaps == 0) & self._equal(x, i, y, j), 1.0, value)
        good = self.accept(value)
        return at[good], value[good], len(at)

    @staticmethod
    def _equal(x: Packed, i: np.ndarray, y: Packed, j: np.ndarray) -> np.ndarray:
        width = min(x.codes.shape[1], y.codes.shape[1])
        inside = np.arange(width) < x.size[i][:, None]
        return ((x.codes[i, :width] == y.codes[j, :width]) | ~inside).all(axis=1)


def _best(i: np.ndarray, j: np.ndarray, value: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Which pairs are among the first ``top`` of their left word, by value and then by the order of the right one."""
    turn = np.lexsort((order[j], -value, i))
    new = np.r_[True, i[turn][1:] != i[turn][:-1]][: len(turn)]
    first = np.flatnonzero(new)
    return turn[np.arange(len(turn)) - first[np.cumsum(new) - 1] < top]


def _scored(measure, x: Packed, i: np.ndarray, y: Packed, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The accepted pairs, some at once."""
    out, scored = [[], [], []], 0
    for a in range(0, len(i), PAIRS_AT_ONCE):
        ii, jj = i[a : a + PAIRS_AT_ONCE], j[a : a + PAIRS_AT_ONCE]
        at, value, n = measure.score(x, ii, y, jj)
        scored += n
        for held, v in zip(out, (ii[at], jj[at], value)):
            held.append(v)
    joined = [np.concatenate(v) if v else np.zeros(0, dtype=t) for v, t in zip(out, (np.int64, np.int64, np.float64))]
    return *joined, scored


def nearest_pairs(left: list[str], right: list[str], measure, top: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``close_pairs`` of which every left word keeps its ``top`` greatest, ties by the order of the right words.

    The pairs of the greatest bounds are scored first; of the others only those whose
    bound reaches the last value kept can change the result.
    """
    short = [np.array([k for k, w in enumerate(side) if len(w) <= WORD_BITS], dtype=np.int64) for side in (left, right)]
    out, scored = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))], 0
    if len(short[0]) and len(short[1]):
        x, y = packed([left[k] for k in short[0]], [right[k] for k in short[1]])
        rank, first_tries = order[short[1]], 4 * top
        columns = [np.ascontiguousarray(y.signature[:, q]) for q in range(SIGNATURE_WORDS)]
        step = max(1, PAIRS_AT_ONCE * 4 // len(y.words))
        need_of = {n: measure.need(np.int64(n), y.size, True) for n in np.unique(x.size)}
        for first in range(0, len(x.words), step):
            some = np.arange(first, min(first + step, len(x.words)))
            met, bounds, early = [], [], []
            for k in some:
                common = np.bitwise_count(columns[0] & x.signature[k, 0]).astype(np.int64)
                for q in range(1, SIGNATURE_WORDS):
                    if x.signature[k, q]:
                        common += np.bitwise_count(columns[q] & x.signature[k, q])
                if x.folded[k]:
                    common += np.minimum(y.folded, x.folded[k])
                j = np.flatnonzero(common >= need_of[x.size[k]])
                bound = measure.bound(common[j], x.size[k], y.size[j])
                now = np.zeros(len(j), dtype=bool)
                now[np.argpartition(-bound, first_tries)[:first_tries] if len(j) > first_tries else slice(None)] = True
                met.append(j)
                bounds.append(bound)
                early.append(now)
            i, j = np.repeat(some, [len(v) for v in met]), np.concatenate(met)
            bound, now = np.concatenate(bounds), np.concatenate(early)
            fi, fj, fv, n = _scored(measure, x, i[now], y, j[now])
            kept = _best(fi, fj, fv, rank, top)
            fi, fj, fv = fi[kept], fj[kept], fv[kept]
            # The last value kept of words that have all their places taken.
            last = np.full(len(some), -np.inf)
            full = np.bincount(fi - first, minlength=len(some)) == top
            least = np.full(len(some), np.inf)
            np.minimum.at(least, fi - first, fv)
            last[full] = least[full]
            more = ~now & (bound >= last[i - first])
            gi, gj, gv, m = _scored(measure, x, i[more], y, j[more])
            scored += n + m
            fi, fj, fv = (np.concatenate(v) for v in ((fi, gi), (fj, gj), (fv, gv)))
            kept = _best(fi, fj, fv, rank, top)
            out.append((short[0][fi[kept]], short[1][fj[kept]], fv[kept]))
    long_right = [n for n, v in enumerate(right) if len(v) > WORD_BITS]
    for k, w in enumerate(left):
        for n in range(len(right)) if len(w) > WORD_BITS else long_right:
            value = measure.scalar(w, right[n])
            scored += 1
            if measure.accept(value):
                out.append((np.array([k]), np.array([n]), np.array([value])))
    i, j, value = (np.concatenate([v[c] for v in out]) for c in range(3))
    kept = _best(i, j, value, order, top)
    return i[kept], j[kept], value[kept], scored


def close_pairs(left: list[str], right: list[str], measure) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places left, places right, values) of the accepted pairs, and how many were scored to the end."""
    out, scored = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))], 0
    size = np.array([len(w) for w in left], dtype=np.int64)
    short = sorted((k for k, w in enumerate(left) if len(w) <= WORD_BITS), key=size.__getitem__)

    def flush(side: Side, held: list[tuple]) -> int:
        i = np.repeat(np.array([k for k, _ in held], dtype=np.int64), [len(m[0]) for _, m in held])
        j, *facts = (np.concatenate([m[c] for _, m in held]) for c in range(len(held[0][1])))
        value = measure.value(size[i], side.size[j], *facts)
        good = measure.accept(value)
        out.append((i[good], side.at[j[good]], value[good]))
        return len(i)

    for side in sides(right) if short else ():
        held, n, last, limits = [], 0, -1, None
        for k in short:
            if size[k] != last:
                last, limits = size[k], measure.limits(side, int(size[k]))
            held.append((k, measure.meet(left[k], side, limits)))
            n += len(held[-1][1][0])
            if n >= PAIRS_AT_ONCE:
                scored += flush(side, held)
                held, n = [], 0
        if held:
            scored += flush(side, held)
    long_right = [n for n, v in enumerate(right) if len(v) > WORD_BITS]
    for k, w in enumerate(left):
        for n in range(len(right)) if len(w) > WORD_BITS else long_right:
            value = measure.scalar(w, right[n])
            scored += 1
            if measure.accept(value):
                out.append((np.array([k]), np.array([n]), np.array([value])))
    i, j, value = (np.concatenate([v[c] for v in out]) for c in range(3))
    return i, j, value, scored


def fuzzy_word_join(left: DataFrame, a: str, right: DataFrame, b: str, measure, out: str, top: int = 0, order: str | None = None) -> DataFrame:
    """``a, b, out``: accepted pairs of two sets of distinct words.

    With ``top`` a task returns of every left word only the pairs that are its ``top``
    greatest there, ties by the whole number ``order`` of the right word: the first
    ``top`` of all are among them, and the result grows with the left words and blocks.

    Both sides are dealt to blocks of bounded size by a hash of the word; every block
    of one side meets every block of the other in one task, which holds just these
    two and returns accepted pairs alone. NULL words pair with nothing.
    """
    place = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    # Stored, as they are counted first and then dealt: what the words come from is worked out once.
    stored = [materialise(df.where(F.col(c).isNotNull()).select(F.col(c).alias("w"), o.alias("o")), "words") for df, c, o in ((left, a, F.lit(0)), (right, b, place))]
    n = [max(1, -(-df.count() // most)) for df, most in zip(stored, (BLOCK_WORDS, BLOCK_WORDS if top else TERMS_AT_ONCE))]
    # Blocks are few bytes and much work: a number of their own, which is not coalesced by size.
    parts = min(n[0] * n[1], MOST_TASKS)
    deal = lambda m: F.pmod(F.xxhash64("w"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one = stored[0].select("w", deal(n[0]).alias("i"), every(n[1]).alias("j")).repartition(parts, "i", "j")
    two = stored[1].select("w", "o", every(n[0]).alias("i"), deal(n[1]).alias("j")).repartition(parts, "i", "j")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        p, q = x.column("w"), y.column("w")
        if top:
            i, j, value, _ = nearest_pairs(p.to_pylist(), q.to_pylist(), measure, top, y.column("o").to_numpy())
        else:
            i, j, value, _ = close_pairs(p.to_pylist(), q.to_pylist(), measure)
        return pa.table({a: p.take(pa.array(i)).cast(pa.string()), b: q.take(pa.array(j)).cast(pa.string()), out: pa.array(value, pa.float64())})

    return one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInArrow(run, f"`{a}` string, `{b}` string, `{out}` double")


class Spelling:
    """The terms of a block by how a word can differ from them: edit distance and shared characters, a word at once."""

    def __init__(self, terms: list[str]):
        self.terms, self.sides = terms, sides(terms)
        self.size = np.array([len(w) for w in terms], dtype=np.int64)
        self.kinds = np.array([len(set(w)) for w in terms], dtype=np.int64)
        self.long = np.flatnonzero(self.size > WORD_BITS)
        self.has = [{c: m != 0 for c, m in side.masks.items()} for side in self.sides]
        self.starts: dict[str, list[int]] = {}  # the terms of each beginning
        for k, w in enumerate(terms):
            for n in range(len(w) + 1):
                self.starts.setdefault(w[:n], []).append(k)
        self.place = {w: k for k, w in enumerate(terms)}

    def meet(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(edit distance, characters shared) of every term to a word."""
        dist, shared = np.empty(len(self.terms), dtype=np.int64), np.zeros(len(self.terms), dtype=np.int64)
        for side, has in zip(self.sides, self.has):
            kind = side.kind
            one, none = kind(1), np.zeros(len(side.at), dtype=kind)
            top = side.full ^ (side.full >> one)
            up, down, own = side.full.copy(), none, side.size.copy()
            for c in word:
                match = side.masks.get(c, none)
                diag = ((((match & up) + up) ^ up) | match | down)
                right_up, right_down = down | ~(diag | up), up & diag
                own += (right_up & top) != 0
                own -= (right_down & top) != 0
                right_up, right_down = (right_up << one) | one, right_down << one
                up, down = (right_down | ~(diag | right_up)) & side.full, right_up & diag & side.full
            dist[side.at] = np.where(side.size == 0, len(word), own)
            common = np.zeros(len(side.at), dtype=np.int64)
            for c in set(word):
                if c in has:
                    common += has[c]
            shared[side.at] = common
        if len(self.long):
            far = [self.terms[k] for k in self.long]
            dist[self.long] = edit_distances([word] * len(far), far)
            shared[self.long] = [len(set(word) & set(w)) for w in far]
        return dist, shared

    def scores(self, word: str) -> np.ndarray:
        """``similarity.plausibility_score`` of a word and every term, by the same operations in the same order."""
        dist, both = self.meet(word)
        le, lt = len(word), self.size
        least, most = np.minimum(le, lt), np.maximum(le, lt)
        safe, union = np.maximum(most, 1), len(set(word)) + self.kinds - both
        esim, ratio, overlap = 1.0 - dist / safe, least / safe, both / np.maximum(union, 1)
        out = np.where(esim > 0.4, 0.30 * esim, 0.0) + np.where(ratio >= 0.65, 0.20 * ratio, 0.0) + np.where(overlap >= 0.4, 0.15 * overlap, 0.0)
        # The guards from the last to the first, as the first one that holds counts.
        begun = np.zeros(len(lt), dtype=bool)
        begun[self.starts.get(word, [])] = True
        if le == 4:
            out[(dist > 1) | (ratio < 0.75)] = 0.1
        if le == 3:
            out[(dist > 0) & ~(begun & (lt - le <= 1))] = 0.05
        if le <= 2:
            out[:] = 0.05
        for n in range(le):
            k = self.place.get(word[:n])
            begun[[] if k is None else [k]] = True
        out[begun & (most - least > 1)] = 0.05
        if word in self.place:
            out[self.place[word]] = 1.0
        out[(lt == 0) | (le == 0)] = 0.0
        return out


def half_up(values: np.ndarray, digits: int, known: dict[float, float]) -> np.ndarray:
    """Rounded like the SQL function, by the shortest decimals of a number; each value is rounded once."""
    some, at = np.unique(values, return_inverse=True)
    for x in some.tolist():
        if x not in known:
            known[x] = float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return np.array([known[x] for x in some.tolist()], dtype=np.float64)[at]


# Words of either side that a row of the join by beginnings holds, and pairs that leave a task at once.
WORDS_A_ROW, TERMS_A_ROW, PAIRS_OUT = 512, 8192, 200_000


def plausible_spellings(words: DataFrame, terms: DataFrame, word: str, term: str, head: int, out: str, digits: int) -> DataFrame:
    """``word, term, out``: the spelling score, rounded, of all pairs of words and terms that begin with the same ``head`` characters.

    Both are sets of distinct lower-case words without edge punctuation. Words of one beginning
    stand in rows of bounded size; a row of words meets a row of terms, and a word
    of it all those terms at once. No pair is shuffled or looked up.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(df: DataFrame, c: str, most: int, names: str) -> DataFrame:
        d = df.where(F.col(c).isNotNull()).select(F.col(c).alias("w"), F.left(c, F.lit(head)).alias("h"))
        n = d.groupBy("h").agg(F.ceil(F.count("*") / most).alias("n"))
        d = d.join(n, "h").withColumn("k", F.pmod(F.xxhash64("w"), F.col("n")))
        return d.groupBy("h", F.col("k").alias(f"k_{names}")).agg(F.collect_list("w").alias(names))

    # Rows are few bytes and much work: they are dealt to a number of tasks of their own, not coalesced by size.
    met = rows(words, word, WORDS_A_ROW, "a").join(rows(terms, term, TERMS_A_ROW, "b"), "h").repartition(tasks, "h", "k_a", "k_b").select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block, known = None, None, {}
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                own, others = a.values, b.values
                if last is None or not others.equals(last):
                    last, block = others, Spelling(others.to_pylist())
                said = own.to_pylist()
                step = max(1, PAIRS_OUT // len(block.terms))
                for at in range(0, len(said), step):
                    some = said[at : at + step]
                    i = np.repeat(np.arange(at, at + len(some)), len(block.terms))
                    j = np.tile(np.arange(len(block.terms)), len(some))
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array(i)).cast(pa.string()), others.take(pa.array(j)).cast(pa.string()), pa.array(half_up(np.concatenate([block.scores(w) for w in some]), digits, known))],
                        names=[word, term, out],
                    )

    return met.mapInArrow(run, f"`{word}` string, `{term}` string, `{out}` double")
