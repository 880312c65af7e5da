"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RUN = 1 << 20  # bytes hashed at a time
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks.

    Kernels travel by value, so a module global would be empty in every task.
    """
    return vars(sys).setdefault("_verbascope_caches", {}).setdefault(name, {})


def kept(make: Callable) -> Callable:
    """Remember the results of a function of few different arguments in the worker."""

    def look_up(*args):
        found = worker_cache(make.__qualname__)
        if args not in found:
            found[args] = make(*args)
        return found[args]

    return look_up


def pieces(n_rows: int, per_part: int) -> int:
    """Number of parts that keeps each near ``per_part`` rows; it grows with the input."""
    return max(1, math.ceil(n_rows / per_part))


def text_runs(texts: list[str], max_chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts of about ``max_chars`` together, with the first index.

    A longer text is a run of its own; no text is cut.
    """
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def word_count(text: str | Column) -> Column:
    """Number of maximal runs of other than ASCII white space; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Just the columns an operator reads: columns of other names cannot clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@kept
def run_powers() -> tuple[np.ndarray, np.ndarray]:
    """The tables of a run, of one size, so that a worker holds them once: 16 bytes a byte of a run."""
    return powers(HASH_RUN)


@kept
def byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * M1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order; words are parted by the byte 32 alone.

    A running sum over the bytes of a run gives every word's polynomial hash by two
    look-ups. A word's hash depends on its own bytes alone, so runs may begin at any
    word; only a word longer than a run needs tables of its own length, which are let go.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, raw != 32, False].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    out = np.zeros(len(first), dtype=np.uint64)
    k = 0
    while k < len(first):
        to = max(k + 1, int(np.searchsorted(last, first[k] + HASH_RUN, side="right")))
        some = raw[first[k] : last[to - 1]]
        up, down = run_powers() if len(some) <= HASH_RUN else powers(len(some))
        total = np.r_[np.uint64(0), np.cumsum(byte_values()[some] * down[: len(some)], dtype=np.uint64)]
        a, b = first[k:to] - first[k], last[k:to] - first[k]
        out[k:to] = mix64((total[b] - total[a]) * up[a])
        k = to
    return text, out
