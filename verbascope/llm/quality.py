"""A quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, each tree seeing one feature
(later one pair of features) in bins; all trees of a feature add up to one lookup
table. A text's score is the sum of its bins' table entries, squashed to 0..1.
"""

from __future__ import annotations

import itertools
import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import need

FEATURES = (
    "chars", "words", "chars_per_word", "upper_share", "digit_share", "mark_share", "symbol_share", "bar_share", "bang_share", "wide_share",
    "distinct_words", "repeated_words", "short_words", "top_word", "lines", "chars_per_line", "distinct_lines", "ended_lines", "capital_lines",
)
MAX_ROWS = 20_000
CLASS = np.zeros((256, 6), dtype=np.float64)  # upper, lower, digit, mark, symbol, wide bytes
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?\"'()-", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(0xC0, 0x100)))):
    CLASS[list(_chars), _k] = 1


def text_features(text: str | None) -> list[float]:
    """Numbers about a whole text; an empty one has zeros, its shares too."""
    data = (text or "").encode()
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, lower, digit, mark, symbol, wide = byte @ CLASS
    n = max(1, len(data))
    words = data.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeated = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / m, upper / max(1.0, upper + lower), digit / n, mark / n, symbol / n, byte[124] / n, byte[33] / n, wide / n,
        len(counts) / m, repeated / m, sum(c for w, c in counts.items() if len(w) <= 3) / m, max(counts.values(), default=0) / m,
        np.log1p(len(lines)), np.log1p(len(data) / k), len(set(lines)) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, sum(x.lstrip()[:1].isupper() for x in lines) / k,
    ]


@dataclass
class Additive:
    """Bin edges of the features, a table for each, a table for each pair of coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, table in self.pairs:
            total += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 5.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 5.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of bins in two, (0, 0) if none helps."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(a, b) + _gain(g.sum() - a, h.sum() - b) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return (float(gains[k]), k + 1) if gains[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree of at most ``leaves`` leaves, grown where it gains most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, k, i = max((*_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts))
        if not k:
            break
        a, b = parts.pop(i)
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a grid once."""

    def corners(t: np.ndarray) -> list[np.ndarray]:
        c = t.cumsum(0).cumsum(1)
        nw, n, w, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [nw, n - nw, w - nw, all_ - n - w + nw]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corners(g), corners(h)
    gains = sum(_gain(a, b) for a, b in zip(gs, hs))
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    out = np.empty(g.shape)
    leaf = [_leaf(a[i, j], b[i, j]) for a, b in zip(gs, hs)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gains[i, j] - _gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, bins: int = 32, coarse_bins: int = 8, rate: float = 0.1) -> Additive:
    """Boost tables in turn; with no rows or one class only the share of label 1 is learned."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    width = x.shape[1]
    edges = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(width)]
    coarse = [_edges(x[:, f], coarse_bins) if len(x) else np.zeros(0) for f in range(width)]
    model = Additive(edges, coarse, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            m = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], g, m), np.bincount(at[f], h, m), leaves=3)
            model.tables[f] += step
            total += step[at[f]]
    low = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]

    def grid(f: int, g_: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[f]) + 1, len(coarse[g_]) + 1
        return np.bincount(low[f] * b + low[g_], v, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in itertools.combinations(range(width), 2)), reverse=True)
    tables = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (a, b), table in tables.items():
            g, h = slopes()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            total += step[low[a], low[b]]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def _features(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def is_held_out(id_col: Column) -> Column:
    """A third of the ids, by checksum; a NULL id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """Fit on labelled rows that are not held out, of ``max_rows`` ids and rows at most (those of the smallest hash of id).

    Several labels of an id count as their majority, an even vote and NULL as none.
    """
    vote = need(labels, id_col, label_col).where(~is_held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("vote"))
    vote = vote.where("vote <> 0.5").select("id", (F.col("vote") > 0.5).cast("double").alias("label"))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_features(texts)))

    # The labels are cut to the sample first, so that only its texts are read closely.
    sample = vote.where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(max_rows).select(F.col("id").alias("_k"), "label")
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = rows.join(F.broadcast(sample), F.col("id") == F.col("_k"))
    drawn = known.select(F.xxhash64("id").alias("h"), "id", features("text").alias("x"), "label").orderBy("h", "id").limit(max_rows).collect()
    x = np.array([r.x for r in drawn], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in drawn], dtype=np.float64))


def score_text(model: Additive, text: Column) -> Column:
    """0..1, higher where label 1 is likelier; NULL counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_features(texts)))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, learned from ``labels``.

    Only the text enters a score, so repeated rows score alike. NULL ids and texts
    are scored too; an empty table gives an empty one.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(f"`{id_col}`"), is_held_out(F.col(f"`{id_col}`")).alias("held_out"), score_text(model, F.col(f"`{text_col}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
