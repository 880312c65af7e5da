"""Documents whose sets of word five-grams are alike: a Jaccard join by MinHash bands.

1. Every document gets a fingerprint of its set, and band hashes of its MinHash values.
   Documents of one set are one text from here on; copies are never paired.
2. Texts meet in buckets of equal band hash. A bucket is cut into tiles of bounded size,
   so that no task holds a bucket however large it is, and a pair of texts is looked at
   only in the first band they share.
3. The full sets of the texts that still have such a partner go to their tiles, and
   every pair is verified by its exact similarity. A tile returns a row for each text
   with the number of its links and one edge towards the smallest text it hangs with:
   never the pairs themselves.
4. Edges give the classes by label propagation with pointer jumping.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.common import M1, M2, kept, mix64, need, text_runs, word_hashes
from verbascope.session import materialise

WORDS = 5
SIMILAR = 0.8
RECALL = 1 - 1e-6
ROWS = 4
TILE_TEXTS = 256
RUN_CHARS = 250_000
BATCH_BYTES = 8_000_000


def band_count(similar: float = SIMILAR, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of ``rows`` values needed to find a pair of the given similarity with the given chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


@kept
def word_bytes() -> bytes:
    """ASCII letters and digits and all bytes of other characters are words; the rest parts them."""
    return bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), sorted, each pair once.

    Words are lower-case runs of letters and digits. A text with fewer than ``words``
    words has one shingle of all of them, one without words has none.
    """
    text, word = word_hashes([t.lower().encode("utf-8", "surrogatepass").translate(word_bytes()) for t in texts])
    n = len(word) - words + 1
    out_text, out = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if n > 0:
        h = word[:n].copy()
        for k in range(1, words):
            h = h * M1 + word[k : n + k]
        same = text[:n] == text[words - 1 :]
        out_text, out = text[:n][same], mix64(h[same])
    count = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), dtype=np.int64)
    for t in np.flatnonzero((count > 0) & (count < words)):
        h = np.uint64(0)
        for w in word[text == t]:
            h = np.uint64((int(h) * int(M1) + int(w)) & (2**64 - 1))
        out_text, out = np.r_[out_text, t], np.r_[out, mix64(np.array([h]) + np.uint64(count[t]))]
    order = np.lexsort((out, out_text))
    out_text, out = out_text[order], out[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (out_text[1:] != out_text[:-1])
    return out_text[keep], out[keep]


@kept
def minhash_factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * M1) | np.uint64(1)


def signatures(texts: list[str], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts with words, first place of each in shingles, shingles, 16-byte fingerprints, band hashes, sizes)."""
    text, h = shingles(texts)
    who, at, n = np.unique(text, return_index=True, return_counts=True)
    if not len(who):
        return who, at, h, np.zeros((0, 2), dtype=np.uint64), np.zeros((0, bands), dtype=np.uint64), n
    one = np.add.reduceat(mix64(h + M1), at)
    two = np.add.reduceat(mix64(h ^ M2), at)
    prints = np.stack([mix64(one + n.astype(np.uint64)), mix64(two ^ n.astype(np.uint64))], axis=1)
    found = np.empty((len(who), bands), dtype=np.uint64)
    factors = minhash_factors(bands * rows)
    for b in range(bands):
        mixed = np.full(len(who), b + 1, dtype=np.uint64) * M2
        for r in range(rows):
            mixed = mix64(mixed * M1 + np.minimum.reduceat(h * factors[b * rows + r], at))
        found[:, b] = mixed
    return who, at, h, prints, found, n


def sign(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, set, bands): fingerprint and band hashes of every row; both NULL without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints: list[bytes | None] = [None] * len(texts)
            held: list[np.ndarray | None] = [None] * len(texts)
            for start, some in text_runs(texts, RUN_CHARS):
                who, _, _, p, b, _ = signatures(some, bands, rows)
                for k, t in enumerate(who.tolist()):
                    prints[start + t], held[start + t] = p[k].tobytes(), b[k].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(held, pa.list_(pa.int64()))], ["id", "set", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, set binary, bands array<long>")


def tiled(members: DataFrame, tile_texts: int) -> DataFrame:
    """Rows of a bucket (h, set, n, ...) dealt to its tiles (tile, h, side): every two blocks
    of a bucket meet in one tile, side 0 and 1, and every block meets itself, side 2."""
    blocks = F.ceil(F.col("n") / tile_texts).cast("int")
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte"))
    tile = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumn("tile", tile).drop("blocks", "own", "other", "n")


def groups(batches: Iterable[pa.RecordBatch], column: str = "tile") -> Iterator[pa.Table]:
    """Rows of equal ``column`` out of a sorted stream, group by group."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        key = rows.column(column).to_numpy()
        cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            part = rows.slice(a, b - a)
            if held and held[0].column(column)[0].as_py() != key[a]:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def first_shared(bands: np.ndarray, band_hash: int, side: np.ndarray) -> np.ndarray:
    """Upper-triangle matrix of the pairs of a tile whose first common band is this one."""
    here = int(np.flatnonzero(bands[0] == band_hash)[0])
    ours = np.triu(np.ones((len(bands), len(bands)), dtype=bool), 1)
    ours &= (side[:, None] == 2) & (side[None, :] == 2) | (side[:, None] != side[None, :])
    for j in range(here):
        ours &= bands[:, j, None] != bands[None, :, j]
    return ours


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets."""
    if len(sets) == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = times[number] > 1
    _, column = np.unique(number[often], return_inverse=True)
    owner = owner[often]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    wide = int(column.max(initial=-1)) + 1
    for a in range(0, wide, 8192):
        some = (column >= a) & (column < a + 8192)
        held = np.zeros((len(sets), min(8192, wide - a)), dtype=np.float32)
        held[owner[some], column[some] - a] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def smallest_reached(linked: np.ndarray) -> np.ndarray:
    """For each text the first one it hangs with, by its links in the tile."""
    near = linked | linked.T | np.eye(len(linked), dtype=bool)
    label = np.arange(len(linked))
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(tile: pa.Table, bands: int, similar: float) -> Iterator[tuple[bytes, bytes, int]]:
    """(set, smallest set it hangs with, linked documents) of a tile's texts that have a link."""
    names = tile.column("set").to_pylist()
    order = [k for _, k in sorted({name: k for k, name in enumerate(names)}.items())]
    marks = dense(tile.column("bands"), bands)[order]
    sets = [np.frombuffer(tile.column("shingles")[k].as_py(), dtype=np.uint64) for k in order]
    copies = tile.column("copies").to_numpy()[order]
    ours = first_shared(marks, tile.column("h")[0].as_py(), tile.column("side").to_numpy()[order])
    both, size = shared_counts(sets), np.array([len(s) for s in sets])
    # |A & B| / |A | B| >= similar, without a division
    linked = ours & (both >= similar * (size[:, None] + size[None, :] - both) - 1e-9)
    pairs = linked | linked.T
    links, head = pairs @ copies, smallest_reached(linked)
    for k in np.flatnonzero(pairs.any(axis=1)):
        yield names[order[k]], names[order[head[k]]], int(links[k])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the (a, b) edges; root is the smallest node reached.

    Labels spread along edges and jump along themselves, so rounds grow with the
    logarithm of the longest path. Each round is a written table.
    """
    both = materialise(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("root")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("_m"))
        spread = label.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "_m").alias("_r"), F.col("root").alias("_old"))
        up = spread.select(F.col("node").alias("_n"), F.col("_r").alias("_up"))
        new = materialise(spread.join(up, F.col("_r") == F.col("_n"), "left").select("node", F.coalesce("_up", "_r").alias("root"), "_old"), "labels")
        if new.where("root <> _old").isEmpty():
            return label
        label = new.drop("_old")


def near_copies(docs: DataFrame, similar: float = SIMILAR, rows: int = ROWS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", tile_texts: int = TILE_TEXTS) -> DataFrame:
    """(id, class_id, n_links) of every row.

    Two documents are linked if the Jaccard similarity of their sets of five-word
    shingles is ``similar`` or more; ``n_links`` counts the other documents a document
    is linked with, copies included. A class is what links connect, named by its
    smallest id. Words are lower-case runs of letters and digits; a text of fewer than
    five words is one shingle; one without any (NULL, empty) is linked to nothing and
    has its own id as class. Repeated rows are copies of each other, NULL ids too. A
    link of exactly the limit is missed with chance 1 - ``recall``; no other is lost.
    """
    spark = docs.sparkSession
    bands = band_count(similar, rows, recall)
    plain = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    signed = materialise(sign(plain, bands, rows), "signatures")
    worded = signed.where("set IS NOT NULL")
    texts = materialise(worded.groupBy("set").agg(F.min("id").alias("head"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "texts")

    at = texts.select("set", F.explode("bands").alias("h"))
    full = at.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = at.join(full, "h").join(texts.select("set", "bands"), "set")

    def partners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tiles, hashes, sides = [], [], [], []
        for g in groups(batches):
            side, h = g.column("side").to_numpy(), g.column("h")[0].as_py()
            ours = first_shared(dense(g.column("bands"), bands), h, side)
            keep = np.flatnonzero(ours.any(axis=0) | ours.any(axis=1))
            name = g.column("set")
            names += [name[int(k)].as_py() for k in keep]
            sides += side[keep].tolist()
            tiles += [g.column("tile")[0].as_py()] * len(keep)
            hashes += [h] * len(keep)
            if len(names) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(tiles, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sides, pa.int8())], ["set", "tile", "h", "side"])
                names, tiles, hashes, sides = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(tiles, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sides, pa.int8())], ["set", "tile", "h", "side"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiled(members, tile_texts).select("tile", "h", "side", "set", "bands").repartition(n_parts, "tile").sortWithinPartitions("tile")
    wanted = dealt.mapInArrow(partners, "set binary, tile long, h long, side byte")
    wanted = wanted.groupBy("set").agg(F.collect_list(F.struct("tile", "h", "side")).alias("tiles")).join(texts.select("set", "head", "copies"), "set")

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the wanted texts, a row for each of their tiles."""
        kinds = {"tile": pa.int64(), "h": pa.int64(), "side": pa.int8(), "set": pa.binary(), "copies": pa.int64(), "bands": pa.list_(pa.int64()), "shingles": pa.binary()}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

        out, size = [], 0
        for batch in batches:
            wants = batch.column("wants").to_pylist()
            for start, some in text_runs([t or "" for t in batch.column("text").to_pylist()], RUN_CHARS):
                who, first, h, p, b, n = signatures(some, bands, rows)
                for k, t in enumerate(who.tolist()):
                    want, name = wants[start + t], p[k].tobytes()
                    if want["set"] != name:
                        continue
                    data, marks = h[first[k] : first[k] + n[k]].tobytes(), b[k].view(np.int64)
                    for x in want["tiles"]:
                        out.append((x["tile"], x["h"], x["side"], name, want["copies"], marks, data))
                        size += len(data)
                        if size > BATCH_BYTES:  # a text of a large bucket goes to many tiles
                            yield flush()
                            out, size = [], 0
        if out:
            yield flush()

    heads = wanted.select(F.col("head"), F.struct("set", "copies", "tiles").alias("wants"))
    held = plain.join(heads, F.col("id").eqNullSafe(F.col("head"))).select("text", "wants").mapInArrow(load, "tile long, h long, side byte, set binary, copies long, bands array<long>, shingles binary")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def flush() -> pa.RecordBatch:
            a, b, n = (list(c) for c in zip(*out)) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "links"])

        for g in groups(batches):
            if g.num_rows > 1:
                out += verified(g, bands, similar)
            if len(out) > 20_000:
                yield flush()
                out = []
        yield flush()

    found = materialise(held.repartition(n_parts, "tile").sortWithinPartitions("tile").mapInArrow(verify, "a binary, b binary, links long"), "links")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(spark, found.where("a <> b").select("a", "b"))
    named = texts.select("set", "head", "copies").join(roots, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set"))
    classes = named.groupBy("root").agg(F.min("head").alias("class_id"))
    known = named.join(classes, "root").join(links, F.col("set") == F.col("a"), "left")
    known = materialise(known.select("set", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "text-classes")
    with_words = worded.select("id", "set").join(known, "set").select("id", "class_id", "n_links")
    without = signed.where("set IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionAll(without).select(F.col("id").cast(kind).alias(id_col), "class_id", "n_links")


def one_of_each(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the one of the smallest id, NULL last.

    Of several texts under that id the one of the smallest MD5 stays, of repeated rows
    (same id, same text) the one whose columns have the smallest hash. Rows without
    words are copies of nothing and all stay.
    """
    spark, doc = docs.sparkSession, F.col(f"`{id_col}`")
    key = F.struct(doc.isNull().alias("last"), doc.alias("id"), F.unhex(F.md5(F.col(f"`{text_col}`"))).alias("text"))
    classes = near_copies(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), similar, id_col="key")
    heads = classes.where("key = class_id").groupBy("key").agg(((F.count("*") > 1) & (F.max("n_links") > 0)).alias("again"))
    heads = materialise(heads, "heads")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    once = rows.join(heads.where("NOT again"), "key", "left_semi").select("row.*")
    if heads.where("again").isEmpty():
        return once
    # Repeated rows combine before they are shuffled, so none of their groups lands in one task.
    order = F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    first = rows.groupBy("key").agg(F.min_by("row", order).alias("row")).join(heads.where("again"), "key", "left_semi")
    return once.unionAll(first.select("row.*"))
