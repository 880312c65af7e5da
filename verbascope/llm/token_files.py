"""Token ids of whole texts in chunk files of compressed byte planes.

Documents are dealt by ranges of their id, so shard k holds smaller ids than shard
k + 1 and the id stream of all shards, read in order, is the stream of all documents
in ascending id order. Inside a part of a shard the ids are cut into chunks of a fixed number.
A chunk's 32-bit ids are transposed into four byte planes, each compressed with
zstandard: the high planes of a small vocabulary shrink to a few bytes.

A file set is one Parquet folder, so that Spark's commit protocol covers lost
executors and any file system Spark can write to:

``kind=chunk``  shard, part, seq (chunk number), first (ids of the part before it), n (ids), planes
``kind=index``  shard, part, seq, first, n, plane_bytes (compressed size of each plane)
``kind=doc``    shard, part, seq (position in the part), first, n (ids with the end id), id

A shard begins a new part at the first document past ``part_ids`` ids, so whoever
reads holds a part at a time, however long a shard's documents are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.common import need, pieces, worker_cache
from verbascope.llm.token_counts import WIDTH, PieceMerger
from verbascope.operators.ordered import running

CHUNK_IDS = 65_536
CACHE_ENTRIES = 250_000
RUN_BYTES = 1_000_000
PART_IDS = 4_000_000
# White space, of one byte and of more.
BLANK = np.zeros(256, dtype=bool)
BLANK[[*b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]] = True
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# An optional space or line feed, letters below U+0250, a comma or full stop at most.
PLAIN_WORD = "^[ \n]?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,]?$"
UNIT_EDGE = re.compile(rb"[!-~][ \n]")


def byte_spelling() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteMerger(PieceMerger):
    """Ids of pre-tokens by the merges of a byte-level BPE model, all sequences at once."""

    def __init__(self, model: dict):
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocabulary = model["vocab"]
        rows = {vocabulary[a] * int(WIDTH) + vocabulary[b]: (rank, vocabulary[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self._index(rows)
        spelling = byte_spelling()
        self.of_byte = np.array([vocabulary[spelling[b]] for b in range(256)], dtype=np.int64)

    def ids(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has) of words one after another in ``data``."""
        ends = list(self.merged(self.of_byte[data], np.repeat(np.arange(len(size)), size)))
        if not ends:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(size), dtype=np.int64)
        seq = np.concatenate([s for _, s in ends])
        found = np.concatenate([e for e, _ in ends])[np.argsort(seq, kind="stable")]
        return found.astype(np.uint32), np.bincount(seq, minlength=len(size))


class Ragged:
    """Rows of ids one after another in one array that grows."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        self.n, self.end = 0, 0

    @staticmethod
    def _room(held: np.ndarray, n: int) -> np.ndarray:
        return held if n <= len(held) else np.r_[held, np.zeros(max(n, 2 * len(held)) - len(held), dtype=held.dtype)]

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the new rows."""
        n, end = self.n + len(sizes), self.end + len(flat)
        self.flat, self.start, self.size = self._room(self.flat, end), self._room(self.start, n), self._room(self.size, n)
        self.flat[self.end : end], self.size[self.n : n] = flat, sizes
        self.start[self.n : n] = self.end + np.cumsum(sizes) - sizes
        out = np.arange(self.n, n)
        self.n, self.end = n, end
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        shift = self.start[rows] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())], size


class CachedEncoder:
    """Ids of whole texts by a byte-level tokenizer.

    The library splits a text before it merges, and never across the step from a
    visible character to a space or a line feed. Texts are cut there; the distinct
    units of a run are told apart by Arrow, looked up, and their ids gathered. A unit
    that is one word of plain letters goes to the array merger, any other one to the
    library, once a worker.
    """

    def __init__(self, tokenizer_file: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            self.merger = ByteMerger(json.load(f)["model"])
        self.single = np.array([self.tokenizer.encode(chr(c), add_special_tokens=False).ids[0] if c < 128 else 0 for c in range(256)], dtype=np.uint32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = Ragged()

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Row numbers of units that are not known yet.

        The tokenizer's pattern makes letters with the space before them one pre-token, and
        a line feed before them or a comma or full stop behind them another.
        """
        plain = pc.match_substring_regex(fresh.cast(pa.large_string()), PLAIN_WORD)
        words, found = fresh.filter(plain), np.zeros(len(fresh), dtype=np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        if len(words):
            data, bounds = binary_parts(words)
            head, tail = data[bounds[:-1]] == 10, data[bounds[1:] - 1]
            mark = (tail == ord(".")) | (tail == ord(","))
            letter = np.ones(len(data), dtype=bool)
            letter[bounds[:-1][head]] = letter[bounds[1:][mark] - 1] = False
            inner = np.r_[0, np.cumsum(np.diff(bounds) - head - mark)]
            bare = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(inner), pa.py_buffer(data[letter])]).dictionary_encode()
            letters, ends = binary_parts(bare.dictionary)
            merged = Ragged()
            flat, size = merged.take(merged.add(*self.merger.ids(letters, np.diff(ends)))[bare.indices.to_numpy()])
            whole = size + head + mark
            end = np.cumsum(whole)
            begin, out = end - whole, np.zeros(int(end[-1]), dtype=np.uint32)
            out[begin[head]] = self.single[10]
            out[end[mark] - 1] = self.single[tail[mark]]
            out[np.repeat(begin + head - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
            found[is_plain] = self.rows.add(out, whole)
        if len(words) < len(fresh):
            rest = fresh.filter(pc.invert(plain)).to_pylist()
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in rest], add_special_tokens=False)]
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32)
            found[~is_plain] = self.rows.add(flat, np.array([len(x) for x in ids]))
        return found

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of the texts between the bounds, in UTF-8."""
        raw, at = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        gap = np.flatnonzero((raw == 32) | (raw == 10))
        gap = gap[gap > 0]
        gap = gap[~BLANK[raw[gap - 1]]]
        held = raw.tobytes()
        if any(x in held for x in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")):
            gap = np.setdiff1d(gap, [m.end() for m in WIDE_SPACE.finditer(held)], assume_unique=True)
        starts = np.zeros(len(raw), dtype=bool)
        starts[gap] = starts[at[:-1][np.diff(at) > 0]] = True
        cut = np.flatnonzero(starts)
        if not len(cut):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(at) - 1, dtype=np.int64)
        ends = np.r_[cut, len(raw)].astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(held)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > CACHE_ENTRIES:
            self.clear()
        row = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), dtype=np.int64, count=len(distinct))
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            row[fresh] = self._learn(units.dictionary.take(pa.array(fresh)))
            self.known.update(zip(map(distinct.__getitem__, fresh.tolist()), row[fresh].tolist()))
        ids, size = self.rows.take(row[units.indices.to_numpy()])
        total = np.r_[0, np.cumsum(size)]
        return ids, np.diff(total[np.searchsorted(cut, at)])


def pieces_of(data: np.ndarray, bounds: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, text number) of texts cut to about ``run`` bytes where units part; a text is never cut inside a unit."""
    if len(bounds) < 2 or np.diff(bounds).max() <= run:
        return bounds, np.arange(len(bounds) - 1)
    held, cuts, owner = data.tobytes(), [int(bounds[0])], []
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        while b - a > run and (found := UNIT_EDGE.search(held, a + run, b)):
            a = found.end() - 1
            cuts.append(a)
            owner.append(k)
        cuts.append(b)
        owner.append(k)
    return np.array(cuts, dtype=np.int64), np.array(owner, dtype=np.int64)


def binary_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of an array of large_binary without NULLs; the bytes begin at the first bound."""
    _, ends, data = values.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of texts, without a copy; NULL is empty."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), bounds


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Four compressed byte planes, the lowest byte first."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(p.tobytes()) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def from_planes(planes: list[bytes]) -> np.ndarray:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return np.ascontiguousarray(np.stack([np.frombuffer(press.decompress(p), dtype=np.uint8) for p in planes], axis=1)).view("<u4").ravel()


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", docs_per_shard: int = 4096, chunk_ids: int = CHUNK_IDS, part_ids: int = PART_IDS) -> None:
    """Encode every whole text, add ``end_id`` to each, and write the file set to ``path``.

    NULL and empty texts hold the end id alone. NULL ids come first, rows of equal id
    lie in the order of their texts' hashes; rows that repeat are dealt to as many
    shards as they fill. An empty table writes an empty set. Strings of the tokenizer's
    special tokens are read as the library reads them.
    """
    n_shards = pieces(docs.count(), docs_per_shard)
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["id"].dataType.simpleString()

    def batch_of(name: str, shard: int, part: int, out: list[tuple], id_type) -> pa.RecordBatch:
        seq, first, n, ids, planes = zip(*out)
        size = [None if p is None or name == "chunk" else [len(x) for x in p] for p in planes]
        held = [p if name == "chunk" else None for p in planes]
        m = len(out)
        arrays = [pa.array([name] * m), pa.array([shard] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.array(seq, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, id_type), pa.array(held, pa.list_(pa.binary())), pa.array(size, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "shard", "part", "seq", "first", "n", "id", "planes", "plane_bytes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = worker_cache("token_files")
        if tokenizer_file not in kept:
            kept[tokenizer_file] = CachedEncoder(tokenizer_file)
        encoder, shard = kept[tokenizer_file], TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        held: list[np.ndarray] = []
        part, n_held, n_ids, n_docs, n_chunks, own, id_type = 0, 0, 0, 0, 0, 0, pa.null()

        def chunks(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, n_chunks
            ids = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
            last = len(ids) if all_of_it else len(ids) // chunk_ids * chunk_ids
            for a in range(0, last, chunk_ids):
                some = ids[a : min(a + chunk_ids, last)]
                row = [(n_chunks, n_chunks * chunk_ids, len(some), None, to_planes(some))]
                yield batch_of("chunk", shard, part, row, id_type)
                yield batch_of("index", shard, part, row, id_type)
                n_chunks += 1
            held, n_held = [ids[last:].copy()], len(ids) - last

        for batch in batches:
            id_type, names = batch.schema.field(0).type, batch.column(0).to_pylist()
            data, bounds = text_bytes(batch.column(1))
            bounds, owner = pieces_of(data, bounds, RUN_BYTES)
            k = 0
            while k < len(owner):
                to = max(k + 1, int(np.searchsorted(bounds, bounds[k] + RUN_BYTES, side="right")) - 1)
                ids, counts = encoder.encode(data, bounds[k : to + 1])
                at, out = np.r_[0, np.cumsum(counts)].tolist(), []
                for j in range(k, to):
                    held.append(ids[at[j - k] : at[j - k + 1]])
                    own += at[j - k + 1] - at[j - k]
                    if j + 1 == len(owner) or owner[j + 1] != owner[j]:
                        held.append(end)
                        out.append((n_docs, n_ids, own + 1, names[owner[j]], None))
                        n_held, n_ids, n_docs, own = n_held + own + 1, n_ids + own + 1, n_docs + 1, 0
                        if n_ids >= part_ids:
                            yield batch_of("doc", shard, part, out, id_type)
                            yield from chunks(True)
                            part, n_ids, n_docs, n_chunks, out = part + 1, 0, 0, 0, []
                if out:
                    yield batch_of("doc", shard, part, out, id_type)
                if n_held + own >= chunk_ids:
                    yield from chunks(False)
                    n_held -= own
                k = to
        if n_ids:
            yield from chunks(True)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it needs

    dealt = rows.repartitionByRange(n_shards, F.col("id").asc(), F.xxhash64("text").asc(), F.col("row").asc()).sortWithinPartitions("id", F.xxhash64("text")).select("id", "text")
    dealt.mapInArrow(run, file_schema(kind)).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def file_schema(id_type: str) -> str:
    return f"kind string, shard int, part int, seq long, first long, n long, id {id_type}, planes array<binary>, plane_bytes array<int>"


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids) of every document, from the files alone.

    ``start`` counts the ids of all documents before it, ``ids`` holds its ids as
    little-endian unsigned 32-bit integers. A task decodes one part of a shard at a time.
    """
    def stored(name: str) -> DataFrame:
        return spark.read.schema(file_schema(id_type)).parquet(path).where(F.col("kind") == name)

    docs, chunks = stored("doc").select("shard", "part", "first", "n", "id"), stored("chunk").select("shard", "part", "first", "planes")
    kind = docs.schema["id"].dataType.simpleString()

    # Where a part begins is put to the small index rows, so that decoded ids are never moved.
    sums = stored("doc").groupBy("shard", "part").agg(F.sum("n").alias("_n"))
    offset = running(sums, [], F.floor(F.col("shard") / 4096), ["shard", "part"], F.col("_n"), "_before")
    offset = offset.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"), F.coalesce("_before", F.lit(0)).alias("_before"))
    mine = (F.col("shard") == F.col("_shard")) & (F.col("part") == F.col("_part"))
    placed = docs.join(offset, mine).select("shard", "part", "first", "n", "id", (F.col("_before") + F.col("first")).alias("start"))

    def decode(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(theirs.column("first").to_numpy())
        planes = theirs.column("planes")
        ids = np.concatenate([from_planes(planes[int(k)].as_py()) for k in order]).tobytes()
        first, n = mine.column("first").to_pylist(), mine.column("n").to_pylist()
        own = pa.array([ids[4 * a : 4 * (a + b)] for a, b in zip(first, n)], pa.binary())
        return pa.table({id_col: mine.column("id"), "start": mine.column("start"), "n_tokens": mine.column("n"), "ids": own})

    return placed.groupBy("shard", "part").cogroup(chunks.groupBy("shard", "part")).applyInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")
