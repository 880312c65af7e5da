"""Word alignment of text pairs: one pass gives distance, counts and diff.

The kernel runs inside Arrow batches, one pair per row, so the work is spread
like the pairs are. It keeps bit vectors per hypothesis word (Myers 1999 /
Hyyrö 2003) and walks back through them. Where all vectors would take too much
memory only every so many-th column is kept and the columns between are swept again
on the way back, so the walk, and with it every tie, is the same at any length.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbascope.functions.similarity import WORD_BITS, _masks, edit_distance, low_bits, word_distance

# Bits kept for one traceback before columns are left out (32 MiB).
TRACE_BITS = 1 << 28

EQUAL, SUBSTITUTE, DELETE, INSERT = "equal", "substitute", "delete", "insert"

# Steps expanded at once, but for one pair of more.
FLUSH_ROWS = 100_000

# One letter per step keeps the edit script of a pair in one small string.
STEP_NAMES = {"e": EQUAL, "s": SUBSTITUTE, "d": DELETE, "i": INSERT}
STEP_FIELDS = ["pos", "type", "ref_pos", "hyp_pos", "ref_word", "hyp_word", "grp"]
STEP_DDL = "pos int, type string, ref_pos int, hyp_pos int, ref_word string, hyp_word string, grp bigint"


def _columns(table: dict, full: int, hyp: list, up: int, down: int) -> Iterator[tuple[int, int]]:
    """Bit-parallel distance columns: the vertical steps up and down after each word."""
    for item in hyp:
        match = table.get(item, 0)
        diag = ((((match & up) + up) ^ up) | match | down) & full
        right_up = down | (full & ~(diag | up))
        right_down = up & diag
        right_up = ((right_up << 1) | 1) & full
        right_down = (right_down << 1) & full
        up = (right_down | (full & ~(diag | right_up))) & full
        down = right_up & diag
        yield up, down


def edit_script(ref: list, hyp: list) -> str:
    """Steps of an optimal alignment as letters e/s/d/i, left to right.

    Ties are broken while walking back from the end: delete first, then insert,
    then match or substitute.
    """
    head = 0
    limit = min(len(ref), len(hyp))
    while head < limit and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < limit - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    core_r = ref[head : len(ref) - tail]
    core_h = hyp[head : len(hyp) - tail]
    return "e" * head + _core_script(core_r, core_h) + "e" * tail


def _core_script(ref: list, hyp: list) -> str:
    if not ref:
        return "i" * len(hyp)
    if not hyp:
        return "d" * len(ref)
    table, full = _masks(ref), (1 << len(ref)) - 1
    stride = len(hyp) if 2 * len(ref) * len(hyp) <= TRACE_BITS else math.isqrt(len(hyp))
    # The columns before each block of ``stride``; a block is swept again when the walk enters it.
    before = [(full, 0)]
    for k, state in enumerate(_columns(table, full, hyp, full, 0), 1):
        if k % stride == 0 and k < len(hyp):
            before.append(state)
    i, j = len(ref), len(hyp)
    steps = []
    for block in range(len(before) - 1, -1, -1):
        first = block * stride
        held = [before[block], *_columns(table, full, hyp[first:j], *before[block])]
        while i and j > first:
            bit = i - 1
            if (held[j - first][0] >> bit) & 1:
                i -= 1
                steps.append("d")
            elif j > 1 and (held[j - first - 1][1] >> bit) & 1:
                j -= 1
                steps.append("i")
            else:
                i -= 1
                j -= 1
                steps.append("e" if ref[i] == hyp[j] else "s")
        if not i:
            break
    steps.append("d" * i + "i" * j)
    return "".join(reversed(steps))


# Longer texts (in characters or words) are measured by bit vectors, not by the built-in's table.
LONG = 1024


def distance(ref, hyp) -> int:
    """Exact edit distance of two strings or word lists, one step of bit vectors a word."""
    head, limit = 0, min(len(ref), len(hyp))
    while head < limit and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < limit - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    ref, hyp = ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]
    full = (1 << len(ref)) - 1
    up, down = full, 0
    for up, down in _columns(_masks(ref), full, hyp, up, down):
        pass
    return len(hyp) + up.bit_count() - down.bit_count()


def _measured(a: Column, b: Column, size, near) -> Column:
    """``near`` for short values; of long ones only they reach the bit vectors."""
    far = F.greatest(size(a), size(b)) > LONG

    @F.arrow_udf(T.IntegerType())
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([distance(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in zip(xs, ys)], pa.int32())

    return F.when(far, run(F.when(far, a), F.when(far, b))).otherwise(near(a, b))


def char_distance(a: Column, b: Column) -> Column:
    """Exact character distance of texts of any length."""
    return _measured(a, b, F.length, edit_distance)


# Pairs of word lists whose steps are taken together.
LISTS_AT_ONCE = 8192
# Columns kept at once for walks back, two machine words each (64 MiB).
STEPS_AT_ONCE = 1 << 22


def word_distances(refs: pa.Array, hyps: pa.Array) -> np.ndarray:
    """Exact distances of many pairs of word lists.

    Words become numbers, exactly. Where one side of a pair has at most 64 words its bit vectors are machine
    words, and a step is taken for all pairs of about one length at once; other pairs are measured one by one.
    """
    sides = [refs, hyps]
    size = np.stack([pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) for x in sides]).astype(np.int64)
    flat = pa.concat_arrays([x.flatten().cast(pa.string()) for x in sides]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.cumsum(size, axis=1) - size
    first[1] += size[0].sum()
    # Each pair as (shorter, longer): the distance is the same both ways.
    swap = (size[0] > size[1]).astype(np.int64)
    at = np.arange(len(refs))
    n, m, a, b = size[swap, at], size[1 - swap, at], first[swap, at], first[1 - swap, at]
    out = m.copy()
    one = np.uint64(1)
    todo = np.flatnonzero((n > 0) & (n <= WORD_BITS))
    todo = todo[np.lexsort((n[todo], m[todo]))]
    for k in range(0, len(todo), LISTS_AT_ONCE):
        some = todo[k : k + LISTS_AT_ONCE]
        steps, width = int(m[some].max()), int(n[some].max())
        inside = np.arange(width) < n[some][:, None]
        rows = np.where(inside, flat[np.where(inside, a[some][:, None] + np.arange(width), 0)], -1)
        full = low_bits(n[some])
        top = full ^ (full >> one)
        up, down, dist = full.copy(), np.zeros_like(full), n[some].copy()
        for j in range(steps):
            # In order of length: the pairs that still have a word are the last ones.
            live = int(np.searchsorted(m[some], j, side="right"))
            word = flat[b[some[live:]] + j]
            packed = np.packbits(rows[live:] == word[:, None], axis=1, bitorder="little")
            match = np.zeros((len(word), 8), dtype=np.uint8)
            match[:, : packed.shape[1]] = packed
            match = match.view(np.uint64).ravel()
            u, d, f, t = up[live:], down[live:], full[live:], top[live:]
            diag = ((((match & u) + u) ^ u) | match | d)
            right_up, right_down = d | ~(diag | u), u & diag
            dist[live:] += (right_up & t) != 0
            dist[live:] -= (right_down & t) != 0
            right_up, right_down = (right_up << one) | one, right_down << one
            up[live:], down[live:] = (right_down | ~(diag | right_up)) & f, right_up & diag & f
        out[some] = dist
    for k in np.flatnonzero(n > WORD_BITS):
        out[k] = distance(flat[a[k] : a[k] + n[k]].tolist(), flat[b[k] : b[k] + m[k]].tolist())
    return out


def edit_scripts(refs: pa.Array, hyps: pa.Array) -> list[str]:
    """``edit_script`` of many pairs of word lists, with the same ties.

    What is left of a pair without its equal ends is swept and walked back together with the pairs
    of about its length, where the reference has at most 64 such words; other pairs go one by one.
    """
    sides = [refs, hyps]
    size = [pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in sides]
    flat = pa.concat_arrays([x.flatten().cast(pa.string()) for x in sides]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    a, b = np.cumsum(size[0]) - size[0], np.cumsum(size[1]) - size[1] + size[0].sum()
    head, tail, least = np.zeros(len(refs), dtype=np.int64), np.zeros(len(refs), dtype=np.int64), np.minimum(*size)
    for ends, first, second, step in ((head, a, b, 1), (tail, a + size[0] - 1, b + size[1] - 1, -1)):
        live = np.flatnonzero(least - head > 0)
        while len(live):
            k = ends[live] * step
            live = live[flat[first[live] + k] == flat[second[live] + k]]
            ends[live] += 1
            live = live[head[live] + tail[live] < least[live]]
    n, m, a, b = size[0] - head - tail, size[1] - head - tail, a + head, b + head
    core = [""] * len(refs)
    for k in np.flatnonzero((n == 0) | (m == 0)).tolist():
        core[k] = "i" * int(m[k]) + "d" * int(n[k])
    for k in np.flatnonzero((n > WORD_BITS) & (m > 0)).tolist():
        core[k] = _core_script(flat[a[k] : a[k] + n[k]].tolist(), flat[b[k] : b[k] + m[k]].tolist())
    todo = np.flatnonzero((n > 0) & (n <= WORD_BITS) & (m > 0))
    todo = todo[np.argsort(m[todo], kind="stable")]
    at = 0
    while at < len(todo):
        # The longest pair of a stretch sets the columns that are kept for each of its pairs.
        count = LISTS_AT_ONCE
        while count > 1 and count * int(m[todo[min(at + count, len(todo)) - 1]]) > STEPS_AT_ONCE:
            count //= 2
        some = todo[at : at + count]
        for k, script in zip(some.tolist(), _core_scripts(flat, a[some], n[some], b[some], m[some])):
            core[k] = script
        at += count
    return ["e" * x + y + "e" * z for x, y, z in zip(head.tolist(), core, tail.tolist())]


def _core_scripts(flat: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> Iterator[str]:
    """``_core_script`` of pairs in order of their heard length; neither side is empty."""
    one, zero, width, steps = np.uint64(1), np.uint64(0), int(n.max()), int(m.max())
    rows = np.where(np.arange(width) < n[:, None], flat[np.where(np.arange(width) < n[:, None], a[:, None] + np.arange(width), 0)], -1)
    full = low_bits(n)
    ups, downs = np.zeros((steps + 1, len(n)), dtype=np.uint64), np.zeros((steps + 1, len(n)), dtype=np.uint64)
    ups[0] = full
    for j in range(steps):
        live = int(np.searchsorted(m, j, side="right"))
        packed = np.packbits(rows[live:] == flat[b[live:] + j][:, None], axis=1, bitorder="little")
        match = np.zeros((len(n) - live, 8), dtype=np.uint8)
        match[:, : packed.shape[1]] = packed
        match = match.view(np.uint64).ravel()
        u, d, f = ups[j, live:], downs[j, live:], full[live:]
        diag = ((((match & u) + u) ^ u) | match | d) & f
        right_up, right_down = d | (f & ~(diag | u)), u & diag
        right_up, right_down = ((right_up << one) | one) & f, (right_down << one) & f
        ups[j + 1, live:], downs[j + 1, live:] = (right_down | ~(diag | right_up)) & f, right_up & diag
    letters = np.zeros((len(n), width + steps), dtype=np.uint8)
    at, i, j, place = np.arange(len(n)), n.copy(), m.copy(), width + steps
    while len(at):
        place -= 1
        bit = np.maximum(i - 1, 0).astype(np.uint64)
        gone = (j == 0) | ((i > 0) & ((ups[j, at] >> bit) & one != zero))
        more = ~gone & ((i == 0) | ((downs[np.maximum(j - 1, 0), at] >> bit) & one != zero))
        same = rows[at, np.maximum(i - 1, 0)] == flat[b[at] + np.maximum(j - 1, 0)]
        letters[at, place] = np.where(gone, ord("d"), np.where(more, ord("i"), np.where(same, ord("e"), ord("s"))))
        i, j = i - ~more, j - ~gone
        left = (i > 0) | (j > 0)
        at, i, j = at[left], i[left], j[left]
    for line in letters:
        yield line.tobytes().lstrip(b"\0").decode()


def words_distance(a: Column, b: Column) -> Column:
    """Exact word distance of word lists of any length, many pairs at once; NULL where a list is."""

    @F.arrow_udf(T.IntegerType())
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        none = pc.or_(xs.is_null(), ys.is_null()).to_numpy(zero_copy_only=False)
        return pa.array(word_distances(xs, ys), pa.int32(), mask=none)

    return run(a, b)


def blank_joined_distance(a: Column, b: Column, most: Column, long: int = 64) -> Column:
    """Word distance of two texts whose words stand one blank apart: exact up to ``most``,
    some greater number beyond. Texts of ``long`` words and more travel as they are, not as
    lists, to the bit vectors, and only where the words they share leave ``most`` open.
    """
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    n_blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    far = F.greatest(n_blanks(a), n_blanks(b)) >= long

    def one(x: str | None, y: str | None, limit: int | None) -> int | None:
        if x is None or y is None or limit is None:
            return None
        ref, hyp = ([w for w in c.split(" ") if w] for c in (x, y))
        least = max(len(ref), len(hyp)) - (Counter(ref) & Counter(hyp)).total()
        return least if least > limit else distance(ref, hyp)

    @F.arrow_udf(T.IntegerType())
    def run(xs: pa.Array, ys: pa.Array, limits: pa.Array) -> pa.Array:
        return pa.array([one(*v) for v in zip(xs.to_pylist(), ys.to_pylist(), limits.to_pylist())], pa.int32())

    return F.when(far, run(F.when(far, a), F.when(far, b), most.cast("int"))).otherwise(word_distance(split(a), split(b)))


def align(pairs: DataFrame, ref_words: str, hyp_words: str, out: str = "script") -> DataFrame:
    """Add the edit script of two word-array columns to each pair."""

    @F.arrow_udf(T.StringType())
    def run(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        return pa.array(edit_scripts(refs, hyps), pa.string())

    return pairs.withColumn(out, run(F.col(ref_words), F.col(hyp_words)))


_COUNTS = "struct<substitutions:bigint,deletions:bigint,insertions:bigint,target_total:bigint>"


def target_counts(ref_words: Column, hyp_words: Column, targets: Column) -> Column:
    """How many target words the alignment of a pair substitutes, deletes and inserts, and how many the reference has.

    A pair without targets is not aligned, as it can have none of them.
    """

    def one(ref: list[str], hyp: list[str], wanted: set[str], script: str) -> tuple[int, ...]:
        counts, i, j = Counter(), 0, 0
        for step in script:
            if (hyp[j] if step == "i" else ref[i]) in wanted:
                counts[step] += 1
            i, j = i + (step != "i"), j + (step != "d")
        return counts["s"], counts["d"], counts["i"], counts["e"] + counts["s"] + counts["d"]

    @F.arrow_udf(_COUNTS)
    def run(refs: pa.Array, hyps: pa.Array, wanted: pa.Array) -> pa.Array:
        asked = pc.greater(pc.list_value_length(wanted), 0).fill_null(False)
        some = [x.filter(asked) for x in (refs, hyps, wanted)]
        met = (one(r or [], h or [], set(w), x) for r, h, w, x in zip(*(x.to_pylist() for x in some), edit_scripts(*some[:2])))
        rows = [next(met) if x else (0, 0, 0, 0) for x in asked.to_pylist()]
        names = ["substitutions", "deletions", "insertions", "target_total"]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)

    return run(ref_words, hyp_words, targets)


_PICKED = pa.struct([("pos", pa.int32()), ("hyp_word", pa.string()), ("ref_word", pa.string()), ("is_negative", pa.bool_())])


def picked_steps(ref_words: Column, hyp_words: Column, place: Column, rate: float, salt: str) -> Column:
    """Array of (pos, hyp_word, ref_word, is_negative): the substituted words of a pair's alignment, and of the
    equal words of three or more characters those that ``unit_hash`` of ``place`` and the heard place puts below ``rate``.
    """

    def one(ref: list[str], hyp: list[str], own: str, script: str) -> list[tuple]:
        out, i, j = [], 0, 0
        for pos, step in enumerate(script):
            if step == "s":
                out.append((pos, hyp[j], ref[i], False))
            elif step == "e" and len(hyp[j]) >= 3 and int(hashlib.md5(f"{salt}:{own}{j}".encode()).hexdigest()[:8], 16) / 4294967296.0 < rate:
                out.append((pos, hyp[j], ref[i], True))
            i, j = i + (step != "i"), j + (step != "d")
        return out

    @F.arrow_udf("array<struct<pos:int,hyp_word:string,ref_word:string,is_negative:boolean>>")
    def run(refs: pa.Array, hyps: pa.Array, places: pa.Array) -> pa.Array:
        rows = [one(r or [], h or [], p, x) for r, h, p, x in zip(refs.to_pylist(), hyps.to_pylist(), places.to_pylist(), edit_scripts(refs, hyps))]
        flat = [x for row in rows for x in row]
        columns = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(_PICKED)]
        ends = np.cumsum([0] + [len(row) for row in rows])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [f.name for f in _PICKED]))

    return run(ref_words, hyp_words, place)


def script_count(script: str, letter: str):
    """How many steps of one kind a script has."""
    s = F.col(script)
    return (F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))).cast("int")


def _steps(refs: pa.Array, hyps: pa.Array, scripts: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The steps of many pairs, one after the other, and the row each belongs to."""
    scripts = scripts.fill_null("")
    sizes = pc.binary_length(scripts).to_numpy(zero_copy_only=False)
    code = np.frombuffer("".join(scripts.to_pylist()).encode(), np.uint8)
    row, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    is_edit, has_ref, has_hyp = code != ord("e"), code != ord("i"), code != ord("d")
    whole = lambda flag: np.r_[0, np.cumsum(flag)]
    edits, used_ref, used_hyp = whole(is_edit), whole(has_ref), whole(has_hyp)
    own = lambda c: c[:-1] - c[start][row]
    kind = np.zeros(256, np.int8)
    kind[[ord(c) for c in STEP_NAMES]] = range(len(STEP_NAMES))
    word = lambda words, used, has: words.flatten().take(pa.array(used[:-1], mask=~has)).fill_null("")
    columns = [
        pa.array(np.arange(len(code)) - start[row], pa.int32()), pa.array(list(STEP_NAMES.values())).take(pa.array(kind[code])),
        pa.array(np.where(has_ref, own(used_ref), -1), pa.int32()), pa.array(np.where(has_hyp, own(used_hyp), -1), pa.int32()),
        word(refs, used_ref, has_ref), word(hyps, used_hyp, has_hyp), pa.array(own(edits), pa.int64(), mask=~is_edit),
    ]
    return row, pa.StructArray.from_arrays(columns, STEP_FIELDS)


def diff_rows(aligned: DataFrame, keys: list[str], ref_words: str, hyp_words: str, script: str = "script") -> DataFrame:
    """One row per alignment step: ``keys, pos, type, ref_pos, hyp_pos, ref_word, hyp_word, grp``.

    ``grp`` numbers the edits of a pair (NULL on equal words). The scripts are expanded a
    stretch of pairs at a time, so a batch of pairs never becomes one huge frame.
    """
    key_fields = [f for f in aligned.schema.fields if f.name in keys]
    names = [f.name for f in key_fields]
    src = aligned.select(*names, ref_words, hyp_words, script)
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in key_fields)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(script).fill_null("")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + FLUSH_ROWS, side="right")))
                part = batch.slice(at, to - at)
                row, steps = _steps(part.column(ref_words), part.column(hyp_words), part.column(script))
                own = [part.column(k).take(pa.array(row)) for k in names]
                yield pa.RecordBatch.from_arrays([*own, *steps.flatten()], names=[*names, *STEP_FIELDS])
                at = to

    return src.mapInArrow(expand, schema=ddl + STEP_DDL)


def diff_list(ref_words: str, hyp_words: str, script: str = "script") -> Column:
    """The steps of a pair as one array, in order: the rows of ``diff_rows`` where a row holds a pair."""

    @F.arrow_udf(f"array<struct<{STEP_DDL.replace(' ', ':').replace(',:', ',')}>>")
    def run(refs: pa.Array, hyps: pa.Array, scripts: pa.Array) -> pa.Array:
        row, steps = _steps(refs, hyps, scripts)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(scripts) + 1)), pa.int32()), steps)

    return run(F.col(ref_words), F.col(hyp_words), F.col(script))
