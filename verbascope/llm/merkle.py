"""A Merkle manifest of a table, with a proof for every row, by incremental witnesses.

Nodes are appended in order. An appended node opens a subtree of its own; where a run
of ``fanout`` siblings completes, each of them is given the others as the next step of
its witness, and the run's hash is appended one level up. Witnesses are shared: a step
is kept once for a whole subtree, and whatever lies under it reaches the step through
its parents, so an append touches no leaf that came before.

The table is dealt to aligned blocks of ``fanout ** BLOCK_LEVELS`` consecutive leaves.
A task appends one block and returns its root; block roots are appends of the blocks
above them, and so on until one node is left. The witnesses of the block roots then go
down again, joined by block: a block's leaves continue their own witness with it.
Texts are hashed where they are read and never shuffled; a leaf travels as its digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.llm.common import need, pieces
from verbascope.operators.ordered import running
from verbascope.session import materialise

FANOUT = 8
BLOCK_LEVELS = 4
ROWS_PER_PART = 100_000
Step = tuple[str, str]  # digests of the siblings to the left, and to the right
STEPS = "array<struct<before string, after string>>"


def node_hash(digests: str) -> str:
    return sha256(digests.encode()).hexdigest()


@dataclass
class Node:
    """A subtree: its hash, and its witness as far as siblings have completed it."""

    digest: str
    step: Step | None = None
    parent: Node | None = None

    def witness(self) -> Iterator[Step]:
        node = self
        while node.parent is not None:
            yield node.step
            node = node.parent


@dataclass
class WitnessTree:
    """Append nodes one at a time; only the open run of each level is held."""

    fanout: int = FANOUT
    open: list[list[Node]] = field(default_factory=list)

    def append(self, digest: str, level: int = 0) -> Node:
        node = Node(digest)
        self._put(node, level)
        return node

    def _put(self, node: Node, level: int) -> None:
        while len(self.open) <= level:
            self.open.append([])
        run = self.open[level]
        run.append(node)
        if len(run) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Extend the witnesses of a run by their siblings and append its hash above."""
        run, self.open[level] = self.open[level], []
        digests = [n.digest for n in run]
        above = Node(node_hash("".join(digests)))
        for k, node in enumerate(run):
            node.step, node.parent = ("".join(digests[:k]), "".join(digests[k + 1 :])), above
        self._put(above, level + 1)

    def close(self, levels: int | None = None) -> Node | None:
        """Complete what is open, up to a tree of one node, or to exactly ``levels`` levels."""
        level = 0
        while True:
            top = level + 1 >= len(self.open)
            if levels is None and top and (not self.open or len(self.open[level]) <= 1) or levels == level:
                break
            if level < len(self.open) and self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0] if level < len(self.open) and self.open[level] else None


def fold(leaf: str, witness: list[Step]) -> str:
    """The root that a leaf and its witness lead to."""
    for before, after in witness:
        leaf = node_hash(before + leaf + after)
    return leaf


def sized(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[sized(c) for c in columns]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(leaves: DataFrame, group: list[str], order: list[str], label: str, per_part: int = ROWS_PER_PART) -> DataFrame:
    """Distinct rows with ``start``, the place of the first of their ``n`` copies in the group's order.

    Equal rows travel once, so a row that is repeated without end is no hot key. Ranges
    of the order are numbered, places run inside a range, and a row for each range and
    group carries the count on.
    """
    rows = leaves.groupBy(*leaves.columns).agg(F.count("*").alias("n"))
    rows = materialise(rows, f"{label}-rows")
    sort = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    parts = rows.repartitionByRange(pieces(rows.count(), per_part), *sort).withColumn("part", F.spark_partition_id())
    held = materialise(parts, f"{label}-parts")
    out = running(held, group, F.col("part"), [F.col(c).asc_nulls_first() for c in order], F.col("n"), "start")
    return out.withColumn("start", F.coalesce("start", F.lit(0)).cast("long")).drop("part")


def _dealt(nodes: DataFrame, size: int) -> DataFrame:
    """A row for each block that the copies of a row fall in: ``block``, ``at`` (place in it), ``times``."""
    spans = nodes.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * size)
    return spans.withColumn("at", (lo - F.col("block") * size).cast("int")).withColumn("times", (hi - lo).cast("int"))


def _append_block(tree: WitnessTree, rows: pa.Table) -> tuple[pa.Array, list[Node]]:
    """The rows of a block in the order of its nodes, a row for each node, and the nodes."""
    at, times = rows.column("at").to_numpy(), rows.column("times").to_numpy()
    turn = np.argsort(at, kind="stable")
    turn = pa.array(np.repeat(turn, times[turn]))
    return turn, [tree.append(digest) for digest in rows.column("leaf").take(turn).to_pylist()]


def _levels(total: int, size: int) -> int | None:
    """A block of several is cut off at its full height, a tree of one block where one node is left."""
    return BLOCK_LEVELS if total > size else None


def _closed(rows: pa.Table, fanout: int) -> tuple[pa.Array, list[Node], Node]:
    """A block's rows and nodes with their witnesses inside the block, and its root."""
    tree, total = WitnessTree(fanout), rows.column("total")[0].as_py()
    turn, nodes = _append_block(tree, rows)
    return turn, nodes, tree.close(_levels(total, fanout**BLOCK_LEVELS))


def _steps(rows: pa.Table, name: str) -> list[Step]:
    return [(s["before"], s["after"]) for s in rows.column(name)[0].as_py()]


def _step_array(steps: list[list[Step]]) -> pa.Array:
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    return pa.array([[{"before": b, "after": a} for b, a in some] for some in steps], kind)


def prove(nodes: DataFrame, key: str, label: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (key, start, n, leaf, ...), one for each key.

    Returns the roots (key, root), and the blocks of the nodes with the witness ``above`` them.
    """
    size = fanout**BLOCK_LEVELS
    kind = nodes.schema[key].dataType.simpleString()
    totals = nodes.groupBy(F.col(key).alias("_k")).agg(F.sum("n").cast("long").alias("total"))
    stage = nodes.join(totals, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    stages: list[DataFrame] = []

    def root_of(rows: pa.Table) -> pa.Table:
        root = _closed(rows, fanout)[2]
        above = -(-rows.column("total")[0].as_py() // size)
        return pa.table({key: rows.column(key).slice(0, 1), "start": rows.column("block").slice(0, 1), "n": pa.array([1], pa.int64()), "leaf": [root.digest], "total": pa.array([above], pa.int64())})

    while True:
        stages.append(materialise(_dealt(stage, size), f"{label}-level{len(stages)}"))
        blocks = stages[-1].select(key, "block", "at", "times", "leaf", "total").groupBy(key, "block")
        stage = materialise(blocks.applyInArrow(root_of, f"`{key}` {kind}, start long, n long, leaf string, total long"), f"{label}-roots{len(stages)}")
        if (stage.agg(F.max("total")).first()[0] or 0) <= 1:
            break
    roots = stage.select(key, F.col("leaf").alias("root"))

    def down(rows: pa.Table) -> pa.Table:
        turn, found, _ = _closed(rows, fanout)
        higher = _steps(rows, "above")
        start = rows.column("block")[0].as_py() * size + np.arange(len(found))
        return pa.table({key: rows.column(key).take(turn), "start": pa.array(start, pa.int64()), "above": _step_array([[*n.witness(), *higher] for n in found])})

    def with_above(blocks: DataFrame, above: DataFrame) -> DataFrame:
        above = above.select(F.col(key).alias("_k"), F.col("start").alias("_b"), "above")
        return blocks.join(above, F.col(key).eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b"))).drop("_k", "_b")

    above = stage.select(key, "start", F.array().cast(STEPS).alias("above"))
    for depth in range(len(stages) - 1, 0, -1):
        here = with_above(stages[depth].select(key, "block", "at", "times", "leaf", "total"), above)
        above = materialise(here.groupBy(key, "block").applyInArrow(down, f"`{key}` {kind}, start long, above {STEPS}"), f"{label}-above{depth}")
    return roots, with_above(stages[0], above)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", tamper: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, group, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes the ``columns`` of a row, each ``-`` if NULL. Leaves of a group ascend
    by id, NULL ids first, equal ids by their digests; every ``fanout`` consecutive nodes
    become the hash of their digests until one is left, the group's subroot; a NULL group
    is a group. Subroots in the order of their groups (NULL first, by UTF-8 bytes) give
    the root in the same way. ``tamper`` is the text that the check reads in place of the
    row's own; ``folded_root`` is what that leaf and the true siblings lead to. Repeated
    rows are leaves of their own; columns of other names are not read; an empty table has
    no rows.
    """
    rows = need(docs, *dict.fromkeys([*columns, id_col, group_col, text_col]))
    own, held = leaf_hash([F.col(f"`{c}`") for c in columns]), F.col(f"`{text_col}`")
    text = held if tamper is None else tamper
    # Only a row whose text the check reads otherwise is hashed a second time.
    read = F.when(~text.eqNullSafe(held), leaf_hash([text if c == text_col else F.col(f"`{c}`") for c in columns]))
    leaves = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("g"), own.alias("leaf"), read.alias("read"))
    id_kind, group_kind = (leaves.schema[c].dataType.simpleString() for c in ("id", "g"))
    roots, blocks = prove(placed(leaves, ["g"], ["id", "leaf"], "leaves"), "g", "leaves", fanout)
    # The subroots are nodes of one more tree, however many groups there are.
    subroots = placed(roots.select(F.lit(0).alias("t"), "g", F.col("root").alias("leaf")), ["t"], ["g", "leaf"], "subroots")
    top, upper = prove(subroots, "t", "subroots", fanout)
    found_root = top.first()
    root = found_root.root if found_root else None

    def beyond(rows: pa.Table) -> pa.Table:
        turn, found, _ = _closed(rows, fanout)
        higher = _steps(rows, "above")
        return pa.table({"_g": rows.column("g").take(turn), "subroot": rows.column("leaf").take(turn), "beyond": _step_array([[*n.witness(), *higher] for n in found])})

    witness = materialise(upper.groupBy("t", "block").applyInArrow(beyond, f"_g {group_kind}, subroot string, beyond {STEPS}"), "beyond")
    both = blocks.join(witness, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")

    def report(rows: pa.Table) -> pa.Table:
        turn, found, _ = _closed(rows, fanout)
        higher = [*_steps(rows, "above"), *_steps(rows, "beyond")]
        rest = "".join(b + a for b, a in higher)
        proofs, folded = [], []
        for node, read in zip(found, rows.column("read").take(turn).to_pylist()):
            own = list(node.witness())
            proofs.append(node_hash("".join(b + a for b, a in own) + rest))
            folded.append(fold(read or node.digest, own + higher))
        kept = {c: rows.column(c).take(turn) for c in ("id", "g", "leaf", "subroot")}
        return pa.table(kept | {"proof_sha256": proofs, "folded_root": folded})

    done = both.groupBy("g", "block").applyInArrow(report, f"id {id_kind}, g {group_kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    true_root = F.lit(root).cast("string")
    return done.select(F.col("id").alias(id_col), F.col("g").alias(group_col), "leaf", "subroot", true_root.alias("root"), "proof_sha256", "folded_root", F.col("folded_root").eqNullSafe(true_root).alias("verified"))
