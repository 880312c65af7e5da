"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

The index of lines is a set of runs, each a Parquet folder sorted by line hash with
the number of documents and the largest document id that hold the line. A batch of
documents merge-anti-joins the runs, which tells its new lines from the known ones,
and adds a run of its own: new lines are entries, known ones only updates of counts.
The runs' entries are the index, each line once, and updates are joined to them. When
a level holds ``fanout`` runs they are merged into one run of the next level, so a line
is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.llm.common import need
from verbascope.session import materialise, scratch_dir

STRIPPED = " \t\n\x0b\x0c\r"


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None for a key under ``min_chars`` code points.

    The key is the line without ASCII white space at its ends, A-Z in lower case.
    """
    import xxhash

    key = line.strip(STRIPPED)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def document_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(id, line): the distinct line hashes of each row."""
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {line_hash(x, min_chars) for x in (text or "").split("\n")} - {None}
                at += [i] * len(own)
                held += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(held, pa.binary())], ["id", "line"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, line binary")


class LineRuns:
    """The index. ``add`` takes batches of documents that no earlier batch held."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def rows(self) -> DataFrame | None:
        """(line, docs, last, fresh) of all runs; ``fresh`` marks a line's one entry, other rows update its count."""
        runs = [r for level in self.levels for r in level]
        return self.spark.read.parquet(*runs) if runs else None

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.path}/level{level}/run{self.written}"
        self.written += 1
        rows.sortWithinPartitions("line").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self.spark.read.parquet(*self.levels[level])
            self.levels[level] = []
            self._write(merge(merged), level + 1)

    def add(self, lines: DataFrame) -> None:
        """Merge a batch's (id, line) rows against the runs and add its own run."""
        own = lines.groupBy("line", "id").agg(F.lit(1).alias("_one")).groupBy("line").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
        known = self.rows()
        if known is None:
            self._write(own.withColumn("fresh", F.lit(True)), 0)
            return
        # An anti-join that keeps both sides: the runs hold a fresh line once, so no row is doubled.
        known = known.where("fresh").select("line", F.lit(False).alias("_seen"))
        self._write(own.join(known.hint("merge"), "line", "left").select("line", "docs", "last", F.coalesce("_seen", F.lit(True)).alias("fresh")), 0)

    def shared(self, min_docs: int) -> DataFrame:
        """(line, last) of the lines that at least ``min_docs`` documents hold: entries with their updates."""
        rows = self.rows()
        more = rows.where("NOT fresh").groupBy("line").agg(F.sum("docs").alias("_docs"), F.max("last").alias("_last"))
        both = rows.where("fresh").select("line", "docs", "last").join(more.hint("merge"), "line", "left")
        docs = F.col("docs") + F.coalesce("_docs", F.lit(0))
        return both.where(docs >= min_docs).select("line", F.greatest("last", "_last").alias("last"))


def merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("line").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))


def without_lines(text: Column, dropped: Column, min_chars: int) -> Column:
    """struct(text, n_lines, n_dropped): the text without the lines of the given hashes."""

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, hashes in zip(texts, gone):
            lines = (text or "").split("\n")
            kept = lines
            if hashes is not None and len(hashes):
                hashes = {bytes(h) for h in hashes}
                kept = [x for x in lines if line_hash(x, min_chars) not in hashes]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return cut(text, dropped)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with shared lines cut out of the text, and two columns more:
    ``n_lines`` before the cut and ``n_dropped``.

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold stays
    only in the document of the largest id among them. Other lines stay, in order.
    A NULL or empty text is one empty line and comes back as an empty text. Rows of
    equal id are one document for the count, and so are all rows of a NULL id, which
    is smaller than any other. Columns named n_lines or n_dropped are replaced; an
    empty table gives an empty table. The runs go to ``path``, or to a fresh folder in
    the session's shared one; a table is indexed in ``batches`` batches by hash of id.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, path or scratch_dir(spark, "line-runs"))
    for k in range(batches):
        part = docs.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == k)
        runs.add(document_lines(part, min_chars, id_col, text_col))
    lines = document_lines(docs, min_chars, id_col, text_col)
    # As a table of its own the shared lines let a join split the partition of a very common one.
    shared = materialise(runs.shared(min_docs), "shared-lines")
    gone = lines.join(shared, "line").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("id").agg(F.collect_set("line").alias("_gone"))
    columns = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    d, g = docs.alias("d"), gone.alias("g")
    both = d.join(g, F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")), "left")
    cut = both.withColumn("_cut", without_lines(F.col(f"d.{text_col}"), F.col("g._gone"), min_chars))
    order = [F.col("_cut.text").alias(text_col) if c == text_col else F.col(f"d.{c}") for c in docs.columns if c in columns or c == text_col]
    return cut.select(*order, "_cut.n_lines", "_cut.n_dropped")
