"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbascope.catalog import derive
from verbascope.catalog.derived_sql import DERIVED_SQL
from verbascope.session import materialise

# Tables of long texts: a few bytes of a file are much work, so their rows are dealt to
# all tasks. Files of one row group, as small writers leave them, are one task otherwise.
DEALT_BY = {"documents": ("doc_id",), "conversations": ("conv_id", "turn"), "pages": ("page_id",)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables and the domain tables derived from them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        make = derive.DERIVED.get(name)
        df = make(self) if make else self._read(name)
        setattr(self, name, df)
        return df

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DEALT_BY:
            return df
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *DEALT_BY[name])


def stored(t: Tables, *names: str) -> Tables:
    """Write derived tables once, as they would be stored in practice, so that a
    plan which reads them many times scans them instead of deriving them again."""
    for name in names:
        setattr(t, name, materialise(getattr(t, name), name))
    return t


def compose(sql: str) -> str:
    """Prefix a query with the derived tables (``d_*``) it uses, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bd_\w+", text):
            if name in DERIVED_SQL and name not in order:
                need(DERIVED_SQL[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({DERIVED_SQL[n].strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return wrap
