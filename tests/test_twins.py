"""Every query of the catalogue against its SQL twin, on the smallest tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import duckdb
import pytest

from verbascope.catalog import load

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events orders lineitem customer supplier part nation region".split()


def plain(v):
    """Numbers to nine digits, whatever their type."""
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: repr([round(v) if isinstance(v, float) else v for v in r]))


def same(a, b):
    """Sums in another order may round to the next hundredth."""
    both = isinstance(a, float) and isinstance(b, float)
    return a == b or both and math.isclose(a, b, rel_tol=1e-7, abs_tol=0.0101)


def equal(got, want):
    return len(got) == len(want) and all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.skipif(not os.environ.get("ALL_TWINS"), reason="takes minutes; set ALL_TWINS=1")
def test_every_query_equals_its_twin(spark):
    """Several at a time; what differs is listed by name."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    catalogue = load()

    def differs(name):
        try:
            df = catalogue.QUERIES[name](spark, SF)
            got = rows(df.columns, [tuple(r) for r in df.collect()])
            twin = con.cursor().execute(catalogue.ORACLES[name])
            columns = [d[0] for d in twin.description]
            want = rows(columns, twin.fetchall())
            return None if sorted(columns) == sorted(df.columns) and equal(got, want) else f"{name}: {len(got)} and {len(want)} rows"
        except Exception as e:  # noqa: BLE001
            return f"{name}: {str(e)[:200]}"

    # Streams set the session's state store while they start, so they run by themselves.
    streams = [n for n in catalogue.ORACLES if n.startswith("stream_")]
    with ThreadPoolExecutor(6) as pool:
        found = list(pool.map(differs, [n for n in catalogue.ORACLES if n not in streams]))
    bad = [x for x in [*found, *map(differs, streams)] if x]
    assert not bad, bad
