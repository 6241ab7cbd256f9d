"""Registered queries against their DuckDB oracles on the smallest tables
(a fast subset; ``tools/check_oracle.py`` runs all of them)."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sensorframe.plans.registry import DRIVER_TABLES
from tests.conftest import SF0001

SUBSET = ["explore_daily", "meta_scan", "alias_pick", "ts_scan", "facet_cascade", "valid_timestamp", "enrich_left",
          "resample_sum", "resample_median", "gapfill_week", "gapfill_month", "bins_week", "bins_month",
          "resample_null_keys", "rolling_mean", "resample_then_roll", "chart_groups", "kpi_text", "binary_series",
          "dedup_keep_first", "type_map", "batch_load_stats", "quality_checks"]


def _digest(columns, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return v.isoformat() if hasattr(v, "isoformat") else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return hashlib.sha256("\n".join(sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)
