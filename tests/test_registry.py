import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF01

# queries whose oracle runs quickly enough for the unit suite (tools/check_oracle.py runs all)
FAST = ["agg_zone_distance", "win_extract_events", "win_merge_events", "fn_perc_acc", "top_recent_percacc",
        "reshape_wide_to_long", "join_period_range", "win_route_segments"]


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["team", "jersey_number", "speedZone", "total_distance"]


def test_every_query_has_an_oracle():
    assert set(entry.registry.ORACLE) == set(entry.registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.registry.QUERIES) >= 60


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF01}/events.parquet'")
    df = entry.queries()[name](spark, SF01)
    cols = df.columns
    got = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(cols)
    idx = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in idx) for r in rel.fetchall())
    assert got == want and len(got) > 0
