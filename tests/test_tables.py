"""Bucketed tables: one bucket read per key, no exchange under the interval join."""

import tempfile

from pyspark.sql import functions as F

from pitchload.operators.routes import event_routes
from pitchload.plans.batch import Chain
from pitchload.session import cut
from pitchload.sinks import tables as TB
from tests.conftest import SF01


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filter_reads_one_bucket_and_join_has_no_exchange(spark):
    c, keys = Chain(spark, SF01), ["player_id"]
    lose = F.when(F.col("player_id") != 3, F.col("player_id"))
    raw, merged = (cut(df.withColumn("player_id", lose), "t").drop("rn") for df in (c.raw(), c.merged()))
    d = tempfile.mkdtemp(dir="/tmp")
    events = TB.store_events(merged, f"{d}/events", keys)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"     # the plan names the buckets only if this is off
    for player in (5, None):
        spark.conf.set(auto, "false")
        got = TB.events_of(spark, events, player)
        assert "SelectedBucketsCount: 1 out of 8" in plan(got)
        spark.conf.unset(auto)
        got = TB.events_of(spark, events, player)
        want = merged.where(F.col("player_id").eqNullSafe(player))
        assert sorted(map(str, got.select(merged.columns).collect())) == sorted(map(str, want.collect())) and want.count()
    rows, spans = TB.store_by_time(raw, f"{d}/rows", keys), TB.store_by_time(merged, f"{d}/spans", keys, "ts_start", "ts_end")
    got = TB.stored_routes(spark, spans, rows, keys)
    text = plan(got)
    assert "SortMergeJoin" in text and "Exchange" not in text
    want = event_routes(merged, raw, keys)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("player_id IS NULL").count() > 0
