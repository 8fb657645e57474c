"""Marts brought up to date batch by batch equal the batch marts over all stored events."""

import tempfile

from pyspark.sql import functions as F

from pitchload.operators import marts as M
from pitchload.operators import zones as Z
from pitchload.plans.batch import Chain
from pitchload.session import cut
from pitchload.sinks import commits
from pitchload.streaming import refresh as R
from tests.conftest import SF01


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_three_refreshes_equal_batch_marts(spark):
    c = Chain(spark, SF01)
    scored = cut(c.scored(), "scored")
    parts = cut(Z.zone_distance(c.rows().withColumn("part", F.least(F.expr("ts_ms div 40000"), F.lit(2))), group=("part", "team", "jersey_number")), "parts")
    work, window, seen = tempfile.mkdtemp(dir="/tmp"), 20_000, []
    sink, store = f"{work}/sink", f"{work}/store"
    assert R.refresh(spark, sink, store) is None
    for b in range(3):
        part = F.least(F.expr("ts_start div 40000"), F.lit(2))
        scored.where(part == b).write.parquet(f"{sink}/scored/batch_id={b}")
        parts.where(F.col("part") == b).drop("part").write.parquet(f"{sink}/zone_parts/batch_id={b}")
        assert R.refresh(spark, sink, store, window_ms=window) is None      # not marked yet
        commits.mark(spark, sink, b)
        assert R.refresh(spark, sink, store, window_ms=window) == b and R.refresh(spark, sink, store) is None
        now = scored.where(part <= b)
        zones = parts.where(F.col("part") <= b).groupBy("team", "jersey_number", "speedZone").agg(F.sum("total_distance").alias("total_distance"))
        got = R.marts(spark, store)
        want = {"top_recent_percacc": M.top_recent_percacc(M.recent(now, window_ms=window)), "percacc_share": M.percacc_share(now),
                "event_count": M.event_count(now), "player_labels": M.player_labels(now), "latest_events": M.latest_events(now),
                "zone_km": Z.zone_km(zones.select("team", F.col("jersey_number").alias("player"), F.col("speedZone").alias("speedzone"),
                                                  F.col("total_distance").alias("dist")))}
        for name, df in want.items():
            assert rows(got[name].select(df.columns)) == rows(df), name
        recent = spark.read.parquet(f"{store}/recent/batch_id={b}")
        assert rows(recent) == rows(M.recent(now, window_ms=window).select(recent.columns))
        seen.append(recent.count())
    changes = spark.read.parquet(f"{store}/changes")
    assert changes.where("op = -1").count() > 0 and changes.agg(F.sum("op")).first()[0] == seen[-1]
    assert commits.marked(spark, store) == [1, 2] and "batch_id=0" not in commits.children(spark, f"{store}/totals")
