"""Keyed log: two-phase commit, numbers per key, replay from any offset."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pitchload.sinks import keyed_log as L


def _rows(spark, lo, hi):
    """Player 1 holds two thirds of the rows, 2 and no player the rest."""
    player = F.when(F.col("id") % 3 < 2, 1).when(F.col("id") % 6 == 2, 2)
    return spark.range(lo, hi).select(player.alias("player_id"), (F.col("id") * 40).alias("ts_start"), F.concat(F.lit("é\n"), "id").alias("note"))


def _log(spark, path):
    return [tuple(r) for r in L.read_log(spark, path).orderBy("lane", "offset").collect()]


def test_numbers_order_and_a_batch_sent_again(spark):
    path = tempfile.mkdtemp(dir="/tmp") + "/log"
    for batch, (lo, hi) in enumerate([(0, 3000), (3000, 3600)]):
        L.keyed_send(_rows(spark, lo, hi), batch, path, ["player_id"])
    once = _log(spark, path)
    L.keyed_send(_rows(spark, 3000, 3600), 1, path, ["player_id"])       # a retry
    assert _log(spark, path) == once and len(once) == 3600
    for key, player in (("1", 1), ("2", 2), ("null", None)):
        mine = [(seq, json.loads(value)) for _, _, k, seq, value in once if k == key]
        want = _rows(spark, 0, 3600).where(F.col("player_id").eqNullSafe(player)).orderBy("ts_start").collect()
        assert [s for s, _ in mine] == list(range(1, len(want) + 1))       # in the order of the lane's offsets
        assert [(v.get("player_id"), v["ts_start"], v["note"]) for _, v in mine] == [tuple(r) for r in want]
    hot = next(lane for lane, _, key, _, _ in once if key == "1")
    with open(f"{path}/_commits/0.json") as f:
        assert sum(s[0] == hot for s in json.load(f)) > 3                  # the hot key is spread over tasks


def test_a_failed_batch_leaves_nothing(spark):
    path = tempfile.mkdtemp(dir="/tmp") + "/log"
    bad = _rows(spark, 0, 2000).withColumn("note", F.when(F.col("ts_start") == 60_000, F.raise_error(F.lit("injected"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="injected"):
        L.keyed_send(bad, 0, path, ["player_id"])
    assert _log(spark, path) == []
    L.keyed_send(_rows(spark, 0, 2000), 0, path, ["player_id"])
    assert len(_log(spark, path)) == 2000


def test_replay_from_offsets_and_restart(spark):
    work = tempfile.mkdtemp(dir="/tmp")
    path = f"{work}/log"
    L.keyed_send(_rows(spark, 0, 900), 0, path, ["player_id"])
    first = _log(spark, path)
    ends = {lane: max(o for l, o, *_ in first if l == lane) + 1 for lane in {r[0] for r in first}}
    middle = {lane: n // 2 for lane, n in ends.items()}

    def run(name, starting):
        w = L.stream_log(spark, path, starting).writeStream.format("parquet").option("path", f"{work}/{name}")
        w.option("checkpointLocation", f"{work}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(L.SCHEMA).parquet(f"{work}/{name}").collect()) if os.path.exists(f"{work}/{name}") else []

    starts = {"earliest": "earliest", "middle": json.dumps(middle), "latest": "latest"}
    got = {name: run(name, s) for name, s in starts.items()}
    assert got["earliest"] == sorted(first) and got["latest"] == []
    assert got["middle"] == sorted(r for r in first if r[1] >= middle[r[0]])
    L.keyed_send(_rows(spark, 900, 1500), 1, path, ["player_id"])
    every = sorted(_log(spark, path))
    later = [r for r in every if r not in set(first)]
    assert run("earliest", "earliest") == every and run("latest", "latest") == later and len(later) == 600


def test_stream_writer(spark):
    """The log as the sink of a stream: one commit per micro-batch."""
    work = tempfile.mkdtemp(dir="/tmp")
    spark.dataSource.register(L.KeyedLog)
    df = L.with_lane(_rows(spark, 0, 300).withColumn("seq", F.col("ts_start")), ["player_id"], "seq")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(f"{work}/src")
        w = spark.readStream.schema(L.SCHEMA).parquet(f"{work}/src").writeStream.format("keyed_log").option("path", f"{work}/log")
        w.option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    log = _log(spark, f"{work}/log")
    assert len(log) == 600 and sorted(os.listdir(f"{work}/log/_commits")) == ["0.json", "1.json"]
    assert sorted((k, s, v) for _, _, k, s, v in log) == sorted(2 * [(r.key, r.seq, r.value) for r in df.collect()])


def test_a_batch_is_computed_once(spark, tmp_path):
    """The totals, the range bounds and the write all read the numbered rows of one run of the batch's plan."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v
    df = spark.range(500).selectExpr("id % 3 AS k", "id * 40 AS ts_start", "id AS v")
    df = df.select("k", "ts_start", F.udf(count, "long")("v").alias("w"))
    L.keyed_send(df, 0, str(tmp_path / "log"), ["k"])
    assert seen.value == 500 and L.read_log(spark, str(tmp_path / "log")).count() == 500
