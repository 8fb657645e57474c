import tempfile

from pyspark.sql import functions as F

from pitchload.sinks import writers as W
from pitchload.sources import files as FS
from pitchload.schema import PERC_EVENT


def test_batch_rewrite_is_idempotent(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.createDataFrame([(1, 100), (2, 200)], "player_id int, ts_start long")
    W.event_append(df, 0, d)
    W.event_append(df, 0, d)          # a retried batch overwrites its own folder
    W.event_append(df.limit(1), 1, d)
    assert spark.read.parquet(d).count() == 3


def test_upsert_keeps_latest_per_key(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    W.zone_upsert(spark.createDataFrame([(0, 7, 1, 10.0), (0, 7, 2, 5.0)], "team int, jersey_number int, speedZone int, total_distance double"), 0, d)
    W.zone_upsert(spark.createDataFrame([(0, 7, 1, 12.5)], "team int, jersey_number int, speedZone int, total_distance double"), 1, d)
    got = sorted(tuple(r) for r in W.read_latest(spark, d, ["team", "jersey_number", "speedZone"]).collect())
    assert got == [(0, 7, 1, 12.5), (0, 7, 2, 5.0)]


def test_keyed_sink_spreads_a_hot_key_in_order(spark):
    df = spark.range(20000).select(F.lit(1).alias("player_id"), F.col("id").alias("ts_start"))
    kv = W.keyed_values(df, ["player_id"]).withColumn("p", F.spark_partition_id())
    parts = kv.groupBy("p").agg(F.min(F.get_json_object("value", "$.ts_start").cast("long")).alias("lo"),
                                F.max(F.get_json_object("value", "$.ts_start").cast("long")).alias("hi")).collect()
    assert len(parts) > 1
    spans = sorted((r.lo, r.hi) for r in parts)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))   # contiguous, ordered ranges


def test_snapshot_reader_drops_metadata_and_repairs_quotes(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    row = (3, 1, 9, 1000, 2000, 1.0, 2.5, 7.0, 6.5, "Feint", 123.0)
    df = spark.createDataFrame([row], PERC_EVENT.simpleString().replace("ts_start:string", "ts_start:bigint")
                               .replace("ts_end:string", "ts_end:bigint")[7:-1])
    W.write_records_text(df, d, single_quotes=True)
    assert "'" in spark.read.text(d).first()[0]
    back = FS.read_event_snapshot(spark, d, df.schema)
    assert back.columns == df.columns and tuple(back.first()) == row


def test_ttl_retention(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1000, 120_000, 120_001, 240_000)], "ts_ms long")
    # newest 240 000 ms: rows older than 120 s are gone, exactly 120 s included
    assert sorted(r.ts_ms for r in W.retained(df).collect()) == [120_000, 120_001, 240_000]


def test_live_cache_holds_the_last_slots_only(spark):
    """After every batch the slots that end before the bound are gone from disk; the rest reads back."""
    import os
    d = tempfile.mkdtemp(dir="/tmp")
    df = spark.range(0, 400_000, 500).select((F.col("id") % 3).cast("int").alias("player_id"), F.col("id").alias("ts_ms"), F.lit(1.5).alias("speed"))
    for batch, hi in enumerate((100_000, 250_000, 400_000)):
        W.cache_write(df.where((F.col("ts_ms") < hi) & (F.col("ts_ms") >= (0, 100_000, 250_000)[batch])), batch, d, ["player_id"])
        W.cache_expire(spark, d)
        newest = hi - 500
        slots = sorted(int(s.removeprefix("slot=")) for b in os.listdir(d) for s in os.listdir(f"{d}/{b}") if s.startswith("slot="))
        assert slots[0] == max(0, (newest - W.TTL_MS) // W.SLOT_MS) and slots[-1] == newest // W.SLOT_MS
        got = sorted(r.ts_ms for r in FS.read_tracking_cache(spark, d, df.schema).collect())
        assert got == list(range(slots[0] * W.SLOT_MS, hi, 500))
    assert W.cache_expire(spark, d) == [] and "batch_id=0" not in os.listdir(d)


def test_cache_folders_do_not_grow_with_the_time_of_a_batch(spark):
    """A batch of 40 hours of event time has as many folders as one of 400 s: the slots that reach into the last 120 s
    and one for all that have expired, which holds every older row until it is deleted."""
    import os
    for rows in (800, 288_000):
        d = tempfile.mkdtemp(dir="/tmp")
        df = spark.range(0, rows * 500, 500).select((F.col("id") % 3).cast("int").alias("player_id"), F.col("id").alias("ts_ms"), F.lit(1.5).alias("speed"))
        W.cache_write(df, 0, d, ["player_id"])
        newest = (rows - 1) * 500
        first = (newest - W.TTL_MS) // W.SLOT_MS
        slots = sorted(int(s.removeprefix("slot=")) for s in os.listdir(f"{d}/batch_id=0") if s.startswith("slot="))
        assert slots == list(range(first - 1, newest // W.SLOT_MS + 1))
        assert FS.read_tracking_cache(spark, d, df.schema).distinct().count() == rows
        assert W.cache_expire(spark, d) == [first - 1]
        got = sorted(r.ts_ms for r in FS.read_tracking_cache(spark, d, df.schema).collect())
        assert got == list(range(first * W.SLOT_MS, newest + 1, 500))


def test_markers_and_unmarked_batches(spark):
    from pitchload.sinks import commits
    d = tempfile.mkdtemp(dir="/tmp")
    for b in (0, 1):
        spark.range(b + 1).write.parquet(f"{d}/t/batch_id={b}")
    commits.mark(spark, d, 0)
    assert commits.read(spark, d, "t").count() == 1
    commits.mark(spark, d, 1)
    commits.unmark(spark, d, 0)
    assert commits.marked(spark, d) == [1] and commits.read(spark, d, "t").count() == 2


def test_compaction_bounds_the_runs_and_keeps_readers_going(spark):
    """30 batches of upserts: the latest values stay right at any time, few folders are read, and a read
    that began before a compaction ends after it."""
    d, keys, want = tempfile.mkdtemp(dir="/tmp") + "/z", ["team", "jersey_number", "speedZone"], {}
    schema, reader = "team int, jersey_number int, speedZone int, total_distance double", None
    for b in range(21):
        rows = [(0, b % 5, 1, float(b)), (None, 7, 2, b / 2)]
        want |= {r[:3]: r[3] for r in rows}
        W.zone_upsert(spark.createDataFrame(rows, schema).coalesce(1), b, d)
        if reader is not None:
            assert W.zone_compact(spark, d, keys) == (b % 4 == 3)
            assert sorted(map(str, reader.collect())) == sorted(map(str, before))
        reader = W.read_latest(spark, d, keys)
        before = reader.collect()
        assert {tuple(r[:3]): r[3] for r in before} == want
        version, manifest = W._manifest(spark, d)
        assert len(manifest["runs"]) + len(W._batches_after(spark, d, manifest["upto"])) <= 9
    assert [level for _, level in manifest["runs"]] == [2, 1] and version == 5
    W.zone_upsert(spark.createDataFrame([(0, 3, 1, 3.0)], schema), 3, d)      # batch 3 is run again
    assert {tuple(r[:3]): r[3] for r in W.read_latest(spark, d, keys).collect()} == want
