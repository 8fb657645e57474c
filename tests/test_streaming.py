import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators import kinematics as K
from pitchload.operators import zones as Z
from pitchload.plans.batch import Chain
from pitchload.session import cut
from pitchload.sinks import commits
from pitchload.streaming import live
from tests.conftest import SF01

KICK = 1559763900000
EV = ["player_id", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed"]


def _ingestion(raw):
    return raw.select(S.format_iso_ms(F.col("ts_ms") + F.lit(KICK)).alias("timestamp"), "team", "jersey_number",
                      "x", "y", "speed", F.lit(0).alias("half"), F.lit(0).alias("teamjersey"), "player_id",
                      "ts_ms")


def _write_chunks(raw, src, bounds):
    ing = _ingestion(raw)
    for lo, hi in bounds:
        ing.where((F.col("ts_ms") >= lo) & (F.col("ts_ms") < hi)).drop("ts_ms").coalesce(1) \
           .write.mode("append").json(src)


def _read(spark, sink, kind, cols):
    """Stream output with its epoch timestamps moved back to ms since kick-off."""
    df = spark.read.parquet(f"{sink}/{kind}")
    sel = [(F.col(c) - F.lit(KICK)).alias(c) if c in ("ts_ms", "ts_start", "ts_end") else F.col(c) for c in cols]
    return sorted(tuple(r) for r in df.select(*sel).collect())


def test_stream_equals_batch_with_restart(spark):
    c = Chain(spark, SF01)
    raw = c.raw()
    hi = raw.agg(F.max("ts_ms")).first()[0] + 1
    cuts = [0, hi // 3, 2 * hi // 3, hi]
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink = os.path.join(work, "src"), os.path.join(work, "sink")
    thr = c.thresholds()
    _write_chunks(raw, src, [(cuts[0], cuts[1]), (cuts[1], cuts[2])])
    q = live.start_live(spark, src, sink, thr, name=f"t-{os.path.basename(work)}", max_files=1)
    q.awaitTermination()
    # restart from the checkpoint after more data arrived
    _write_chunks(raw, src, [(cuts[2], cuts[3])])
    q = live.start_live(spark, src, sink, thr, name=f"t-{os.path.basename(work)}", max_files=1)
    q.awaitTermination()

    batch_ex = sorted(tuple(r) for r in c.extracted().select(*EV).collect())
    batch_mg = sorted(tuple(r) for r in c.merged().select(*EV).collect())
    assert _read(spark, sink, "extracted", EV) == batch_ex and len(batch_ex) == 179
    assert _read(spark, sink, "merged", EV) == batch_mg and len(batch_mg) == 151
    en_cols = ["player_id", "ts_ms", "acc_actual", "acc_event", "start_event", "dist", "speedzone"]
    assert _read(spark, sink, "enriched", en_cols) == sorted(tuple(r) for r in c.enriched().select(*en_cols).collect())
    sc = sorted(tuple(r) for r in c.scored().select(*EV, "event_class", "percAcc").collect())
    assert _read(spark, sink, "scored", EV + ["event_class", "percAcc"]) == sc


def test_late_rows_dropped_and_zone_stream(spark):
    c = Chain(spark, "/root/testdata/sf0.001")
    raw = c.raw()
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink = os.path.join(work, "src"), os.path.join(work, "sink")
    _write_chunks(raw, src, [(0, 10**12), (0, 400)])     # the second file replays old rows
    q = live.start_live(spark, src, sink, c.thresholds(), name=f"l-{os.path.basename(work)}", max_files=1)
    q.awaitTermination()
    late = spark.read.parquet(f"{sink}/late").agg(F.sum("late_rows")).first()[0]
    assert late == raw.where(F.col("ts_ms") < 400).count()
    zs = os.path.join(work, "zones")
    q = live.zone_totals_stream(spark, f"{sink}/enriched", zs, name=f"z-{os.path.basename(work)}")
    q.awaitTermination()
    from pitchload.sinks.writers import read_latest
    got = sorted((r[0], r[1], r[2], round(r[3], 6)) for r in
                 read_latest(spark, zs, ["team", "jersey_number", "speedZone"]).collect())
    from pitchload.operators.zones import zone_distance
    want = sorted((r[0], r[1], r[2], round(r[3], 6)) for r in zone_distance(c.enriched()).collect())
    assert got == want


def _fold_in_batches(rows, cuts):
    """Rows of one key through the fold, cut into micro-batches."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, new):
            self.exists, self.get = True, new
    state, out, bounds = State(), [], [0, *cuts, len(rows)]
    for a, b in zip(bounds, bounds[1:]):
        pdf = pd.DataFrame(rows[a:b], columns=["player_id", "team", "jersey_number", "ts_ms", "x", "y", "speed"])
        out += list(live._fold((1,), [pdf], state))
    res = pd.concat(out)
    return {k: sorted(map(str, g.drop(columns="kind").itertuples(index=False, name=None))) for k, g in res.groupby("kind")}


def test_batches_bad_rows_and_ties(spark):
    rows = [(1, 0, 7, 40 * (i - i % 2), float(i), float(-i), abs(i % 40 - 20) / 2.5) for i in range(400)]   # pairs share a time
    whole = _fold_in_batches(rows, [])
    assert len(whole["enriched"]) == 391 and len(whole["merged"]) > 3
    for cuts in ([133], [11, 57, 58, 201, 333, 399]):
        assert _fold_in_batches(rows, cuts) == whole
    bad = rows[:50] + [(1, 0, 7, None, 1.0, 1.0, 1.0), (1, 0, 7, 99999, 1.0, 1.0, None)] + rows[50:] + [rows[3]]
    got = _fold_in_batches(bad, [100, 402])
    assert len(got["reject"]) == 2 and len(got["late"]) == 1
    assert {k: got[k] for k in whole} == whole


def test_a_batch_run_again_changes_nothing(spark):
    c = Chain(spark, "/root/testdata/sf0.001")
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink = os.path.join(work, "src"), os.path.join(work, "sink")
    _write_chunks(c.raw(), src, [(0, 10**12)])
    live.start_live(spark, src, sink, c.thresholds(), name=f"r1-{os.path.basename(work)}").awaitTermination()
    once = sorted(map(tuple, live.zone_totals(spark, sink).collect()))
    # a lost checkpoint makes the same input batch 0 again
    live.start_live(spark, src, sink, c.thresholds(), name=f"r2-{os.path.basename(work)}").awaitTermination()
    assert sorted(map(tuple, live.zone_totals(spark, sink).collect())) == once and once


def test_session_merge_matches_batch_with_flush(spark):
    c = Chain(spark, SF01)
    got = sorted(tuple(r) for r in live.session_merge(c.extracted()).select(*EV).collect())
    want = sorted(tuple(r) for r in c.merged(flush_open=True).select(*EV).collect())
    assert got == want


def _live_parts(spark, raw, n, thr):
    """The live job over ``n`` parts of the time, stopped and started anew for each."""
    hi = raw.agg(F.max("ts_ms")).first()[0] + 1
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink, name = os.path.join(work, "src"), os.path.join(work, "sink"), os.path.basename(work)
    for i in range(n):
        _write_chunks(raw, src, [(hi * i // n, hi * (i + 1) // n)])
        live.start_live(spark, src, sink, thr, name=f"p-{name}").awaitTermination()
    return sink


def test_state_in_1_and_7_batches(spark):
    """Value and map state go on from the checkpoint: every table is the same however the rows arrive."""
    c = Chain(spark, "/root/testdata/sf0.001")
    raw, thr = c.raw(), cut(Chain(spark, SF01).thresholds(), "thresholds")
    zones = ["player_id", "ts_ms", *live.ZONE_MAP]
    want = {tuple(r[:2]): [round(x, 6) for x in r[2:]] for r in
            Z.zone_running(c.rows(), ["player_id"], first_rn=K.SMALL_LAG + 2).select(*zones).collect()}
    events = sorted(tuple(r) for r in c.extracted().select(*EV).collect())
    for n in (1, 7):
        sink = _live_parts(spark, raw, n, thr)
        got = {tuple(r[:2]): [round(x, 6) for x in r[2:]] for r in _read(spark, sink, "zone_map", zones)}
        assert got == want and len(want) > 800
        assert _read(spark, sink, "extracted", EV) == events
        assert commits.marked(spark, sink) == list(range(n))


def test_timer_flushes_the_pending_group(spark):
    c = Chain(spark, SF01)
    raw = c.raw().where("player_id < 6")
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink = os.path.join(work, "src"), os.path.join(work, "sink")
    _write_chunks(raw, src, [(0, 10**12)])
    q = live.start_live(spark, src, sink, c.thresholds(), name=os.path.basename(work), available_now=False, processing_time="1 second", flush_ms=3_000)
    want = sorted(tuple(r) for r in c.merged(flush_open=True).where("player_id < 6").select(*EV).collect())
    try:
        for _ in range(90):
            time.sleep(1)
            if commits.marked(spark, sink) and len(got := _read(spark, sink, "merged", EV)) >= len(want):
                break
    finally:
        q.stop()
    assert got == want and len(want) > len(c.merged().where("player_id < 6").collect())


def test_failure_between_two_tables_shows_nothing(spark, monkeypatch):
    c = Chain(spark, "/root/testdata/sf0.001")
    raw, thr = c.raw(), cut(Chain(spark, SF01).thresholds(), "thresholds")
    work = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    src, sink, name = os.path.join(work, "src"), os.path.join(work, "sink"), os.path.basename(work)
    hi = raw.agg(F.max("ts_ms")).first()[0] + 1
    _write_chunks(raw, src, [(0, hi // 2)])
    live.start_live(spark, src, sink, thr, name=name).awaitTermination()
    before = {k: live.committed(spark, sink, k).count() for k in ("enriched", "zone_map", "scored")}
    _write_chunks(raw, src, [(hi // 2, hi)])

    def broken(*_):
        raise RuntimeError("injected")
    with monkeypatch.context() as m:
        m.setattr(live, "score_batch", broken)      # enriched, zone_map and zone_parts are written by then
        with pytest.raises(Exception, match="injected"):
            live.start_live(spark, src, sink, thr, name=name).awaitTermination()
    assert {k: live.committed(spark, sink, k).count() for k in before} == before
    assert spark.read.parquet(f"{sink}/enriched").count() > before["enriched"]
    live.start_live(spark, src, sink, thr, name=name).awaitTermination()
    assert live.committed(spark, sink, "enriched").count() == c.enriched().count()


def test_sessions_on_a_stream_with_late_events(spark):
    c = Chain(spark, SF01)
    ev = c.extracted().select(*EV[:3], "duration", "v_init", "max_acc", "max_speed", "team", "jersey_number")
    ev = ev.select(*dict.fromkeys(ev.columns)).cache()
    work, delay = tempfile.mkdtemp(prefix="stream-", dir="/tmp"), 5_000
    src, sink, name = os.path.join(work, "src"), os.path.join(work, "sink"), os.path.basename(work)
    hi = ev.agg(F.max("ts_end")).first()[0]
    parts = [ev.where("ts_start < 30000"), ev.where("ts_start BETWEEN 30000 AND 60000"),
             ev.where("ts_start < 2000").limit(3).unionByName(ev.where("ts_start > 60000")),      # three come a second time, too late
             live.end_marker(spark, ev.schema, hi, delay)]
    assert parts[2].where("ts_start < 2000").count() == 3
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        live.split_late(spark.readStream.schema(ev.schema).parquet(src), sink, f"s-{name}", delay).awaitTermination()
        live.session_merge_stream(spark, sink, ev.schema, f"m-{name}", delay_ms=delay).awaitTermination()
    cols = ["player_id", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{sink}/sessions").select(*cols).collect())
    assert got == sorted(tuple(r) for r in c.merged(flush_open=True).select(*cols).collect())
    assert spark.read.parquet(f"{sink}/late").count() == 3


def test_batch_chain_from_exported_records(spark):
    """The chain started from exported CSV records equals the chain on the table."""
    from pitchload.sources.files import read_tracking_records
    c = Chain(spark, SF01)
    d = tempfile.mkdtemp(prefix="records-", dir="/tmp")
    _ingestion(c.raw()).drop("ts_ms").write.option("header", True).csv(d + "/csv")
    rec = read_tracking_records(spark, d + "/csv")
    from_csv = Chain(spark, SF01, source=rec.withColumn("ts_ms", F.col("ts_ms") - F.lit(KICK)))
    got = sorted(tuple(r) for r in from_csv.merged().select(*EV).collect())
    assert got == sorted(tuple(r) for r in c.merged().select(*EV).collect()) and len(got) == 151
