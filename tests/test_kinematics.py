from pyspark.sql import functions as F

from pitchload.operators import kinematics as K
from pitchload.operators import zones as Z
from pitchload.sources import tables
from tests.conftest import SF001


def _raw(spark, speeds, step=40, key=1):
    rows = [(key, 0, key, i * step, float(i * 10), 0.0, float(v)) for i, v in enumerate(speeds)]
    return spark.createDataFrame(rows, "player_id int, team int, jersey_number int, ts_ms long, x double, y double, speed double")


def test_warm_up_rows(spark):
    speeds = [0.1 * n for n in range(1, 19)]
    out = K.lag_rate(_raw(spark, speeds), ["player_id"]).orderBy("rn").collect()
    assert [r["rn"] for r in out] == list(range(9, 19))
    for r in out:
        n = r["rn"]
        assert abs(r["acc_actual"] - (speeds[n - 1] - speeds[n - 9]) / 0.32) < 1e-12
        if n <= 16:
            assert r["acc_event"] == 0.0
        else:
            assert r["acc_event"] == (speeds[n - 1] - speeds[n - 17]) / (16 * 0.04)


def test_rising_edge_fixture(spark):
    vals = [0.0, 0.0, 1.0, 1.0, -1.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, i * 40, v) for i, v in enumerate(vals)], "player_id int, ts_ms long, acc_event double")
    out = K.rising_edge(df, ["player_id"]).orderBy("ts_ms").collect()
    assert len(out) == 6
    assert [r["ts_ms"] // 40 + 1 for r in out if r["start_event"] == 1] == [3, 7]


def test_step_distance_drops_first_row(spark):
    df = _raw(spark, [1, 1, 1])
    out = K.step_distance(df, ["player_id"]).orderBy("ts_ms").collect()
    assert [r["dist"] for r in out] == [10.0, 10.0]


def test_trailing_mean_excludes_current(spark):
    speeds = [0.4 * n * n for n in range(14)]
    out = {r["rn"]: r for r in K.trailing_mean_rate(_raw(spark, speeds, step=400), ["player_id"]).collect()}
    a = {n: (speeds[n - 1] - speeds[n - 2]) / 0.4 for n in range(2, 15)}
    assert min(out) == 5
    assert abs(out[5]["acc_actual"] - (a[2] + a[3] + a[4]) / 3) < 1e-12 and out[11]["acc_event"] == 0.0
    assert abs(out[12]["acc_event"] - sum(a[k] for k in range(2, 12)) / 10) < 1e-12


def test_segments_do_not_change_results(spark):
    raw = tables.tracking(spark, SF001)
    cols = ["player_id", "ts_ms", "acc_actual", "acc_event", "start_event", "dist", "speedzone", "good", "end_rn",
            "nx_mark", "nx_ts_mark"]
    big = sorted(K.enrich(raw, ["player_id"]).select(*cols).collect())
    small = sorted(K.enrich(raw, ["player_id"], seg_rows=20).select(*cols).collect())
    assert big == small and len(big) == 865


def test_zone_running_segments(spark):
    raw = tables.tracking(spark, SF001)
    en = K.enrich(raw, ["player_id"])
    cols = ["player_id", "ts_ms"] + [F.round(f"dist_{z}", 6).alias(f"d{z}") for z in range(1, 6)]
    a = Z.zone_running(en, ["player_id"]).select(*cols)
    b = Z.zone_running(en, ["player_id"], seg_rows=5).select(*cols)
    rows = sorted(a.collect())
    assert rows == sorted(b.collect()) and len(rows) == 865 - 15   # each player's first row only starts the map
