import random

from pitchload.operators import events as E
from pitchload.operators import kinematics as K
from tests.fold import fold_events, fold_merge

SCHEMA = "player_id int, team int, jersey_number int, ts_ms long, speed double, acc_actual double, acc_event double, start_event int"


def extract(spark, rows_by_key, seg_rows=50_000):
    rows = [(k, 0, k, ts, sp, acc, ae, st) for k, rs in rows_by_key.items() for ts, sp, acc, ae, st in rs]
    df = spark.createDataFrame(rows, SCHEMA)
    fl = K.event_flags(df, ["player_id"], seg_rows=seg_rows)
    ev = E.extract_events(fl, ["player_id"], seg_rows=seg_rows)
    return sorted((r["player_id"], r["ts_start"], r["ts_end"], r["v_init"], r["max_acc"], r["max_speed"])
                  for r in ev.collect())


# (ts, speed, acc_actual, acc_event, start): good = acc_event >= 0 and step < 1 s
S, G, B = (1, 0.5), (0, 0.5), (0, -1.0)   # start / good / bad (start flag, acc_event)


def rows(*kinds, step=40, acc=None):
    out = []
    for i, (st, ae) in enumerate(kinds):
        out.append((i * step, 1.0 + 0.5 * i, (acc or {}).get(i, float(i)), ae, st))
    return out


def test_extract_one_event_maxima_exclude_opening(spark):
    r = rows(S, G, G, B)
    got = extract(spark, {1: r})
    assert got == [(1, 0, 80, 1.0, 2.0, 2.0)] == [(1, *e) for e in fold_events(r)]


def test_extract_open_stays_open_over_bad_rows(spark):
    r = rows(S, B, B, G, B)
    assert extract(spark, {1: r}) == [(1, 0, 120, 1.0, 3.0, 2.5)] == [(1, *e) for e in fold_events(r)]


def test_extract_closing_row_opens_nothing(spark):
    r = [(0, 1.0, 0.0, 0.5, 1), (40, 2.0, 1.0, 0.5, 0), (1040, 3.0, 2.0, 0.5, 1), (1080, 4.0, 3.0, 0.5, 0),
         (1120, 5.0, 4.0, -1.0, 0)]
    got = extract(spark, {1: r})
    assert got == [(1, 0, 40, 1.0, 1.0, 2.0)] == [(1, *e) for e in fold_events(r)]


def test_extract_open_at_end_not_emitted(spark):
    assert extract(spark, {1: rows(S, G)}) == []


def test_silence_threshold(spark):
    ok = [(0, 1.0, 0.0, 0.5, 1), (999, 2.0, 1.0, 0.5, 0), (1039, 3.0, 1.0, -1.0, 0)]
    assert extract(spark, {1: ok}) == [(1, 0, 999, 1.0, 1.0, 2.0)]
    silent = [(0, 1.0, 0.0, 0.5, 1), (1000, 2.0, 1.0, 0.5, 0), (1040, 3.0, 1.0, 0.5, 0), (1080, 3.0, 1.0, -1.0, 0)]
    assert extract(spark, {1: silent}) == [(1, 0, 1040, 1.0, 1.0, 3.0)] == [(1, *e) for e in fold_events(silent)]


def _merge(spark, evs, flush=False):
    df = spark.createDataFrame([(1, 0, 1, s, e, (e - s) / 1000.0, v, a, m) for s, e, v, a, m in evs],
                               "player_id int, team int, jersey_number int, ts_start long, ts_end long, "
                               "duration double, v_init double, max_acc double, max_speed double")
    out = E.merge_events(df, ["player_id"], flush_open=flush, seg_rows=2)
    return sorted((r["ts_start"], r["ts_end"], r["v_init"], r["max_acc"], r["max_speed"]) for r in out.collect())


def test_merge_gap_boundary_and_unemitted_tail(spark):
    evs = [(0, 100, 1.0, 1.0, 1.0), (599, 700, 2.0, 3.0, 0.5), (1200, 1300, 3.0, 0.5, 4.0),
           (9000, 9100, 4.0, 1.0, 1.0)]
    # 599 - 100 = 0.499 s merges; 1200 - 700 = 0.500 s breaks; the far last event is never emitted
    assert _merge(spark, evs) == [(0, 700, 1.0, 3.0, 1.0), (1200, 1300, 3.0, 0.5, 4.0)] == fold_merge(evs)
    assert len(_merge(spark, evs, flush=True)) == 3


def test_merge_ignores_zero_duration(spark):
    evs = [(0, 100, 1.0, 1.0, 1.0), (300, 300, 9.0, 9.0, 9.0), (700, 800, 2.0, 1.0, 1.0), (5000, 5100, 1.0, 1.0, 1.0)]
    assert _merge(spark, evs) == fold_merge(evs) == [(0, 100, 1.0, 1.0, 1.0), (700, 800, 2.0, 1.0, 1.0)]


def test_property_windows_equal_fold(spark):
    rnd = random.Random(7)
    data = {}
    for k in range(1, 9):
        ts, rs = 0, []
        for i in range(rnd.randint(50, 400)):
            ts += rnd.choice([40, 40, 40, 40, 999, 1000, 2000])
            rs.append((ts, rnd.choice([1.0, 2.0, 5.0]), round(rnd.uniform(-2, 3), 2), rnd.choice([-1.0, 0.0, 0.5, 1.0]),
                       rnd.choice([0, 0, 1])))
        data[k] = rs
    want = sorted((k, *e) for k, rs in data.items() for e in fold_events(rs))
    assert extract(spark, data, seg_rows=13) == want
    assert extract(spark, data) == want
    assert len(want) > 50


def test_positive_duration_keeps_every_event_with_length(spark):
    """All events are kept as they were extracted, whatever time they start at."""
    import tempfile

    from pitchload.plans import registry
    d = tempfile.mkdtemp(dir="/tmp")
    spark.range(2_000).selectExpr("id AS event_id", "timestamp_millis(id * 1000) AS ts", "id % 4 AS user_id").write.parquet(f"{d}/events.parquet")
    every = [tuple(r) for r in registry.QUERIES["win_extract_events"](spark, d).collect()]
    got = [tuple(r) for r in registry.QUERIES["flt_positive_duration"](spark, d).collect()]
    at, length = registry.EV_COLS.index("ts_start"), registry.EV_COLS.index("duration")
    assert sorted(got) == sorted(e for e in every if e[length] > 0) and any(e[at] % 3 == 0 for e in got)
