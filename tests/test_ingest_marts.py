import tempfile

from pyspark.sql import functions as F

from pitchload.operators import ingest as I
from pitchload.operators import marts as M
from pitchload.operators import reshape as R
from pitchload.operators import routes as RT


def test_wide_frames_keep_complete_players(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    lines = ["100:0,1,7,10.5,-3.0,1.25;1,2,9,0.0,0.0,0.0;-1,3,0,1,1,1;3,4,1,2,2,2;4,0,0,5,5,5;:",
             "101:0,1,7,11.0,-3.5,1.5;1,2,9;;:"]
    spark.createDataFrame([(l,) for l in lines], "value string").coalesce(1).write.text(d + "/f")
    long = R.cast_objects(R.wide_to_long(spark.read.text(d + "/f")))
    players = R.drop_team_codes(long).orderBy("frame_id", "obj_pos").collect()
    assert [(r.frame_id, r.team, r.jersey_number) for r in players] == [(100, 0, 7), (100, 1, 9), (101, 0, 7)]
    assert players[0].x == 10.5 and players[0].speed == 1.25


def test_halves_bounds_kept_between_dropped(spark):
    frames = spark.createDataFrame([(m, f) for m in (1, 2) for f in (10, 20, 21, 29, 30, 40, 41)], "match_id long, frame_id long")
    periods = I.number_periods(spark.createDataFrame([(1, 10, 20), (1, 30, 40), (2, 10, 29)],
                                                     "match_id long, start_frame long, end_frame long"))
    got = sorted((r.match_id, r.frame_id, r.half) for r in I.assign_half(frames, periods).collect())
    assert got == [(1, 10, 0), (1, 20, 0), (1, 30, 1), (1, 40, 1), (2, 10, 0), (2, 20, 0), (2, 21, 0), (2, 29, 0)]


def test_two_matches_in_one_xml(spark):
    from pitchload.plans import derived as D
    from pitchload.sources import files as FS
    raw = spark.createDataFrame([(m, f * m) for m in (1, 2) for f in range(101)], "match_id long, frame_no long")
    path = D.write_match_xml(raw)
    got = sorted(tuple(r) for r in FS.read_periods(spark, path).select("match_id", "half", "start_frame", "end_frame").collect())
    assert got == [(1, 0, 0, 40), (1, 1, 60, 100), (2, 0, 0, 90), (2, 1, 110, 200)]
    assert FS.read_match(spark, path).count() == 2


def test_frame_clock_and_dense_ids(spark):
    df = spark.createDataFrame([(100, 0, 7), (101, 1, 7), (125, 0, 12), (100, 1, 3)], "frame_id long, team int, jersey_number int")
    clk = I.frame_clock(df, F.lit(100), F.lit(25), F.lit(1000)).orderBy("frame_id").collect()
    assert [r.ts_ms for r in clk][:3] == [1000, 1000, 1040] and clk[-1].ts_ms == 2000
    thirty = I.frame_clock(df.limit(1).withColumn("frame_id", F.lit(102)), F.lit(100), F.lit(30), F.lit(0))
    assert thirty.first().ts_ms == 66                                     # cut, not rounded
    ids = {(r.team, r.jersey_number): (r.teamjersey, r.player_id) for r in I.dense_player_id(df).collect()}
    assert ids == {(0, 7): (70, 2), (1, 7): (71, 3), (0, 12): (120, 4), (1, 3): (31, 1)}


def test_recent_window_inclusive(spark):
    t = 1_000_000
    ev = spark.createDataFrame([(1, t), (2, t - 120_000), (3, t - 120_001)], "player_id int, ts_start long")
    assert sorted(r.player_id for r in M.recent(ev).collect()) == [1, 2]


def test_route_segments_fuse_and_drop_last(spark):
    tr = spark.createDataFrame([(1, ts, 0.0, 0.0) for ts in range(0, 6000, 40)], "player_id int, ts_ms long, x double, y double")
    ev = spark.createDataFrame([(1, 0, 80), (1, 120, 200), (1, 5000, 5080)], "player_id int, ts_start long, ts_end long")
    seg = RT.route_segments(RT.event_routes(ev, tr, ["player_id"]), ["player_id"], seg_rows=2).collect()
    # the first two events are 0.04 s apart and fuse into one segment; the last one is dropped
    assert sorted(r.ts_ms for r in seg) == [0, 40, 80, 120, 160, 200]
    assert {r.segment_id for r in seg} == {1} and seg[0].x == 52.5


def test_top_k_ties_are_deterministic(spark):
    rows = [(p, 0, p, 1000 * p, 1.0, 0.5, 1.0, 2.0, "Feint", 50.0) for p in range(1, 15)]
    df = spark.createDataFrame(rows, "player_id int, team int, jersey_number int, ts_start long, duration double, "
                                     "v_init double, max_acc double, max_speed double, event_class string, percAcc double")
    got = [r["player"] for r in M.top_recent_percacc(df).collect()]
    assert got == [f"CH-{p}" for p in range(1, 11)]


def test_share_scoped_per_match(spark):
    rows = [(1, 1, 0, 7, 30.0), (1, 2, 1, 9, 10.0), (2, 1, 0, 7, 5.0), (2, 3, 1, 4, 5.0)]
    df = spark.createDataFrame(rows, "match_id int, player_id int, team int, jersey_number int, percAcc double")
    got = {(r.match_id, r.player_id): r.percAccperc
           for r in M.percacc_share(df, ["match_id", "player_id"], scope=["match_id"]).collect()}
    assert got == {(1, 1): 75.0, (1, 2): 25.0, (2, 1): 50.0, (2, 3): 50.0}
    whole = {r.player_id: r.percAccperc for r in M.percacc_share(df.where("match_id = 1")).collect()}
    assert whole == {1: 75.0, 2: 25.0}
