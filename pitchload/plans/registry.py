"""Registered queries (one per operator ID of the survey) and their DuckDB oracles.

Every query reads the driver tables (or files Spark derives from them) in full.
``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is DuckDB SQL over
the same tables with the same column names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators import ingest as I
from pitchload.operators import kinematics as K
from pitchload.operators import marts as M
from pitchload.operators import reshape as R
from pitchload.operators import routes as RT
from pitchload.operators import scoring as SC
from pitchload.operators import zones as Z
from pitchload.plans import derived as D
from pitchload.plans import oracle as O
from pitchload.plans.batch import Chain
from pitchload.session import cut
from pitchload.sinks import keyed_log as KL
from pitchload.sinks import tables as TB
from pitchload.sinks import writers as W
from pitchload.sources import files as FS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = ["player_id"]
KICKOFF_EPOCH_MS = 1559763900000       # 2019-06-05T20:45:00.000+0100
FOCUS_PLAYER = 2                       # the player shown by the route view


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _sql(*ctes: str) -> Callable[[str], str]:
    return lambda select: O.with_ctes(*ctes) + select


RAW = _sql(O.TRK)
TRK = _sql(O.TRK, O.TRACKING)
ENR = _sql(O.TRK, O.TRACKING, O.ENRICHED)
EXT = _sql(*O.BASE_EVENTS)
MRG = _sql(*O.BASE_EVENTS, O.MERGED)
FLT = _sql(*O.BASE_EVENTS, O.MERGED, O.FILTERED)
THR = _sql(*O.BASE_EVENTS, O.MERGED, O.FILTERED, O.THRESHOLDS)
SCO = _sql(*O.BASE_SCORED)

EV_COLS = ["player_id", "team", "jersey_number", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed"]
EV_SQL = ", ".join(EV_COLS)

PERIODS_SQL = """per AS (SELECT min(frame_no) lo, max(frame_no) hi FROM raw),
pds AS (SELECT 0 AS half, lo AS start_frame, CAST(floor((lo + hi) / 2e0) AS BIGINT) - 10 AS end_frame FROM per
        UNION ALL SELECT 1, CAST(floor((lo + hi) / 2e0) AS BIGINT) + 10, hi FROM per)"""
OBJ_SQL = """pobj AS (SELECT frame_no, CAST(row_number() OVER (PARTITION BY frame_no ORDER BY player_id) - 1 AS INTEGER) pos,
                    team, player_id AS target_id, jersey_number, x, y, speed FROM raw),
nobj AS (SELECT frame_no, CAST(count(*) AS INTEGER) n, min(x) mx, min(y) my, max(speed) ms FROM raw GROUP BY frame_no)"""


def _chain(spark, sf_dir) -> Chain:
    return Chain(spark, sf_dir)


# ---------------------------------------------------------------- kinematics / zones
# floating sums depend on summation order, which differs between engines: the
# registered sums are rounded to 6 decimals (micrometres) on both sides
@q("agg_zone_distance", ENR('SELECT team, jersey_number, speedzone AS "speedZone", round_even(sum(dist), 6) AS total_distance '
                            "FROM enriched WHERE speedzone IS NOT NULL GROUP BY ALL"))
def agg_zone_distance(spark, sf):
    z = Z.zone_distance(_chain(spark, sf).rows())
    return z.select("team", "jersey_number", "speedZone", S.round_half_even("total_distance", 6).alias("total_distance"))


@q("win_lag_rate", TRK("SELECT player_id, ts_ms, x, y, speed, acc_actual, acc_event FROM tracking"))
def win_lag_rate(spark, sf):
    return _chain(spark, sf).tracking().select("player_id", "ts_ms", "x", "y", "speed", "acc_actual", "acc_event")


_ALT_A = "(speed - lag(speed) OVER w) / 4e-1"
_ALT_SQL = RAW(f"""SELECT player_id, ts_ms, speed,
  (l3 + l2 + l1) / 3e0 AS acc_actual,
  CASE WHEN rn >= 12 THEN (l10 + l9 + l8 + l7 + l6 + l5 + l4 + l3 + l2 + l1) / 10e0 ELSE 0e0 END AS acc_event
FROM (SELECT *, {', '.join(f'lag(a, {i}) OVER w AS l{i}' for i in range(1, 11))}
      FROM (SELECT *, {_ALT_A} AS a FROM raw WINDOW w AS (PARTITION BY player_id ORDER BY rn))
      WINDOW w AS (PARTITION BY player_id ORDER BY rn))
WHERE rn >= 5""")


@q("win_trailing_mean_rate", _ALT_SQL)
def win_trailing_mean_rate(spark, sf):
    return K.trailing_mean_rate(_chain(spark, sf).raw(), KEYS).select(
        "player_id", "ts_ms", "speed", "acc_actual", "acc_event")


@q("win_step_distance", RAW("""SELECT player_id, ts_ms, x, y, dist FROM (
  SELECT player_id, ts_ms, x / 100e0 AS x, y / 100e0 AS y,
         sqrt((lag(x / 100e0) OVER w - x / 100e0) ** 2 + (lag(y / 100e0) OVER w - y / 100e0) ** 2) AS dist
  FROM raw WINDOW w AS (PARTITION BY player_id ORDER BY rn)) WHERE dist IS NOT NULL"""))
def win_step_distance(spark, sf):
    return K.covered_distance(_chain(spark, sf).raw(), KEYS).select("player_id", "ts_ms", "x", "y", "dist")


@q("win_rising_edge", ENR("SELECT player_id, ts_ms, acc_event, start_event FROM enriched"))
def win_rising_edge(spark, sf):
    return K.rising_edge(_chain(spark, sf).tracking(), KEYS).select("player_id", "ts_ms", "acc_event", "start_event")


@q("fn_units", RAW("SELECT player_id, ts_ms, x / 100e0 AS x_m, y / 100e0 AS y_m, speed * 3.6e0 AS speed_kmh FROM raw"))
def fn_units(spark, sf):
    return _chain(spark, sf).raw().select("player_id", "ts_ms", S.cm_to_m("x").alias("x_m"),
                                          S.cm_to_m("y").alias("y_m"), S.mps_to_kmh("speed").alias("speed_kmh"))


@q("fn_speed_zone", ENR("SELECT player_id, ts_ms, speed, speedzone FROM enriched"))
def fn_speed_zone(spark, sf):
    return _chain(spark, sf).rows().select("player_id", "ts_ms", "speed", "speedzone")


_ZR = ", ".join(f"round_even(sum(CASE WHEN speedzone = {z} THEN dist ELSE 0e0 END) OVER w, 6) AS dist_{z}"
                for z in range(1, 6))


@q("agg_zone_running", ENR(f"""SELECT player_id, ts_ms, team, jersey_number, {_ZR}
  FROM enriched WINDOW w AS (PARTITION BY player_id ORDER BY rn ROWS UNBOUNDED PRECEDING)
  QUALIFY rn > min(rn) OVER (PARTITION BY player_id)"""))
def agg_zone_running(spark, sf):
    r = Z.zone_running(_chain(spark, sf).rows(), KEYS, first_rn=K.SMALL_LAG + 2)
    return r.select("player_id", "ts_ms", "team", "jersey_number",
                    *[S.round_half_even(f"dist_{z}", 6).alias(f"dist_{z}") for z in range(1, 6)])


_ZONE_LONG_SQL = ENR("""SELECT CAST(team AS INTEGER) AS team, CAST(jersey_number AS INTEGER) AS player,
  CAST(z AS VARCHAR) AS speedzone, round_even(coalesce(d, 0e0), 6) AS dist
FROM (SELECT DISTINCT player_id, team, jersey_number FROM enriched) p
CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS z) zz
LEFT JOIN (SELECT player_id, speedzone, sum(dist) AS d FROM enriched WHERE speedzone IS NOT NULL GROUP BY ALL) s
  ON s.player_id = p.player_id AND s.speedzone = zz.z""")


def _zone_long(df):
    return df.select(F.col("team").cast("int").alias("team"), F.col("player").cast("int").alias("player"),
                     "speedzone", S.round_half_even("dist", 6).alias("dist"))


@q("reshape_zone_melt", _ZONE_LONG_SQL)
def reshape_zone_melt(spark, sf):
    return _zone_long(R.zone_melt(Z.zone_snapshot(_chain(spark, sf).rows(), KEYS)))


@q("src_zone_snapshot", _ZONE_LONG_SQL)
def src_zone_snapshot(spark, sf):
    path = D.write_zone_snapshot(Z.zone_snapshot(_chain(spark, sf).rows(), KEYS))
    return _zone_long(R.zone_melt(FS.read_zone_snapshot(spark, path)))


@q("agg_zone_km", ENR("""SELECT CASE team WHEN 0 THEN 'CH' WHEN 1 THEN 'PT' ELSE CAST(team AS VARCHAR) END AS team,
  jersey_number AS player, CAST(speedzone AS DOUBLE) AS speedzone, round_even(d / 1000e0, 3) AS dist,
  (CASE team WHEN 0 THEN 'CH' WHEN 1 THEN 'PT' ELSE CAST(team AS VARCHAR) END) || '-' || CAST(jersey_number AS VARCHAR) AS team_pl
FROM (SELECT team, jersey_number, speedzone, sum(dist) AS d FROM enriched WHERE speedzone IS NOT NULL GROUP BY ALL)"""))
def agg_zone_km(spark, sf):
    z = Z.zone_distance(_chain(spark, sf).rows())
    return Z.zone_km(z.select("team", F.col("jersey_number").alias("player"),
                              F.col("speedZone").alias("speedzone"), F.col("total_distance").alias("dist")))


@q("sort_team_jersey", ENR("""SELECT team, jersey_number, speedzone AS "speedZone", round_even(sum(dist), 6) AS total_distance
  FROM enriched WHERE speedzone IS NOT NULL GROUP BY ALL ORDER BY team, jersey_number, "speedZone\""""))
def sort_team_jersey(spark, sf):
    z = Z.zone_distance(_chain(spark, sf).rows())
    return z.select("team", "jersey_number", "speedZone", S.round_half_even("total_distance", 6).alias("total_distance")) \
            .orderBy("team", "jersey_number", "speedZone")


@q("reshape_zone_mask", ENR("SELECT player_id, ts_ms, speedzone, "
                            + ", ".join(f"CASE WHEN speedzone = {i} THEN y END AS y_{i}" for i in range(1, 6))
                            + " FROM enriched"))
def reshape_zone_mask(spark, sf):
    return R.zone_mask(_chain(spark, sf).rows().select("player_id", "ts_ms", "speedzone", "y")).drop("y")


_LEAD_SQL = TRK("""SELECT player_id, t1, t2, v1, v2, color FROM (
  SELECT player_id, ts_ms / 1000e0 AS t1, lead(ts_ms / 1000e0) OVER w AS t2, speed AS v1, lead(speed) OVER w AS v2,
         CASE WHEN acc_actual >= 0 THEN 'green' ELSE 'red' END AS color
  FROM tracking WINDOW w AS (PARTITION BY player_id ORDER BY rn)) WHERE t2 IS NOT NULL""")


def _lead(spark, sf):
    t = _chain(spark, sf).tracking().withColumn("t", F.col("ts_ms") / F.lit(1000.0))
    return RT.lead_segments(t, KEYS, "t", "speed", "acc_actual").select("player_id", "t1", "t2", "v1", "v2", "color")


q("win_lead_segments", _LEAD_SQL)(_lead)


@q("fn_acc_sign", TRK("SELECT player_id, ts_ms, CASE WHEN acc_actual >= 0 THEN 'green' ELSE 'red' END AS color FROM tracking"))
def fn_acc_sign(spark, sf):
    return _chain(spark, sf).tracking().select("player_id", "ts_ms", S.acc_sign("acc_actual").alias("color"))


# ---------------------------------------------------------------- events
@q("win_extract_events", EXT(f"SELECT {EV_SQL} FROM extracted"))
def win_extract_events(spark, sf):
    return _chain(spark, sf).extracted().select(*EV_COLS)


@q("flt_positive_duration", EXT(f"SELECT {EV_SQL} FROM extracted WHERE duration > 0"))
def flt_positive_duration(spark, sf):
    return _chain(spark, sf).extracted().where(F.col("duration") > 0).select(*EV_COLS)


@q("win_merge_events", MRG(f"SELECT {EV_SQL} FROM merged"))
def win_merge_events(spark, sf):
    return _chain(spark, sf).merged().select(*EV_COLS)


@q("flt_min_action", FLT(f"SELECT {EV_SQL} FROM filtered"))
def flt_min_action(spark, sf):
    return _chain(spark, sf).filtered().select(*EV_COLS)


@q("agg_median_thresholds", THR("SELECT acc_median, speed_median FROM thr"))
def agg_median_thresholds(spark, sf):
    return _chain(spark, sf).thresholds()


@q("src_history_csv", THR("SELECT acc_median, speed_median FROM thr"))
def src_history_csv(spark, sf):
    path = D.write_history_csv(_chain(spark, sf).filtered())
    hist = FS.read_history_csv(spark, path)
    # no event key in the history file: split ties on the values themselves
    return SC.class_thresholds(hist)


@q("fn_event_class", SCO(f"SELECT {EV_SQL}, event_class FROM classed"))
def fn_event_class(spark, sf):
    return _chain(spark, sf).classified().select(*EV_COLS, "event_class")


@q("agg_linear_fit", FLT("""SELECT round_even(slope, 9) AS slope, round_even((sy - slope * sx) / n, 9) AS intercept,
  CAST(n AS BIGINT) AS n_points FROM (
  SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM (
    SELECT CAST(count(*) AS DOUBLE) n, sum(v_init * 3.6e0) sx, sum(max_acc) sy,
           sum((v_init * 3.6e0) * (v_init * 3.6e0)) sxx, sum((v_init * 3.6e0) * max_acc) sxy FROM filtered))"""))
def agg_linear_fit(spark, sf):
    f = _chain(spark, sf).filtered().withColumn("v_kmh", S.mps_to_kmh("v_init"))
    r = SC.linear_fit(f, "v_kmh", "max_acc")
    return r.select(S.round_half_even("slope", 9).alias("slope"), S.round_half_even("intercept", 9).alias("intercept"), "n_points")


@q("fn_max_voluntary_acc", FLT(f"""SELECT player_id, ts_start, v_init * 3.6e0 AS v_init_kmh,
  {SC.FIT_SLOPE!r}e0 * (v_init * 3.6e0) + {SC.FIT_INTERCEPT!r}e0 AS amax_vol FROM filtered"""))
def fn_max_voluntary_acc(spark, sf):
    f = _chain(spark, sf).filtered()
    return f.select("player_id", "ts_start", S.mps_to_kmh("v_init").alias("v_init_kmh"),
                    S.max_voluntary_acc(S.mps_to_kmh("v_init"), SC.FIT_SLOPE, SC.FIT_INTERCEPT).alias("amax_vol"))


@q("fn_perc_acc", SCO(f'SELECT {EV_SQL}, event_class, "percAcc" FROM scored'))
def fn_perc_acc(spark, sf):
    return _chain(spark, sf).scored().select(*EV_COLS, "event_class", "percAcc")


@q("flt_min_percacc", SCO(f'SELECT {EV_SQL}, "percAcc" FROM scored WHERE "percAcc" > 10e0'))
def flt_min_percacc(spark, sf):
    return _chain(spark, sf).scored().where(F.col("percAcc") > S.MIN_PERCACC_ROUTE).select(*EV_COLS, "percAcc")


@q("flt_player", SCO(f'SELECT {EV_SQL}, "percAcc" FROM scored WHERE player_id = {FOCUS_PLAYER}'))
def flt_player(spark, sf):
    """One player's events from the stored, bucketed table: one bucket is read."""
    table = TB.store_events(_chain(spark, sf).scored(), D.scratch(spark, "events-bucketed"), KEYS)
    return TB.events_of(spark, table, FOCUS_PLAYER).select(*EV_COLS, "percAcc")


@q("flt_recent", SCO(f'SELECT {EV_SQL}, "percAcc" FROM scored WHERE ts_start >= (SELECT max(ts_start) - 120000 FROM scored)'))
def flt_recent(spark, sf):
    return M.recent(_chain(spark, sf).scored()).select(*EV_COLS, "percAcc")


_LABEL = "(CASE team WHEN 0 THEN 'CH' WHEN 1 THEN 'PT' ELSE CAST(team AS VARCHAR) END)"


def _tod(ms: str) -> str:
    t = f"(({ms}) % 86400000)"
    return (f"printf('%02d:%02d:%02d.%03d', CAST(floor({t} / 3600000) AS BIGINT), "
            f"CAST(floor(({t} % 3600000) / 60000) AS BIGINT), CAST(floor(({t} % 60000) / 1000) AS BIGINT), "
            f"CAST({t} % 1000 AS BIGINT))")


def _display_sql(src: str, top: bool) -> str:
    order = ' ORDER BY "percAcc" DESC, player_id, ts_start LIMIT 10' if top else ""
    where = " WHERE ts_start >= (SELECT max(ts_start) - 120000 FROM scored)" if top else ""
    return SCO(f"""SELECT {_LABEL} || '-' || CAST(jersey_number AS VARCHAR) AS "player",
  {_tod(f'ts_start + {M.KICKOFF_WALL_MS}')} AS "event start",
  round_even(duration, 2) AS "duration[s]", round_even(round_even(v_init, 2) * 3.6e0, 3) AS "v init[km/h]",
  round_even(max_acc, 2) AS "max acc[m/s²]", round_even(round_even(max_speed, 2) * 3.6e0, 3) AS "max speed[km/h]",
  event_class AS "event class", round_even("percAcc", 2) AS "percAcc"
FROM (SELECT * FROM {src}{where}{order})""")


@q("top_recent_percacc", _display_sql("scored", True))
def top_recent_percacc(spark, sf):
    return M.top_recent_percacc(_chain(spark, sf).scored())


def _display_all(spark, sf):
    s = _chain(spark, sf).scored()
    r2 = lambda c: S.round_half_even(c, 2)
    n = M.DISPLAY_NAMES
    return s.select(S.team_player_label("team", "jersey_number").alias(n[0]),
                    S.time_of_day(F.col("ts_start") + F.lit(M.KICKOFF_WALL_MS)).alias(n[1]),
                    r2("duration").alias(n[2]), S.round_half_even(S.mps_to_kmh(r2("v_init")), 3).alias(n[3]),
                    r2("max_acc").alias(n[4]), S.round_half_even(S.mps_to_kmh(r2("max_speed")), 3).alias(n[5]),
                    F.col("event_class").alias(n[6]), r2("percAcc").alias(n[7]))


q("fn_rename_columns", _display_sql("scored", False))(_display_all)
q("fn_round_display", _display_sql("scored", False))(_display_all)


@q("fn_time_of_day", SCO(f"SELECT player_id, ts_start, {_tod(f'ts_start + {M.KICKOFF_WALL_MS}')} AS time_of_day FROM scored"))
def fn_time_of_day(spark, sf):
    s = _chain(spark, sf).scored()
    return s.select("player_id", "ts_start", S.time_of_day(F.col("ts_start") + F.lit(M.KICKOFF_WALL_MS)).alias("time_of_day"))


@q("fn_team_label", SCO(f"SELECT player_id, ts_start, {_LABEL} AS team, {_LABEL} || '-' || CAST(jersey_number AS VARCHAR) AS team_pl FROM scored"))
def fn_team_label(spark, sf):
    s = _chain(spark, sf).scored()
    return s.select("player_id", "ts_start", S.team_label("team").alias("team"),
                    S.team_player_label("team", "jersey_number").alias("team_pl"))


_SHARE_SQL = SCO(f"""SELECT player_id, round_even(p, 6) AS "percAcc", {_LABEL} AS team, jersey_number,
  round_even(p / (SELECT sum("percAcc") FROM scored) * 100e0, 6) AS "percAccperc",
  {_LABEL} || '-' || CAST(jersey_number AS VARCHAR) AS team_pl
FROM (SELECT player_id, sum("percAcc") AS p, max(team) AS team, max(jersey_number) AS jersey_number FROM scored GROUP BY player_id)""")


def _share_cols(df):
    return df.select("player_id", S.round_half_even("percAcc", 6).alias("percAcc"), "team", "jersey_number",
                     S.round_half_even("percAccperc", 6).alias("percAccperc"), "team_pl")


@q("agg_percacc_share", _SHARE_SQL)
def agg_percacc_share(spark, sf):
    return _share_cols(M.percacc_share(_chain(spark, sf).scored()))


@q("top_percacc_share", f'SELECT * FROM ({_SHARE_SQL}) ORDER BY "percAcc" DESC, player_id LIMIT 10')
def top_percacc_share(spark, sf):
    return _share_cols(M.top_percacc_share(_chain(spark, sf).scored()))


@q("agg_event_count", SCO(f"""SELECT player_id, event_class, n AS n_events, {_LABEL} AS team,
  jersey_number, {_LABEL} || '-' || CAST(jersey_number AS VARCHAR) AS team_pl
FROM (SELECT player_id, event_class, count("percAcc") AS n, max(team) AS team, max(jersey_number) AS jersey_number
      FROM scored GROUP BY player_id, event_class)"""))
def agg_event_count(spark, sf):
    return M.event_count(_chain(spark, sf).scored())


_PLAYERS_SQL = SCO(f"""SELECT DISTINCT player_id, {_LABEL} AS team, jersey_number,
  {_LABEL} || '-' || CAST(jersey_number AS VARCHAR) AS team_pl FROM scored""")


@q("agg_player_labels", _PLAYERS_SQL)
def agg_player_labels(spark, sf):
    return M.player_labels(_chain(spark, sf).scored())


@q("set_distinct", SCO("SELECT DISTINCT player_id FROM scored"))
def set_distinct(spark, sf):
    return _chain(spark, sf).scored().select("player_id").distinct()


@q("top_latest_events", SCO("""SELECT player_id, ts_start, event_class, "percAcc", ts_start / 1000e0 + 4e-2 AS video_offset_s
  FROM scored ORDER BY ts_start DESC, player_id DESC LIMIT 10"""))
def top_latest_events(spark, sf):
    return M.latest_events(_chain(spark, sf).scored())


@q("fn_video_offset", SCO(f"""SELECT player_id, ts_start,
  ((ts_start + {KICKOFF_EPOCH_MS}) - {KICKOFF_EPOCH_MS}) / 1000e0 + 4e-2 AS video_offset_s FROM scored"""))
def fn_video_offset(spark, sf):
    s = _chain(spark, sf).scored().withColumn("_abs", F.col("ts_start") + F.lit(KICKOFF_EPOCH_MS))
    kick = S.parse_iso_ms(F.lit(S.KICKOFF_VIDEO))
    return s.select("player_id", "ts_start", S.video_offset_s("_abs", kick).alias("video_offset_s"))


@q("fn_alert_band", SCO("""SELECT player_id, ts_start, "percAcc",
  CASE WHEN "percAcc" > 180e0 THEN 'red' WHEN "percAcc" > 150e0 AND "percAcc" < 180e0 THEN 'orange' END AS band FROM scored"""))
def fn_alert_band(spark, sf):
    s = _chain(spark, sf).scored()
    return s.select("player_id", "ts_start", "percAcc", S.alert_band("percAcc").alias("band"))


def _iso_sql(col: str) -> str:
    loc = f"({col} + {KICKOFF_EPOCH_MS} + 3600000)"
    tod = _tod(loc)
    return (f"strftime(DATE '1970-01-01' + CAST(floor({loc} / 86400000) AS INTEGER), '%Y-%m-%d') || 'T' || "
            f"{tod} || '+0100'")


@q("fn_format_ts", SCO(f"SELECT player_id, ts_start, {_iso_sql('ts_start')} AS ts_start_iso FROM scored"))
def fn_format_ts(spark, sf):
    s = _chain(spark, sf).scored()
    return s.select("player_id", "ts_start",
                    S.format_iso_ms(F.col("ts_start") + F.lit(KICKOFF_EPOCH_MS)).alias("ts_start_iso"))


@q("fn_parse_ts", SCO(f"SELECT player_id, ts_start, ts_start + {KICKOFF_EPOCH_MS} AS parsed_ms FROM scored"))
def fn_parse_ts(spark, sf):
    s = _chain(spark, sf).scored()
    txt = S.format_iso_ms(F.col("ts_start") + F.lit(KICKOFF_EPOCH_MS))
    return s.select("player_id", "ts_start", S.parse_iso_ms(txt).alias("parsed_ms"))


@q("fn_time_diff", SCO("SELECT player_id, ts_start, duration AS time_diff_s FROM scored"))
def fn_time_diff(spark, sf):
    s = _chain(spark, sf).scored()
    a = S.parse_iso_ms(S.format_iso_ms(F.col("ts_start") + F.lit(KICKOFF_EPOCH_MS)))
    b = S.parse_iso_ms(S.format_iso_ms(F.col("ts_end") + F.lit(KICKOFF_EPOCH_MS)))
    return s.select("player_id", "ts_start", S.time_diff_s(a, b).alias("time_diff_s"))


@q("fn_record_json", SCO(f'SELECT {EV_SQL}, event_class, "percAcc" FROM scored'))
def fn_record_json(spark, sf):
    s = _chain(spark, sf).scored()
    j = s.select(S.record_json(*s.columns).alias("j"))
    back = j.select(F.from_json("j", s.schema).alias("r")).select("r.*")
    return back.select(*EV_COLS, "event_class", "percAcc")


# ---------------------------------------------------------------- routes
_ROUTE_SEL = """SELECT e.player_id, e.ts_start, t.ts_ms, t.x, t.y, t.speedzone
FROM (SELECT * FROM scored WHERE "percAcc" > 10e0) e JOIN enriched t
  ON t.player_id = e.player_id AND t.ts_ms BETWEEN e.ts_start AND e.ts_end"""
_ROUTE_SQL = SCO(_ROUTE_SEL)


def _routes(spark, sf):
    c = _chain(spark, sf)
    ev = c.scored().where(F.col("percAcc") > S.MIN_PERCACC_ROUTE)
    return RT.event_routes(ev, c.enriched().select("player_id", "ts_ms", "x", "y", "speedzone"), KEYS)


@q("join_event_routes", _ROUTE_SQL)
def join_event_routes(spark, sf):
    """Routes of the stored events over the stored tracking rows: both bucketed alike, no exchange under the join."""
    c, folder = _chain(spark, sf), D.scratch(spark, "routes")
    ev = c.scored().where(F.col("percAcc") > S.MIN_PERCACC_ROUTE).select("player_id", "ts_start", "ts_end")
    tracking = TB.store_by_time(c.enriched().select("player_id", "ts_ms", "x", "y", "speedzone"), f"{folder}/tracking", KEYS)
    events = TB.store_by_time(ev, f"{folder}/events", KEYS, "ts_start", "ts_end")
    return TB.stored_routes(spark, events, tracking, KEYS).select("player_id", "ts_start", "ts_ms", "x", "y", "speedzone")


@q("fn_shift_pitch", SCO(f"""SELECT player_id, ts_start, ts_ms, x + 52.5e0 AS x, y + 34e0 AS y FROM ({_ROUTE_SEL})"""))
def fn_shift_pitch(spark, sf):
    r = _routes(spark, sf)
    return r.select("player_id", "ts_start", "ts_ms", S.shift_pitch_x("x").alias("x"), S.shift_pitch_y("y").alias("y"))


@q("win_route_segments", SCO(f"""SELECT player_id, segment_id, ts_start, ts_ms, x + 52.5e0 AS x, y + 34e0 AS y, speedzone FROM (
  SELECT *, CAST(sum(brk) OVER (PARTITION BY player_id ORDER BY ts_start, ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM (
    SELECT *, CASE WHEN lag(ts_ms) OVER w IS NULL OR ts_ms - lag(ts_ms) OVER w <> 40 THEN 1 ELSE 0 END AS brk
    FROM ({_ROUTE_SEL}) WINDOW w AS (PARTITION BY player_id ORDER BY ts_start, ts_ms)))
QUALIFY segment_id < max(segment_id) OVER (PARTITION BY player_id)"""))
def win_route_segments(spark, sf):
    return RT.route_segments(_routes(spark, sf), KEYS)


# ---------------------------------------------------------------- offline preparation
def _frames(spark, sf):
    c = _chain(spark, sf)
    path = D.write_frames_text(c.raw())
    return c, FS.read_wide_frames(spark, path)


@q("src_wide_frames", RAW("""SELECT frame_id, obj_pos, n_fields FROM (
  SELECT frame_no AS frame_id, CAST(row_number() OVER (PARTITION BY frame_no ORDER BY player_id) - 1 AS INTEGER) AS obj_pos,
         6 AS n_fields FROM raw
  UNION ALL SELECT frame_no, CAST(count(*) AS INTEGER), 6 FROM raw GROUP BY frame_no
  UNION ALL SELECT frame_no, CAST(count(*) + 1 AS INTEGER), 2 FROM raw GROUP BY frame_no
  UNION ALL SELECT frame_no, CAST(count(*) + 2 AS INTEGER), 1 FROM raw GROUP BY frame_no)"""))
def src_wide_frames(spark, sf):
    _, lines = _frames(spark, sf)
    parts = F.split(F.col("value"), ":")
    objs = lines.select(F.element_at(parts, 1).cast("long").alias("frame_id"),
                        F.posexplode(F.split(F.element_at(parts, 2), ";")).alias("obj_pos", "obj"))
    return objs.select("frame_id", "obj_pos", F.size(F.split("obj", ",")).alias("n_fields"))


def _long_sql(select: str) -> str:
    return O.with_ctes(O.TRK, OBJ_SQL) + select


_LONG = ("SELECT frame_no AS frame_id, pos AS obj_pos, team, target_id, jersey_number, x, y, speed FROM pobj "
         "UNION ALL SELECT frame_no, n, 4, -1, -1, mx, my, ms FROM nobj")


@q("reshape_wide_to_long", _long_sql(_LONG))
def reshape_wide_to_long(spark, sf):
    _, lines = _frames(spark, sf)
    return R.cast_objects(R.wide_to_long(lines))


@q("flt_complete_object", _long_sql(f"SELECT frame_id, obj_pos FROM ({_LONG})"))
def flt_complete_object(spark, sf):
    _, lines = _frames(spark, sf)
    return R.wide_to_long(lines).select(F.col("frame_id").cast("long").alias("frame_id"), "obj_pos")


@q("flt_team_codes", _long_sql("SELECT frame_no AS frame_id, pos AS obj_pos, team, target_id, jersey_number, x, y, speed FROM pobj"))
def flt_team_codes(spark, sf):
    _, lines = _frames(spark, sf)
    return R.drop_team_codes(R.cast_objects(R.wide_to_long(lines)))


@q("fn_cast", _long_sql("""SELECT frame_no AS frame_id, pos AS obj_pos, team FROM pobj
  UNION ALL SELECT frame_no, n, 4 FROM nobj UNION ALL SELECT frame_no, n + 1, 4 FROM nobj
  UNION ALL SELECT frame_no, n + 2, CAST(NULL AS INTEGER) FROM nobj"""))
def fn_cast(spark, sf):
    _, lines = _frames(spark, sf)
    parts = F.split(F.col("value"), ":")
    objs = lines.select(F.element_at(parts, 1).try_cast("long").alias("frame_id"),
                        F.posexplode(F.split(F.element_at(parts, 2), ";")).alias("obj_pos", "obj"))
    return objs.select("frame_id", "obj_pos", S.safe_cast(F.element_at(F.split("obj", ","), 1), "int").alias("team"))


def _meta(spark, sf):
    """Rows with their match (the tables hold one), its periods and its metadata."""
    raw = _chain(spark, sf).raw().withColumn("match_id", F.lit(1).cast("long"))
    path = D.write_match_xml(raw)
    return raw, FS.read_periods(spark, path), FS.read_match(spark, path)


_PER = _sql(O.TRK, PERIODS_SQL)


@q("src_match_meta", _PER("SELECT half, start_frame, end_frame, '20:45:00' AS dt_date, 25 AS fps FROM pds"))
def src_match_meta(spark, sf):
    _, periods, match = _meta(spark, sf)
    return periods.join(match, "match_id").select("half", "start_frame", "end_frame", "dt_date", "fps")


_HALF_SQL = "SELECT r.player_id, r.frame_no, p.half FROM raw r JOIN pds p ON r.frame_no BETWEEN p.start_frame AND p.end_frame"


@q("join_period_range", _PER(_HALF_SQL))
def join_period_range(spark, sf):
    raw, periods, _ = _meta(spark, sf)
    return I.assign_half(raw, periods, frame="frame_no").select("player_id", "frame_no", "half")


@q("set_union_all", _PER(_HALF_SQL))
def set_union_all(spark, sf):
    raw, periods, _ = _meta(spark, sf)
    halves = []
    for h in (0, 1):
        halves.append(I.assign_half(raw, periods.where(F.col("half") == h), frame="frame_no"))
    out = halves[0].unionByName(halves[1])
    return out.select("player_id", "frame_no", "half")


@q("fn_frame_ts", _PER(f"""SELECT r.player_id, r.frame_no, p.half,
  {KICKOFF_EPOCH_MS} + CAST(floor((r.frame_no - (SELECT min(start_frame) FROM pds)) * 1e6 / 25 / 1000e0) AS BIGINT) AS frame_ts_ms
FROM raw r JOIN pds p ON r.frame_no BETWEEN p.start_frame AND p.end_frame"""))
def fn_frame_ts(spark, sf):
    raw, periods, match = _meta(spark, sf)
    halves = I.assign_half(raw, periods, frame="frame_no")
    first = periods.groupBy("match_id").agg(F.min("start_frame").alias("first_frame"))
    m = match.join(first, "match_id").select(
        "match_id",
        S.parse_iso_ms(F.concat(F.lit("2019-06-05T"), F.col("dt_date"), F.lit(".000+0100"))).alias("start_ms"),
        "fps", "first_frame")
    j = halves.join(m, "match_id")
    return I.frame_clock(j, F.col("first_frame"), F.col("fps"), F.col("start_ms"), frame="frame_no") \
            .select("player_id", "frame_no", "half", F.col("ts_ms").alias("frame_ts_ms"))


@q("win_forward_fill", RAW("""SELECT player_id, frame_no,
  CAST(floor((frame_no - (SELECT min(frame_no) FROM raw)) * 1e6 / 25 / 1000e0) AS BIGINT) AS offset_ms FROM raw"""))
def win_forward_fill(spark, sf):
    raw, periods, match = _meta(spark, sf)
    first = periods.groupBy("match_id").agg(F.min("start_frame").alias("first_frame")).join(match, "match_id")
    rows = raw.select("match_id", "player_id", "frame_no").join(first.select("match_id", "first_frame", "fps"), "match_id")
    return I.forward_fill_frame_offset(rows, ["match_id"], "frame_no", ["player_id"], F.col("first_frame"),
                                       F.col("fps")).select("player_id", "frame_no", "offset_ms")


@q("agg_first_per_frame", RAW("""SELECT frame_no, min(player_id) AS player_id FROM raw GROUP BY frame_no
  HAVING frame_no > (SELECT min(frame_no) FROM raw)"""))
def agg_first_per_frame(spark, sf):
    return I.first_per_frame(_chain(spark, sf).raw(), "frame_no", "player_id").select("frame_no", "player_id")


@q("sort_frames", RAW("SELECT frame_no, player_id, ts_ms FROM raw ORDER BY frame_no, player_id"))
def sort_frames(spark, sf):
    return _chain(spark, sf).raw().select("frame_no", "player_id", "ts_ms").orderBy("frame_no", "player_id")


@q("win_dense_player_id", RAW("""SELECT player_id, frame_no, teamjersey, CAST(dense_rank() OVER (ORDER BY teamjersey) AS INTEGER) AS dense_id
  FROM (SELECT *, CAST(CAST(jersey_number AS VARCHAR) || CAST(team AS VARCHAR) AS INTEGER) AS teamjersey FROM raw)"""))
def win_dense_player_id(spark, sf):
    raw = _chain(spark, sf).raw().select("player_id", "frame_no", "team", "jersey_number")
    return I.dense_player_id(raw, out="dense_id").select("player_id", "frame_no", "teamjersey", "dense_id")


@q("fn_teamjersey", RAW("""SELECT DISTINCT team, jersey_number,
  CAST(CAST(jersey_number AS VARCHAR) || CAST(team AS VARCHAR) AS INTEGER) AS teamjersey FROM raw"""))
def fn_teamjersey(spark, sf):
    raw = _chain(spark, sf).raw()
    return raw.select("team", "jersey_number", S.teamjersey("jersey_number", "team").alias("teamjersey")).distinct()


# ---------------------------------------------------------------- stored records and sinks
@q("src_event_snapshot", SCO(f'SELECT {EV_SQL}, event_class, "percAcc" FROM scored'))
def src_event_snapshot(spark, sf):
    s = _chain(spark, sf).scored().select(*EV_COLS, "event_class", "percAcc")
    path = D.write_event_snapshot(s)
    schema = s.schema
    return FS.read_event_snapshot(spark, path, schema)


_CACHE_COLS = ["player_id", "ts_ms", "speed", "speedzone", "dist"]
_CACHE_SQL = ENR(f"""SELECT {', '.join(_CACHE_COLS)} FROM (
  SELECT *, max(ts_ms) OVER (PARTITION BY player_id, CAST(floor(ts_ms / 4000e0) AS BIGINT)) AS gmax FROM enriched)
WHERE gmax >= (SELECT max(ts_ms) - 120000 FROM enriched)""")


def _cache(spark, sf):
    e = _chain(spark, sf).rows().select(*_CACHE_COLS)
    path = D.write_tracking_cache(e, KEYS)
    return FS.read_tracking_cache(spark, path, e.schema)


q("src_tracking_cache", _CACHE_SQL)(_cache)
q("flt_non_null_payload", _CACHE_SQL)(_cache)


@q("sink_tracking_ttl", ENR(f"SELECT {', '.join(_CACHE_COLS)} FROM enriched WHERE ts_ms >= (SELECT max(ts_ms) - 120000 FROM enriched)"))
def sink_tracking_ttl(spark, sf):
    """The cache as it is on disk after the expired slots are deleted; the slot that the bound falls into
    is cut at the bound when it is read."""
    e = cut(_chain(spark, sf).rows().select(*_CACHE_COLS), "cache-rows")
    path = D.scratch(spark, "ttl-cache")
    W.cache_write(e, 0, path, KEYS)
    W.cache_expire(spark, path)
    return W.retained(FS.read_tracking_cache(spark, path, e.schema))


@q("sink_event_append", SCO(f'SELECT {EV_SQL}, event_class, "percAcc" FROM scored'))
def sink_event_append(spark, sf):
    s = _chain(spark, sf).scored().select(*EV_COLS, "event_class", "percAcc")
    path = D.scratch(spark, "event-sink")
    W.event_append(s, 0, path)
    return spark.read.parquet(path).select(*EV_COLS, "event_class", "percAcc")


@q("sink_zone_upsert", ENR("""SELECT team, jersey_number, speedzone AS "speedZone", round_even(sum(dist), 6) AS total_distance
  FROM enriched WHERE speedzone IS NOT NULL GROUP BY ALL"""))
def sink_zone_upsert(spark, sf):
    """Totals upserted after each of six micro-batches, compacted on the way, and the latest value per key."""
    keys = ["team", "jersey_number", "speedZone"]
    e = _chain(spark, sf).rows()
    span = e.agg((F.max("ts_ms") + 1).alias("_hi"))                      # one row
    part = F.expr("ts_ms * 6 div _hi").alias("part")
    shares = cut(Z.zone_distance(e.crossJoin(F.broadcast(span)).select("*", part), group=("part", "team", "jersey_number")), "zone-shares")
    path = D.scratch(spark, "zone-sink")
    for batch in range(6):
        so_far = shares.where(F.col("part") <= batch)
        touched = shares.where(F.col("part") == batch).select(*keys)
        W.zone_upsert(so_far.groupBy(*keys).agg(F.sum("total_distance").alias("total_distance")).join(touched, keys, "left_semi"), batch, path)
        W.zone_compact(spark, path, keys)
    out = W.read_latest(spark, path, keys)
    return out.select(*keys, S.round_half_even("total_distance", 6).alias("total_distance"))


@q("sink_csv_first_n", SCO("""SELECT player_id, ts_start, ts_end, duration, event_class, "percAcc"
  FROM scored ORDER BY ts_start, player_id LIMIT 1201"""))
def sink_csv_first_n(spark, sf):
    s = _chain(spark, sf).scored().select("player_id", "ts_start", "ts_end", "duration", "event_class", "percAcc")
    path = D.scratch(spark, "events-csv")
    W.csv_first_n(s, path, W.CSV_EVENTS, ["ts_start", "player_id"])
    return spark.read.schema(s.schema).option("header", True).csv(path)


@q("sink_csv_zones", ENR("SELECT player_id, ts_ms, speedzone, dist FROM enriched ORDER BY ts_ms, player_id LIMIT 11"))
def sink_csv_zones(spark, sf):
    """The export of the first 11 zone rows."""
    e = _chain(spark, sf).rows().select("player_id", "ts_ms", "speedzone", "dist")
    path = D.scratch(spark, "zones-csv")
    W.csv_first_n(e, path, W.CSV_ZONE_ROWS, ["ts_ms", "player_id"])
    return spark.read.schema(e.schema).option("header", True).csv(path)


@q("sink_tracking_csv", _PER(f"""SELECT {_iso_sql('r.ts_ms')} AS timestamp, r.team, r.jersey_number, r.x, r.y, r.speed, p.half
FROM raw r JOIN pds p ON r.frame_no BETWEEN p.start_frame AND p.end_frame"""))
def sink_tracking_csv(spark, sf):
    raw, periods, _ = _meta(spark, sf)
    h = I.assign_half(raw, periods, frame="frame_no")
    t = h.select(S.format_iso_ms(F.col("ts_ms") + F.lit(KICKOFF_EPOCH_MS)).alias("timestamp"),
                 "team", "jersey_number", "x", "y", "speed", "half")
    path = D.scratch(spark, "tracking-csv")
    W.tracking_csv(t, path)
    return spark.read.schema(t.schema).option("header", True).csv(path)


@q("sink_keyed_stream", SCO(f"""SELECT CAST(player_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY player_id ORDER BY ts_start) AS seq,
  {EV_SQL}, event_class, "percAcc" FROM scored"""))
def sink_keyed_stream(spark, sf):
    """Scored events sent to the keyed log in two batches, the second one twice; read back with their numbers."""
    s = cut(_chain(spark, sf).scored().select(*EV_COLS, "event_class", "percAcc"), "scored")
    path = D.scratch(spark, "keyed-log")
    mid = s.agg(F.floor((F.min("ts_start") + F.max("ts_start")) / 2).alias("_m"))
    parted = s.crossJoin(F.broadcast(mid))        # one row
    for batch, part in ((0, "ts_start <= _m"), (1, "ts_start > _m"), (1, "ts_start > _m")):
        KL.keyed_send(parted.where(part).drop("_m"), batch, path, KEYS)
    return KL.read_log(spark, path).select("key", "seq", F.from_json("value", s.schema).alias("r")).select("key", "seq", "r.*")


# ---------------------------------------------------------------- live path (Structured Streaming)
PARTS = 3
_LIVE: dict[tuple, str] = {}


def _stored_chain(spark, sf) -> Chain:
    """A chain over the tracking view as a table: the live queries read its rows several times (bounds of the
    time, one part after the other, thresholds), and the view numbers all of them for each reading."""
    return Chain(spark, sf, source=cut(_chain(spark, sf).raw(), "tracking"))


def _arrivals(spark, c: Chain, src: str):
    """arrive(k) writes the k-th part of the time as JSON records. Timestamps go through ISO text."""
    raw = c.raw()
    ing = raw.select(S.format_iso_ms(F.col("ts_ms") + F.lit(KICKOFF_EPOCH_MS)).alias("timestamp"), "team",
                     "jersey_number", "x", "y", "speed", F.lit(0).alias("half"),
                     S.teamjersey("jersey_number", "team").alias("teamjersey"), "player_id", "ts_ms")
    hi = raw.agg(F.max("ts_ms")).first()[0] + 1
    return lambda k: ing.where((F.col("ts_ms") >= hi * k // PARTS) & (F.col("ts_ms") < hi * (k + 1) // PARTS)) \
        .drop("ts_ms").write.mode("append").json(src)


def _live(spark, sf):
    """Replay the tracking rows in three parts of the time: each part arrives as a set of JSON
    files, the live job reads it (``availableNow``) and is restarted from its checkpoint for
    the next. Returns the sink folder. The queries of one application that show another
    table of the same job read one run of it."""
    from pitchload.streaming import live
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LIVE:
        c = _stored_chain(spark, sf)
        src, sink, name = D.scratch(spark, "live-src"), D.scratch(spark, "live-sink"), f"live-{uuid.uuid4().hex[:10]}"
        arrive, thresholds = _arrivals(spark, c, src), cut(c.thresholds(), "thresholds")
        for k in range(PARTS):
            arrive(k)
            live.start_live(spark, src, sink, thresholds, name=name).awaitTermination()
        _LIVE[key] = sink
    return _LIVE[key]


def _live_table(spark, sf, kind: str) -> DataFrame:
    from pitchload.streaming import live
    return live.committed(spark, _live(spark, sf), kind)


def _since_kickoff(df, cols):
    return df.select(*[(F.col(c) - F.lit(KICKOFF_EPOCH_MS)).alias(c) if c in ("ts_ms", "ts_start", "ts_end")
                       else F.col(c) for c in cols])


@q("st_event_pipeline", SCO(f'SELECT {EV_SQL}, event_class, "percAcc" FROM scored'))
def st_event_pipeline(spark, sf):
    return _since_kickoff(_live_table(spark, sf, "scored"), EV_COLS + ["event_class", "percAcc"])


@q("st_keyed_state", MRG(f"SELECT {EV_SQL} FROM merged"))
def st_keyed_state(spark, sf):
    return _since_kickoff(_live_table(spark, sf, "merged"), EV_COLS)


@q("st_gap_close", EXT(f"SELECT {EV_SQL} FROM extracted"))
def st_gap_close(spark, sf):
    return _since_kickoff(_live_table(spark, sf, "extracted"), EV_COLS)


_EN_COLS = ["player_id", "ts_ms", "x", "y", "speed", "acc_actual", "acc_event", "start_event", "dist", "speedzone"]


def _tracking_log(spark, c: Chain) -> tuple[str, str]:
    """(path, offsets): the tracking records in a keyed log of two batches, cut in the middle of the time,
    and the offsets at which the second one starts."""
    raw = c.raw()
    ing = raw.select(S.format_iso_ms(F.col("ts_ms") + F.lit(KICKOFF_EPOCH_MS)).alias("timestamp"), "team", "jersey_number", "x", "y", "speed",
                     F.lit(0).alias("half"), S.teamjersey("jersey_number", "team").alias("teamjersey"), "player_id", "ts_ms")
    path, mid = D.scratch(spark, "tracking-log"), (raw.agg(F.max("ts_ms")).first()[0] + 1) // 2
    KL.keyed_send(ing.where(F.col("ts_ms") < mid), 0, path, KEYS, order="ts_ms")
    lanes = KL.read_log(spark, path).groupBy("lane").count().collect()       # a row a lane
    KL.keyed_send(ing.where(F.col("ts_ms") >= mid), 1, path, KEYS, order="ts_ms")
    return path, json.dumps({r[0]: r[1] for r in lanes})


@q("src_tracking_stream", ENR(f"SELECT {', '.join(_EN_COLS)} FROM enriched"))
def src_tracking_stream(spark, sf):
    """The live job fed from the keyed log, from its earliest offset on."""
    from pitchload.streaming import live
    c = _stored_chain(spark, sf)
    path, _ = _tracking_log(spark, c)
    sink = D.scratch(spark, "live-sink")
    live.start_live(spark, None, sink, c.thresholds(), name=f"live-{uuid.uuid4().hex[:10]}",
                    stream=live.read_ingestion_log(spark, path)).awaitTermination()
    return _since_kickoff(live.committed(spark, sink, "enriched"), _EN_COLS)


@q("st_zone_running", ENR(f"""SELECT player_id, ts_ms, team, jersey_number, {_ZR}
  FROM enriched WINDOW w AS (PARTITION BY player_id ORDER BY rn ROWS UNBOUNDED PRECEDING)
  QUALIFY rn > min(rn) OVER (PARTITION BY player_id)"""))
def st_zone_running(spark, sf):
    """The live half of agg_zone_running: the zone map of the keyed state, emitted with every row."""
    z = _since_kickoff(_live_table(spark, sf, "zone_map"), ["player_id", "ts_ms", "team", "jersey_number", *[f"dist_{z}" for z in range(1, 6)]])
    return z.select("player_id", "ts_ms", "team", "jersey_number",
                    *[S.round_half_even(f"dist_{z}", 6).alias(f"dist_{z}") for z in range(1, 6)])


@q("st_earliest_offset", RAW("""SELECT 'earliest' AS start, player_id, ts_ms, x, y, speed FROM raw
UNION ALL SELECT 'given', player_id, ts_ms, x, y, speed FROM raw WHERE ts_ms >= (SELECT (max(ts_ms) + 1) // 2 FROM raw)"""))
def st_earliest_offset(spark, sf):
    """What a stream over the log delivers from the earliest offset and from given ones in the middle."""
    from pitchload.streaming import live
    path, middle = _tracking_log(spark, _stored_chain(spark, sf))
    out = D.scratch(spark, "replayed")
    for start, offsets in (("earliest", "earliest"), ("given", middle)):
        live.replay(spark, path, offsets, f"{out}/start={start}")
    rows = spark.read.option("basePath", out).parquet(f"{out}/start=*")
    return _since_kickoff(rows, ["start", "player_id", "ts_ms", "x", "y", "speed"])


_ZONE_SQL = ENR("""SELECT team, jersey_number, speedzone AS "speedZone", round_even(sum(dist), 6) AS total_distance
  FROM enriched WHERE speedzone IS NOT NULL GROUP BY ALL""")


def _rounded_totals(out):
    return out.select("team", "jersey_number", "speedZone",
                      S.round_half_even("total_distance", 6).alias("total_distance"))


def _zone_stream(spark, sf, parts: int):
    """The continuous SQL over the enriched rows of the live job, which reach it in ``parts`` steps of whole
    batches; the query is stopped and started anew between them."""
    from pitchload.streaming import live
    src, zs, name = D.scratch(spark, "zone-src"), D.scratch(spark, "zone-stream"), f"zones-{uuid.uuid4().hex[:10]}"
    enriched = _live_table(spark, sf, "enriched")
    for k in range(parts):
        enriched.where(F.col("batch_id") % parts == k).drop("batch_id").write.mode("append").parquet(src)
        live.zone_totals_stream(spark, src, zs, name=name).awaitTermination()
    out = _rounded_totals(W.read_latest(spark, zs, ["team", "jersey_number", "speedZone"]))
    return out.select(F.col("team").cast("int").alias("team"), F.col("jersey_number").cast("int").alias("jersey_number"),
                      F.col("speedZone").cast("int").alias("speedZone"), "total_distance")


@q("st_continuous_zone_sum", _ZONE_SQL)
def st_continuous_zone_sum(spark, sf):
    """Streaming aggregate in update mode: totals of earlier steps stay in the state and grow."""
    return _zone_stream(spark, sf, PARTS)


@q("src_enriched_stream", _ZONE_SQL)
def src_enriched_stream(spark, sf):
    """The declared stream over the enriched rows and its continuous SQL, in one step."""
    return _zone_stream(spark, sf, 1)


@q("st_session_merge", _sql(*O.BASE_EVENTS, O.MERGED.replace("WHERE grp < last_grp", "WHERE true"))(
    f"SELECT {EV_SQL} FROM merged"))
def st_session_merge(spark, sf):
    """Events arrive in three parts, late ones are split off, sessions come out as the watermark passes
    them; the end marker flushes the last ones."""
    from pitchload.streaming import live
    ev = cut(_chain(spark, sf).extracted().select(*EV_COLS), "events")
    hi = ev.agg(F.coalesce(F.max("ts_end"), F.lit(0))).first()[0]
    src, sink, name = D.scratch(spark, "event-src"), D.scratch(spark, "sessions"), uuid.uuid4().hex[:10]
    span = hi // PARTS + 1
    for k in range(PARTS + 1):
        part = ev.where(F.expr(f"ts_start div {span}") == k) if k < PARTS else live.end_marker(spark, ev.schema, hi)
        part.write.mode("append").parquet(src)
        live.split_late(spark.readStream.schema(ev.schema).parquet(src), sink, f"split-{name}").awaitTermination()
        live.session_merge_stream(spark, sink, ev.schema, f"sessions-{name}").awaitTermination()
    return spark.read.parquet(f"{sink}/sessions").select(*EV_COLS)


@q("st_ttl_cache", ENR(f"""SELECT {', '.join(_CACHE_COLS)} FROM enriched
WHERE (CAST(floor(ts_ms / 4000e0) AS BIGINT) + 1) * 4000 > (SELECT max(ts_ms) - 120000 FROM enriched)"""))
def st_ttl_cache(spark, sf):
    """What the live job's cache holds on disk: the slots that reach into the last 120 s."""
    sink = _live(spark, sf)
    schema = _since_kickoff(_live_table(spark, sf, "enriched"), _CACHE_COLS).schema
    return _since_kickoff(FS.read_tracking_cache(spark, f"{sink}/cache", schema), _CACHE_COLS)


_MARTS_SQL = " UNION ALL ".join([
    f"""SELECT 'top' AS mart, "player" AS item, "event start" AS part, "percAcc" AS value FROM ({_display_sql('scored', True)})""",
    f"""SELECT 'share', team_pl, '', "percAccperc" FROM ({_SHARE_SQL})""",
    f"""SELECT 'count', team_pl, event_class, CAST(n_events AS DOUBLE) FROM ({ORACLE['agg_event_count']})""",
    f"""SELECT 'km', team_pl, CAST(CAST(speedzone AS INTEGER) AS VARCHAR), dist FROM ({ORACLE['agg_zone_km']})""",
    f"""SELECT 'labels', team_pl, '', CAST(player_id AS DOUBLE) FROM ({_PLAYERS_SQL})"""])


@q("st_periodic_refresh", _MARTS_SQL)
def st_periodic_refresh(spark, sf):
    """The dashboard's refresh: one live query with a processing-time trigger sees each part as it arrives,
    and its marts are brought up to date after each; what the five marts show at the end, as rows."""
    from pitchload.streaming import live, refresh
    c = _stored_chain(spark, sf)
    src, sink, store = D.scratch(spark, "live-src"), D.scratch(spark, "live-sink"), D.scratch(spark, "marts")
    arrive = _arrivals(spark, c, src)
    arrive(0)
    query = live.start_live(spark, src, sink, c.thresholds(), name=f"live-{uuid.uuid4().hex[:10]}", available_now=False, processing_time="1 second")
    try:
        for k in range(1, PARTS + 1):
            query.processAllAvailable()
            refresh.refresh(spark, sink, store, KEYS)
            if k < PARTS:
                arrive(k)
    finally:
        query.stop()
    m = refresh.marts(spark, store, KEYS, kickoff_wall_ms=M.KICKOFF_WALL_MS - KICKOFF_EPOCH_MS)
    shown = [("top", "top_recent_percacc", F.col("player"), F.col("`event start`"), F.col("percAcc")),
             ("share", "percacc_share", F.col("team_pl"), F.lit(""), S.round_half_even("percAccperc", 6)),
             ("count", "event_count", F.col("team_pl"), F.col("event_class"), F.col("n_events").cast("double")),
             ("km", "zone_km", F.col("team_pl"), F.col("speedzone").cast("int").cast("string"), F.col("dist")),
             ("labels", "player_labels", F.col("team_pl"), F.lit(""), F.col("player_id").cast("double"))]
    return reduce(DataFrame.unionByName, [m[t].select(F.lit(name).alias("mart"), item.alias("item"), part.alias("part"), value.alias("value"))
                                          for name, t, item, part, value in shown])
