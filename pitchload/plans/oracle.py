"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark plans: the event automaton is a recursive
CTE that walks each player's rows one position at a time.
"""

from __future__ import annotations

# fixed values, written out here so that a wrong one in the library shows
SPEED_ZONES_KMH = [(1, 0.0, 11.0), (2, 11.001, 14.0), (3, 14.001, 19.0), (4, 19.001, 23.0), (5, 23.001, 100.0)]
FIT_SLOPE, FIT_INTERCEPT = -0.2231103204008683, 5.870670997437445
TRACKING_SQL = """
SELECT CAST(player_id % 2 AS INT) AS team, player_id AS jersey_number, player_id, frame_no,
       frame_no * 40 + CAST(floor(frame_no / 100e0) AS BIGINT) * 45000 AS ts_ms,
       CAST(-5250 + (frame_no * 25 + player_id * 400) % 10500 AS DOUBLE) AS x,
       CAST(-3400 + (frame_no * 13 + event_id % 50 + player_id * 300) % 6800 AS DOUBLE) AS y,
       abs((frame_no + player_id * 7) % 60 - 30) / 30e0 * 8e0 + ((event_id * 7919) % 101) / 100e0 * 15e-1 AS speed
FROM (SELECT event_id, CAST(user_id % 22 + 1 AS INT) AS player_id,
             row_number() OVER (PARTITION BY user_id % 22 ORDER BY ts, event_id) - 1 AS frame_no FROM events)
"""


def _zone_case(kmh: str) -> str:
    parts = " ".join(f"WHEN {kmh} >= {lo!r}e0 AND {kmh} <= {hi!r}e0 THEN {z}" for z, lo, hi in SPEED_ZONES_KMH)
    return f"CAST(CASE {parts} END AS INTEGER)"


# raw tracking with positions 1..n per player
TRK = f"trk AS ({TRACKING_SQL}),\nraw AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY ts_ms) rn FROM trk)"

# rows after the acceleration step (raw row 9 on), x/y in m
TRACKING = """acc AS (
  SELECT team, jersey_number, player_id, rn, ts_ms, x / 100e0 AS x, y / 100e0 AS y, speed,
         (speed - lag(speed, 8) OVER w) / 32e-2 AS acc_actual,
         CASE WHEN rn > 16 THEN (speed - lag(speed, 16) OVER w) / 64e-2 ELSE 0e0 END AS acc_event
  FROM raw WINDOW w AS (PARTITION BY player_id ORDER BY rn)),
tracking AS (SELECT * FROM acc WHERE rn >= 9)"""

ENRICHED = f"""enr0 AS (
  SELECT *, CASE WHEN lag(acc_event) OVER w <= 0 AND acc_event > 0 THEN 1 ELSE 0 END AS start_event,
         sqrt((lag(x) OVER w - x) ** 2 + (lag(y) OVER w - y) ** 2) AS dist,
         {_zone_case('speed * 3.6e0')} AS speedzone,
         ts_ms - lag(ts_ms) OVER w AS gap
  FROM tracking WINDOW w AS (PARTITION BY player_id ORDER BY rn)),
enriched AS (SELECT * FROM enr0 WHERE rn >= 10)"""

EXTRACTED = """st AS (
  SELECT *, rn - 9 AS i, (rn > 10 AND gap < 1000 AND (acc_event >= 0 OR speed >= 4e0)) AS good FROM enriched),
walk AS (
  SELECT player_id, i, CASE WHEN start_event = 1 THEN 1 ELSE 0 END AS phase,
         ts_ms AS ts_start, speed AS v_init, 0e0 AS mx_acc, 0e0 AS mx_speed, CAST(NULL AS BIGINT) AS ts_end,
         false AS emit, team, jersey_number
  FROM st WHERE i = 1
  UNION ALL
  SELECT t.player_id, t.i,
         CASE WHEN w.phase = 0 THEN (CASE WHEN t.start_event = 1 THEN 1 ELSE 0 END)
              WHEN t.good THEN 2 WHEN w.phase = 2 THEN 0 ELSE 1 END,
         CASE WHEN w.phase = 0 THEN t.ts_ms ELSE w.ts_start END,
         CASE WHEN w.phase = 0 THEN t.speed ELSE w.v_init END,
         CASE WHEN w.phase = 0 THEN 0e0 WHEN t.good THEN greatest(w.mx_acc, t.acc_actual) ELSE w.mx_acc END,
         CASE WHEN w.phase = 0 THEN 0e0 WHEN t.good THEN greatest(w.mx_speed, t.speed) ELSE w.mx_speed END,
         CASE WHEN w.phase = 0 THEN NULL WHEN t.good THEN t.ts_ms ELSE w.ts_end END,
         (w.phase = 2 AND NOT t.good), t.team, t.jersey_number
  FROM walk w JOIN st t ON t.player_id = w.player_id AND t.i = w.i + 1),
extracted AS (
  SELECT player_id, team, jersey_number, ts_start, ts_end, (ts_end - ts_start) / 1000e0 AS duration,
         v_init, mx_acc AS max_acc, mx_speed AS max_speed
  FROM walk WHERE emit)"""

MERGED = """mg1 AS (
  SELECT *, CASE WHEN lag(ts_end) OVER w IS NULL OR ts_start - lag(ts_end) OVER w >= 500 THEN 1 ELSE 0 END AS brk
  FROM extracted WHERE duration > 0 WINDOW w AS (PARTITION BY player_id ORDER BY ts_start)),
mg2 AS (SELECT *, sum(brk) OVER (PARTITION BY player_id ORDER BY ts_start ROWS UNBOUNDED PRECEDING) AS grp FROM mg1),
mg3 AS (
  SELECT player_id, grp, min(ts_start) AS ts_start, arg_min(v_init, ts_start) AS v_init, max(ts_end) AS ts_end,
         max(max_acc) AS max_acc, max(max_speed) AS max_speed,
         arg_max(team, ts_start) AS team, arg_max(jersey_number, ts_start) AS jersey_number,
         max(grp) OVER (PARTITION BY player_id) AS last_grp
  FROM mg2 GROUP BY player_id, grp),
merged AS (
  SELECT player_id, team, jersey_number, ts_start, ts_end, (ts_end - ts_start) / 1000e0 AS duration,
         v_init, max_acc, max_speed
  FROM mg3 WHERE grp < last_grp)"""

FILTERED = """filtered AS (SELECT * FROM merged WHERE max_speed > 1.2e0 AND max_speed - v_init > 0.9e0)"""


def _median(col: str, src: str) -> str:
    # pandas/numpy linear interpolation at 0.5: hi - (hi - lo) * 0.5
    return f"""(SELECT hi - (hi - lo) * 0.5e0 FROM (
        SELECT max(CASE WHEN r = (n + 1) // 2 THEN v END) AS lo, max(CASE WHEN r = (n + 2) // 2 THEN v END) AS hi
        FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS r, count(*) OVER () AS n
              FROM {src} WHERE {col} IS NOT NULL)))"""


THRESHOLDS = f"""thr AS (SELECT {_median('max_acc', 'filtered')} AS acc_median,
                         {_median('max_speed', 'filtered')} AS speed_median)"""

CLASSED = """classed AS (
  SELECT f.*, CASE
    WHEN f.max_acc <= t.acc_median AND f.max_speed <= t.speed_median THEN
         CASE WHEN f.duration > 4e0 THEN 'Long increasing run' ELSE 'Short increasing run' END
    WHEN f.max_acc <= t.acc_median AND f.max_speed > t.speed_median THEN
         CASE WHEN f.v_init > 4e0 THEN 'High intensity run' ELSE 'Low intensity run' END
    WHEN f.max_acc > t.acc_median AND f.max_speed <= t.speed_median THEN 'Feint'
    WHEN f.max_acc > t.acc_median AND f.max_speed > t.speed_median THEN
         CASE WHEN f.v_init > 4e0 THEN 'High intensity sprint' ELSE 'Low intensity sprint' END
    ELSE '' END AS event_class
  FROM filtered f CROSS JOIN thr t)"""

SCORED = f"""scored AS (
  SELECT *, CASE WHEN ({FIT_SLOPE!r}e0 * (v_init * 3.6e0) + {FIT_INTERCEPT!r}e0) <> 0
                 THEN max_acc / ({FIT_SLOPE!r}e0 * (v_init * 3.6e0) + {FIT_INTERCEPT!r}e0) * 100e0 END AS "percAcc"
  FROM classed)"""


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


BASE_EVENTS = [TRK, TRACKING, ENRICHED, EXTRACTED]
BASE_SCORED = BASE_EVENTS + [MERGED, FILTERED, THRESHOLDS, CLASSED, SCORED]
