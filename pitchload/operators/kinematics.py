"""Per-row kinematics over time-ordered rows of each key.

Every operator takes rows with the key columns, an order column ``ts_ms`` and
a contiguous position ``rn`` (1..n per key; added by ``ensure_rn`` if absent).
Lags run inside (key, segment) windows with halo rows, see ``sequence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators.sequence import (BUCKET_MS, HALO, SEG, SEGMENT_ROWS, join_null_safe, number_rows,
                                          seg_window, segment)

# ---- fixed values (must equal the reference's) ----
STEP_S = 0.04          # main variant: 25 Hz
SMALL_LAG = 8
BIG_LAG = 16
ALT_STEP_S = 0.4       # alternate variant
ALT_SMALL = 3
ALT_BIG = 10
GAP_CLOSE_MS = 1000    # a silence of 1 s or more ends an event
# ---------------------------------------------------


def ensure_rn(df: DataFrame, keys: list[str], ts: str = "ts_ms", rn: str = "rn",
              bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Positions 1..n inside a key by time; rows of one time are ordered by their values."""
    if rn in df.columns:
        return df
    ties = [c for c in ("x", "y", "speed") if c in df.columns]
    return number_rows(df, keys, [ts, *ties], F.floor(F.col(ts) / bucket_ms), out=rn)


def _drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, SEG)


def _lag(c, n, w):
    return F.lag(F.col(c), n).over(w)


def lag_rate(df: DataFrame, keys: list[str], ts: str = "ts_ms", speed: str = "speed",
             small: int = SMALL_LAG, big: int = BIG_LAG, step_s: float = STEP_S,
             to_metres: bool = True, seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Tracking rows from each key's row ``small+1`` on.

    acc_actual = (v - v[n-small]) / (small*step); acc_event = (v - v[n-big]) / (big*step)
    from row ``big+1``, 0 before. x, y are converted cm -> m when ``to_metres``.
    """
    d = segment(ensure_rn(df, keys, ts), size=seg_rows, before=big)
    w = seg_window(keys)
    rn, v = F.col("rn"), F.col(speed)
    out = d.withColumn("acc_actual", (v - _lag(speed, small, w)) / F.lit(small * step_s)) \
           .withColumn("acc_event", F.when(rn > big, (v - _lag(speed, big, w)) / F.lit(big * step_s))
                       .otherwise(F.lit(0.0)))
    if to_metres:
        out = out.withColumn("x", S.cm_to_m("x")).withColumn("y", S.cm_to_m("y"))
    return _drop_halo(out.where(rn > small))


def trailing_mean_rate(df: DataFrame, keys: list[str], ts: str = "ts_ms", speed: str = "speed",
                       small: int = ALT_SMALL, big: int = ALT_BIG, step_s: float = ALT_STEP_S,
                       seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Alternate variant: means of the previous ``small`` / ``big`` per-step rates.

    a_n = (v_n - v_{n-1}) / step for n >= 2. acc_actual = mean(a_{n-small} .. a_{n-1})
    emitted from n = small+2; acc_event = mean(a_{n-big} .. a_{n-1}) from n = big+2, 0 before.
    The current rate is not part of either mean.
    """
    d = segment(ensure_rn(df, keys, ts), size=seg_rows, before=big + 1)
    w = seg_window(keys)
    rn = F.col("rn")
    d = d.withColumn("_a", (F.col(speed) - _lag(speed, 1, w)) / F.lit(step_s))

    def mean_prev(n):
        tot = None
        for i in range(n, 0, -1):  # oldest first, left to right
            t = F.lag("_a", i).over(w)
            tot = t if tot is None else tot + t
        return tot / F.lit(float(n))

    out = d.withColumn("acc_actual", mean_prev(small)) \
           .withColumn("acc_event", F.when(rn >= big + 2, mean_prev(big)).otherwise(F.lit(0.0))) \
           .drop("_a")
    return _drop_halo(out.where(rn >= small + 2))


def step_distance(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", ts: str = "ts_ms",
                  seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Euclidean distance to the previous row of the key; the first row is dropped."""
    d = segment(ensure_rn(df, keys, ts), size=seg_rows, before=1)
    w = seg_window(keys)
    out = d.withColumn("_px", _lag(x, 1, w)).withColumn("_py", _lag(y, 1, w))
    out = out.withColumn("dist", F.sqrt((F.col("_px") - F.col(x)) ** 2 + (F.col("_py") - F.col(y)) ** 2))
    return _drop_halo(out.where(F.col("_px").isNotNull())).drop("_px", "_py")


def covered_distance(raw: DataFrame, keys: list[str], ts: str = "ts_ms",
                     seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Stand-alone variant: positions cm -> m, then ``step_distance``."""
    m = raw.withColumn("x", S.cm_to_m("x")).withColumn("y", S.cm_to_m("y"))
    return step_distance(m, keys, ts=ts, seg_rows=seg_rows)


def rising_edge(df: DataFrame, keys: list[str], acc: str = "acc_event", ts: str = "ts_ms",
                seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """start_event = 1 where the previous value is <= 0 and this one > 0; first row dropped."""
    d = segment(ensure_rn(df, keys, ts), size=seg_rows, before=1)
    w = seg_window(keys)
    out = d.withColumn("_prev", _lag(acc, 1, w))
    out = out.withColumn("start_event", F.when((F.col("_prev") <= 0) & (F.col(acc) > 0), 1).otherwise(0))
    return _drop_halo(out.where(F.col("_prev").isNotNull())).drop("_prev")


def _with_flags(d: DataFrame, w, ts: str, speed: str, first) -> DataFrame:
    """good / end_rn / nx_mark / nx_ts_mark; rows at or before ``first`` are never good."""
    rn, v = F.col("rn"), F.col(speed)
    gap = F.col(ts) - _lag(ts, 1, w)
    d = d.withColumn("good", (rn > first) & (gap < GAP_CLOSE_MS)
                     & ((F.col("acc_event") >= 0) | (v >= F.lit(S.MIN_SPEED_GOOD))))
    g1, g2 = F.lead("good", 1).over(w), F.lead("good", 2).over(w)
    is_end = F.col("good") & g1.isNotNull() & ~g1
    nx_end = g1 & g2.isNotNull() & ~g2
    return d.withColumn("end_rn", F.when(is_end, rn)) \
            .withColumn("nx_mark", F.when(nx_end, rn + 1)) \
            .withColumn("nx_ts_mark", F.when(nx_end, F.lead(ts, 1).over(w)))


def event_flags(rows: DataFrame, keys: list[str], ts: str = "ts_ms", speed: str = "speed",
                seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Automaton inputs for rows that already carry acc_event / start_event; each
    key's first row is the stream's first row, which is never good."""
    r = ensure_rn(rows, keys, ts)
    first = r.groupBy(*keys).agg(F.min("rn").alias("_first"))
    d = segment(join_null_safe(r, first, keys), size=seg_rows, before=1, after=2)
    d = _with_flags(d, seg_window(keys), ts, speed, F.col("_first"))
    return _drop_halo(d).drop("_first")


def enrich(raw: DataFrame, keys: list[str], ts: str = "ts_ms", speed: str = "speed",
           seg_rows: int = SEGMENT_ROWS, flags: bool = True) -> DataFrame:
    """Fused ``lag_rate`` -> ``rising_edge`` + ``step_distance`` + speed zone.

    One (key, segment) pass gives the enriched rows (raw row ``SMALL_LAG+2`` on) with
    acc_actual, acc_event, start_event, dist, speedzone. With ``flags`` it also adds the
    per-row inputs of the event automaton: ``good`` (continuation test), ``end_rn`` (rn if
    the row ends a good run), ``nx_mark`` / ``nx_ts_mark`` (rn / ts of the next row if
    that row ends a run).
    """
    first = SMALL_LAG + 2            # first enriched row (row SMALL_LAG+1 only initialises)
    d = segment(ensure_rn(raw, keys, ts), size=seg_rows, before=BIG_LAG + 1, after=2 if flags else 0)
    w = seg_window(keys)
    rn, v = F.col("rn"), F.col(speed)
    d = d.withColumn("x", S.cm_to_m("x")).withColumn("y", S.cm_to_m("y")) \
         .withColumn("acc_actual", (v - _lag(speed, SMALL_LAG, w)) / F.lit(SMALL_LAG * STEP_S)) \
         .withColumn("acc_event", F.when(rn > BIG_LAG, (v - _lag(speed, BIG_LAG, w)) / F.lit(BIG_LAG * STEP_S))
                     .otherwise(F.lit(0.0)))
    prev_acc = _lag("acc_event", 1, w)
    d = d.withColumn("start_event", F.when((prev_acc <= 0) & (F.col("acc_event") > 0), 1).otherwise(0)) \
         .withColumn("dist", F.sqrt((_lag("x", 1, w) - F.col("x")) ** 2 + (_lag("y", 1, w) - F.col("y")) ** 2)) \
         .withColumn("speedzone", S.speed_zone(speed))
    if flags:
        d = _with_flags(d, w, ts, speed, F.lit(first))
    return _drop_halo(d.where(rn >= first))
