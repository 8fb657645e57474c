"""Routes run during events: interval join and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators.sequence import (HALO, SEG, SEGMENT_ROWS, Scan, join_null_safe, number_rows,
                                          scan, seg_window, segment)

STEP_MS = 40            # fixed value: one frame at 25 Hz
ROUTE_BUCKET_MS = 10_000


def event_routes(events: DataFrame, tracking: DataFrame, keys: list[str], ts: str = "ts_ms",
                 bucket_ms: int = ROUTE_BUCKET_MS) -> DataFrame:
    """Tracking rows with ``ts_start <= ts <= ts_end`` of an event of the same key.

    Overlapping events duplicate rows. Each event is exploded over the time buckets
    it spans and joined on (keys, bucket) -- an equi-join that spreads one key over
    many tasks -- then the exact interval test is applied.
    """
    ev = events.select(*keys, "ts_start", "ts_end").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("ts_start") / bucket_ms), F.floor(F.col("ts_end") / bucket_ms))))
    tr = tracking.withColumn("_b", F.floor(F.col(ts) / bucket_ms))
    return (join_null_safe(tr, ev, [*keys, "_b"])
            .where(F.col(ts).between(F.col("ts_start"), F.col("ts_end")))
            .drop("_b"))


def route_segments(routes: DataFrame, keys: list[str], ts: str = "ts_ms", step_ms: int = STEP_MS,
                   drop_last: bool = True, seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Split each key's route rows (ordered by event start, then time) where the step
    is not exactly one frame. As displayed, the last segment of each key is dropped
    (``drop_last``). Positions are shifted to pitch coordinates."""
    r = number_rows(routes, keys, ["ts_start", ts], F.floor(F.col("ts_start") / 3_600_000), out="_r")
    s = segment(r, rn="_r", size=seg_rows, before=1)
    w = seg_window(keys, rn="_r")
    prev = F.lag(ts, 1).over(w)
    s = s.withColumn("_brk", F.when(prev.isNull() | (F.col(ts) - prev != step_ms), 1).otherwise(0))
    s = s.where(~F.col(HALO)).drop(HALO, SEG)
    s = scan(s, keys, [Scan("segment_id", "_brk", "cumsum")], rn="_r", size=seg_rows)
    if drop_last:
        last = s.groupBy(*keys).agg(F.max("segment_id").alias("_last"))
        s = join_null_safe(s, last, keys).where(F.col("segment_id") < F.col("_last")).drop("_last")
    return s.select(*keys, "segment_id", "ts_start", ts, S.shift_pitch_x("x").alias("x"),
                    S.shift_pitch_y("y").alias("y"), *[c for c in ("speedzone",) if c in s.columns])


def lead_segments(df: DataFrame, keys: list[str], t: str, v: str, a: str, rn: str = "rn",
                  seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Consecutive-pair line segments (t1, v1) -> (t2, v2), coloured by the sign of
    ``a`` at the first point."""
    s = segment(df, rn=rn, size=seg_rows, after=1)
    w = seg_window(keys, rn=rn)
    s = s.select(*keys, rn, HALO, SEG, F.col(t).alias("t1"), F.lead(t, 1).over(w).alias("t2"),
                 F.col(v).alias("v1"), F.lead(v, 1).over(w).alias("v2"), S.acc_sign(a).alias("color"))
    return s.where(~F.col(HALO) & F.col("t2").isNotNull()).drop(HALO, SEG)
