"""Offline preparation: halves by frame range, frame clock, player ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators.sequence import Scan, dense_rank_global, join_null_safe, number_rows, scan


MATCH = ["match_id"]


def number_periods(periods: DataFrame, match_keys: list[str] = MATCH) -> DataFrame:
    """Periods (start/end frame) -> ``half`` = 0, 1, ... by start frame within the match."""
    w = Window.partitionBy(*match_keys).orderBy("start_frame")
    return periods.withColumn("half", (F.row_number().over(w) - 1).cast("int"))


def assign_half(frames: DataFrame, periods: DataFrame, frame: str = "frame_id",
                match_keys: list[str] = MATCH) -> DataFrame:
    """Range join within the match: a frame gets the half whose [start, end] (inclusive)
    holds it; frames between periods are dropped. The match key makes it an equi-join
    (AQE broadcasts the periods if they are small, or splits a hot match)."""
    p = periods.select(*match_keys, "start_frame", "end_frame", "half")
    return join_null_safe(frames, p, list(match_keys)).where(
        F.col(frame).between(F.col("start_frame"), F.col("end_frame"))).drop("start_frame", "end_frame")


def frame_clock(frames: DataFrame, first_frame, fps, start_ms, frame: str = "frame_id") -> DataFrame:
    """ts_ms = start + (frame - first) / fps (closed form, cut to the millisecond)."""
    return frames.withColumn("ts_ms", S.frame_ts_ms(frame, first_frame, fps, start_ms))


def forward_fill_frame_offset(rows: DataFrame, keys: list[str], frame: str, order: list[str],
                              first_frame, fps) -> DataFrame:
    """Offset of each row's frame written on the frame's first row and carried
    forward to the later rows of the frame (two-level forward fill). ``first_frame``
    and ``fps`` are columns or values; ``keys`` name the match."""
    r = number_rows(rows, keys, [frame, *order], F.floor(F.col(frame) / 1_000), out="_o")
    first_row = r.groupBy(*keys, frame).agg(F.min("_o").alias("_first"))
    r = join_null_safe(r, first_row, [*keys, frame])
    mark = F.when(F.col("_o") == F.col("_first"), S.frame_ts_ms(frame, first_frame, fps, F.lit(0)))
    r = r.withColumn("_mark", mark)
    return scan(r, keys, [Scan("offset_ms", "_mark", "ffill")], rn="_o").drop("_o", "_first", "_mark")


def first_per_frame(rows: DataFrame, frame: str, order: str, keys: list[str] = ()) -> DataFrame:
    """First row (by ``order``) of each frame, the very first frame excluded."""
    f = rows.groupBy(*keys, frame).agg(F.min(order).alias(order))
    lo = f.groupBy(*keys).agg(F.min(frame).alias("_lo")) if keys else f.agg(F.min(frame).alias("_lo"))
    j = join_null_safe(f, lo, list(keys)) if keys else f.crossJoin(F.broadcast(lo))     # one row
    return j.where(F.col(frame) > F.col("_lo")).drop("_lo")


def dense_player_id(df: DataFrame, team: str = "team", jersey: str = "jersey_number",
                    out: str = "player_id") -> DataFrame:
    """teamjersey = int(jersey || team); ``out`` = dense rank of teamjersey.

    The rank is computed over the distinct values without a single-task window
    (``sequence.dense_rank_global``) and joined back on teamjersey.
    """
    d = df.withColumn("teamjersey", S.teamjersey(jersey, team))
    return d.join(dense_rank_global(d, "teamjersey", out), on="teamjersey", how="left")
