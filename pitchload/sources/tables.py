"""Readers for the driver tables and the tracking view defined over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchload.operators.sequence import number_rows

TRACKING_KEYS = ["player_id"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw positional rows (x, y in cm, speed m/s) keyed by player, ordered by ``ts_ms``.

    The tracking view of FIXTURES.md section 2; the frame number is computed with the
    distributed row numbering (per key and hour bucket) instead of a window
    over the whole key. ``rn`` (= frame_no + 1) is kept for the ordered steps.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    ev = ev.withColumn("player_id", (F.col("user_id") % 22 + 1).cast("int"))
    # hour index, monotone in ts and independent of the session time zone
    hour = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    ev = number_rows(ev, ["player_id"], ["ts", "event_id"], hour, out="rn")
    f = F.col("rn") - 1
    pid = F.col("player_id")
    return ev.select(
        (pid % 2).cast("int").alias("team"),
        pid.alias("jersey_number"),
        pid.alias("player_id"),
        f.alias("frame_no"),
        (f * 40 + F.floor(f / F.lit(100.0)) * 45_000).alias("ts_ms"),
        (F.lit(-5250) + (f * 25 + pid * 400) % 10500).cast("double").alias("x"),
        (F.lit(-3400) + (f * 13 + F.col("event_id") % 50 + pid * 300) % 6800).cast("double").alias("y"),
        (F.abs((f + pid * 7) % 60 - 30) / F.lit(30.0) * F.lit(8.0)
         + ((F.col("event_id") * 7919) % 101) / F.lit(100.0) * F.lit(1.5)).alias("speed"),
        F.col("rn"),
    )
