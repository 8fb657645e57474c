"""Reshaping: wide frame text -> long rows, zone maps -> long rows, zone masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT_FIELDS = ["team", "target_id", "jersey_number", "x", "y", "speed"]   # fixed field order
DROP_TEAM_CODES = [-1, 4, 3]   # fixed values: codes that are not players


def wide_to_long(lines: DataFrame, value: str = "value") -> DataFrame:
    """Frame lines ``frame:obj;obj;...;:`` with ``obj = team,target_id,number,x,y,speed``
    -> one row per complete object: frame_id, obj_pos and the six fields (text).

    The trailing empty object is dropped; so are incomplete objects (missing or empty
    fields), as the wide-to-long step of the reference drops them. No wide frame is built.
    """
    parts = F.split(F.col(value), ":")
    objs = lines.select(F.element_at(parts, 1).alias("frame_id"),
                        F.posexplode(F.split(F.element_at(parts, 2), ";")).alias("obj_pos", "obj"))
    f = F.split(F.col("obj"), ",")
    out = objs.select("frame_id", "obj_pos",
                      *[F.element_at(f, i + 1).alias(n) for i, n in enumerate(OBJECT_FIELDS)],
                      F.size(f).alias("_n"))
    complete = (F.col("_n") == len(OBJECT_FIELDS))
    for n in OBJECT_FIELDS:
        complete = complete & F.col(n).isNotNull() & (F.col(n) != "")
    return out.where(complete).drop("_n")


def cast_objects(long: DataFrame) -> DataFrame:
    """Typed object rows (ids int, positions and speed double, frame id long)."""
    return long.select(F.col("frame_id").try_cast("long").alias("frame_id"), "obj_pos",
                       F.col("team").try_cast("int").alias("team"),
                       F.col("target_id").try_cast("int").alias("target_id"),
                       F.col("jersey_number").try_cast("int").alias("jersey_number"),
                       *[F.col(c).try_cast("double").alias(c) for c in ("x", "y", "speed")])


def drop_team_codes(df: DataFrame, codes=DROP_TEAM_CODES) -> DataFrame:
    return df.where(~F.col("team").isin(list(codes)))


def zone_melt(snapshot: DataFrame, keys=("team", "player")) -> DataFrame:
    """Nested zone map (zone -> metres) -> one row per key and zone."""
    return snapshot.select(*keys, F.explode("dist").alias("speedzone", "dist"))


def zone_mask(df: DataFrame, zone: str = "speedzone", y: str = "y", zones=range(1, 6)) -> DataFrame:
    """``y_i`` = y where the row's zone is i, else NULL (one column per zone)."""
    return df.select("*", *[F.when(F.col(zone) == i, F.col(y)).alias(f"y_{i}") for i in zones])
