"""Distance per speed zone: continuous totals, running totals, display marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators.sequence import SEGMENT_ROWS, Scan, join_null_safe, scan


def zone_distance(enriched: DataFrame, zone: str = "speedzone",
                  group: tuple[str, ...] = ("team", "jersey_number")) -> DataFrame:
    """SUM(dist) by team, jersey, zone. Rows without a zone are left out (their SQL
    group key is NULL). Partial aggregation runs map-side,
    so a hot player or zone costs one row per map task in the shuffle."""
    return (enriched.where(F.col(zone).isNotNull())
            .groupBy(*group, F.col(zone).alias("speedZone"))
            .agg(F.sum("dist").alias("total_distance")))


def zone_running(enriched: DataFrame, keys: list[str], zone: str = "speedzone", rn: str = "rn",
                 first_rn: int | None = None, seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The live per-player zone map after every row: ``dist_1`` .. ``dist_5`` = metres
    covered so far in each zone, emitted from each key's second row on (the first row
    only starts the map). Rows without a zone add to no zone.

    Five running sums in one two-level scan over the key's positions, so one
    player's long match is split over segments instead of one task.
    """
    zones = [z for z, _, _ in S.SPEED_ZONES_KMH]
    d = enriched.select(*keys, rn, "ts_ms", "team", "jersey_number",
                        *[F.when(F.col(zone) == z, F.col("dist")).otherwise(F.lit(0.0)).alias(f"_d{z}")
                          for z in zones])
    out = scan(d, keys, [Scan(f"dist_{z}", f"_d{z}", "cumsum") for z in zones], rn=rn, size=seg_rows)
    if first_rn is None:
        first = out.groupBy(*keys).agg(F.min(rn).alias("_first"))
        out = join_null_safe(out, first, keys).where(F.col(rn) > F.col("_first")).drop("_first")
    else:
        out = out.where(F.col(rn) > first_rn)
    return out.drop(*[f"_d{z}" for z in zones])


def zone_snapshot(enriched: DataFrame, keys: list[str], zone: str = "speedzone") -> DataFrame:
    """Latest per-key map zone -> metres (zones 1..5 always present, 0 when unused)."""
    z = (zone_distance(enriched, zone, tuple(keys) + ("team", "jersey_number"))
         .groupBy(*keys, "speedZone").agg(F.max("team").alias("team"), F.max("jersey_number").alias("jersey_number"),
                                          F.sum("total_distance").alias("total_distance")))
    agg = z.groupBy(*keys).agg(F.max("team").alias("team"), F.max("jersey_number").alias("player"),
                               F.map_from_entries(F.collect_list(F.struct(F.col("speedZone").cast("string"),
                                                                          "total_distance"))).alias("_m"))
    zeros = F.create_map(*[x for i in range(1, 6) for x in (F.lit(str(i)), F.lit(0.0))])
    return agg.select(*keys, "team", "player",
                      F.map_zip_with(zeros, F.col("_m"), lambda k, a, b: F.coalesce(b, a)).alias("dist"))


def zone_km(zone_long: DataFrame, player: str = "player", zone: str = "speedzone",
            dist: str = "dist") -> DataFrame:
    """Display projection: metres -> km rounded to 3 (half even), labels, zone as double."""
    return (zone_long.select(
        S.team_label("team").alias("team"), F.col(player).alias("player"),
        F.col(zone).cast("double").alias("speedzone"),
        S.round_half_even(F.col(dist) / F.lit(1000.0), 3).alias("dist"),
        S.team_player_label("team", player).alias("team_pl"))
        .orderBy("team", "player", "speedzone"))
