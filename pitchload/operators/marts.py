"""Dashboard questions over the scored events and the zone totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.functions import scalar as S
from pitchload.operators.sequence import join_null_safe

RECENT_MS = 120_000          # fixed value: the top table looks back 2 minutes
TOP_N = 10
KICKOFF_WALL_MS = (20 * 3600 + 45 * 60) * 1000   # wall clock of kick-off (20:45:00.000)

DISPLAY_NAMES = ["player", "event start", "duration[s]", "v init[km/h]", "max acc[m/s²]",
                 "max speed[km/h]", "event class", "percAcc"]


def recent(events: DataFrame, ts: str = "ts_start", window_ms: int = RECENT_MS,
           scope: list[str] = ()) -> DataFrame:
    """Events with ``ts >= max(ts) - window`` (inclusive). Without ``scope`` the bound is
    a one-row aggregate broadcast to every task; with ``scope`` (e.g. ``[match_id]``) it
    is one row per scope value, joined back (AQE measures it and picks the join)."""
    scope = list(scope)
    if not scope:
        bound = events.agg((F.max(ts) - F.lit(window_ms)).alias("_lo"))
        return events.crossJoin(F.broadcast(bound)).where(F.col(ts) >= F.col("_lo")).drop("_lo")
    bound = events.groupBy(*scope).agg((F.max(ts) - F.lit(window_ms)).alias("_lo"))
    return join_null_safe(events, bound, scope).where(F.col(ts) >= F.col("_lo")).drop("_lo")


def top_recent_percacc(scored: DataFrame, n: int = TOP_N, kickoff_wall_ms: int = KICKOFF_WALL_MS,
                       keys: list[str] = ("player_id",)) -> DataFrame:
    """Highest percAcc of the last 2 minutes, projected for display.

    Order: round 2 (half even) on the numbers, km/h conversion, round 3 -- as displayed.
    Ties are broken by (player_id, ts_start) so the top-k is deterministic.
    """
    top = recent(scored).orderBy(F.col("percAcc").desc(), *keys, "ts_start").limit(n)
    r2 = lambda c: S.round_half_even(c, 2)
    return top.select(
        S.team_player_label("team", "jersey_number").alias(DISPLAY_NAMES[0]),
        S.time_of_day(F.col("ts_start") + F.lit(kickoff_wall_ms)).alias(DISPLAY_NAMES[1]),
        r2("duration").alias(DISPLAY_NAMES[2]),
        S.round_half_even(S.mps_to_kmh(r2("v_init")), 3).alias(DISPLAY_NAMES[3]),
        r2("max_acc").alias(DISPLAY_NAMES[4]),
        S.round_half_even(S.mps_to_kmh(r2("max_speed")), 3).alias(DISPLAY_NAMES[5]),
        F.col("event_class").alias(DISPLAY_NAMES[6]),
        r2("percAcc").alias(DISPLAY_NAMES[7]))


def percacc_share(scored: DataFrame, keys: list[str] = ("player_id",), scope: list[str] = ()) -> DataFrame:
    """Summed percAcc per player and its share (%) of the total over all players, or
    over the players of the same ``scope`` value (e.g. ``[match_id]``).

    Partial aggregation per player; the total is one row (broadcast) or one row per
    scope value (AQE measures it and picks the join).
    """
    keys, scope = list(keys), list(scope)
    per = scored.groupBy(*keys).agg(F.sum("percAcc").alias("percAcc"), F.max("team").alias("team"),
                                    F.max("jersey_number").alias("jersey_number"))
    if scope:
        tot = per.groupBy(*scope).agg(F.sum("percAcc").alias("_tot"))
        j = join_null_safe(per, tot, scope)
    else:
        j = per.crossJoin(F.broadcast(per.agg(F.sum("percAcc").alias("_tot"))))
    return j.select(
        *keys, "percAcc", S.team_label("team").alias("team"), "jersey_number",
        (F.col("percAcc") / F.col("_tot") * F.lit(100.0)).alias("percAccperc"),
        S.team_player_label("team", "jersey_number").alias("team_pl"))


def top_percacc_share(scored: DataFrame, n: int = TOP_N, keys: list[str] = ("player_id",)) -> DataFrame:
    return percacc_share(scored, keys).orderBy(F.col("percAcc").desc(), *keys).limit(n)


def event_count(scored: DataFrame, keys: list[str] = ("player_id",)) -> DataFrame:
    """Number of scored events per player and class (count of non-null percAcc)."""
    keys = list(keys)
    return event_count_labels(scored.groupBy(*keys, "event_class").agg(
        F.count("percAcc").alias("n_events"), F.max("team").alias("team"),
        F.max("jersey_number").alias("jersey_number")), keys)


def event_count_labels(c: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per player and class (``n_events``, team, jersey_number) as displayed."""
    return c.select(*keys, "event_class", "n_events", S.team_label("team").alias("team"), "jersey_number",
                    S.team_player_label("team", "jersey_number").alias("team_pl")) \
            .orderBy("team", "jersey_number", "event_class")


def player_labels(df: DataFrame, keys: list[str] = ("player_id",)) -> DataFrame:
    """Distinct players with their label, sorted by team and jersey."""
    keys = list(keys)
    return (df.select(*keys, "team", "jersey_number").distinct()
            .select(*keys, S.team_label("team").alias("team"), "jersey_number",
                    S.team_player_label("team", "jersey_number").alias("team_pl"))
            .orderBy("team", "jersey_number"))


def latest_events(scored: DataFrame, n: int = TOP_N, kickoff_ms: int = 0,
                  keys: list[str] = ("player_id",)) -> DataFrame:
    """The ``n`` latest events by start, with the video offset of each (seconds)."""
    keys = list(keys)
    return (scored.orderBy(F.col("ts_start").desc(), *[F.col(k).desc() for k in keys]).limit(n)
            .select(*keys, "ts_start", "event_class", "percAcc",
                    S.video_offset_s("ts_start", F.lit(kickoff_ms)).alias("video_offset_s")))
