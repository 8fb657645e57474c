"""Dashboard marts kept up to date over the tables of a live job.

``refresh`` takes the batches that the live job has marked since the last refresh and brings five small
tables of ``store`` up to date, without reading older events again:

* ``totals``: percAcc sum and count per key and event class (old totals + the new events' sums),
* ``zones``: metres per team, jersey and zone (old + the new batches' shares),
* ``recent``: the scored events of the last two minutes: new ones come in, and what the moving bound has
  passed is retracted; both steps are rows of ``changes`` (``op`` 1 or -1),
* ``latest``: the newest events.

Each refresh writes its tables under the id of the last batch taken and is marked after the last one, so a
reader sees one refresh as a whole and a refresh that failed is done again. The version before stays for
readers that are under way; older ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchload.operators import marts as M
from pitchload.operators import zones as Z
from pitchload.sinks import commits

TABLES = ("totals", "zones", "recent", "latest", "changes")


def _totals(df: DataFrame, keys: list[str], total, n) -> DataFrame:
    return df.groupBy(*keys, "event_class").agg(total.alias("percAcc"), n.alias("n_events"), F.max("team").alias("team"),
                                                F.max("jersey_number").alias("jersey_number"))


def refresh(spark: SparkSession, sink: str, store: str, keys: list[str] = ("player_id",), window_ms: int = M.RECENT_MS) -> int | None:
    """Bring ``store`` up to date; returns the id of the refresh, or None if there was no new batch."""
    keys, done = list(keys), commits.marked(spark, store)
    last = done[-1] if done else None
    fresh = [b for b in commits.marked(spark, sink) if last is None or b > last]
    if not fresh:
        return None
    now = fresh[-1]
    new = commits.read(spark, sink, "scored", fresh).drop("batch_id")
    old = lambda table: spark.read.parquet(f"{store}/{table}/batch_id={last}")

    def write(df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{store}/{table}/batch_id={now}")

    totals = _totals(new, keys, F.sum("percAcc"), F.count("percAcc"))
    zones = commits.read(spark, sink, "zone_parts", fresh).drop("batch_id")
    window = new.withColumn("_new", F.lit(True))
    if last is not None:
        totals = _totals(totals.unionByName(old("totals")), keys, F.sum("percAcc"), F.sum("n_events"))
        zones = zones.unionByName(old("zones"))
        window = window.unionByName(old("recent").withColumn("_new", F.lit(False)))
    write(totals, "totals")
    write(zones.groupBy("team", "jersey_number", "speedZone").agg(F.sum("total_distance").alias("total_distance")), "zones")
    bound = window.agg((F.max("ts_start") - F.lit(window_ms)).alias("_lo"))                    # one row
    window = window.crossJoin(F.broadcast(bound)).withColumn("_in", F.col("ts_start") >= F.col("_lo")).drop("_lo")
    write(window.where("_in").drop("_in", "_new"), "recent")
    write(window.where("_new = _in").withColumn("op", F.when(F.col("_new"), 1).otherwise(-1)).drop("_in", "_new"), "changes")
    latest = new if last is None else new.unionByName(old("latest"))
    write(latest.orderBy(F.col("ts_start").desc(), *[F.col(k).desc() for k in keys]).limit(M.TOP_N), "latest")
    commits.mark(spark, store, now)
    for version in done[:-1]:
        commits.unmark(spark, store, version)
        for table in TABLES[:-1]:
            commits.delete(spark, f"{store}/{table}/batch_id={version}")
    return now


def marts(spark: SparkSession, store: str, keys: list[str] = ("player_id",), kickoff_wall_ms: int = M.KICKOFF_WALL_MS) -> dict[str, DataFrame]:
    """The dashboard's tables from the latest refresh of ``store``."""
    keys, now = list(keys), commits.marked(spark, store)[-1]
    table = {t: spark.read.parquet(f"{store}/{t}/batch_id={now}") for t in TABLES[:-1]}
    zones = table["zones"].select("team", F.col("jersey_number").alias("player"), F.col("speedZone").alias("speedzone"),
                                  F.col("total_distance").alias("dist"))
    counts = table["totals"].groupBy(*keys, "event_class").agg(
        F.sum("n_events").alias("n_events"), F.max("team").alias("team"), F.max("jersey_number").alias("jersey_number"))
    return {"top_recent_percacc": M.top_recent_percacc(table["recent"], kickoff_wall_ms=kickoff_wall_ms, keys=keys),
            "percacc_share": M.percacc_share(table["totals"], keys), "event_count": M.event_count_labels(counts, keys),
            "zone_km": Z.zone_km(zones), "player_labels": M.player_labels(table["totals"], keys),
            "latest_events": M.latest_events(table["latest"], keys=keys)}
