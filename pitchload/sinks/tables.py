"""Stored tables that are bucketed and sorted, so that readers neither shuffle nor scan other keys.

``store_events`` buckets events by one key column: a filter on a key reads that key's bucket only (events
are thousands of times fewer than rows, so the bucket of a busy key stays small). ``store_by_time`` buckets
rows and events by (key, slot of ten seconds): a key that holds a third of all rows is spread over all
buckets, and the interval join of two such tables needs no exchange. The key column ``_key`` is text and
never NULL, so rows without a key are a key of their own and plain equality, which the bucketing serves, is
right for them too.

Tables are external ones of the session catalog, their files lie in the folder that the caller gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchload.operators.routes import ROUTE_BUCKET_MS

BUCKETS = 8


def key_text(keys: list[str]) -> Column:
    """One text per key: the values with their lengths in front, so no two keys read alike; NULL is ``-``."""
    one = [F.when(F.col(k).isNull(), "-").otherwise(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")))
           for k in keys]
    return F.concat_ws("|", *one)


def _save(df: DataFrame, path: str, by: list[str], sort: list[str], buckets: int) -> str:
    name = f"pitchload_{uuid.uuid4().hex}"
    # rows are dealt by the bucket columns first: one file a bucket, not one a task and bucket
    (df.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*sort)
     .format("parquet").saveAsTable(name))
    return name


def store_events(events: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> str:
    """Events bucketed by key and sorted by start; returns the table's name."""
    return _save(events.withColumn("_key", key_text(keys)), path, ["_key"], ["_key", "ts_start"], buckets)


def events_of(spark: SparkSession, table: str, *key) -> DataFrame:
    """The events of one key; reads one bucket."""
    text = "|".join("-" if k is None else f"{len(str(k))}:{k}" for k in key)
    return spark.table(table).where(F.col("_key") == text).drop("_key")


def store_by_time(df: DataFrame, path: str, keys: list[str], first: str = "ts_ms", last: str | None = None,
                  slot_ms: int = ROUTE_BUCKET_MS, buckets: int = BUCKETS) -> str:
    """Rows bucketed by (key, slot of ``first``); with ``last`` a row stands in every slot of [first, last]."""
    slot = F.floor(F.col(first) / slot_ms)
    slots = slot if last is None else F.explode(F.sequence(slot, F.floor(F.col(last) / slot_ms)))
    return _save(df.withColumn("_key", key_text(keys)).withColumn("_slot", slots), path, ["_key", "_slot"], ["_key", "_slot", first], buckets)


def stored_routes(spark: SparkSession, events: str, tracking: str, keys: list[str], ts: str = "ts_ms") -> DataFrame:
    """``routes.event_routes`` over two ``store_by_time`` tables: a merge join of equal buckets, no exchange."""
    ev = spark.table(events).select("_key", "_slot", "ts_start", "ts_end")
    return (spark.table(tracking).hint("merge").join(ev, ["_key", "_slot"])
            .where(F.col(ts).between(F.col("ts_start"), F.col("ts_end"))).drop("_key", "_slot"))
