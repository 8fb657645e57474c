"""File readers: frame text, match metadata XML, history CSV, stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchload import schema as SCH
from pitchload.operators.ingest import number_periods

META_FIELD = "__meta"   # trailing metadata field of stored records, dropped on read


def read_tracking_records(spark: SparkSession, path: str, fmt: str = "csv",
                          schema: T.StructType = SCH.INGESTION) -> DataFrame:
    """Exported tracking records (ingestion schema: ISO timestamp with offset, team,
    jersey, x/y in cm, speed in m/s, half, teamjersey, player_id) -> rows for the
    batch chain, with ``ts_ms`` parsed once. Unparsable timestamps become NULL and
    are dropped (they cannot be ordered). ``schema`` may add key columns (match_id)."""
    r = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    df = r.load(path)
    from pitchload.functions.scalar import parse_iso_ms
    return df.withColumn("ts_ms", parse_iso_ms("timestamp")).where(F.col("ts_ms").isNotNull())


def read_wide_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame line (column ``value``)."""
    return spark.read.text(path)


def _matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "match").schema(SCH.MATCH_META).load(path)


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """``period`` elements of every match in the XML -> match_id, start_frame, end_frame, half."""
    p = _matches(spark, path).select(F.col("_iId").alias("match_id"), F.explode("period").alias("p"))
    return number_periods(p.select("match_id", F.col("p._iStartFrame").alias("start_frame"),
                                   F.col("p._iEndFrame").alias("end_frame")))


def read_match(spark: SparkSession, path: str) -> DataFrame:
    """``match`` elements -> match_id, start time text (dtDate) and frame rate."""
    return _matches(spark, path).select(F.col("_iId").alias("match_id"), F.col("_dtDate").alias("dt_date"),
                                        F.col("_iFrameRateFps").alias("fps"))


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCH.HISTORY).option("header", True).csv(path)


def read_event_snapshot(spark: SparkSession, path: str, schema: T.StructType = SCH.PERC_EVENT) -> DataFrame:
    """Stored events: one JSON text per row, possibly with single quotes; the
    trailing metadata field is dropped (an explicit projection of ``schema``)."""
    full = T.StructType(list(schema.fields) + [T.StructField(META_FIELD, T.StringType(), True)])
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json(F.regexp_replace("value", "'", '"'), full).alias("r"))
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def read_tracking_cache(spark: SparkSession, path: str, schema: T.StructType = SCH.TRACKING_START) -> DataFrame:
    """Cached batches: ``value`` = JSON array of JSON records, NULL once expired.
    Expired batches are skipped, the lists flattened, the metadata field dropped."""
    full = T.StructType(list(schema.fields) + [T.StructField(META_FIELD, T.StringType(), True)])
    raw = spark.read.parquet(path).where(F.col("value").isNotNull())
    recs = raw.select(F.explode(F.from_json("value", T.ArrayType(T.StringType()))).alias("j"))
    return recs.select(F.from_json("j", full).alias("r")).select(*[F.col(f"r.{f.name}") for f in schema.fields])


def read_zone_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Latest zone totals per player: JSON ``{team, player, dist: {zone: metres}}``."""
    raw = spark.read.text(path)
    return raw.select(F.from_json(F.regexp_replace("value", "'", '"'), SCH.ZONE_SNAPSHOT).alias("r")).select("r.*")
