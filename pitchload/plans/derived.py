"""Input files for the file-based operators, derived by Spark from the driver tables.

The reference reads frame text, a match XML, a history CSV and stored records;
none is shipped, so each is written here from the tracking view (work grows with
the tables) into the shared checkpoint folder and read back by the real readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.session import checkpoint_dir
from pitchload.sinks import writers as W

FPS = 25                 # frame rate written into the match XML
KICKOFF_TEXT = "20:45:00"
PERIOD_GAP = 10          # frames left out between the two periods


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/derived/{name}-{uuid.uuid4().hex[:12]}"


def _obj(team, target, number, x, y, speed):
    return F.concat_ws(",", *[c.cast("string") for c in (team, target, number, x, y, speed)])


def write_frames_text(raw: DataFrame) -> str:
    """One line per frame: ``frame:players;ball;partial;:``.

    The ball (team 4) sits at the smallest x and y of the frame's players; a two-field
    partial object and the trailing empty object exercise the completeness rule.
    Objects per frame are bounded by the players on the pitch.
    """
    spark = raw.sparkSession
    one = _obj(F.col("team"), F.col("player_id"), F.col("jersey_number"), F.col("x"), F.col("y"), F.col("speed"))
    lines = raw.groupBy("frame_no").agg(
        F.concat_ws(";", F.transform(F.sort_array(F.collect_list(F.struct("player_id", one.alias("o")))),
                                     lambda s: s["o"])).alias("objs"),
        _obj(F.lit(4), F.lit(-1), F.lit(-1), F.min("x"), F.min("y"), F.max("speed")).alias("ball")).select(
        F.concat(F.col("frame_no").cast("string"), F.lit(":"), F.col("objs"), F.lit(";"), F.col("ball"),
                 F.lit(";4,0;:")).alias("value"))
    path = scratch(spark, "frames")
    lines.write.mode("overwrite").text(path)
    return path


def periods_of(raw: DataFrame) -> DataFrame:
    """Two periods over a match's frame range with a gap between them."""
    b = raw.groupBy("match_id").agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    return b.select("match_id", F.col("lo").alias("s0"), (mid - PERIOD_GAP).alias("e0"),
                    (mid + PERIOD_GAP).alias("s1"), F.col("hi").alias("e1"))


def write_match_xml(raw: DataFrame) -> str:
    spark = raw.sparkSession
    p = periods_of(raw)
    doc = p.select(F.col("match_id").cast("long").alias("_iId"), F.lit(KICKOFF_TEXT).alias("_dtDate"), F.lit(FPS).alias("_iFrameRateFps"),
                   F.array(F.struct(F.col("s0").cast("long").alias("_iStartFrame"),
                                    F.col("e0").cast("long").alias("_iEndFrame")),
                           F.struct(F.col("s1").cast("long").alias("_iStartFrame"),
                                    F.col("e1").cast("long").alias("_iEndFrame"))).alias("period"))
    path = scratch(spark, "meta")
    doc.write.format("xml").option("rootTag", "matches").option("rowTag", "match") \
       .mode("overwrite").save(path)
    return path


def write_history_csv(events: DataFrame) -> str:
    path = scratch(events.sparkSession, "history")
    W.tracking_csv(events.select("max_acc", "max_speed"), path)
    return path


def write_event_snapshot(scored: DataFrame) -> str:
    path = scratch(scored.sparkSession, "events")
    W.write_records_text(scored, path, single_quotes=True)
    return path


def write_zone_snapshot(snapshot: DataFrame) -> str:
    path = scratch(snapshot.sparkSession, "zones")
    snapshot.select(F.regexp_replace(F.to_json(F.struct("team", "player", "dist")), '"', "'").alias("value")) \
            .write.mode("overwrite").text(path)
    return path


def write_tracking_cache(enriched: DataFrame, keys: list[str], ttl_ms: int = W.TTL_MS) -> str:
    """Cache batches of enriched rows; batches whose newest row lies before the
    newest row overall minus the retention are stored expired (NULL)."""
    path = scratch(enriched.sparkSession, "cache")
    W.tracking_cache_batch(enriched, 0, path, keys)
    t = enriched.sparkSession.read.parquet(path)
    bound = t.agg((F.max("ts_ms") - F.lit(ttl_ms)).alias("_lo"))
    exp = t.crossJoin(F.broadcast(bound)).select(
        *[c for c in t.columns if c != "value"],
        F.when(F.col("ts_ms") >= F.col("_lo"), F.col("value")).alias("value"))
    out = path + "-ttl"
    exp.write.mode("overwrite").parquet(out)
    return out
