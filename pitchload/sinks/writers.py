"""Batch and micro-batch sinks (table sinks replace the key-value store).

All writes are idempotent per micro-batch (a batch id directory is overwritten on
retry), so a restarted or re-tried batch does not duplicate rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.sinks import commits
from pitchload.sources.files import META_FIELD

TTL_MS = 120_000   # fixed value: cache retention
CSV_EVENTS, CSV_ZONE_ROWS = 1_201, 11   # fixed values: rows of the two CSV exports


def keyed_values(df: DataFrame, keys: list[str], order: str = "ts_start") -> DataFrame:
    """Records as (key, JSON value), clustered by key (the keyed topic send).

    Range partitioning on (key, order) keeps each key's records together and in
    order, yet splits a hot key over several partitions (hash on the key would not).
    """
    spread = [*keys, order] if order in df.columns else list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *spread).sortWithinPartitions(*spread).select(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]).alias("key"),
                                        F.to_json(F.struct(*df.columns)).alias("value"))


def with_meta(df: DataFrame, meta: str = "pitchload") -> DataFrame:
    return df.withColumn(META_FIELD, F.lit(meta))


def write_records_text(df: DataFrame, path: str, single_quotes: bool = False, mode: str = "overwrite") -> None:
    """One JSON record per line (metadata field last), as stored values."""
    v = F.to_json(F.struct(*with_meta(df).columns))
    if single_quotes:
        v = F.regexp_replace(v, '"', "'")
    with_meta(df).select(v.alias("value")).write.mode(mode).text(path)


def event_append(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: scored events of one micro-batch, keyed by (player, ts_start)."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def zone_upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink for update-mode totals: rows of this batch are stored with the
    batch id; ``read_latest`` keeps the newest row per key (a log-structured upsert)."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


FAN = 4   # runs of one level that are merged into one of the next


def _manifest(spark, path: str) -> tuple[int, dict]:
    """(version, {runs: [[folder, level]] from old to new, upto: last batch in them}); version 0 if there is none."""
    versions = [int(n.removesuffix(".json")) for n in commits.children(spark, f"{path}/_levels") if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return 0, {"runs": [], "upto": -1}
    return max(versions), json.loads(commits.get_text(spark, f"{path}/_levels/{max(versions)}.json"))


def _batches_after(spark, path: str, upto: int) -> list[int]:
    found = (n.removeprefix("batch_id=") for n in commits.children(spark, path) if n.startswith("batch_id="))
    return sorted(int(n) for n in found if int(n) > upto)


def _latest(t: DataFrame, keys: list[str]) -> DataFrame:
    vals = [c for c in t.columns if c not in keys and c != "batch_id"]
    return t.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in vals], F.max("batch_id").alias("batch_id"))


def read_latest(spark, path: str, keys: list[str]) -> DataFrame:
    """Latest value per key of a ``zone_upsert`` table (max_by per key: map-side partial): the runs of the
    manifest and the batches after them. A run has one row per key, and there are at most ``FAN - 1`` runs a
    level (as many batches beside them), so what is read grows with the keys and the logarithm of the batches."""
    _, manifest = _manifest(spark, path)
    folders = [name for name, _ in manifest["runs"]] + [f"batch_id={b}" for b in _batches_after(spark, path, manifest["upto"])]
    return _latest(spark.read.parquet(*[f"{path}/{f}" for f in folders]), keys).drop("batch_id")


def zone_compact(spark, path: str, keys: list[str], fan: int = FAN) -> bool:
    """Levelled compaction of a ``zone_upsert`` table: the newest ``fan`` runs of one level become one run of
    the next, as often as there are so many. The new manifest counts from its rename on. Folders that the
    manifest before still names stay until the next compaction, so a read under way finds its files; a
    batch that is run again after it was merged changes nothing."""
    version, manifest = _manifest(spark, path)
    fresh = _batches_after(spark, path, manifest["upto"])
    runs = [tuple(r) for r in manifest["runs"]] + [(f"batch_id={b}", 0) for b in fresh]
    before = {name for name, _ in runs}
    while len(runs) >= fan and len({level for _, level in runs[-fan:]}) == 1:
        merged, level = f"run-{uuid.uuid4().hex}", runs[-1][1] + 1
        _latest(spark.read.parquet(*[f"{path}/{name}" for name, _ in runs[-fan:]]), keys).write.parquet(f"{path}/{merged}")
        runs[-fan:] = [(merged, level)]
    if {name for name, _ in runs} == before:
        return False
    commits.put_text(spark, f"{path}/_levels/{version + 1}.json", json.dumps({"runs": runs, "upto": max(fresh)}))
    named = {name for name, _ in runs} | before
    for name in commits.children(spark, path):
        if name.startswith(("run-", "batch_id=")) and name not in named and name not in {f"batch_id={b}" for b in _batches_after(spark, path, max(fresh))}:
            commits.delete(spark, f"{path}/{name}")
    for old in range(1, version):
        commits.delete(spark, f"{path}/_levels/{old}.json")
    return True


SLOT_MS = 4_000   # event time that one cached value and one folder of the cache span (100 frames at 25 Hz)


def _cached_values(batch: DataFrame, keys: list[str], span_ms: int) -> DataFrame:
    """(keys, slot, value, ts_ms): records as arrays of JSON strings per key and ``span_ms`` of event time;
    a key has at most one row per millisecond, so no array grows with the data."""
    j = with_meta(batch)
    rec = F.to_json(F.struct(*j.columns))
    return (j.groupBy(*keys, F.floor(F.col("ts_ms") / span_ms).alias("slot"))
            .agg(F.to_json(F.sort_array(F.collect_list(F.struct("ts_ms", rec.alias("r"))))["r"]).alias("value"),
                 F.max("ts_ms").alias("ts_ms")))


def tracking_cache_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str],
                         span_ms: int = SLOT_MS) -> None:
    """foreachBatch sink: cached values of one batch in one folder."""
    _cached_values(batch, keys, span_ms).drop("slot").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def cache_write(batch: DataFrame, batch_id: int, path: str, keys: list[str], ttl_ms: int = TTL_MS) -> None:
    """foreachBatch sink of the live cache: one folder per slot of event time, ``path/batch_id=N/slot=S``;
    a batch that is run again overwrites its folders.

    The slots that lie wholly more than ``ttl_ms`` before the batch's newest row, which the next
    ``cache_expire`` takes, share one folder that bears the number of the last of them. So a batch has as
    many folders as slots reach into ``ttl_ms``, and one, however much event time it spans. The batch is
    read twice (for its newest row first)."""
    last = F.floor((F.max("ts_ms") - F.lit(ttl_ms)) / SLOT_MS) - 1         # the last slot that ends by the bound
    rows = _cached_values(batch, keys, SLOT_MS).crossJoin(F.broadcast(batch.agg(last.alias("_last"))))        # one row
    slot = F.when(F.col("slot") < F.col("_last"), F.col("_last")).otherwise(F.col("slot"))
    rows.withColumn("slot", slot).drop("_last").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/batch_id={batch_id}")


def cache_expire(spark, path: str, ttl_ms: int = TTL_MS) -> list[int]:
    """Delete the slots that lie wholly more than ``ttl_ms`` before the newest slot's newest row; returns the
    numbers of their folders.

    Runs after a batch is committed. A slot goes when its end is not after the bound, so what stays on disk
    is the last ``ttl_ms`` and the rest of the slot that the bound falls into.
    """
    found = [(b, s) for b in commits.children(spark, path) if b.startswith("batch_id=")
             for s in commits.children(spark, f"{path}/{b}") if s.startswith("slot=")]
    if not found:
        return []
    slots = [int(s.removeprefix("slot=")) for _, s in found]
    newest = spark.read.parquet(*[f"{path}/{b}/{s}" for (b, s), n in zip(found, slots) if n == max(slots)]).agg(F.max("ts_ms")).first()[0]
    gone = [(b, s) for (b, s), n in zip(found, slots) if (n + 1) * SLOT_MS <= newest - ttl_ms]
    for b, s in gone:
        commits.delete(spark, f"{path}/{b}/{s}")
    for b in {b for b, _ in gone}:
        if not any(s.startswith("slot=") for s in commits.children(spark, f"{path}/{b}")):
            commits.delete(spark, f"{path}/{b}")
    return sorted({int(s.removeprefix("slot=")) for _, s in gone})


def retained(cache: DataFrame, ts: str = "ts_ms", ttl_ms: int = TTL_MS) -> DataFrame:
    """Event-time retention: rows with ts >= max(ts) - ttl (one-row bound, broadcast)."""
    bound = cache.agg((F.max(ts) - F.lit(ttl_ms)).alias("_lo"))
    return cache.crossJoin(F.broadcast(bound)).where(F.col(ts) >= F.col("_lo")).drop("_lo")


def csv_first_n(df: DataFrame, path: str, n: int, order: list[str]) -> None:
    """Export the first ``n`` rows by ``order`` (a top-k, not a full sort) as CSV."""
    df.orderBy(*order).limit(n).write.mode("overwrite").option("header", True).csv(path)


def tracking_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
