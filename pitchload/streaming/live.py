"""Live path: Structured Streaming with keyed state, same answers as the batch plans.

Window functions such as ``lag`` are not allowed on streaming frames, so the
ordered per-player steps (rates -> edge / distance / zone -> event automaton ->
merge) are one keyed stateful step (``transformWithStateInPandas`` on the RocksDB
store). Spark shuffles the rows by key; each key's micro-batch rows are folded in
event-time order. A key's value state holds the last speeds and position, the open
event and the pending merge group; its map state holds the metres run in each speed
zone so far, which every row after the first carries along. A processing-time timer
can flush the pending merge group of a key that has gone silent (``flush_ms``).

Rows of one time are ordered by their values (x, y, speed), in a batch and across
batches, so a key's rows give the same answer however the trigger cuts them.

The state step emits rows of several kinds in one wide schema: ``enriched`` rows,
``extracted`` and ``merged`` events, ``late`` rows (before the key's last row) and
``reject`` rows (no key, time, position or speed). ``foreachBatch`` routes them to
idempotent table sinks, so nothing is dropped unseen. The stateless tail (filter,
classify, score) and the batch's share of the zone totals are computed there too.
A batch counts once its marker is set, after its last table: ``committed`` reads
the tables of marked batches only, so a failure between two writes shows nothing
of the batch in any table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pitchload import schema as SCH
from pitchload.functions import scalar as S
from pitchload.operators import kinematics as K
from pitchload.operators import scoring as SC
from pitchload.operators.events import MERGE_GAP_MS
from pitchload.operators.zones import zone_distance
from pitchload.session import checkpoint_dir, cut, rocksdb_state
from pitchload.sinks import commits
from pitchload.sinks.keyed_log import stream_log
from pitchload.sinks.writers import cache_expire, cache_write, zone_compact, zone_upsert

_I, _L, _D, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

# fold output after the key columns
BODY = T.StructType([T.StructField(n, t) for n, t in [
    ("kind", _S), ("team", _I), ("jersey_number", _I), ("ts_ms", _L), ("x", _D), ("y", _D),
    ("speed", _D), ("acc_actual", _D), ("acc_event", _D), ("start_event", _I), ("dist", _D), ("speedzone", _I),
    ("ts_start", _L), ("ts_end", _L), ("duration", _D), ("v_init", _D), ("max_acc", _D), ("max_speed", _D),
    ("late_rows", _L), *[(f"dist_{z}", _D) for z, _, _ in S.SPEED_ZONES_KMH]]])
# with the default key
OUT = T.StructType([T.StructField("player_id", _I)] + BODY.fields)

STATE = T.StructType([T.StructField(n, t) for n, t in [
    ("n", _L), ("last_ts", _L), ("last_row", T.ArrayType(_D)), ("speeds", T.ArrayType(_D)), ("prev_acc", _D),
    ("phase", _I), ("open", T.ArrayType(_D)), ("group", T.ArrayType(_D)), ("team", _I), ("jersey_number", _I)]])

_FIRST_ENRICHED = K.SMALL_LAG + 2

# phases of a key's event automaton
IDLE, OPEN, RUNNING = 0, 1, 2


def automaton(ts, speed, acc, start, good, phase: int, event: list):
    """Run the event automaton over a key's rows; returns (events, phase, open event).

    An idle key opens an event at a start row; an open one runs from the first good row on;
    a running one takes in good rows and ends before the first row that is not. Only phase
    changes are visited, the stretches between them are array slices.
    An event is [start, end, first speed, greatest acceleration, greatest speed].
    """
    at = {IDLE: np.flatnonzero(start), OPEN: np.flatnonzero(good), RUNNING: np.flatnonzero(~good)}
    done, i, n = [], 0, len(ts)
    while i < n:
        k = np.searchsorted(at[phase], i)
        turn = int(at[phase][k]) if k < len(at[phase]) else n
        if phase == RUNNING and turn > i:
            event = [event[0], float(ts[turn - 1]), event[2], max(event[3], float(acc[i:turn].max())),
                     max(event[4], float(speed[i:turn].max()))]
        if turn == n:
            break
        if phase == IDLE:
            event, phase, i = [float(ts[turn]), float("nan"), float(speed[turn]), 0.0, 0.0], OPEN, turn + 1
        elif phase == OPEN:
            phase, i = RUNNING, turn
        else:
            done.append(event)
            event, phase, i = [], IDLE, turn + 1
    return done, phase, event


def join_groups(events: list, group: list, gap_ms: int = MERGE_GAP_MS):
    """Merge events less than ``gap_ms`` apart into the open group; returns (closed groups, open group).
    Events without length are passed over."""
    closed = []
    for e in events:
        if e[1] <= e[0]:
            continue
        if group and e[0] - group[1] < gap_ms:
            group = [group[0], e[1], group[2], max(group[3], e[3]), max(group[4], e[4])]
        else:
            closed += [group] if group else []
            group = e
    return closed, group


def _zones(speed: np.ndarray) -> np.ndarray:
    kmh = speed * S.MS_TO_KMH
    zone = np.full(len(kmh), np.nan)
    for z, lo, hi in S.SPEED_ZONES_KMH:
        zone[(kmh >= lo) & (kmh <= hi)] = z
    return zone


def _before(pdf: pd.DataFrame, last: tuple) -> np.ndarray:
    """Rows that come before ``last`` in the order of (ts_ms, x, y, speed)."""
    less = np.zeros(len(pdf), bool)
    for column, value in reversed(list(zip(("ts_ms", "x", "y", "speed"), last))):
        c = pdf[column].to_numpy()
        less = (c < value) | ((c == value) & less)
    return less.astype(bool)


def _running_zones(zones: dict, zone: np.ndarray, dist: np.ndarray) -> dict:
    """Metres per zone after every row, going on from ``zones``, which moves on to the last row."""
    out = {}
    for z, _, _ in S.SPEED_ZONES_KMH:
        out[f"dist_{z}"] = run = np.cumsum(np.concatenate(([zones.get(z, 0.0)], np.where(zone == z, dist, 0.0))))[1:]
        if len(run):
            zones[z] = float(run[-1])
    return out


def _events_frame(events: list, **columns) -> pd.DataFrame:
    e = pd.DataFrame(events, columns=["ts_start", "ts_end", "v_init", "max_acc", "max_speed"])
    return e.assign(duration=(e["ts_end"] - e["ts_start"]) / 1000.0, **columns)


def _shaped(parts: list, key, key_names) -> pd.DataFrame:
    """Rows of all kinds in the output schema, with the key columns in front."""
    res = pd.concat([o.reindex(columns=BODY.fieldNames()) for o in parts], ignore_index=True)
    for c in ("team", "jersey_number", "ts_ms", "start_event", "speedzone", "ts_start", "ts_end", "late_rows"):
        res[c] = res[c].astype("Int64")
    for i, (name, value) in enumerate(zip(key_names, key)):
        res.insert(i, name, value)
    return res


def _fold(key, pdfs, state, key_names=("player_id",), zones: dict | None = None):
    """Per-key fold over one micro-batch, rows in event-time order. ``zones`` (zone -> metres) is
    brought up to date in place; without it rows carry no zone map."""
    pdf = pd.concat(list(pdfs), ignore_index=True)
    bad = pdf[["ts_ms", "x", "y", "speed"]].isna().any(axis=1) | any(pd.isna(k) for k in key)
    out = [pdf[bad].assign(kind="reject")]
    pdf = pdf[~bad].sort_values(["ts_ms", "x", "y", "speed"], kind="stable")
    n, last_ts, last_row, speeds, prev_acc, phase, event, group, team, jersey = \
        state.get if state.exists else (0, None, [], [], None, IDLE, [], [], None, None)
    if last_ts is not None:
        old = _before(pdf, (last_ts, *last_row))
        out.append(pdf[old].assign(kind="late", late_rows=1))
        pdf = pdf[~old]
    if len(pdf):
        ts, v = pdf["ts_ms"].to_numpy().astype(np.int64), pdf["speed"].to_numpy(float)
        x, y = pdf["x"].to_numpy(float) / S.CM_PER_M, pdf["y"].to_numpy(float) / S.CM_PER_M
        tail = np.array(speeds, float)
        every, place = np.concatenate((tail, v)), n + 1 + np.arange(len(v))
        before = lambda lag: every[np.maximum(len(tail) + np.arange(len(v)) - lag, 0)]
        acc = np.where(place > K.SMALL_LAG, (v - before(K.SMALL_LAG)) / (K.SMALL_LAG * K.STEP_S), 0.0)
        acc_ev = np.where(place > K.BIG_LAG, (v - before(K.BIG_LAG)) / (K.BIG_LAG * K.STEP_S), 0.0)
        first = [last_ts, last_row[0] / S.CM_PER_M, last_row[1] / S.CM_PER_M, prev_acc] if n else [ts[0], x[0], y[0], 0.0]
        was_ts, was_x, was_y, was_acc = (np.concatenate(([f], c[:-1])) for f, c in zip(first, (ts, x, y, acc_ev)))
        keep = place >= _FIRST_ENRICHED
        start = (was_acc <= 0) & (acc_ev > 0)
        good = ((acc_ev >= 0) | (v >= S.MIN_SPEED_GOOD)) & (ts - was_ts < K.GAP_CLOSE_MS)
        zone, dist = _zones(v[keep]), np.sqrt((was_x - x) ** 2 + (was_y - y) ** 2)[keep]
        rows = pdf[keep].assign(kind="enriched", x=x[keep], y=y[keep], acc_actual=acc[keep], acc_event=acc_ev[keep],
                                start_event=start[keep].astype(int), speedzone=zone, dist=dist)
        if zones is not None:
            later = place[keep] > _FIRST_ENRICHED       # the first row only starts the map
            rows = rows.assign(**{c: np.where(later, run, np.nan) for c, run in _running_zones(zones, zone, dist).items()})
        out.append(rows)
        done, phase, event = automaton(ts[keep], v[keep], acc[keep], start[keep], good[keep], phase, list(event))
        closed, group = join_groups(done, list(group))
        team, jersey = (None if pd.isna(c.iloc[-1]) else int(c.iloc[-1]) for c in (pdf["team"], pdf["jersey_number"]))
        out += [_events_frame(events, kind=kind, team=team, jersey_number=jersey) for kind, events in (("extracted", done), ("merged", closed))]
        n, speeds = n + len(v), every[-K.BIG_LAG:].tolist()
        last_ts, last_row, prev_acc = int(ts[-1]), [float(c) for c in pdf[["x", "y", "speed"]].iloc[-1]], float(acc_ev[-1])
    if n:
        state.update((n, last_ts, list(last_row), list(speeds), prev_acc, phase, list(event), list(group), team, jersey))
    out = [o for o in out if len(o)]
    if out:
        yield _shaped(out, key, key_names)


class _Held:
    """A value state as ``_fold`` takes it: ``exists``, ``get``, ``update``."""

    def __init__(self, value_state):
        self.get = value_state.get() if value_state.exists() else None
        self.exists, self.update = self.get is not None, value_state.update


class KeyedFold(StatefulProcessor):
    """The fold's state per key: one value, the zone map and, with ``flush_ms``, one timer.

    The timer runs from the key's last micro-batch on. When it fires, the pending merge group is emitted
    as a merged event; an event that opens later within the merge gap then starts a group of its own.
    """

    def __init__(self, key_names: list[str], flush_ms: int | None = None):
        self.key_names, self.flush_ms = key_names, flush_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", STATE)
        self.zones = handle.getMapState("zones", "zone int", "metres double")

    def handleInputRows(self, key, rows, timerValues):
        was = {z[0]: m[0] for z, m in self.zones.iterator()}
        zones = dict(was)
        yield from _fold(key, rows, _Held(self.value), self.key_names, zones)
        for z, metres in zones.items():
            if was.get(z) != metres:
                self.zones.updateValue((z,), (metres,))
        if self.flush_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.value.exists():
            return
        *rest, group, team, jersey = self.value.get()
        if group:
            self.value.update((*rest, [], team, jersey))
            yield _shaped([_events_frame([list(group)], kind="merged", team=team, jersey_number=jersey)], key, self.key_names)

    def close(self) -> None:
        pass


def read_ingestion(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = SCH.INGESTION,
                   max_files: int | None = None) -> DataFrame:
    """Typed record stream (file source in tests; ``format("kafka")`` + ``from_json`` on a
    cluster). The ISO timestamp is parsed once into ``ts_ms``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(path)
    return df.withColumn("ts_ms", S.parse_iso_ms("timestamp"))


def read_ingestion_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
                         max_offsets: int | None = None, schema: T.StructType = SCH.INGESTION) -> DataFrame:
    """The ingestion topic: JSON values parsed with the declared schema.

    ``starting="earliest"`` replays the topic from its first offset (the optional
    earliest-offset setting); ``max_offsets`` bounds a micro-batch, and so the rows one
    key brings to the fold. Needs the Spark Kafka connector on the classpath (not
    bundled here); tests use the file source with the same records.
    """
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    rec = r.load().select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    return rec.withColumn("ts_ms", S.parse_iso_ms("timestamp"))


def read_ingestion_log(spark: SparkSession, path: str, starting: str = "earliest", schema: T.StructType = SCH.INGESTION) -> DataFrame:
    """The ingestion records of a keyed log (``sinks.keyed_log``) from the given offsets on."""
    rec = stream_log(spark, path, starting).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rec.withColumn("ts_ms", S.parse_iso_ms("timestamp"))


def keyed_fold(stream: DataFrame, keys: list[str] = ("player_id",), flush_ms: int | None = None) -> DataFrame:
    """The stateful step: enriched rows, extracted and merged events (column ``kind``),
    each prefixed by the key columns (e.g. ``match_id, player_id``)."""
    keys = list(keys)
    cols = [*keys, "team", "jersey_number", "ts_ms", "x", "y", "speed"]
    sel = stream.select(*cols)
    out = T.StructType([sel.schema[k] for k in keys] + BODY.fields)
    return sel.groupBy(*keys).transformWithStateInPandas(KeyedFold(keys, flush_ms), out, "Append", "ProcessingTime" if flush_ms else "None")


def score_batch(merged: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stateless tail per batch: filter, classify (broadcast thresholds), score."""
    return SC.score(SC.classify(SC.filter_min_action(merged), thresholds))


KINDS = ("enriched", "extracted", "merged", "late", "reject")
ZONE_MAP = [f"dist_{z}" for z, _, _ in S.SPEED_ZONES_KMH]


def start_live(spark: SparkSession, source: str | None, sink: str, thresholds: DataFrame, name: str = "live",
               available_now: bool = True, processing_time: str = "15 seconds", max_files: int | None = None,
               stream: DataFrame | None = None, keys: list[str] = ("player_id",), flush_ms: int | None = None):
    """Run the live pipeline; writes ``sink``/{enriched,extracted,merged,scored,late,reject,zone_parts,zone_map}/batch_id=N
    and marks the batch; then ``sink``/cache loses what has expired.

    ``source`` is a folder of JSON records; or pass ``stream`` (e.g. ``read_ingestion_kafka``)."""
    keys = list(keys)
    folded = keyed_fold(stream if stream is not None else read_ingestion(spark, source, max_files=max_files), keys, flush_ms)
    thr = cut(thresholds, "thresholds")   # one row, read by every batch
    by = [k for k in keys if k != "player_id"]

    def route(batch: DataFrame, batch_id: int):
        commits.unmark(spark, sink, batch_id)      # a batch that is run again counts when it is whole again
        batch.persist()
        try:
            for kind in KINDS:
                part = batch.where(F.col("kind") == kind).drop("kind", *ZONE_MAP)
                part.write.mode("overwrite").parquet(f"{sink}/{kind}/batch_id={batch_id}")
            enriched = batch.where("kind = 'enriched'")
            enriched.where(F.col(ZONE_MAP[0]).isNotNull()).select(*keys, "ts_ms", "team", "jersey_number", *ZONE_MAP) \
                .write.mode("overwrite").parquet(f"{sink}/zone_map/batch_id={batch_id}")
            zone_distance(enriched, group=(*by, "team", "jersey_number")) \
                .write.mode("overwrite").parquet(f"{sink}/zone_parts/batch_id={batch_id}")
            merged = batch.where(F.col("kind") == "merged").select(
                *keys, "team", "jersey_number", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed")
            score_batch(merged, thr).write.mode("overwrite").parquet(f"{sink}/scored/batch_id={batch_id}")
            cache_write(enriched.select(*keys, "ts_ms", "speed", "speedzone", "dist"), batch_id, f"{sink}/cache", keys)
        finally:
            batch.unpersist()
        commits.mark(spark, sink, batch_id)
        cache_expire(spark, f"{sink}/cache")

    w = folded.writeStream.foreachBatch(route).option(
        "checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    with rocksdb_state(spark):
        return w.start()


def committed(spark: SparkSession, sink: str, kind: str) -> DataFrame:
    """A live job's table ``kind``: the rows of its marked batches."""
    return commits.read(spark, sink, kind)


def replay(spark: SparkSession, path: str, starting: str, out: str) -> None:
    """Copy the records of a keyed log from the given offsets on to the table ``out``; a later call goes on
    from where this one ended."""
    w = read_ingestion_log(spark, path, starting).writeStream.format("parquet").option("path", out)
    w.option("checkpointLocation", f"{out}/_state").trigger(availableNow=True).start().awaitTermination()


def zone_totals(spark: SparkSession, sink: str, by: list[str] = ()) -> DataFrame:
    """Running SUM(dist) by (``by``,) team, jersey and zone of a live job: the sum of its batches' shares.
    A batch that is run again writes its share anew, so a retry changes nothing."""
    keys = [*by, "team", "jersey_number", "speedZone"]
    return committed(spark, sink, "zone_parts").groupBy(*keys).agg(F.sum("total_distance").alias("total_distance"))


ZONE_SQL = """SELECT team, jersey_number, speedZone, SUM(dist) AS total_distance FROM {enriched}
WHERE speedZone IS NOT NULL GROUP BY team, jersey_number, speedZone"""


def zone_totals_stream(spark: SparkSession, enriched_path: str, sink: str, name: str = "zones",
                       available_now: bool = True):
    """Continuous SQL over the enriched rows as a stream of the declared schema (update mode),
    upserted per batch into ``sink`` (latest row per key wins on read).

    The folder's batches must be complete: a batch that the live job writes again under new
    file names is new input here (``zone_totals`` is safe against that)."""
    src = spark.readStream.schema(SCH.ENRICHED_STREAM).parquet(enriched_path)
    agg = spark.sql(ZONE_SQL, enriched=src)

    def upsert(batch: DataFrame, batch_id: int):
        zone_upsert(batch, batch_id, sink)
        zone_compact(spark, sink, ["team", "jersey_number", "speedZone"])

    return _started(agg.writeStream.outputMode("update").foreachBatch(upsert), spark, name, available_now)


#: how far event time may lag behind the newest event before an event counts as late
SESSION_DELAY_MS = 600_000


def session_merge(events: DataFrame, keys: list[str] = ("player_id",), gap_ms: int = MERGE_GAP_MS,
                  delay_ms: int = SESSION_DELAY_MS) -> DataFrame:
    """Option: merge by an inactivity gap with ``session_window``, on a table or a stream of events.

    Spark's gap bound is inclusive, so 1 ms is taken off to keep "exactly 0.5 s apart" separate. On a
    stream in append mode a session is emitted when the watermark (``delay_ms`` behind the newest event
    start) passes its end, so the last group is flushed by later events of any key or by the end marker."""
    ev = events.withColumn("_t0", F.timestamp_millis("ts_start"))
    if events.isStreaming:
        ev = ev.withWatermark("_t0", f"{delay_ms} milliseconds")
    # one condition on the event time: it stays above the watermark, which so sees the end marker too
    ev = ev.where(F.expr("CASE WHEN _t0 IS NULL THEN false ELSE duration > 0 END"))
    # a session spans [start, end + gap); the event's own length is folded in by
    # opening the window at the event start with a gap of (duration + gap)
    gap = F.concat((F.col("ts_end") - F.col("ts_start") + F.lit(gap_ms - 1)).cast("string"), F.lit(" milliseconds"))
    grouped = ev.groupBy(*keys, F.session_window("_t0", gap).alias("sw")).agg(
        F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"),
        F.min_by("v_init", "ts_start").alias("v_init"), F.max("max_acc").alias("max_acc"),
        F.max("max_speed").alias("max_speed"), F.max_by("team", "ts_start").alias("team"),
        F.max_by("jersey_number", "ts_start").alias("jersey_number"))
    return grouped.select(*keys, "team", "jersey_number", "ts_start", "ts_end",
                          ((F.col("ts_end") - F.col("ts_start")) / F.lit(1000.0)).alias("duration"),
                          "v_init", "max_acc", "max_speed")


def _started(writer, spark: SparkSession, name: str, available_now: bool):
    w = writer.option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="15 seconds")
    with rocksdb_state(spark):
        return w.start()


def split_late(events: DataFrame, sink: str, name: str, delay_ms: int = SESSION_DELAY_MS, available_now: bool = True):
    """Events of a stream that start ``delay_ms`` or more before the newest start of earlier batches go to
    ``sink``/late, the others to ``sink``/on_time. Each batch stores the newest start it has seen, so a batch
    that is run again splits as before.

    What a later watermark of the same delay would drop unseen is so in a table of its own: the watermark
    that a reader of ``on_time`` has reached is never ahead of the bound that the rows were held against."""
    spark = events.sparkSession

    def route(batch: DataFrame, batch_id: int):
        commits.unmark(spark, sink, batch_id)
        seen = [b for b in commits.marked(spark, sink) if b < batch_id]
        newest = spark.read.parquet(f"{sink}/newest/batch_id={seen[-1]}").first()[0] if seen else None
        late = F.lit(False) if newest is None else F.col("ts_start") <= F.lit(newest - delay_ms)
        batch.persist()
        try:
            batch.where(late).write.mode("overwrite").parquet(f"{sink}/late/batch_id={batch_id}")
            batch.where(~late).coalesce(1).write.mode("overwrite").parquet(f"{sink}/on_time/batch_id={batch_id}")
            batch.agg(F.greatest(F.max("ts_start"), F.lit(newest).cast("long")).alias("newest")) \
                .write.mode("overwrite").parquet(f"{sink}/newest/batch_id={batch_id}")
        finally:
            batch.unpersist()
        commits.mark(spark, sink, batch_id)

    return _started(events.writeStream.foreachBatch(route), spark, name, available_now)


def session_merge_stream(spark: SparkSession, sink: str, schema: T.StructType, name: str, keys: list[str] = ("player_id",),
                         delay_ms: int = SESSION_DELAY_MS, available_now: bool = True):
    """``session_merge`` over the stream of ``sink``/on_time (see ``split_late``), append mode, to ``sink``/sessions."""
    events = spark.readStream.schema(schema).parquet(f"{sink}/on_time/batch_id=*")
    merged = session_merge(events, list(keys), delay_ms=delay_ms)
    write = lambda b, i: b.write.mode("overwrite").parquet(f"{sink}/sessions/batch_id={i}")
    return _started(merged.writeStream.outputMode("append").foreachBatch(write), spark, name, available_now)


def end_marker(spark: SparkSession, schema: T.StructType, after_ms: int, delay_ms: int = SESSION_DELAY_MS) -> DataFrame:
    """One event without key and length that moves the watermark past ``after_ms``: the end of the input.
    It takes part in no session."""
    at = after_ms + delay_ms + 1_000
    row = {"ts_start": at, "ts_end": at, "duration": 0.0}
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema)], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
