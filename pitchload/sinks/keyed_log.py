"""Keyed log: the keyed topic as a folder, written in two phases and read from any offset.

``keyed_send`` gives every record of a micro-batch its key, its number within the key (which goes on over
batches) and a lane (hash of the key), and writes them by the Python data source ``keyed_log``. Rows are
range-partitioned by (lane, key, number): a key's records lie in order, and a key that holds a third of all
rows is spread over many tasks, each of which writes segments of its own. Tasks write staged files; the
commit lists them in ``_commits/<batch>.json`` by one rename, so a batch is there as a whole or not at all,
and a batch that is sent again adds nothing.

As a stream source ``keyed_log`` has one offset per lane (records so far). ``startingOffsets`` is
``earliest``, ``latest`` or JSON ``{"lane": offset}``; a range of offsets is read segment by segment, in as
many tasks, and gives the same records however often it is read. Segments are JSON lines
``[key, seq, value]``.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter,
                                    InputPartition, WriterCommitMessage)

from pitchload.operators.sequence import BUCKET_MS, join_null_safe, number_rows
from pitchload.session import cut

SCHEMA = "lane int, offset long, key string, seq long, value string"
LANES = 8


def _fs(path: str):
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _batches(files, root: str) -> list[int]:
    found = files.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


class Segments(WriterCommitMessage):
    """What one task wrote: [lane, first key, first seq, file, records]."""

    def __init__(self, found: list):
        self.found = found


class _Writing:
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        files, root = _fs(self.path)
        files.create_dir(f"{root}/segments")
        found, out = [], None
        for row in iterator:
            if not found or found[-1][0] != row.lane:
                if out:
                    out.close()
                found.append([row.lane, row.key, row.seq, f"{uuid.uuid4().hex}.jsonl", 0])
                out = files.open_output_stream(f"{root}/segments/{found[-1][3]}")
            out.write(json.dumps([row.key, row.seq, row.value], ensure_ascii=False).encode() + b"\n")
            found[-1][4] += 1
        if out:
            out.close()
        return Segments(found)

    def _drop(self, messages):
        files, root = _fs(self.path)
        for m in messages:
            for s in m.found if m else ():
                files.delete_file(f"{root}/segments/{s[3]}")

    def _commit(self, messages, batch: int):
        files, root = _fs(self.path)
        files.create_dir(f"{root}/_commits")
        if batch in _batches(files, root):
            return self._drop(messages)       # sent before: the first time counts
        segments = sorted(s for m in messages if m for s in m.found)
        draft = f"{root}/_commits/.{batch}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(segments).encode())
        files.move(draft, f"{root}/_commits/{batch}.json")


class LogWriter(_Writing, DataSourceWriter):
    def __init__(self, options):
        super().__init__(options)
        self.batch = int(options["batch"])

    def commit(self, messages):
        self._commit(messages, self.batch)

    def abort(self, messages):
        self._drop(messages)


class LogStreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        self._commit(messages, batchId)

    def abort(self, messages, batchId):
        self._drop(messages)


class Piece(InputPartition):
    """``take`` records of a segment after its first ``skip``; ``offset`` is that of the first one taken."""

    def __init__(self, lane: int, file: str, skip: int, take: int, offset: int):
        self.lane, self.file, self.skip, self.take, self.offset = lane, file, skip, take, offset


class _Reading:
    def __init__(self, options):
        self.path, self.starting, self.known = options["path"], options.get("startingOffsets", "earliest"), {}

    def _segments(self) -> dict[str, list]:
        """Per lane its segments in order; commits already seen are not read again."""
        files, root = _fs(self.path)
        lanes: dict[str, list] = {}
        for b in _batches(files, root):
            if b not in self.known:
                with files.open_input_stream(f"{root}/_commits/{b}.json") as f:
                    self.known[b] = json.loads(f.read())
            for lane, _, _, file, n in self.known[b]:
                lanes.setdefault(str(lane), []).append((file, n))
        return lanes

    def _ends(self) -> dict[str, int]:
        return {lane: sum(n for _, n in found) for lane, found in self._segments().items()}

    def _pieces(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for lane, found in sorted(self._segments().items()):
            at, lo, hi = 0, start.get(lane, 0), end.get(lane, 0)
            for file, n in found:
                a, b = max(lo - at, 0), min(hi - at, n)
                if a < b:
                    out.append(Piece(int(lane), file, a, b - a, at + a))
                at += n
        return out

    def read(self, piece):
        if not isinstance(piece, Piece):
            return
        files, root = _fs(self.path)
        with files.open_input_stream(f"{root}/segments/{piece.file}", buffer_size=1 << 20) as raw:
            rest, line = b"", 0
            while line < piece.skip + piece.take and (chunk := raw.read(1 << 20)):
                *lines, rest = (rest + chunk).split(b"\n")
                for record in lines:
                    if piece.skip <= line < piece.skip + piece.take:
                        key, seq, value = json.loads(record)
                        yield piece.lane, piece.offset + line - piece.skip, key, seq, value
                    line += 1


class LogReader(_Reading, DataSourceReader):
    def partitions(self):
        return self._pieces({}, self._ends()) or [InputPartition(None)]


class LogStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self):
        if self.starting == "earliest":
            return {}
        return self._ends() if self.starting == "latest" else {str(k): int(v) for k, v in json.loads(self.starting).items()}

    def latestOffset(self):
        return self._ends()

    def partitions(self, start, end):
        return self._pieces(start, end)

    def commit(self, end):
        pass


class KeyedLog(DataSource):
    @classmethod
    def name(cls):
        return "keyed_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options)

    def writer(self, schema, overwrite):
        return LogWriter(self.options)

    def streamReader(self, schema):
        return LogStreamReader(self.options)

    def streamWriter(self, schema, overwrite):
        return LogStreamWriter(self.options)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the log: lane, offset, key, seq, value."""
    spark.dataSource.register(KeyedLog)
    return spark.read.format("keyed_log").option("path", path).load()


def stream_log(spark: SparkSession, path: str, starting: str = "earliest") -> DataFrame:
    """The log as a stream from the given offsets on."""
    spark.dataSource.register(KeyedLog)
    return spark.readStream.format("keyed_log").option("path", path).option("startingOffsets", starting).load()


def with_lane(df: DataFrame, keys: list[str], seq: str, lanes: int = LANES) -> DataFrame:
    """lane, offset (set by the log), key, seq, value of every record; key columns that are NULL read ``null``."""
    value = F.to_json(F.struct(*[c for c in df.columns if c != seq]))
    return df.select(F.pmod(F.xxhash64(*keys), F.lit(lanes)).cast("int").alias("lane"), F.lit(None).cast("long").alias("offset"),
                     F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).alias("key"),
                     F.col(seq).alias("seq"), value.alias("value"))


def keyed_send(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: str = "ts_start", lanes: int = LANES) -> None:
    """foreachBatch sink: append the batch's records to the log at ``path``, in order and numbered per key.

    ``order`` is a time in milliseconds. The numbers so far are a table of one row per key beside the log."""
    spark = batch.sparkSession
    spark.dataSource.register(KeyedLog)
    before = [b for b in _batches(*_fs(path)) if b < batch_id]
    numbered = number_rows(batch, keys, [F.col(order), *sorted(c for c in batch.columns if c != order)],
                           F.floor(F.col(order) / BUCKET_MS), out="_seq")
    if before:
        totals = spark.read.parquet(f"{path}/_totals/batch={before[-1]}")
        numbered = join_null_safe(numbered, totals, keys, "left").withColumn("_seq", F.col("_seq") + F.coalesce("_total", F.lit(0))).drop("_total")
    numbered = cut(numbered, "numbered")       # read by the totals, the range bounds and the write
    ends = numbered.groupBy(*keys).agg(F.max("_seq").alias("_total"))
    if before:
        ends = ends.unionByName(totals).groupBy(*keys).agg(F.max("_total").alias("_total"))
    ends.write.mode("overwrite").parquet(f"{path}/_totals/batch={batch_id}")
    sent = with_lane(numbered, keys, "_seq", lanes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartitionByRange(parts, "lane", "key", "seq").sortWithinPartitions("lane", "key", "seq")
    sent.write.format("keyed_log").option("path", path).option("batch", batch_id).mode("append").save()
