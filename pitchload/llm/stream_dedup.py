"""Exact deduplication with keyed streaming state on disk.

`ingest` reads the table as a stream. The state (RocksDB, checkpointed in the shared folder, no watermark
and no expiry) keeps per digest of the normalised text how many rows had it, and of the row with the
largest doc_id the stable identifier and the content locator: file and row number. Rows are combined per
task before the shuffle, so a text that a third of all rows share costs one row a task. Files that arrive
later are read by the next call alone; the state goes on where it stood.

`resolve` checks the full bytes on hits: of the rows of a digest the smallest and the largest normalised
text, again combined per task, must be the same bytes. Where they are not (two texts, one digest) the
digest's rows are grouped anew by their whole bytes. Every row then gets its class from the state.

Normalised text: A-Z lower-cased, all else as it is; a null text counts as empty. Null doc_ids are smaller
than all others; rows of one doc_id and one text are rows of their own, of which exactly one stays. An
empty table gives an empty result; other columns are not read. A text of any length is one value in one
row and nothing else grows with it.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchload.session import checkpoint_dir, cut

SCHEMA = "doc_id long, text string"
#: a call takes all new files in one micro-batch, so each state partition is loaded, written and let go once;
#: unloading on commit leaves nothing of the state on the executors' disks
ROCKSDB = {"spark.sql.streaming.stateStore.unloadOnCommit": "true",
           "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def normal_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text with A-Z lower-cased (empty for null)."""
    @F.pandas_udf("binary")
    def lower(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t.encode().lower() if t else b"")   # bytes.lower() touches A-Z only
    return lower(text)


def _rows(table: DataFrame, key_bytes: int) -> DataFrame:
    """doc_id, normalised bytes, key (the digest, or its first bytes), SHA-256 and locator of every row."""
    got = table.select("doc_id", normal_bytes(F.col("text")).alias("normal"), F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
    got = got.withColumn("sha", F.sha2("normal", 256))
    return got.withColumn("key", F.substring(F.unhex("sha"), 1, key_bytes))


def _glob(path: str) -> str:
    """The same path as a pattern: a stream takes a pattern for a single file too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, path: str, folder: str, key_bytes: int = 32, files: int | None = None) -> None:
    """Bring the state in `folder` up to date with the files of the Parquet table at `path`.

    `files` bounds the files of a micro-batch. Each micro-batch writes the classes it touched to its own
    folder, which a retry overwrites.
    """
    reader = spark.readStream.schema(SCHEMA)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(_glob(path))
    state = _rows(stream, key_bytes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "place")).alias("last"))
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:   # a started query keeps its own copy of the settings
        query = (state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
                 .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/classes/batch={i}")).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def classes(spark: SparkSession, folder: str) -> DataFrame:
    """The state as the stream last gave it: key, n, last (doc_id, place). Both only ever grow."""
    schema = "key binary, n long, last struct<doc_id: long, place: struct<file: string, row: long>>, batch int"
    got = spark.read.schema(schema).parquet(f"{folder}/classe[s]")
    return got.groupBy("key").agg(F.max("n").alias("n"), F.max("last").alias("last"))


def resolve(spark: SparkSession, path: str, folder: str, key_bytes: int = 32) -> DataFrame:
    """One row per row of the table: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(spark.read.schema(SCHEMA).parquet(path), key_bytes)
    known = classes(spark, folder)
    unlike = cut(rows.groupBy("key").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi"))
                 .where("lo <> hi").select("key"), "unlike")
    got = rows.select("doc_id", "key", "place", "sha").join(known, "key")
    if not unlike.isEmpty():
        exact = rows.join(unlike, "key", "left_semi").groupBy("normal").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "place")).alias("last"))
        got = got.join(unlike, "key", "left_anti").unionByName(
            rows.join(exact, "normal").select("doc_id", "key", "place", "sha", "n", "last"))
    return got.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("place") == F.col("last.place")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(spark: SparkSession, path: str, folder: str | None = None, key_bytes: int = 32, files: int | None = None) -> DataFrame:
    """`ingest` and `resolve`; without `folder` the state goes to a new one in the shared folder."""
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/exact-dedup-{uuid.uuid4().hex}"
    ingest(spark, path, folder, key_bytes, files)
    return resolve(spark, path, folder, key_bytes)


def kept_texts(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The table without the copies: rows that the locators in the state point at, texts as they are."""
    table = spark.read.schema(SCHEMA).parquet(path)
    table = table.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    return table.join(classes(spark, folder).select("last.place.*"), ["file", "row"], "left_semi").select("doc_id", "text")


#: DuckDB twin: the row that stays is the one of the largest doc_id; without repeated doc_ids there is one
ORACLE = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(normal) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents)
WINDOW w AS (PARTITION BY normal)"""
