"""Batch markers: a micro-batch that writes several tables counts once all of them are written.

A marker is an empty file ``sink/_commits/<batch id>``; creating and deleting it is one operation of the
file system (Hadoop's, so any store that Spark writes to). Readers list the markers and read the folders
``batch_id=N`` of marked batches only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file by one rename: readers see all of it or the file is not there."""
    fs, p = file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, p):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def mark(spark: SparkSession, sink: str, batch_id: int) -> None:
    fs, p = file_system(spark, f"{sink}/_commits/{batch_id}")
    fs.create(p, True).close()


def unmark(spark: SparkSession, sink: str, batch_id: int) -> None:
    delete(spark, f"{sink}/_commits/{batch_id}")


def marked(spark: SparkSession, sink: str) -> list[int]:
    return sorted(int(n) for n in children(spark, f"{sink}/_commits") if n.isdigit())


def read(spark: SparkSession, sink: str, table: str, batches: list[int] | None = None) -> DataFrame:
    """Rows of ``sink/table`` of the marked batches, or of the given ones (column ``batch_id`` included)."""
    batches = marked(spark, sink) if batches is None else batches
    if not batches:
        raise FileNotFoundError(f"no finished batch in {sink}")
    return spark.read.option("basePath", f"{sink}/{table}").parquet(*[f"{sink}/{table}/batch_id={b}" for b in batches])
