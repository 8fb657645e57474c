"""Exact deduplication: state over several batches, byte check on equal keys, odd rows."""

import hashlib
from collections import defaultdict

import duckdb

from pitchload.llm import stream_dedup
from pitchload.session import cut
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, place string, n long"


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    return sorted(((d, max(g), len(g), d == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for d in g))


def table(spark, rows, parts=4):
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], SCHEMA).repartition(parts)
    return cut(df, "docs").inputFiles()[0].rsplit("/", 1)[0]


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def some(n=300):
    return [(i, ["Same", "same", "sAME ", "É", "é", "", None, "x" * 50_000 + "Y"][i % 8] if i % 3 else f"only {i % 40}") for i in range(n)]


def test_classes_over_many_batches(spark):
    assert got(stream_dedup.deduplicate(spark, table(spark, some(), 5), files=1)) == plain(some())


def test_equal_keys_of_different_texts(spark):
    """With one byte of the digest as key nearly all keys clash; the byte check splits them."""
    assert got(stream_dedup.deduplicate(spark, table(spark, some()), key_bytes=1)) == plain(some())


def test_later_files(spark, tmp_path):
    path, folder, rows = f"{tmp_path}/a table", f"{tmp_path}/state", some()
    for part in (rows[:100], rows[100:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(2).write.mode("append").parquet(path)
        stream_dedup.ingest(spark, path, folder)
    assert got(stream_dedup.resolve(spark, path, folder)) == plain(rows)
    kept = sorted(r.doc_id for r in stream_dedup.kept_texts(spark, path, folder).collect())
    assert kept == sorted(d for d, _, _, stays, _ in plain(rows) if stays)


def test_null_ids_and_repeated_rows(spark):
    rows = stream_dedup.deduplicate(spark, table(spark, [(None, "a"), (None, "A"), (7, "b"), (7, "b"), (None, "b")])).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append((r.doc_id, r.keep_id, r.group_size, r.kept))
    a, b = (by[hashlib.sha256(t).hexdigest()] for t in (b"a", b"b"))
    assert sorted(a, key=str) == [(None, None, 2, False), (None, None, 2, True)] and len(rows) == 5
    assert sorted(b, key=str) == [(7, 7, 3, False), (7, 7, 3, True), (None, 7, 3, False)]


def test_empty_table(spark):
    assert stream_dedup.deduplicate(spark, table(spark, [], 1)).count() == 0


def test_against_sql(spark):
    path = f"{SF001}/documents.parquet"
    want = duckdb.sql(stream_dedup.ORACLE.replace("FROM documents", f"FROM '{path}'")).fetchall()
    assert got(stream_dedup.deduplicate(spark, path)) == sorted(want)
