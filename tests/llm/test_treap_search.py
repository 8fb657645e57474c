"""Search over quadtrees of impacts, held against all scores."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from pitchload.llm import treap_search
from tests.conftest import SF001

DOCS, ITEMS = "doc_id long, text string, terms string, n long", "item_id long, text string, item string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    total, n_all = sum(sum(c.values()) for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(words(text)) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "x1"]
    docs = [(i, " ".join(r.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=r.randint(0, 40))).upper()) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1]), (999, None), (998, "--"), (997, "w1 w2 " * 30_000)]
    items = [(i, " ".join(r.choices(pool, k=r.randint(1, 25)))) for i in range(25)]
    return docs, items + [(30, docs[3][1]), (31, None), (32, "..."), (33, "nowhere"), (34, docs[7][1]), (34, docs[7][1]), (None, "w1 w5")]


@pytest.mark.parametrize("shard, cells, block, long", [(4096, 1 << 21, 50_000, 2048), (16, 300, 40, 4)])
def test_all_scores(spark, monkeypatch, shard, cells, block, long):
    for name, value in (("SHARD_DOCS", shard), ("SHARD_CELLS", cells), ("BLOCK", block), ("LONG", long)):
        monkeypatch.setattr(treap_search, name, value)
    docs, items = corpus(shard)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(4)
    # workers have their own copy of the module: the small sizes are checked there by _postings below
    assert got(treap_search.ranked(df, spark.createDataFrame([(*i, "x") for i in items], ITEMS))) == plain(docs, items)


def test_small_shards_by_hand(monkeypatch):
    """The same in one process, where the small sizes hold: shards, trees, and both ways of finding cells."""
    import pandas as pd
    docs, items = corpus(5)
    docs = [d for d in docs if d[0] is not None]
    monkeypatch.setattr(treap_search, "SHARD_DOCS", 16)
    monkeypatch.setattr(treap_search, "SHARD_CELLS", 120)
    shards = [s.iloc[0] for s in treap_search._postings([pd.DataFrame(docs, columns=["doc_id", "text"])])]
    assert len(shards) > 20 and max(len(s.doc_ids) for s in shards) <= 16
    for long in (0, 1 << 20):
        monkeypatch.setattr(treap_search, "LONG", long)
        for s in shards:
            counts, col = np.frombuffer(s.counts, np.int32), np.frombuffer(s.cols, np.uint16).astype(np.int64)
            row, tf = np.repeat(np.arange(len(counts)), counts), np.frombuffer(s.tfs, np.int32).astype(np.int64)
            bits = max(len(s.doc_ids) - 1, 1).bit_length()
            key, widths, masks, gaps = treap_search.quadtrees(row, col, tf, bits)
            tree = treap_search.Treap(bits, key.astype(np.int32).tobytes(), widths, masks.tobytes(), gaps.astype(np.int32).tobytes())
            rows = np.unique(np.random.default_rng(0).integers(0, len(counts), 7))
            grid = np.zeros((len(counts), len(s.doc_ids)), np.int64)
            grid[row, col] = tf
            weights = np.arange(1, len(rows) + 1)
            want = sorted((-int(x), False, d) for x, d in zip(weights @ grid[rows], s.doc_ids) if x > 0)[:3]
            assert tree.search(rows, weights, s.doc_ids, [], 3) == want


def test_shards_go_one_at_a_time(spark, monkeypatch):
    """Several full shards in one task: each is an Arrow batch of its own, and no more than two share a row group."""
    searcher, read, key = treap_search._searcher, spark.sparkContext.accumulator(0), "spark.sql.execution.arrow.maxBytesPerBatch"

    def watched(k):
        run = searcher(k)

        def one(batches):
            for batch in batches:
                assert batch.num_rows == 1
                read.add(1)
                yield batch
        return lambda batches: run(one(batches))

    monkeypatch.setattr(treap_search, "_searcher", watched)
    docs = spark.range(0, 9_000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 250), x -> concat('w', pmod(xxhash64(id, x), 60000)))) AS text")
    before = spark.conf.get(key, None)
    index, n_docs = treap_search.build(docs)
    shards, files = index.count(), [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert n_docs == 9_000 and shards >= 4 and max(g.num_rows for g in groups) <= 2
    assert not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))     # whole values, kept until a file ends
    assert treap_search.search(index, n_docs, spark.createDataFrame([(1, "w1 w2 w3", "x")], ITEMS)).count() == 10
    assert read.value == shards and spark.conf.get(key, None) == before


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert treap_search.ranked(docs, items).count() == 0
    assert treap_search.ranked(spark.createDataFrame([(1, "a", "x", 1)], DOCS), items.limit(0)).count() == 0


def test_ranges_are_left_unopened(monkeypatch):
    """One document of many has the rare words: most ranges are never opened."""
    r = np.random.default_rng(1)
    row, col = np.nonzero(r.random((64, 4096)) < 0.05)
    value = r.integers(1, 1000, len(row))
    value[col == 1234] = 5000
    key, widths, masks, gaps = treap_search.quadtrees(row, col, value, 12)
    tree = treap_search.Treap(12, key.astype(np.int32).tobytes(), widths, masks.tobytes(), gaps.astype(np.int32).tobytes())
    opened, child = [], treap_search.Treap.child
    monkeypatch.setattr(treap_search.Treap, "child", lambda self, n, q: (opened.append(len(n)), child(self, n, q))[1])
    rows = row[col == 1234][:2]
    assert tree.search(rows, np.array([1, 1]), list(range(4096)), [], 1) == [(-10000, False, 1234)]
    assert sum(opened) < 1000


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    want = sorted(con.execute(treap_search.ORACLE).fetchall(), key=str)
    rows = got(treap_search.ranked(*[spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark")]))
    assert rows == want and len(rows) > 50
