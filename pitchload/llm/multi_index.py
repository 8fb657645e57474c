"""Nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, and each half gets its own centroids. A vector's cell is the pair of
its halves' nearest centroids. A query walks the pairs by the sum of both distances, with a heap that
starts at the nearest pair and offers the next centroid of either half, until the cells it has met hold
enough vectors. Their entries are reranked by the Euclidean distance of the original vectors.

The centroids are fitted on a bounded sample; every vector is indexed. Cells are met as a whole, so a
cell of any size loses nobody. Queries go over the index in blocks of bounded size: a block travels to
the tasks with its queries' cells, and each task reranks its entries and keeps every query's best.

Recall depends on `share`, the part of the vectors that a query's cells must hold. Vectors without any
cluster structure, as in the test tables, need a large part; the README has figures.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchload.session import cut

SAMPLE = 20_000           # vectors that the centroids are fitted on (expected number)
CENTROIDS = 256           # most centroids of a half; PER_ROOT times the root of the table's rows, so cells grow with it
PER_ROOT = 0.7
SHARE, LEAST = 0.5, 1_000 # of the vectors, and vectors, that a query's cells must hold together
BLOCK = 1024              # queries (expected) that go over the index together
ROUNDS = 12               # of k-means


def kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Centroids of the rows; a centroid that loses all its rows goes to a row far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        d = distances(x, c)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        far = np.argsort(-d[np.arange(len(x)), own])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], 0)
        lost = np.flatnonzero(n == 0)
        c[lost] = x[far[:len(lost)]]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def traverse(a: np.ndarray, b: np.ndarray, size, enough: int) -> list[int]:
    """Cells (i * len(b) + j) in order of a[i] + b[j], until those met hold `enough` vectors.

    `size(cell)` is a cell's number of vectors; empty cells are passed over.
    """
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    ia, ib = ia.tolist(), ib.tolist()
    heap, out, met = [(sa[0] + sb[0], 0, 0)], [], 0
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        cell = ia[i] * len(sb) + ib[j]
        n = size(cell)
        if n:
            out.append(cell)
            met += n
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):                  # a row's first pair opens the next row
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, of the table's most frequent length (the
    longer of equals), no null or non-finite component, not all zero, with a vec_id."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    dim = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return v.where(F.size("v") == (dim.d if dim else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and distances of the k nearest different vec_ids among the rows that `may` allows, ties to
    the smaller. Distances are of the differences themselves, in double precision."""
    rows = np.flatnonzero(may)
    near = rows
    if len(rows) > k:
        rough = distances(x[rows], q[None])[:, 0]
        edge = np.partition(rough, k - 1)[k - 1]
        # what rounding can change in the expanded squares, on both sides of the edge
        longest = np.sqrt((x[rows] * x[rows]).sum(1).max()) + np.sqrt((q * q).sum())
        slack = 8 * (len(q) + 8) * np.finfo(float).eps * longest * longest
        near = rows[rough <= edge + slack + 1e-9 * (1 + edge)] if np.isfinite(slack) else rows
        if len(np.unique(ids[near])) < k:               # repeated vec_ids
            near = rows
    d = x[near] - q
    score = np.sqrt((d * d).sum(1))
    o = np.lexsort((ids[near], score))
    _, first = np.unique(ids[near][o], return_index=True)
    o = o[np.sort(first)][:k]
    return ids[near][o], score[o]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE,
           sample: int = SAMPLE, centroids: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query, nearest first, ties to the
    smaller vec_id; all candidates if there are fewer.

    Both tables are (vec_id, embedding); see `valid` for rows that take no part. A row is no candidate
    for a query of its own vec_id. A repeated vec_id counts once, at its smallest distance; other
    columns are ignored; an empty table gives an empty table. Of vectors with one component the first half is
    empty. Candidates are chosen with room for rounding, so an offset common to all vectors loses none.
    """
    spark = vectors.sparkSession
    data = valid(vectors)
    n = data.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    rows = data.where(place < int(min(1.0, sample / n) * (1 << 40))).select("v").toPandas()
    if not len(rows):
        rows = data.limit(1).select("v").toPandas()
    x = _matrix(rows["v"])
    half, mean = x.shape[1] // 2, x.mean(0)             # cells are of vectors less the sample's mean
    x = x - mean
    each = int(min(centroids, max(1, round(PER_ROOT * n ** 0.5))))
    left, right = kmeans(x[:, :half], each if half else 1), kmeans(x[:, half:], each)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                v = _matrix(pdf["v"]) - mean
                cell = distances(v[:, :half], left).argmin(1) * len(right) + distances(v[:, half:], right).argmin(1)
                yield pd.DataFrame({"cell": cell, "vec_id": pdf["vec_id"], "v": pdf["v"]})

    index = cut(data.mapInPandas(assign, "cell long, vec_id long, v array<double>"), "index")
    counts = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()      # at most centroids ** 2 rows
    sizes = spark.sparkContext.broadcast(dict(zip(counts["cell"].tolist(), counts["n"].tolist())))

    cells = len(left) * len(right)

    def probe(batches):
        for pdf in batches:
            out = []
            size = lambda cell: sizes.value.get(cell, 0)
            if len(pdf):
                v = _matrix(pdf["v"]) - mean
                for a, b in zip(distances(v[:, :half], left), distances(v[:, half:], right)):
                    met = np.zeros(cells, bool)
                    met[traverse(a, b, size, max(share * n, LEAST))] = True
                    out.append(np.packbits(met).tobytes())
            yield pd.DataFrame({"query_id": pdf["vec_id"], "q": pdf["v"], "cells": out})

    asked = cut(valid_like(queries, x.shape[1]).mapInPandas(probe, "query_id long, q array<double>, cells binary"), "queries")
    blocks = -(-asked.count() // block)
    near = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        if len(part):
            near = near.unionByName(_reranked(index, part, k))
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reranked(index: DataFrame, part: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every task for a block of queries."""
    shared = index.sparkSession.sparkContext.broadcast(
        (part["query_id"].to_numpy(), _matrix(part["q"]), np.stack([np.frombuffer(c, np.uint8) for c in part["cells"]])))

    def rerank(batches):
        query, q, cells = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids, cell = _matrix(pdf["v"]), pdf["vec_id"].to_numpy(), pdf["cell"].to_numpy()
            out = []
            for j in range(len(query)):
                may = ((cells[j, cell >> 3] >> (7 - (cell & 7))) & 1).astype(bool) & (ids != query[j])
                best, score = _nearest(x, ids, q[j], may, k)
                out.append(pd.DataFrame({"query_id": query[j], "vec_id": best, "score": score}))
            yield pd.concat(out, ignore_index=True)

    return index.mapInPandas(rerank, "query_id long, vec_id long, score double")


def valid_like(queries: DataFrame, dim: int) -> DataFrame:
    """The queries that take part, of the index's length."""
    q = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return q.where("vec_id is not null and v is not null").where(
        (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
