"""Ranked lexical search over a K2-treap of the term-document grid.

`build` cuts the documents into shards of at most `SHARD_DOCS` documents or about `SHARD_CELLS` (term,
document) cells, and writes one row a shard. A shard's grid has a row for each of its terms and a column for
each document with a term; rows are ordered by how many documents hold the term and columns by length, so
that cells beside each other are alike. The grid is cut into bands as high as it is wide and each band is a
quadtree: a bitmap of four bits says which quadrants hold anything, and every cell, of any size, holds the
greatest impact in it, stored as the difference to the cell around it. An impact is the contract's
(1000000000 tf) div (1000 tf + 8 m) without the term's weight, which is the asker's.

`search` descends for an item all its rows together. Its unit is a range of documents with the cell of each
row's path there; the sum of weight x greatest impact bounds every score in the range. Ranges wait by bound,
the best ones are halved first (some at a time, as arrays), single documents are scores, and ranges whose
bound is under the item's k-th score so far are never opened. Ranges whose bound equals it are, so ties go by
doc_id. A task carries its items' k best from shard to shard. Results are exact: nothing is sampled or capped.

Items go out in blocks of about `BLOCK` (item, term) pairs, one broadcast row a block, against all shards;
their terms' document frequencies are summed from the shards' counts. Per item the tasks' k best are cut to
k in the final window, whose limit Spark applies in each task before the shuffle.

Every row of documents is a document and every row of the items an item, repeated ids too. Null and empty
texts have no terms: such documents do not count and such items find nothing. Equal scores go by doc_id,
null ids last. Empty tables give empty results; other columns are not read. A Python worker gets shards one
at a time, and so do Arrow and Parquet: a task's memory goes by the shard, not by how many it has. A very long
text closes its shard early; an item with many terms opens fewer ranges at a time and finds its cells again from the top.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchload.session import arrow_bytes, cut

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SHARD_DOCS = 4_096
SHARD_CELLS = 1 << 19      # a task holds some ten arrays of this length
#: (item, term) pairs that one block holds, as expected
BLOCK = 50_000
#: bytes of documents or shards that go to a Python worker at once; a shard of full size goes alone
BATCH_BYTES = 2 << 20
#: a page of a shard table holds one shard's value, a row group as much as this or one shard; both sides hold whole pages.
#: Statistics would keep the least and greatest whole value of every row group until the file ends
SHARD_FILES = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1,
               "parquet.column.statistics.enabled": False}
#: items of more terms keep no cells for waiting ranges
LONG = 2_048
_POP = np.array([bin(i).count("1") for i in range(16)], np.int32)

_POSTINGS = "doc_ids array<long>, sizes binary, terms array<string>, counts binary, cols binary, tfs binary, n_docs long, n_terms long"
_INDEX = "doc_ids array<long>, terms array<string>, counts array<int>, bits int, bands binary, widths array<int>, masks binary, gaps binary"


def terms_of(text: str | None) -> list[str]:
    """Terms in order, A-Z lower-cased."""
    return TERM.findall(text.encode().lower().decode()) if text else []


def _postings(frames):
    """Shards of one task's documents: postings row by row, rows from the most to the least frequent term."""
    ids, rows, tfs, docs, sizes, widths = {}, array("i"), array("i"), [], [], []

    def shard():
        row = np.frombuffer(rows, np.int32) if rows else np.zeros(0, np.int32)
        counts = np.bincount(row, minlength=len(ids)).astype(np.int32)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        by = np.argsort(place[row], kind="stable")
        names = list(ids)
        return pd.DataFrame([{
            "doc_ids": docs, "sizes": np.array(sizes, np.int64).tobytes(), "terms": [names[i] for i in order], "counts": counts[order].tobytes(),
            "cols": np.repeat(np.arange(len(docs), dtype=np.int32), widths)[by].astype(np.uint16).tobytes(),
            "tfs": np.array(tfs, np.int32)[by].tobytes(), "n_docs": len(docs), "n_terms": int(sum(sizes))}])

    for pdf in frames:
        for doc_id, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"]):
            found = terms_of(text)
            if not found:
                continue
            count = Counter(found)
            rows.extend([ids.setdefault(t, len(ids)) for t in count])
            tfs.extend(count.values())
            docs.append(None if doc_id is None else int(doc_id))
            sizes.append(len(found))
            widths.append(len(count))
            if len(docs) >= SHARD_DOCS or len(rows) >= SHARD_CELLS:
                yield shard()
                ids, rows, tfs, docs, sizes, widths = {}, array("i"), array("i"), [], [], []
    if docs:
        yield shard()


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x (16 at most) moved to the even places."""
    for shift, keep in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & keep
    return x


def quadtrees(row: np.ndarray, col: np.ndarray, value: np.ndarray, bits: int):
    """Quadtrees of the bands of a grid 2**bits wide: (bands, widths, masks, gaps), nodes from the top level
    down. A node's children are in the order of their quadrants (2 x row bit + column bit); `masks` are those
    of all levels but the last, `gaps` the differences to the greatest value of the cell around."""
    side = (1 << bits) - 1
    key = ((row >> bits) << (2 * bits)) | (_spread(row & side) << 1) | _spread(col)
    by = np.argsort(key)
    key, most = key[by], value[by]
    masks, maxima = [], [most]
    for _ in range(bits):
        start = np.flatnonzero(np.concatenate(([True], (key[1:] >> 2) != (key[:-1] >> 2))))
        masks.append(np.bitwise_or.reduceat((1 << (key & 3)).astype(np.uint8), start))
        most = np.maximum.reduceat(most, start)
        key = key[start] >> 2
        maxima.append(most)
    masks, maxima = masks[::-1], maxima[::-1]
    gaps = [maxima[0]] + [np.repeat(up, _POP[m]) - low for up, m, low in zip(maxima, masks, maxima[1:])]
    return key, [len(g) for g in gaps], np.concatenate([np.zeros(0, np.uint8), *masks]), np.concatenate(gaps)


def build(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index over (doc_id, text), written to the shared folder: (a row a shard, N)."""
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        posts = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_postings, _POSTINGS), "postings", **SHARD_FILES)
    totals = posts.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_all, l_all = totals[0] or 0, totals[1] or 1

    def trees(batches):
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("bits", pa.int32()),
                            ("bands", pa.binary()), ("widths", pa.list_(pa.int32())), ("masks", pa.binary()), ("gaps", pa.binary())])
        for batch in batches:
            for p in (batch.slice(i, 1) for i in range(batch.num_rows)):
                size, counts, col, tf = (np.frombuffer(p.column(c)[0].as_py(), kind) for c, kind in
                                         (("sizes", np.int64), ("counts", np.int32), ("cols", np.uint16), ("tfs", np.int32)))
                order = np.argsort(size, kind="stable")
                place = np.empty(len(size), np.int64)
                place[order] = np.arange(len(size))
                m = 100 - 90 + (90 * size * n_all) // l_all
                impact = ((1_000_000_000 * tf.astype(np.int64)) // (1_000 * tf.astype(np.int64) + 8 * m[col])).astype(np.int32)
                bits = max(len(size) - 1, 1).bit_length()
                row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
                bands, widths, masks, gaps = quadtrees(row, place[col], impact, bits)
                values = [p.column("doc_ids")[0].values.take(pa.array(order)).to_pylist()], p.column("terms"), [counts], [bits], \
                    [bands.astype(np.int32).tobytes()], [widths], [masks.tobytes()], [gaps.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        return cut(posts.drop("n_docs", "n_terms").mapInArrow(trees, _INDEX), "k2_index", **SHARD_FILES), n_all


class Treap:
    """A shard's trees as arrays; node -1 is an empty cell."""

    def __init__(self, bits, bands, widths, masks, gaps):
        self.bits = bits
        masks, gaps = np.frombuffer(masks, np.uint8), np.frombuffer(gaps, np.int32)
        self.mask = np.concatenate((masks, np.zeros(widths[-1] + 1, np.uint8)))
        kids = _POP[masks]
        self.first = np.concatenate((widths[0] + np.cumsum(kids) - kids, np.zeros(widths[-1] + 1, np.int32))).astype(np.int32)
        most, done, at = [gaps[:widths[0]]], 0, widths[0]
        for w, below in zip(widths, widths[1:]):
            most.append(np.repeat(most[-1], kids[done:done + w]) - gaps[at:at + below])
            done, at = done + w, at + below
        self.most = np.concatenate((*most, [0])).astype(np.int32)
        bands = np.frombuffer(bands, np.int32)
        self.root = np.full(int(bands.max()) + 1, -1, np.int32)
        self.root[bands] = np.arange(len(bands))

    def child(self, nodes, quadrant):
        mask = self.mask[nodes]
        return np.where((mask >> quadrant) & 1, self.first[nodes] + _POP[mask & ((1 << quadrant) - 1)], -1).astype(np.int32)

    def locate(self, rows, at, level):
        """Cells of the rows at the ranges that start at `at` and are 2**level wide."""
        nodes = np.tile(self.root[rows >> self.bits], (len(at), 1))
        for low in range(self.bits - 1, -1, -1):
            go = np.flatnonzero(level <= low)
            nodes[go] = self.child(nodes[go], 2 * ((rows >> low) & 1)[None, :] + ((at[go] >> low) & 1)[:, None])
        return nodes

    def search(self, rows, weights, doc_ids, best: list, k: int) -> list:
        """The k best (-score, doc_id is null, doc_id) of `best` and this shard's documents, best first."""
        held = len(rows) <= LONG
        nodes = self.root[rows >> self.bits][None, :]
        at, level, bound = np.zeros(1, np.int64), np.full(1, self.bits), self.most[nodes] @ weights
        step, most = 8, max(16, (1 << 18) // len(rows))
        while True:
            least = -best[-1][0] if len(best) == k else 1
            live = np.flatnonzero(bound >= least)
            if not len(live):
                return best
            if len(live) > step:
                live = live[np.argsort(-bound[live], kind="stable")]
            pick, wait = live[:step], live[step:]
            p_at, p_level, p_bound = at[pick], level[pick], bound[pick]
            if (single := p_level == 0).any():
                best = sorted(best + [(-int(s), doc_ids[a] is None, doc_ids[a] or 0) for s, a in zip(p_bound[single], p_at[single])])[:k]
            wide = np.flatnonzero(~single)
            p_nodes = nodes[pick[wide]] if held else self.locate(rows, p_at[wide], p_level[wide])
            p_at, low = p_at[wide], p_level[wide] - 1
            row_bit = 2 * ((rows[None, :] >> low[:, None]) & 1)
            halves = [self.child(p_nodes, row_bit + half) for half in (0, 1)]
            bound = np.concatenate((bound[wait], *[self.most[h] @ weights for h in halves]))
            at = np.concatenate((at[wait], p_at, p_at | (1 << low)))
            level = np.concatenate((level[wait], low, low))
            if held:
                nodes = np.concatenate((nodes[wait], *halves))
            if len(best) == k:     # until then every step goes down toward single documents
                step = min(2 * step, most)


def _searcher(k: int):
    def run(batches):
        asked = best = names = None
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                if asked is None:
                    block = col["asked"][i].values     # one row a block, the same beside every shard
                    item, term, weight = (block.field(f) for f in ("item", "term", "w"))
                    names = pc.unique(term)
                    places = pc.index_in(term, names).to_numpy()
                    item, weight = item.to_numpy(), weight.to_numpy()
                    by = np.argsort(item, kind="stable")
                    asked = [(item[g[0]], places[g], weight[g]) for g in np.split(by, np.flatnonzero(np.diff(item[by])) + 1) if len(g)]
                    best = {a[0]: [] for a in asked}
                hit = pc.index_in(col["terms"][i].values, names)
                rows = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
                row_of = np.full(len(names), -1, np.int64)
                row_of[hit.drop_null().to_numpy()] = rows
                treap = Treap(*[col[c][i].as_py() for c in ("bits", "bands", "widths", "masks", "gaps")])
                ids = col["doc_ids"][i].as_py()
                for key, at, weight in asked:
                    have = row_of[at] >= 0
                    if have.any():
                        best[key] = treap.search(row_of[at][have], weight[have], ids, best[key], k)
        out = [(key, None if null else doc, -score) for key, found in (best or {}).items() for score, null, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])
    return run


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for every row of items."""
    words = F.pandas_udf(lambda texts: texts.map(lambda t: list(dict.fromkeys(terms_of(t)))), "array<string>")
    items = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), words("text").alias("terms")), "items")
    pairs = items.select("item", F.explode("terms").alias("term"))
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = held.join(pairs.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    pairs = cut(pairs.join(df, "term").select("item", "term", weight.alias("w")), "weights")
    blocks = -(-pairs.count() // BLOCK)
    found = None
    for b in range(blocks):
        one = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).agg(F.collect_list(F.struct("item", "term", "w")).alias("asked"))
        part = index.drop("counts").crossJoin(F.broadcast(one)).mapInArrow(_searcher(k), "item long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = pairs.select("item", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    with arrow_bytes(index.sparkSession, BATCH_BYTES):
        top = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top")
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """`build` and `search`."""
    index, n_docs = build(docs)
    return search(index, n_docs, items, k)


#: DuckDB twin: all scores, then the ten best of each item
ORACLE = r"""WITH t AS (
  SELECT rowid_ AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
n AS (SELECT d, doc_id, count(*) AS n FROM t GROUP BY d, doc_id),
a AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM n),
m AS (SELECT d, doc_id, 100 - 90 + (90 * n * n_all) // l_all AS m FROM n, a),
q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
f AS (SELECT d, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY d, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
s AS (SELECT q.i, q.item_id, m.d, m.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY q.i, q.item_id, m.d, m.doc_id)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0) WHERE r <= 10"""
