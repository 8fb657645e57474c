"""Near-duplicate classes with ProbMinHash.

A document is the weighted set of its five-word shingles; a shingle that occurs n times weighs
1 + ln n. Every shingle is a Poisson process with its weight as rate: its arrivals fall on random
registers, a register keeps the shingle that arrives first, and a document is done as soon as no
process can arrive before its slowest register (early termination). Two documents agree in a
register with their probability Jaccard similarity.

Registers are cut into bands. Documents that share a band are candidates; in each bucket every
document is paired with the bucket's most central one (that shares most buckets' company), which is
linear in the bucket's size. Pairs are verified on the whole shingle sets. Members of a bucket that
did not reach the class of its centre get a centre of their own in the next round.

Buckets that then still hold several classes are finished by an exact join: their members are compared
with all members of other classes that can be similar (places and sizes in a prefix filter over the rarest
shingles). So two documents that share a band and reach the similarity are always of one class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.llm import textnp as T
from pitchload.llm.graph import components
from pitchload.session import cut

_U = np.uint64
SHINGLE = 5          # words
SIMILARITY = 0.8     # of the sets of shingles
REGISTERS = 96
ROWS = 3             # registers in a band
ROUNDS = 2           # centres that a bucket gets before the exact join
BAND = 1.05          # ratio of the bounds of a size band in the exact join


def sketch(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS, seed: int = 1) -> np.ndarray:
    """ProbMinHash registers (n_docs x m) of weighted elements (hash, document, weight).

    All processes advance one arrival at a time; those that can't change a register any more stop.
    Registers of a document without elements hold 0.
    """
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    slowest = np.full(n_docs, np.inf)
    r, x = h ^ _U(T.splitmix_int(seed)), np.zeros(len(h))
    while len(h):
        r = T.splitmix(r)
        x = x - np.log1p(-(r >> _U(11)).astype(np.float64) * 2.0 ** -53) / weight
        go = x < slowest[doc]
        h, doc, weight, x, r = h[go], doc[go], weight[go], x[go], r[go]
        register = ((T.splitmix(r ^ _U(0x5851F42D4C957F2D)) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        slot = doc * m + register
        better = x < first[slot]
        o = np.flatnonzero(better)
        o = o[np.argsort(-x[o], kind="stable")]       # the earliest arrival is written last
        first[slot[o]], owner[slot[o]] = x[o], h[o]
        slowest = first.reshape(n_docs, m).max(1)
    return owner.reshape(n_docs, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    n, m = sig.shape
    out = np.repeat(np.arange(m // rows, dtype=np.uint64)[None] * _U(0x9E3779B97F4A7C15), n, 0)
    for j in range(rows):
        out = T.splitmix(out * _U(3) + sig[:, j:m // rows * rows:rows])
    return out.view(np.int64)


def shingle_sets(texts: list[str], k: int = SHINGLE):
    """(hash, text index, count) of the distinct shingles of a few texts."""
    buf, off = T.join_bytes([t.encode("utf-8", "surrogatepass") for t in texts])
    h, _, doc = T.words(buf, off)
    return T.unique_per_doc(*T.shingles(h, doc, k))


def _texts(pdf: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in pdf["text"]]


def _sketch_batches(k: int, m: int, rows: int):
    def run(batches):
        for pdf in batches:
            texts = _texts(pdf)
            for a, b in T.slices(texts):
                part = texts[a:b]
                h, doc, n = shingle_sets(part, k)
                keys = band_keys(sketch(h, doc, 1 + np.log(n), b - a, m), rows)
                some = np.bincount(doc, minlength=b - a) > 0
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[a:b].astype("Int64"),
                    "node": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in part],
                    "keys": [list(x) if s else [] for x, s in zip(keys, some)]})
    return run


def _set_batches(k: int):
    def run(batches):
        for pdf in batches:
            texts = _texts(pdf)
            for a, b in T.slices(texts):
                h, doc, _ = shingle_sets(texts[a:b], k)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                yield pd.DataFrame({"node": pdf["node"].iloc[a:b],
                                    "sh": [h[at[i]:at[i + 1]].view(np.int64) for i in range(b - a)]})
    return run


def near_duplicate_classes(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY,
                           m: int = REGISTERS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, node, class_id, chosen) for every row of `docs` (doc_id, text; other columns are ignored).

    `node` is the MD5 of the text; equal texts are one node. `class_id` is the smallest doc_id of the
    class (null if it has none); `chosen` marks the rows that hold the class's one (node, doc_id).
    A null text counts as empty; all empty texts are copies of each other, as are all texts that are
    equal byte for byte. A text with fewer than five words has one shingle of all its words.
    Repeated rows are copies. Null doc_ids come after all others. An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    sk = cut(docs.mapInPandas(_sketch_batches(k, m, rows), "doc_id long, node binary, keys array<long>"), "sketch")
    nodes = sk.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    member = sk.select("node", F.explode("keys").alias("key")).distinct()
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut(member.join(size, "key"), "buckets")
    score = member.groupBy("node").agg(F.sum("n").alias("score"))
    member = cut(member.select("key", "node").join(score, "node"), "buckets")

    links, comp, done = None, None, None
    for _ in range(rounds):
        open_ = member
        if comp is not None:
            # members whose class differs from that of a centre which their bucket has had
            known = done.join(comp.withColumnRenamed("node", "centre"), "centre", "left") \
                .select("key", F.coalesce("comp", "centre").alias("reached"))
            mine = member.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_ = mine.join(known, "key").where("comp <> reached").select("key", "node", "score")
        centre = (open_.groupBy("key").agg(F.max(F.struct("score", "node")).alias("c"))
                  .select("key", F.col("c.node").alias("centre")))
        pair = cut(open_.join(centre, "key").where("node <> centre").select("node", "centre").distinct(), "pairs")
        new = verified(pair, docs, nodes, k, similarity)
        links = new if links is None else links.unionByName(new)
        comp = cut(components(links, "node", "centre"), "classes")
        done = centre

    missed = left_over(member, comp, docs, nodes, k, similarity)
    if missed.limit(1).count():
        comp = cut(components(links.unionByName(missed), "node", "centre"), "classes")

    by_node = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = by_node.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("best"))
    classes = by_node.select("node", "comp").join(best, "comp").select("node", "best")
    return sk.select("doc_id", "node").join(classes, "node").select(
        "doc_id", "node", F.col("best.doc_id").alias("class_id"),
        ((F.col("node") == F.col("best.node")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("chosen"))


def shingle_table(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, sh): the distinct shingles of the nodes in `asked` (node, doc_id of one of its rows)."""
    text = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("node")).alias("t")
    asked = asked.select("node", "doc_id").alias("a")
    own = (text.join(asked, (F.col("t.node") == F.col("a.node")) & F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")))
           .select("t.node", "t.text"))
    return cut(own.mapInPandas(_set_batches(k), "node binary, sh array<long>").groupBy("node").agg(F.first("sh").alias("sh")), "sets")


def similar(pair: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, centre) whose whole shingle sets reach the similarity."""
    far = sets.select(F.col("node").alias("centre"), F.col("sh").alias("csh"))
    common = F.size(F.array_intersect("sh", "csh"))
    return cut(pair.join(far, "centre").join(sets, "node")
               .withColumn("both", common)
               .where(F.col("both") >= F.lit(similarity) * (F.size("sh") + F.size("csh") - F.col("both")) - F.lit(1e-9))
               .where("both > 0").select("node", "centre"), "verified")


def verified(pair: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """`similar` pairs of `pair`, with the shingles of its nodes only."""
    asked = pair.select("node").unionByName(pair.select(F.col("centre").alias("node"))).distinct().join(nodes, "node")
    return similar(pair, shingle_table(asked, docs, k), similarity)


def left_over(member: DataFrame, comp: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """All similar pairs (node, centre) of different classes among the members of buckets with several classes."""
    mine = member.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = mine.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    open_ = cut(mine.join(mixed, "key").select("node", "comp").distinct(), "open")
    sets = shingle_table(open_.select("node").join(nodes, "node"), docs, k)
    return similar(cut(may_be_similar(sets, open_, similarity), "pairs"), sets, similarity)


def may_be_similar(sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, centre) of different classes, among them all whose `sets` (node, sh) reach the similarity;
    `classes` is (node, comp).

    Sets of n and m shingles that are similar share at least similarity / (1 + similarity) * (n + m) of them.
    In any common order, the first shared one therefore stands early enough in both sets that as many are left
    from there on. The rarest come first; those of one class only need no join, they just use up places. How far
    a set's shingles go into the join depends on the partner's size, so the key has, next to the shingle, the
    size bands of both: a copy with too many places of its own meets none of the group it was copied from. In a
    key's group the members of its largest class are not paired with each other, nor is a group of one class.
    """
    share = similarity / (1 + similarity)
    band = lambda size: F.floor(F.log(size) / F.lit(float(np.log(BAND)))).cast("int")
    each = sets.select("node", F.size("sh").alias("n"), F.explode("sh").alias("s")).join(classes, "node")
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("a"), F.max("comp").alias("b"))
    ordered = (each.join(often.where("a <> b").select("s", "f"), "s").groupBy("node", "comp", "n")
               .agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("o")))
    least = F.greatest(F.pow(F.lit(BAND), F.col("far")), F.lit(similarity) * F.col("n")) * (1 - 1e-9)   # partner's size
    places = F.floor(F.col("n") - share * (F.col("n") + least) + 1e-6) + 1 - (F.col("n") - F.size("o"))
    prefix = (ordered.withColumn("band", band(F.col("n")))
              .withColumn("far", F.explode(F.sequence(band(F.col("n") * (similarity * (1 - 1e-9))),
                                                      band(F.col("n") * ((1 + 1e-9) / similarity)))))
              .withColumn("places", F.least(places, F.size("o")).cast("int")).where("places > 0")
              .select("node", "comp", "n", "band", "far", F.size("o").alias("shared"),
                      F.posexplode(F.slice("o", F.lit(1), F.col("places"))).alias("at", "x"))
              .select("node", "comp", "n", "band", "far", (F.col("shared") - F.col("at")).alias("rest"), F.col("x.s").alias("s"),
                      F.least("band", "far").alias("lo"), F.greatest("band", "far").alias("hi")))
    prefix = cut(prefix, "prefix")
    group = (prefix.groupBy("s", "lo", "hi", "comp").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("s", "lo", "hi").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("classes"))
             .where("classes > 1").select("s", "lo", "hi", F.col("top.comp").alias("most")))
    grouped = prefix.join(group, ["s", "lo", "hi"])
    one = grouped.where("comp <> most").select("s", "band", "far", "node", "comp", "n", "rest")
    two = grouped.select("s", F.col("far").alias("band"), F.col("band").alias("far"), F.col("node").alias("centre"), F.col("comp").alias("comp2"),
                         F.col("n").alias("m"), F.col("rest").alias("rest2"), (F.col("comp") == F.col("most")).alias("main"))
    enough = F.least("rest", "rest2") >= share * (F.col("n") + F.col("m")) - 1e-6
    return (one.join(two, ["s", "band", "far"])
            .where((F.col("comp") != F.col("comp2")) & (F.col("main") | (F.col("node") < F.col("centre"))) & enough)
            .select("node", "centre").distinct())


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one row of each near-duplicate class: that of its smallest doc_id (see
    `near_duplicate_classes`); all columns as they were. A repeated row stays once."""
    key, one = "__node", "__one"
    chosen = near_duplicate_classes(docs, **how).where("chosen").select(F.col("node").alias(key), F.col("doc_id").alias(one)).distinct()
    return (docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
            .join(chosen, key).where(F.col("doc_id").eqNullSafe(F.col(one)))
            .dropDuplicates([key]).select(*docs.columns))
