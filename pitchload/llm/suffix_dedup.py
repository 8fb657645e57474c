"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier.

A sparse suffix array over the corpus. Of the 72 29-grams in a 100-byte string the one with the
smallest hash is its anchor, so equal strings have equal anchors at equal offsets, and about one
position in 36 is an anchor. Work per step:

1. Anchors are counted by their gram in Spark; only grams that occur twice or more go on.
2. An anchor's context is the up to 171 bytes that its 100-byte strings can reach. Occurrences with
   equal contexts are pre-aggregated to the first; all the others are repeats as a whole.
3. The distinct contexts of a gram are sorted in tasks by deep-shallow sorting, to the right of the
   anchor and, reversed, to its left. With the common prefixes of neighbours, two occurrences share
   the 100-byte string at offset o if they agree in o bytes to the left and 100 - o to the right;
   in each such class all but the earliest occurrence are repeats.
4. A gram with more distinct contexts than one task should hold goes the plain way: its 100-byte
   strings become rows, and Spark aggregates the earliest start of each.

Bounds hold per gram and document, so no group of copies meets in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.llm import deep_shallow
from pitchload.llm import textnp as T
from pitchload.session import cut

_U = np.uint64
LENGTH = 100                 # bytes of a repeated string
GRAM = 29                    # bytes of an anchor
REACH = LENGTH - GRAM        # how far a string with the anchor can reach to either side
PIECE = 1 << 20              # bytes of a text that are looked at together
CONTEXTS = 20_000            # distinct contexts of one gram that one task sorts
TASK_ROWS = 40_000           # contexts that are classified together
_AT = _U((1 << 28) - 1)      # low bits of a sort key: position in the buffer


def _parts(texts):
    """Pieces of the texts: (bytes, text index, offset of the piece, first start, last start + 1).
    Neighbouring pieces overlap by what their strings' contexts need."""
    for i, t in enumerate(texts):
        starts = len(t) - LENGTH + 1
        for a in range(0, max(starts, 0), PIECE):
            b = min(a + PIECE, starts)
            lo = max(0, a - REACH)
            yield t[lo:min(len(t), b + LENGTH + REACH)], i, lo, a - lo, b - lo


def _grouped(parts, most: int = PIECE):
    group, size = [], 0
    for p in parts:
        if group and size + len(p[0]) > most:
            yield group
            group, size = [], 0
        group.append(p)
        size += len(p[0])
    if group:
        yield group


def anchors(group):
    """(text index, position in the text, gram hash, context hash) of the anchors of some pieces."""
    buf, off = T.join_bytes([p[0] for p in group])
    prefix = T.prefix_hash(buf)
    n = len(buf) - GRAM + 1
    g = (prefix[GRAM:] - prefix[:-GRAM]) * T._power(len(prefix), "down")[:n]
    g = (g ^ (g >> _U(32))) * _U(0xD6E8FEB86659FD93)
    low = ((g ^ (g >> _U(29))) & ~_AT) | np.arange(n, dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32, REACH + 1 - 64):
        low = np.minimum(low[:-step], low[step:])
    valid = np.zeros(len(low) + 1, np.int8)
    for k, p in enumerate(group):
        valid[off[k] + p[3]] += 1
        valid[off[k] + p[4]] -= 1
    at = (low[np.cumsum(valid[:-1], dtype=np.int8) > 0] & _AT).astype(np.int64)
    if not len(at):
        return None
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    k = np.searchsorted(off, at, side="right") - 1
    lo, hi = np.maximum(at - REACH, off[k]), np.minimum(at + GRAM + REACH, off[k + 1] - 1)
    gram = T.range_hash(prefix, at, at + GRAM)
    context = T.splitmix(T.range_hash(prefix, lo, hi) ^ ((at - lo).astype(np.uint64) << _U(8)))
    text = np.array([p[1] for p in group], np.int64)[k]
    pos = at - off[k] + np.array([p[2] for p in group], np.int64)[k]
    return text, pos, gram.view(np.int64), context.view(np.int64)


def _anchor_batches(batches):
    for pdf in batches:
        did, tie = pdf["did"].to_numpy(), pdf["tie"].to_numpy()
        for group in _grouped(_parts(list(pdf["bytes"]))):
            got = anchors(group)
            if got:
                i, pos, gram, context = got
                # neighbouring pieces of a text may share an anchor
                yield pd.DataFrame({"gram": gram, "context": context, "did": did[i], "tie": tie[i],
                                    "pos": pos.astype(np.int32)})


def _context_batches(batches):
    for pdf in batches:
        cols = {c: [] for c in ("gram", "did", "tie", "pos", "before", "after", "many")}
        for t, did, tie, asked in zip(pdf["bytes"], pdf["did"], pdf["tie"], pdf["asked"]):
            for a in asked:
                p = a["pos"]
                cols["gram"].append(a["gram"])
                cols["did"].append(did)
                cols["tie"].append(tie)
                cols["pos"].append(p)
                cols["before"].append(t[max(0, p - REACH):p])
                cols["after"].append(t[p:p + LENGTH])
                cols["many"].append(a["many"])
        yield pd.DataFrame(cols)


def repeated(gram: np.ndarray, rank: np.ndarray, before: list[bytes], after: list[bytes]):
    """For distinct contexts (gram, rank of the occurrence, bytes to both sides): the smallest and
    largest offset at which the occurrence's 100-byte string also has an earlier occurrence (-1: none).
    """
    n = len(gram)
    tag = [(int(g) + (1 << 63)).to_bytes(8, "big") for g in gram]      # strings of a gram sort together
    sides = []
    for strings, width in (([t + a for t, a in zip(tag, after)], 8 + LENGTH),
                           ([t + b[::-1] for t, b in zip(tag, before)], 8 + REACH)):
        at = np.array(deep_shallow.order(strings), np.int64)
        sides.append((at, deep_shallow.neighbours(strings, at, width) - 8))
    (ra, rl), (la, ll) = sides
    # what a string shares with a neighbour in the order is the most that it shares with any
    far_a, far_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    far_a[ra], far_b[la] = np.maximum(rl, np.append(rl[1:], 0)), np.maximum(ll, np.append(ll[1:], 0))
    least, most = np.full(n, -1), np.full(n, -1)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        some = np.flatnonzero((far_a >= LENGTH - o) & (far_b >= o))
        if not len(some):
            continue
        right[ra] = np.cumsum(rl < LENGTH - o)
        left[la] = np.cumsum(ll < o)
        key = left[some] * (n + 1) + right[some]
        by = np.lexsort((rank[some], key))
        later = some[by[1:][key[by[1:]] == key[by[:-1]]]]
        least[later[least[later] < 0]] = o
        most[later] = o
    return least, most


def _sorted_batches(batches):
    """Rows sorted by gram -> covered ranges. Whole grams are classified together, some at a time."""
    def classify(pdf):
        by = np.lexsort((pdf["pos"], pdf["tie"], pdf["did"]))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        least, most = repeated(pdf["gram"].to_numpy(), rank, list(pdf["before"]), list(pdf["after"]))
        hit = most >= 0
        pos = pdf["pos"].to_numpy()[hit].astype(np.int64)
        return pd.DataFrame({"did": pdf["did"].to_numpy()[hit], "tie": pdf["tie"].to_numpy()[hit],
                             "a": pos - most[hit], "b": pos - least[hit] + LENGTH})

    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        while len(held) > TASK_ROWS:
            g = held["gram"].to_numpy()
            last = np.flatnonzero(g[1:] != g[:-1])
            if not len(last):
                break                                   # one gram: its number of contexts is bounded
            fit = last[last < TASK_ROWS]
            n = int(fit[-1] if len(fit) else last[0]) + 1
            yield classify(held.iloc[:n])
            held = held.iloc[n:].reset_index(drop=True)
    if held is not None and len(held):
        yield classify(held)


def _string_batches(batches):
    """The 100-byte strings of contexts as two 64-bit hashes and their start."""
    for pdf in batches:
        out = []
        for did, tie, pos, b, a in zip(pdf["did"], pdf["tie"], pdf["pos"], pdf["before"], pdf["after"]):
            whole, first = b + a, pos - len(b)
            for s in range(len(whole) - LENGTH + 1):
                d = hashlib.blake2b(whole[s:s + LENGTH], digest_size=16).digest()
                out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True),
                            did, tie, first + s))
        yield pd.DataFrame(out, columns=["h1", "h2", "did", "tie", "a"])


def _result_batches(batches):
    for pdf in batches:
        rows = []
        for t, spans in zip(pdf["bytes"], pdf["spans"]):
            kept, end, removed, runs = [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in (spans if spans is not None else ())):
                if a > end or not runs:
                    kept.append(t[end:a])
                    runs += 1
                    removed += b - a
                    end = b
                elif b > end:
                    removed += b - end
                    end = b
            kept.append(t[end:])
            rows.append((len(t), removed, runs, b"".join(kept)))
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [r[0] for r in rows],
                            "n_removed": [r[1] for r in rows], "n_spans": [r[2] for r in rows],
                            "kept": [r[3] for r in rows]})


def repeated_spans(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(did, tie, a, b): byte ranges of documents (see `_keyed`) to remove; ranges may overlap."""
    found = docs.select("did", "tie", "bytes").mapInPandas(
        _anchor_batches, "gram long, context long, did long, tie long, pos int")
    twice = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    found = cut(found.join(twice, "gram"), "anchors")
    first = cut(found.groupBy("gram", "context").agg(F.min(F.struct("did", "tie", "pos")).alias("first")), "firsts")
    later = (found.join(first, ["gram", "context"]).where(F.struct("did", "tie", "pos") != F.col("first"))
             .select("did", "tie", F.greatest(F.lit(0), F.col("pos") - REACH).cast("long").alias("a"),
                     (F.col("pos") + GRAM + REACH).cast("long").alias("b")))
    several = first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("gram", (F.col("n") > contexts).alias("many"))
    asked = (first.join(several, "gram").select("first.did", "first.tie", F.struct("gram", F.col("first.pos"), "many").alias("x"))
             .groupBy("did", "tie").agg(F.collect_list("x").alias("asked")))
    text = docs.select("did", "tie", "bytes").join(asked, ["did", "tie"])
    rows = cut(text.mapInPandas(_context_batches, "gram long, did long, tie long, pos int, before binary, after binary, many boolean"),
               "contexts")
    parts = ["gram", "did", "tie", "pos", "before", "after"]
    few = (rows.where("not many").select(*parts).repartition("gram").sortWithinPartitions("gram")
           .mapInPandas(_sorted_batches, "did long, tie long, a long, b long"))
    strings = rows.where("many").select(*parts).mapInPandas(_string_batches, "h1 long, h2 long, did long, tie long, a long")
    one = strings.groupBy("h1", "h2").agg(F.min(F.struct("did", "tie", "a")).alias("first"))
    plain = (strings.join(one, ["h1", "h2"]).where(F.struct("did", "tie", "a") != F.col("first"))
             .select("did", "tie", "a", (F.col("a") + LENGTH).alias("b")))
    return later.unionByName(few).unionByName(plain)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the order key (did, tie): doc_id, null before all others, and the text's hash."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"),
                       F.xxhash64(data).alias("tie"), data.alias("bytes"))


def remove_repeats(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of `docs` (doc_id, text; others are ignored).

    Texts are UTF-8 bytes; a null text is empty. Strings are judged on the input and never cross
    documents; texts under 100 bytes stay whole. Rows that repeat a doc_id with the same text are one
    document, reported for each row; rows of one doc_id with different texts are ordered by the text's
    hash. A null doc_id comes before all others. An empty table gives an empty table.
    """
    docs = _keyed(docs)
    spans = repeated_spans(docs, contexts)
    size = F.length("bytes").cast("long")
    per_doc = spans.groupBy("did", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = docs.join(per_doc, ["did", "tie"], "left").withColumn(
        "spans", F.transform("spans", lambda s: F.struct(s["a"].alias("a"), F.least(s["b"], size).alias("b"))))
    return rows.select("doc_id", "bytes", "spans").mapInPandas(
        _result_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
