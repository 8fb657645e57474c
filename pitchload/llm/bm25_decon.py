"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, overlap check.

The test items are the index, the training passages the queries. Documents are cut into units of 32
words, and every three neighbouring units are a passage. An item's postings hold its BM25 impacts over
the item's own threshold, so a passage retrieves an item when its impacts sum to 1 or more. The threshold
is part of the item's score against itself, or less where a text that the overlap check accepts (the
question alone, or pieces of it) may have no better passage.

Items are ordered by threshold and cut into blocks. Sums of the block maxima bound what a passage can
reach in a block; most passages end there. The others run WAND inside the blocks that are left: the
cursors' block maxima give the pivot, and only pivots are scored. Everything above the threshold is
retrieved, there is no top-k. A retrieved item counts as found in the document if enough of the
five-word runs of its question and its answer stand in the document's whole text.

Items are indexed in shards of bounded size, each broadcast by itself; document frequencies are of all
items. Documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchload.llm import textnp as T

UNIT, PASSAGE = 32, 3        # words of a unit, units of a passage
K1, B = 1.2, 0.75
SHARE = 0.5                  # of an item's score against itself that a passage must reach ...
SURE = (PASSAGE - 1) * UNIT + 1      # ... for an item of at most so many words; of a longer one a passage surely holds so many
RUN = 5                      # words in a row that are compared
WHOLE, BOTH = 0.8, 0.5       # share of the question's runs or of all, or of the question's and the answer's each
BLOCKS = 100                 # of a shard's items
SHARD_CHARS = 400_000        # characters of items that are indexed and broadcast together
_SLACK = 1e-4                # for sums of 32-bit bounds

HITS = "array<struct<item_id:long, score:double, question:double, answer:double>>"


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of the lower-cased words; ASCII punctuation separates words too."""
    buf, off = T.join_bytes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    h, _, doc = T.words(buf, off, T.SEPARATOR)
    return h, doc


def runs(h: np.ndarray) -> np.ndarray:
    """Distinct hashes of the word runs of one text (of all its words if there are fewer than RUN)."""
    return np.unique(T.shingles(h, np.zeros(len(h), np.int64), RUN)[0])


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the answer is what follows the last 'answer:', else the last
    sentence if there are several, else nothing."""
    at = text.lower().rfind("answer:")
    if at > 0:
        return text[:at], text[at + 7:]
    body = text.rstrip()
    cut = max(body.rfind(". ", 0, len(body) - 1), body.rfind("? "), body.rfind("! "), body.rfind(".\n"), body.rfind("?\n"))
    return (body[:cut + 1], body[cut + 2:]) if cut > 0 else (body, "")


def least_part(words: list[int], impact: dict[int, float], n_runs: float) -> float:
    """Least impact of as many neighbouring words as hold `n_runs` runs (of SURE words if that is less);
    infinite if there are fewer."""
    w = int(np.ceil(n_runs - 1e-9)) + RUN - 1
    if len(words) < max(w, RUN):
        return np.inf
    w = min(w, SURE)
    return min(sum(impact[x] for x in set(words[i:i + w])) for i in range(len(words) - w + 1))


def weakest(question: list[int], answer: list[int], impact: dict[int, float]) -> float:
    """What the best passage of a text of RUN words or more reaches at least if the overlap check accepts the item.

    The text may hold the runs in pieces in any places, and each border between two pieces costs RUN - 1
    runs. So the largest piece has the runs that are held over the number of pieces at least.
    """
    def largest(runs: int, share: float, parts: int) -> float:
        lost = int(runs * (1 - share) + 1e-9)
        return (runs - lost) / (parts + lost // (RUN - 1))

    q, a = (max(1, len(x) - RUN + 1) if x else 0 for x in (question, answer))
    if any(len(runs(np.array(x, np.uint64))) < n for x, n in ((question, q), (answer, a)) if x):
        return min(least_part(question, impact, 1), least_part(answer, impact, 1))      # a run occurs twice
    alone = least_part(question, impact, largest(q, WHOLE, 1))
    pooled = largest(q + a, WHOLE, 2)
    both = [least_part(x, impact, largest(n, BOTH, 1)) for x, n in ((question, q), (answer, a))]
    return min(alone, least_part(question, impact, pooled), least_part(answer, impact, pooled), max(both))


class Index:
    """Block-max index of some items. `df` and `n_items`, `mean_words` are those of all items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_words: float):
        found = []
        for item, text in items:
            h, _ = word_hashes([text])
            if not len(h):
                continue
            tf = Counter(h.tolist())
            norm = K1 * (1 - B + B * len(h) / mean_words)
            impact = {w: np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            q, a = (word_hashes([part])[0] for part in split_item(text))
            least = min(SHARE * sum(impact.values()) * min(1.0, SURE / len(h)), weakest(q.tolist(), a.tolist(), impact))
            short = {int(runs(x)[0]): sum(impact[w] for w in set(x.tolist())) / least for x in (q, a) if 0 < len(x) < RUN}
            found.append((least, item, {w: x / least for w, x in impact.items()}, runs(q), runs(a), short))
        found.sort(key=lambda f: (f[0], f[1]))
        self.items = [(f[1], f[3], f[4]) for f in found]
        self.runs = np.unique(np.concatenate([x for f in found for x in (f[3], f[4])] or [np.zeros(0, np.uint64)]))
        self.short: dict[int, list] = {}        # run of a whole text of fewer than RUN words -> [(item, score)]
        for k, f in enumerate(found):
            for run, x in f[5].items():
                self.short.setdefault(run, []).append((k, x))
        self.terms = np.array(sorted({w for f in found for w in f[2]}), np.uint64)
        place = {w: k for k, w in enumerate(self.terms.tolist())}
        block = -(-len(found) // BLOCKS) or 1
        self.blocks = -(-len(found) // block)
        self.bound = np.zeros((len(place), self.blocks), np.float32)
        self.postings: list[dict[int, list]] = [{} for _ in place]      # term -> block -> [(item, impact)]
        for k, f in enumerate(found):
            for w, x in f[2].items():
                t, b = place[w], k // block
                self.postings[t].setdefault(b, []).append((k, x))
                self.bound[t, b] = max(self.bound[t, b], x)

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """(item, score) of the block's items whose impacts over the distinct terms reach 1."""
        cursors = [[self.postings[t][block], 0, float(self.bound[t, block])] for t in terms if block in self.postings[t]]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            total = 0.0
            for p, c in enumerate(cursors):
                total += c[2]
                if total >= 1 - _SLACK:
                    break
            else:
                break                                   # what is left can't reach the threshold
            pivot = cursors[p][0][cursors[p][1]][0]
            if cursors[0][0][cursors[0][1]][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[1]][0] != pivot:
                        break
                    score += c[0][c[1]][1]
                    c[1] += 1
                if score >= 1:
                    out.append((pivot, score))
            else:
                for c in cursors[:p]:
                    while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                        c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return out

    def retrieve(self, texts: list[str]) -> tuple[dict[int, dict[int, float]], np.ndarray, np.ndarray]:
        """Per text the retrieved items with their best passage's score; the words and their text index."""
        h, doc = word_hashes(texts)
        got: dict[int, dict[int, float]] = {}
        if not len(h) or not self.items:
            return got, h, doc
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        units = -(-np.diff(first) // UNIT)
        base = np.cumsum(units) - units
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == h)
        unit = base[doc[known]] + (known - first[doc[known]]) // UNIT
        size = len(self.terms)
        both = np.unique(unit * size + at[known])
        unit, term = both // size, both % size
        begin = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1]))) if len(unit) else np.zeros(0, np.int64)
        if not len(begin):
            return got, h, doc
        bound = np.zeros((int(units.sum()), self.blocks), np.float32)
        bound[unit[begin]] = np.add.reduceat(self.bound[term], begin, axis=0)
        owner = np.repeat(np.arange(len(texts)), units)
        end = np.minimum((base + units)[owner], np.arange(len(owner)) + PASSAGE)     # unit behind the passage
        bound = np.concatenate((np.zeros((1, self.blocks), np.float32), np.cumsum(bound, 0, np.float64)))
        bound = bound[end] - bound[:len(owner)]
        lo = np.searchsorted(unit, np.arange(len(owner) + 1))
        for u in np.flatnonzero((bound >= 1 - _SLACK).any(1)).tolist():
            terms = set(term[lo[u]:lo[end[u]]].tolist())
            mine = got.setdefault(int(owner[u]), {})
            for b in np.flatnonzero(bound[u] >= 1 - _SLACK).tolist():
                for item, score in self.wand(sorted(terms), b):
                    mine[item] = max(score, mine.get(item, 0.0))
        return got, h, doc

    def search(self, texts: list[str]) -> list[list[dict]]:
        """Per text the verified items. Only texts that hold a run of an item can have one."""
        out: list[list[dict]] = [[] for _ in texts]
        h, doc = word_hashes(texts)
        if not len(h) or not len(self.runs):
            return out
        run, of = T.shingles(h, doc, RUN)[:2]
        at = np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)
        some = np.unique(of[self.runs[at] == run]).tolist()
        for i, found in zip(some, self._verified([texts[i] for i in some])):
            out[i] = found
        return out

    def _verified(self, texts: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        got, h, doc = self.retrieve(texts)
        size = np.bincount(doc, minlength=len(texts))
        for i in np.flatnonzero((size > 0) & (size < RUN)).tolist():
            a, b = np.searchsorted(doc, [i, i + 1])
            for k, score in self.short.get(int(runs(h[a:b])[0]), ()):
                got.setdefault(i, {}).setdefault(k, score)
        for i, items in got.items():
            if not items:
                continue
            a, b = np.searchsorted(doc, [i, i + 1])
            have = runs(h[a:b])
            for k, score in sorted(items.items()):
                item, question, answer = self.items[k]
                q = float(np.isin(question, have).mean()) if len(question) else 0.0
                s = float(np.isin(answer, have).mean()) if len(answer) else 0.0
                pooled = (q * len(question) + s * len(answer)) / max(1, len(question) + len(answer))
                if q >= WHOLE or pooled >= WHOLE or (q >= BOTH and s >= BOTH):
                    out[i].append({"item_id": item, "score": score * 1.0, "question": q, "answer": s})
        return out


def indexes(items: DataFrame):
    """The index of every shard of `items` (item_id, text), as broadcast variables.

    Repeated rows count once; items without words are left out. A shard's size is bounded by
    SHARD_CHARS (in expectation over a hash of the item), so larger benchmarks give more shards.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()

    @F.pandas_udf("array<long>")
    def words(text: pd.Series) -> pd.Series:
        return text.map(lambda t: word_hashes([t])[0].view(np.int64).tolist())

    split = items.withColumn("words", words("text"))
    n, chars, total = split.where(F.size("words") > 0).agg(
        F.count(F.lit(1)), F.sum(F.length("text")), F.sum(F.size("words"))).first()
    if not n:
        return []
    shards = -(-chars // SHARD_CHARS)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    df = split.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    out = []
    for k in range(shards):
        mine = split.where(shard == k)
        rows = [(r.item_id, r.text) for r in mine.select("item_id", "text").collect()]
        need = mine.select(F.explode("words").alias("word")).distinct().join(df, "word")
        counts = {r.word & (1 << 64) - 1: r.df for r in need.collect()}
        out.append(spark.sparkContext.broadcast(Index(rows, counts, n, total / n)))
    return out


def hits(text: Column, indexes: list) -> Column:
    """Array of the items found in a text (see HITS); empty for a null or empty text."""
    def one(index):
        @F.pandas_udf(HITS)
        def search(text: pd.Series) -> pd.Series:
            texts = [t if isinstance(t, str) else "" for t in text]
            out = []
            for a, b in T.slices(texts):
                out += index.value.search(texts[a:b])
            return pd.Series(out)
        return search(text)
    found = [one(i) for i in indexes]
    return F.concat(*found) if found else F.from_json(F.lit("[]"), HITS)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question, answer): one row per document row and item found in it.

    `score` is the best passage's BM25 over the item's threshold; `question` and `answer` are the shares
    of their five-word runs in the document. Null and empty texts have no hits; repeated documents give
    repeated rows; other columns are ignored; an empty table on either side gives an empty table.
    """
    return (docs.select("doc_id", F.explode(hits(F.col("text"), indexes(items))).alias("hit"))
            .select("doc_id", "hit.*"))


def without_test_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a test item; all columns as they were."""
    return docs.where(F.size(hits(F.col("text"), indexes(items))) == 0)
