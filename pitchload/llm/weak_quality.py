"""Quality classifier from weak labels.

Overlapping labellers vote good, junk or toxic on a document, or abstain. Expectation-maximisation over
the counts of vote patterns of all documents estimates what each labeller votes in each kind of
document: good, three kinds of junk (marked, shouted, repeated) and toxic. Junk of one kind looks good
to the labellers of the others, so one class of junk would not do. No labeller is taken as the truth;
the rows of the labels table are one labeller among the others. The posteriors label a bounded sample
of documents, and those train a hashed linear scorer (softmax over word, word-head and shape features),
which judges every document from its text alone.

Toxic cue words are counted in all labelled documents, so words of any language can become cues. A cue
must be in a share of the toxic ones, which bounds the number of cues (a thousand times the distinct words
of a mean toxic document) without a cap. The pattern table is bounded by the product of the vote
options, the scorer by its buckets.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchload.llm import textnp as T
from pitchload.session import cut

GOOD, JUNK, TOXIC, ABSTAIN = 0, 1, 2, 3
CLASSES = ("good", "junk", "toxic")
SAMPLE = (15_000, 10_000)        # labelled and other documents that train the scorer (expected numbers, by a hash of the row)
CUE_SHARE = 0.001        # of the toxic documents that a cue must occur in ...
CUE_DOCS = 4             # ... and toxic documents, at least
CUE_RATE = 20            # toxic documents for each other one that a cue is in
ID_BITS = 1 << 26        # of the filter of labelled ids, at most
BUCKETS = 1 << 17        # of the scorer
GROUPS = 4               # parts of the sample that are trained apart and averaged
EPOCHS, RATE, BATCH, DECAY = 6, 0.5, 32, 1e-6
KEEP = 0.5               # least probability of good
#: fixed values: seed words of the toxic labeller
INSULTS = ("idiot", "moron", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "stupid", "clown")

_U = np.uint64
_bytes = np.arange(256)
_SYMBOL = np.isin(_bytes, np.frombuffer(b"%&$#*|!~^<>{}=\\", np.uint8)).astype(np.int64)
_UPPER = ((_bytes >= 65) & (_bytes <= 90)).astype(np.int64)
_LETTER = (_UPPER.astype(bool) | ((_bytes >= 97) & (_bytes <= 122))).astype(np.int64)
_TEXT = ((_LETTER > 0) | ((_bytes >= 48) & (_bytes <= 57)) | (_bytes >= 128)).astype(np.int64)
_insult = re.compile(r"(?<!\w)(?:" + "|".join(INSULTS) + r")(?!\w)", re.I)
KINDS = ("good", "marked", "shouted", "repeated", "toxic")
CLASS_OF = np.array([GOOD, JUNK, JUNK, JUNK, TOXIC])         # of the kinds
#: labellers that a kind of junk starts from, by their place in LABELLERS
ANCHORS = {"marked": (0, 4), "shouted": (1,), "repeated": (2, 3)}
LABELLERS = ("symbols", "capitals", "repetition", "vocabulary", "separators", "insults", "cues", "people")


class Shapes:
    """Shape measures of some texts: word counts and the shares that the labellers and the scorer use."""

    def __init__(self, texts: list[str]):
        buf, off = T.join_bytes([t.encode("utf-8", "surrogatepass") for t in texts])
        n = len(texts)
        total = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[buf])))[off])
        h, start, doc = T.words(buf, off)
        per_doc = lambda d: np.bincount(d, minlength=n)
        self.words = per_doc(doc)
        share = lambda a, b: a / np.maximum(b, 1)
        letters = total(_LETTER)
        self.letters = letters
        self.symbols = share(total(_SYMBOL), np.diff(off) - 1)
        self.capitals = share(total(_UPPER), letters)
        _, d1, _ = T.unique_per_doc(h, doc)
        self.distinct = share(per_doc(d1), self.words)
        s, sd = T.shingles(h, doc, 3)
        _, d3, _ = T.unique_per_doc(s, sd)
        self.repeated = 1 - share(per_doc(d3), np.maximum(per_doc(sd), 1))
        inside = np.concatenate(([0], np.cumsum(_TEXT[buf])))
        after = np.concatenate((start[1:], off[-1:]))[:len(start)]
        self.bare = share(per_doc(doc[inside[after] == inside[start]]), self.words)

    def votes(self) -> np.ndarray:
        """Votes of the shape labellers, one row per text."""
        def vote(x, good, junk, able):
            low = np.where(junk > good, x < good, x > good)
            high = np.where(junk > good, x > junk, x < junk)
            return np.where(able & low, GOOD, np.where(able & high, JUNK, ABSTAIN))
        some = self.words > 0
        return np.stack([vote(self.symbols, .01, .03, some), vote(self.capitals, .2, .5, some), vote(self.repeated, .1, .45, some),
                         vote(self.distinct, .55, .3, some), vote(self.bare, .02, .1, some)], 1)


def heads(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words: hash of the word, hash of its first four bytes, text index, length in bytes."""
    buf, off = T.join_bytes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    inside = ~T.SEPARATOR[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    prefix = T.prefix_hash(buf)
    return (T.range_hash(prefix, a, b), T.range_hash(prefix, a, np.minimum(a + 4, b)) ^ _U(0xABCD),
            np.searchsorted(off, a, side="right") - 1, b - a)


def all_votes(texts: list[str], cues: np.ndarray) -> np.ndarray:
    """Votes of every labeller but the people, as one number in base 4 per text."""
    votes = np.full((len(texts), len(LABELLERS) - 1), ABSTAIN)
    if not texts:
        return votes[:, 0]
    votes[:, :5] = Shapes(texts).votes()
    votes[:, 5] = [TOXIC if t and _insult.search(t) else ABSTAIN for t in texts]
    if len(cues):
        h, g, doc, _ = heads(texts)
        at = lambda x: cues[np.minimum(np.searchsorted(cues, x), len(cues) - 1)] == x
        votes[np.unique(doc[at(h) | at(g)]), 6] = TOXIC
    return votes @ (4 ** np.arange(votes.shape[1]))


def _start() -> np.ndarray:
    """P(vote | kind) that EM starts from (labellers x kinds x votes): a labeller mostly says what it is made for.
    The people's are given that they vote."""
    tables = np.zeros((len(LABELLERS), len(KINDS), 4))
    for k, kind in enumerate(KINDS):
        tables[:5, k] = (.85, .04, .01, .1)
        for j in ANCHORS.get(kind, ()):
            tables[j, k] = (.2, .69, .01, .1)
        tables[5:7, k] = (.01, .01, .58, .4) if kind == "toxic" else (.01, .01, .02, .96)
        tables[7, k] = np.where(np.arange(4) == CLASS_OF[k], .9, .05)
        tables[7, k, ABSTAIN] = 1
    return tables


def posterior(prior: np.ndarray, tables: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """P(kind | votes), one row per row of votes."""
    log = np.log(prior) + sum(np.log(tables[j][:, votes[:, j]]).T for j in range(len(tables)))
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of votes) and their counts: shares of the kinds and P(vote | kind) by
    labeller (labellers x kinds x votes). It stops when the posteriors stand."""
    start = _start()
    tables, prior, post = start, np.array([.8] + [.05] * (len(KINDS) - 1)), None
    for _ in range(rounds):
        new = posterior(prior, tables, patterns)
        if post is not None and np.abs(new - post).max() < 1e-6:
            break
        post = new
        weight = post * counts[:, None]
        prior = (weight.sum(0) + 1) / (weight.sum() + len(KINDS))
        hit = np.stack([[np.bincount(patterns[:, j], weights=weight[:, k], minlength=4) for k in range(len(KINDS))]
                        for j in range(len(tables))])
        tables = hit + start                              # one imagined document of each kind at the start's rates
        tables[7, :, ABSTAIN] = 0
        tables /= tables.sum(2, keepdims=True)
        tables[7, :, ABSTAIN] = 1                         # which documents people judged says nothing about their kind
    return prior, tables


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, bucket) pairs, sorted: words, word heads and steps of the shape measures."""
    h, g, doc, _ = heads(texts)
    s = Shapes(texts)
    steps = []
    for k, x in enumerate((s.symbols, s.capitals, s.repeated, s.distinct, s.bare)):
        step = np.minimum((x * 40).astype(np.int64), 39)
        steps.append(T.splitmix((step + 1000 * (k + 1)).astype(np.uint64)))
    every = np.concatenate([h, g, *steps, T.splitmix(np.full(len(texts), 77, np.uint64))])
    of = np.concatenate([doc, doc] + [np.arange(len(texts))] * (len(steps) + 1))
    pair = np.unique(of * BUCKETS + (T.splitmix(every) % _U(BUCKETS)).astype(np.int64))
    return pair // BUCKETS, pair % BUCKETS


def probabilities(weights: np.ndarray, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Softmax scores of n texts."""
    z = np.stack([np.bincount(doc, weights=weights[bucket, c], minlength=n) for c in range(len(CLASSES))], 1)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(texts: list[str], target: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights (BUCKETS x classes) by AdaGrad on soft targets."""
    k = len(CLASSES)
    w, square = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-2)
    parts = []
    for a, b in T.slices(texts):
        of, at = features(texts[a:b])
        parts.append(((of + a).astype(np.int32), at.astype(np.int32)))
    doc, bucket = (np.concatenate(c) for c in zip(*parts))
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            size = first[rows + 1] - first[rows]
            of = np.repeat(np.arange(len(rows)), size)
            at = bucket[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first[rows], size)]
            p = probabilities(w, of, at, len(rows))
            # long texts have many features: share their step among them
            g = (p - target[rows]) / np.sqrt(np.maximum(size, 1))[:, None]
            used, back = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(back, weights=g[of, c], minlength=len(used)) for c in range(k)], 1) + DECAY * w[used]
            square[used] += grad ** 2
            w[used] -= RATE * grad / np.sqrt(square[used])
    return w


class Model:
    """What `train` found: cue hashes, prior and labeller tables, scorer weights (32-bit)."""

    def __init__(self, cues, prior, tables, weights):
        self.cues, self.prior, self.tables, self.weights = cues, prior, tables, weights

    def score(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros((0, len(CLASSES)))]
        for a, b in T.slices(texts):
            out.append(probabilities(self.weights, *features(texts[a:b]), b - a))
        return np.concatenate(out)


def _strings(texts) -> list[str]:
    return [t if isinstance(t, str) else "" for t in texts]


def _votes_column(cues: np.ndarray) -> Column:
    @F.pandas_udf("long")
    def votes(text: pd.Series) -> pd.Series:
        texts = _strings(text)
        return pd.Series(np.concatenate([np.zeros(0, np.int64)] + [all_votes(texts[a:b], cues) for a, b in T.slices(texts)]))
    return votes("text")


def _cue_counts(batches):
    """(hash, toxic documents, other documents) of a batch's words and heads; heads of short words don't count."""
    for pdf in batches:
        texts, toxic = _strings(pdf["text"]), pdf["people"].to_numpy() == TOXIC
        for a, b in T.slices(texts):
            h, g, doc, n = heads(texts[a:b])
            every, of, _ = T.unique_per_doc(np.concatenate((h, g[n > 4])), np.concatenate((doc, doc[n > 4])))
            keys, back = np.unique(every, return_inverse=True)
            bad = np.bincount(back, weights=toxic[a:b][of], minlength=len(keys)).astype(np.int64)
            yield pd.DataFrame({"cue": keys.view(np.int64), "bad": bad, "other": np.bincount(back, minlength=len(keys)) - bad})


def _marks(h: np.ndarray, bits: int) -> np.ndarray:
    """The three bits of each hash in a filter of so many bits, a power of two."""
    h = h.view(np.uint64)
    return np.concatenate([T.splitmix(h ^ _U(k)) & _U(bits - 1) for k in range(1, 4)])


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of the `n` hashes `h`, as 64-bit words: ten bits or more a hash up to ID_BITS in all."""
    bits = min(ID_BITS, 1 << max(6, (10 * n).bit_length()))

    def words(batches):
        for pdf in batches:
            at = np.unique(_marks(pdf["h"].to_numpy(np.int64), bits))
            if len(at):
                word, first = np.unique(at >> _U(6), return_index=True)
                yield pd.DataFrame({"word": word.view(np.int64), "set": np.bitwise_or.reduceat(_U(1) << (at & _U(63)), first).view(np.int64)})
    got = ids.mapInPandas(words, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    out = np.zeros(bits >> 6, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["set"].to_numpy(np.int64).view(np.uint64)
    return out


def maybe_labelled(docs: DataFrame, people: DataFrame, n: int) -> DataFrame:
    """The rows of `docs` whose doc_id is in `people` (`n` rows) and few others: a join with `people` moves the
    texts of these only."""
    if docs.schema["doc_id"].dataType != people.schema["doc_id"].dataType:
        return docs                          # the hashes of equal ids would differ
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(people.select(F.xxhash64("doc_id").alias("h")), n))

    def passing(batches):                    # Arrow batches, so that no task keeps texts while it waits for an answer
        words = shared.value
        for batch in batches:
            at = _marks(batch.column("h").to_numpy(zero_copy_only=False), len(words) << 6)
            hit = (words[at >> _U(6)] >> (at & _U(63)) & _U(1)).reshape(3, -1).all(0)
            if hit.any():
                yield batch.drop_columns(["h"]).filter(pa.array(hit))
    return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(passing, docs.schema)


def toxic_cues(docs: DataFrame, people: DataFrame) -> np.ndarray:
    """Sorted hashes of the words and word heads that tell toxic documents, counted in all of `docs`
    (doc_id, text) that `people` (doc_id, people) call good, junk or toxic."""
    people = people.where(F.col("people") != ABSTAIN)
    n, toxic = people.agg(F.count(F.lit(1)), F.count_if(F.col("people") == TOXIC)).first()
    known = maybe_labelled(docs, people, n).join(people.hint("merge"), "doc_id")      # labels don't go through the driver
    least = max(CUE_DOCS, math.ceil(CUE_SHARE * toxic))
    counts = (known.select("text", "people").mapInPandas(_cue_counts, "cue long, bad long, other long")
              .groupBy("cue").agg(F.sum("bad").alias("bad"), F.sum("other").alias("other"))
              .where((F.col("bad") >= least) & (F.col("other") * CUE_RATE <= F.col("bad"))).select("cue").toPandas())
    return np.sort(counts["cue"].to_numpy(np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame | None, sample: tuple[int, int] = SAMPLE, held_out: Column | None = None) -> Model:
    """Fit labeller tables on the votes on all of `docs` (doc_id, text) and the scorer on a sample.

    `labels` (doc_id, quality, toxic) may cover some of them, be empty or None; several rows of one
    doc_id count as the worst; a null means not known. `held_out`: a condition on labels' rows whose
    people's votes must not be used (for tests).
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    if labels is not None:
        if held_out is not None:
            labels = labels.where(~held_out)
        people = (F.when(F.max("toxic") == 1, TOXIC).when(F.min("quality") == 0, JUNK)
                  .when(F.min("quality") == 1, GOOD).otherwise(ABSTAIN))
        labels = labels.where("doc_id is not null").groupBy("doc_id").agg(people.alias("people"))
    else:
        labels = spark.createDataFrame([], "doc_id long, people int")
    said = F.coalesce("people", F.lit(ABSTAIN)).alias("people")

    n = docs.count()
    if not n:
        return Model(np.zeros(0, np.uint64), None, None, np.zeros((BUCKETS, len(CLASSES)), np.float32))
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(3)), F.lit(1 << 40))
    known = labels.count()
    below = [int(min(1.0, want / max(have, 1)) * (1 << 40)) for want, have in zip(sample, (known, n - known))]
    part = docs.withColumn("place", place).where(F.col("place") < max(below)).join(labels, "doc_id", "left")
    part = cut(part.where(F.col("place") < F.when(F.col("people").isNull(), below[1]).otherwise(below[0]))
               .select("doc_id", "text", said, "place"), "sample")

    cues = toxic_cues(docs, labels)

    votes = docs.select("doc_id", _votes_column(cues).alias("votes"))
    joined = votes.join(labels, "doc_id", "left").select((F.col("votes") + 4 ** (len(LABELLERS) - 1) * said).alias("votes"))
    rows = sorted(joined.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.votes)
    split = lambda code: (code[:, None] // 4 ** np.arange(len(LABELLERS))) % 4
    patterns = split(np.array([r.votes for r in rows], np.int64))
    prior, tables = estimate(patterns, np.array([r.n for r in rows], float))

    def fit_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")      # the same order whenever the task runs again
        texts = _strings(pdf["text"])
        code = np.concatenate([all_votes(texts[a:b], cues) for a, b in T.slices(texts)])
        said_by = split(code + 4 ** (len(LABELLERS) - 1) * pdf["people"].to_numpy())
        kinds = posterior(prior, tables, said_by)
        w = fit(texts, np.stack([kinds[:, CLASS_OF == c].sum(1) for c in range(len(CLASSES))], 1))
        used = np.flatnonzero(np.abs(w).max(1) > 0)
        return pd.DataFrame({"bucket": used, **{c: w[used, i] for i, c in enumerate(CLASSES)}})

    group = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(GROUPS)).alias("part")
    got = (part.select("text", "people", "place", group).groupBy("part")
           .applyInPandas(fit_part, "bucket long, " + ", ".join(f"{c} double" for c in CLASSES))
           .groupBy("bucket").agg(*[F.sum(c).alias(c) for c in CLASSES]).toPandas())
    weights = np.zeros((BUCKETS, len(CLASSES)), np.float32)
    weights[got["bucket"].to_numpy()] = got[list(CLASSES)].to_numpy() / GROUPS
    return Model(cues, prior, tables, weights)


def score_column(model: Model, text: Column, spark) -> Column:
    """Struct of the class probabilities of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"{c} double" for c in CLASSES))
    def score(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.score(_strings(text)), columns=list(CLASSES))
    return score(text)


def judged(docs: DataFrame, labels: DataFrame | None, **how) -> DataFrame:
    """(doc_id, p_good, p_junk, p_toxic, keep) for every row of `docs`; keep if p_good >= KEEP.

    Only doc_id and text are read. A null text counts as empty and gets what a text without words gets;
    repeated rows get equal results, and texts with equal probabilities equal decisions (exactly KEEP is kept).
    Texts are judged whole, some at a time by their length, so a very long one only makes a slice of its own.
    An empty table gives an empty table.
    """
    model = train(docs, labels, **how)
    q = score_column(model, F.col("text"), docs.sparkSession)
    return docs.select("doc_id", q.alias("q")).select("doc_id", *[F.col(f"q.{c}").alias(f"p_{c}") for c in CLASSES],
                                                      (F.col("q.good") >= KEEP).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame | None, **how) -> DataFrame:
    """The rows of `docs` that `judged` keeps, all columns as they were."""
    model = train(docs, labels, **how)
    return docs.where(score_column(model, F.col("text"), docs.sparkSession)["good"] >= KEEP)
