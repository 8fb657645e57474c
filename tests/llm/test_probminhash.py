import random

import numpy as np

from pitchload.llm import probminhash as P
from pitchload.llm import textnp as T


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, least=0.8):
    """{row index: class id} by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    of = dict(zip(texts, label))
    ids = {}
    for d, t in rows:
        k = of[t or ""]
        ids[k] = min((x for x in (ids.get(k), d) if x is not None), default=None)
    return [ids[of[t or ""]] for _, t in rows]


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += ["a b", "a b", "a b c", "", None, "   ", "x " * 5000, "x " * 4000, rows[0], rows[0]]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_against_all_pairs(spark):
    rows = corpus() + [(None, "a b"), (None, "only null here twice"), (None, "only null here twice"), (3, "one two three")]
    df = spark.createDataFrame([(d, t, "n", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, node string, key long")
    got = P.near_duplicate_classes(df.repartition(4)).collect()
    key = lambda pairs: sorted(((str(a), str(b)) for a, b in pairs))
    assert key((r.doc_id, r.class_id) for r in got) == key((d, c) for (d, _), c in zip(rows, brute(rows)))
    kept = P.keep_one(df).collect()
    assert len(kept) == len({str(c) for c in brute(rows)}) + 1          # doc_id 3 names two classes
    assert kept[0].__fields__ == ["doc_id", "text", "node", "key"]


def test_many_clusters_in_one_bucket(spark):
    """A template shared by all puts 25 clusters into the same buckets; no bucket has a centre for each."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(60)], []
    for _ in range(25):
        own = [word() for _ in range(25)]
        for _ in range(6):
            w = template + own
            w[r.randrange(60, len(w))] = word()
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.near_duplicate_classes(df, m=12, rows=1).collect()
    want = brute(rows)
    assert len(set(want)) > 10
    assert {x.doc_id: x.class_id for x in got} == {d: c for (d, _), c in zip(rows, want)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.near_duplicate_classes(df).count() == 0 and P.keep_one(df).count() == 0


def test_early_termination_changes_nothing():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    w = rng.uniform(1, 3, 40)
    m = 16
    got = P.sketch(h, np.zeros(40, np.int64), w, 1, m)[0]
    first, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    for x, weight in zip(h, w):                    # every process far beyond its last useful arrival
        r, t = np.array([x]) ^ np.uint64(T.splitmix_int(1)), 0.0
        for _ in range(400):
            r = T.splitmix(r)
            t = t - np.log1p(-(r[0] >> np.uint64(11)).astype(float) * 2.0 ** -53) / weight
            k = int((T.splitmix(r ^ np.uint64(0x5851F42D4C957F2D))[0] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32))
            if t < first[k]:
                first[k], owner[k] = t, x
    assert (got == owner).all()


def test_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 60), rng.uniform(0.5, 4, 60)
    a[:15], b[-15:] = 0, 0
    exact = sum(1 / max_sum for x, y in zip(a, b) if x and y
                for max_sum in [sum(max(p / x, q / y) for p, q in zip(a, b))])
    m = 4096
    sig = [P.sketch(h[v > 0], np.zeros(int((v > 0).sum()), np.int64), v[v > 0], 1, m)[0] for v in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - exact) < 4 * np.sqrt(exact / m)


def test_keep_one_with_columns_of_any_name(spark):
    df = spark.createDataFrame([(2, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (3, None, 3, "z")],
                               "doc_id long, text string, one long, node string")
    got = sorted(map(tuple, P.keep_one(df).collect()), key=str)
    assert got == [(1, "a b c d e f", 2, "y"), (3, None, 3, "z")]


def _near_copies(spark, n, seed=3):
    """Sets of n near copies: half of them in the class of their source, half too far from it and each other."""
    r = np.random.default_rng(seed)
    base, rows = r.integers(0, 1 << 40, 150), []
    for i in range(n):
        w = base.copy()
        w[r.choice(150, 6 if i % 2 else 30, False)] = r.integers(1 << 40, 1 << 41, 6 if i % 2 else 30)
        rows.append((bytearray(i.to_bytes(4, "big")), [int(x) for x in w[:150 - i % 5]], bytearray(b"A" if i % 2 else i.to_bytes(4, "big"))))
    return spark.createDataFrame(rows, "node binary, sh array<long>, comp binary")


def test_pairs_of_a_group_of_near_copies_grow_with_the_group(spark):
    count = {}
    for n in (500, 2000):
        df = _near_copies(spark, n)
        count[n] = P.may_be_similar(df.select("node", "sh"), df.select("node", "comp"), 0.8).count()
    assert count[2000] <= 5 * max(count[500], 20)


def test_join_keeps_every_similar_pair_of_different_classes(spark):
    """Sets of many sizes around the similarity, whatever the classes: no pair at 0.8 is missed."""
    r = random.Random(9)
    sets = []
    for _ in range(12):
        base = [r.randrange(1000) for _ in range(r.choice([1, 2, 5, 9, 40, 90]))]
        for _ in range(14):
            w = {r.randrange(2000) if r.random() < r.choice([0, .05, .1, .2]) else x for x in base}
            w |= {r.randrange(2000) for _ in range(r.randrange(1 + len(base) // 4))}
            sets.append(w)
    comp = [r.randrange(60) for _ in sets]
    df = spark.createDataFrame([(bytearray([i // 256, i % 256]), sorted(w), bytearray([c])) for i, (w, c) in enumerate(zip(sets, comp))],
                               "node binary, sh array<long>, comp binary")
    got = {frozenset(256 * x[0] + x[1] for x in (p.node, p.centre))
           for p in P.may_be_similar(df.select("node", "sh"), df.select("node", "comp"), 0.8).collect()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i)
            if comp[i] != comp[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 50 and want <= got
