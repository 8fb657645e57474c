"""Operators that learn: EM, Viterbi, language models, centroids."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchload.llm import multi_index, transcript_hmm, url_lm, weak_quality
from tests.conftest import SF01

SF1 = "/root/testdata/sf0.1"


def test_em_finds_the_kinds():
    rng = np.random.default_rng(1)
    kind = rng.choice(5, 20_000, p=[.75, .06, .05, .06, .08])
    tables = weak_quality._start()
    tables = tables / tables.sum(2, keepdims=True)
    tables[7] = (.3, .02, .02, .66)
    for k in range(5):
        tables[7, k, :3] = np.where(np.arange(3) == weak_quality.CLASS_OF[k], .3, .02)
    votes = np.stack([(rng.random((len(kind), 1)) > np.cumsum(tables[j][kind] / tables[j][kind].sum(1, keepdims=True), 1)[:, :3]).sum(1)
                      for j in range(8)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, found = weak_quality.estimate(patterns, n.astype(float))
    assert np.abs(prior - [.75, .06, .05, .06, .08]).max() < 0.03
    assert abs(found[5, 4, weak_quality.TOXIC] - tables[5, 4, weak_quality.TOXIC]) < 0.1


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = weak_quality.judged(docs, labels, held_out=held).join(labels.where(held), "doc_id").collect()
    clean = [r.keep for r in got if r.quality == 1 and not r.toxic]
    bad = [r.keep for r in got if r.quality == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(bad) <= 0.25 * len(bad)


def test_cues_are_counted_in_all_labelled_documents(spark):
    """Against a plain count of words; the training sample's size doesn't matter."""
    r = np.random.default_rng(3)
    common, rare = [f"word{i:02}" for i in range(40)], ["zorpa", "qixel", "vunto"]
    rows = []
    for i in range(3000):
        toxic = i % 10 == 0
        words = list(r.choice(common, 8)) + ([str(r.choice(rare))] if toxic and i % 50 == 0 else []) + (["zorpa"] if i == 7 else [])
        rows.append((i, " ".join(words), weak_quality.TOXIC if toxic else weak_quality.ABSTAIN if i % 3 == 0 else weak_quality.GOOD))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = set(weak_quality.toxic_cues(docs, spark.createDataFrame([(i, p) for i, _, p in rows], "doc_id long, people int")).tolist())
    for w in common + rare:
        bad = sum(w in t.split() for _, t, p in rows if p == weak_quality.TOXIC)
        other = sum(w in t.split() for _, t, p in rows if p == weak_quality.GOOD)
        assert (int(weak_quality.heads([w])[0][0]) in got) == (bad >= 4 and other * 20 <= bad), w
    assert got


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "a word or two", "c"), (2, "a word or two", "c"),
                                  (3, "$$$ %%% " * 300, "d")], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), None):
        assert weak_quality.judged(docs, given).count() == 5
    assert weak_quality.accepted(docs, labels).columns == docs.columns
    assert weak_quality.judged(docs.limit(0), labels).count() == 0


def test_urls_against_sql(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()]
    rows += [(None, None), (9005, "no host"), (9005, "no host"), (9006, "HTTP://WWW.Example.COM:80/en/?x"), (9007, "ftp://a.net/es/é#"), (9008, "x://com"),
             (9009, "x://notexample.com/en/"), (9010, "x://example.com?/en/"), (9011, "://"), (9012, "a://ÄB.net/fr/")]
    df = spark.createDataFrame([(p, u, "r", "s") for p, u in rows], "page_id long, url string, rule string, host string")
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    want = con.sql("SELECT page_id, host, path, rule, verdict FROM (" + url_lm.oracle() + ")").fetchall()
    plain = sorted(tuple(map(str, r)) for r in url_lm.judge(df).select("page_id", "host", "path", "rule", "verdict").collect())
    assert plain == sorted(tuple(map(str, r)) for r in want)
    by = {r[0]: r[1:] for r in plain}
    assert by["9006"][:3] == ("www.example.com:80", "/en/", "None") and by["9008"][2] == "None" and by["9009"][2:] == ("com/", "allow")
    assert by["9007"][2:] == ("net/es/", "block") and by["9012"][0] == "Äb.net" and by["9011"][3] == "allow"
    assert url_lm.judge(df.limit(0)).count() == 0


def test_urls_language_model_tells_sites_apart(spark):
    r = random.Random(2)
    good = [f"http://{''.join(r.choice('abc') for _ in range(6))}.com/{r.randint(1, 99)}" for _ in range(300)]
    bad = [f"http://{''.join(r.choice('xyz') for _ in range(6))}.net/es/{r.randint(1, 99)}" for _ in range(300)]
    asked = ["http://abcabc.org/7", "http://xyzzyx.org/es/7"]
    df = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_lm.judge(df).where("rule is null").collect()}
    assert got == {600: "allow", 601: "block"}


def test_viterbi_against_all_paths():
    r = random.Random(1)
    model = transcript_hmm.Model({("start", 1, 0): 50, ("next", 1, 2): 40, ("next", 2, 1): 40, ("look", 1, 5): 9, ("look", 2, 8): 9})
    for entry, exit_ in itertools.product((None, 0, 2), (None, 1)):
        seq = [(r.choice([-1, -1, 0, 1, 2]), r.randrange(transcript_hmm._KINDS), r.random() < .6) for _ in range(6)]

        def score(path):
            total, before = 0.0, entry
            for (m, k, opens), s in zip(seq, path):
                total += model.start[s] if before is None else model.go[int(opens)][before][s]
                total += model.emit(m, k)[s]
                before = s
            return total
        paths = [p for p in itertools.product(range(3), repeat=6) if exit_ is None or p[-1] == exit_]
        assert abs(score(model.decode(seq, entry, exit_)) - max(map(score, paths))) < 1e-9
        m = model.matrix(seq)[3 if entry is None else entry]
        assert abs((m.max() if exit_ is None else m[exit_]) - max(map(score, paths))) < 1e-9


def test_transcripts_slices_don_t_matter(spark):
    base = spark.read.parquet(f"{SF01}/conversations.parquet")
    hidden = base.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) > 0, F.col("role")))
    hot = hidden.where("conv_id < 40").withColumn("turn", F.col("turn") + 10 * F.col("conv_id")).withColumn("conv_id", F.lit(-5).cast("long"))
    df = hidden.unionByName(hot).withColumn("part", F.lit("clash"))
    key = lambda d: sorted((r.conv_id, r.turn, r.part, r.role, r.text) for r in d.collect())
    whole, sliced = key(transcript_hmm.canonical(df, 10**6)), key(transcript_hmm.canonical(df, 25))
    assert whole == sliced
    truth = {(r.conv_id, r.turn): r.role for r in base.collect()}
    found = [role == truth[c, t] for c, t, _, role, _ in whole if (c, t) in truth]
    assert sum(found) > 0.97 * len(found)


def test_transcripts_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, None, "System: be kind\nUser: hi\nthere\n\nAssistant: hello"), (1, 1, "USER", None), (1, 1, "USER", None),
                                (None, None, None, ""), (2, 0, "weird", "x")], "conv_id long, turn long, role string, text string")
    got = sorted((str(r.conv_id), str(r.turn), r.part, r.role, r.text) for r in transcript_hmm.canonical(df).collect())
    assert [g for g in got if g[:2] == ("1", "0")] == [("1", "0", 0, "system", "be kind"), ("1", "0", 1, "user", "hi\nthere"),
                                                       ("1", "0", 2, "assistant", "hello")]
    assert len(got) == 7 and ("1", "1", 0, "user", "") in got
    assert transcript_hmm.canonical(df.limit(0)).count() == 0


def nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    o = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [ids[i] for i in o]


def test_recall(spark):
    vectors = spark.read.parquet(f"{SF1}/embeddings.parquet")
    pdf = vectors.orderBy("vec_id").toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    got = {}
    for r in multi_index.search(vectors, vectors.where("vec_id % 100 = 0"), 10, block=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hit = sum(len(set(got[ids[q]].values()) & set(nearest(x, ids, q))) for q in range(0, len(ids), 100))
    assert hit >= 0.9 * 10 * len(got) and len(got) == 20
    whole = multi_index.search(vectors, vectors.where("vec_id = 100"), 10, share=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in whole] == nearest(x, ids, 100)


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1., 0.]), (1, [1., 0.]), (2, [1., 0.]), (2, [1., 0.]), (3, None), (4, [0., 0.]), (5, [nan, 1.]), (6, [1., inf]), (7, [1., None]),
            (8, [1., 2., 3.]), (None, [1., 0.]), (9, [1., 1.]), (100, [0., 0.])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("cell", F.lit("x"))
    got = multi_index.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 9, 1.0)]
    assert multi_index.search(df.limit(0), df).count() == 0 and multi_index.search(df, df.limit(0)).count() == 0


def test_vectors_of_one_component(spark):
    df = spark.createDataFrame([(i, [float(i * i)]) for i in range(1, 8)] + [(100, [5.0])], "vec_id long, embedding array<double>")
    got = multi_index.search(df, df.where("vec_id = 100"), 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(100, 1, 2, 1.0), (100, 2, 1, 4.0), (100, 3, 3, 4.0)]


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e8, 1e200])
def test_nearest_far_from_the_origin(offset):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 64)) + offset
    q, ids = x[0], np.arange(500)
    want = np.lexsort((ids, np.sqrt(((x - q) ** 2).sum(1))))[1:11]
    got, score = multi_index._nearest(x, ids, q, ids != 0, 10)
    assert got.tolist() == want.tolist() and (score == np.sqrt(((x[want] - q) ** 2).sum(1))).all()


def test_cells_come_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    cells = multi_index.traverse(a, b, lambda c: 1, 10**6)
    total = [a[c // 7] + b[c % 7] for c in cells]
    assert sorted(cells) == list(range(63)) and all(x <= y + 1e-12 for x, y in zip(total, total[1:]))
