import hashlib
import random

import pytest

from pitchload.llm import deep_shallow, suffix_dedup


def brute(rows):
    """rows: [(doc_id, text)] with unique ids -> {doc_id: (n, removed, runs, sha)}"""
    seen, out = set(), {}
    for did, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                cover[s:s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[did] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeäö") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(r.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            t = t + s[a:a + r.randint(50, 400)] + text(r.randint(0, 10))
        if r.random() < .1 and rows:
            t = rows[-1][1]
        rows.append((i * 3, t))
    return rows + [(1000, None), (1001, ""), (1002, "x" * 500), (1003, "ab" * 300 + "x" * 150), (None, shared[0])]


@pytest.mark.parametrize("contexts", [20_000, 2])
def test_against_brute_force(spark, contexts):
    rows = corpus(contexts)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
           for r in suffix_dedup.remove_repeats(df, contexts).collect()}
    assert got == brute(rows)
    assert sum(v[1] for v in got.values()) > 1000


def test_pieces_of_a_long_text(spark, monkeypatch):
    rows = corpus(5, 20)
    whole = " ".join(t for _, t in rows if t)
    old = list(suffix_dedup._grouped(suffix_dedup._parts([whole.encode()])))
    base = set(zip(*[x.tolist() for x in suffix_dedup.anchors(old[0])[1:]]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    got = set()
    for g in suffix_dedup._grouped(suffix_dedup._parts([whole.encode()]), 700):
        got |= set(zip(*[x.tolist() for x in suffix_dedup.anchors(g)[1:]]))
    assert got == base


def test_odd_rows(spark):
    t = "abc def " * 5 + "q" * 90 + " and so on and so on, nothing else matters here at all, really"
    df = spark.createDataFrame([(1, t, "x"), (1, t, "y"), (2, t, "z")], "doc_id long, text string, bytes string")
    got = sorted(suffix_dedup.remove_repeats(df).select("doc_id", "n_removed").collect())
    assert [tuple(r) for r in got] == [(1, 0), (1, 0), (2, len(t))]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_order():
    r = random.Random(3)
    base = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) for _ in range(40)]
    strings = base + [b"a" * 60 + s for s in base] + [b"a" * 70 + s[:9] for s in base]
    assert [strings[i] for i in deep_shallow.order(strings)] == sorted(strings)
    assert [strings[i] for i in deep_shallow.blind_trie(strings, list(range(len(strings))))] == sorted(strings)
