"""Prefix trie against a plain version: random conversations, deep chains, odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
from pitchload.llm import prefix_trie
from tests.conftest import SF01

SCHEMA = "conv_id long, turn long, role string, text string, d long, h1 string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, tie, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(c - 20 * int(c / 20))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(str(c))
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        words = len(re.findall(prefix_trie.WORD, s[-1][1])) if s else 0
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids[s])
    return sorted((m[0], len(s), members[s[:-1]][0] if s else -1, len(m), len(kids[s]), leaves[s], saved[s],
                   hashlib.sha256(",".join(ends[s]).encode()).hexdigest()) for s, m in members.items())


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(COLS).collect())


def both(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(5)
    assert got(prefix_trie.prefix_trie(df)) == plain(rows)


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    r, rows = random.Random(3), []
    for c in r.sample(range(-60, 400), 200):
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", None]), r.choice(["a b", "a  b c", "", None, "é x y"])))
    rows += rows[:40] + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    both(spark, rows)


def test_chain_of_many_segments(spark, monkeypatch):
    """One conversation with most of the rows, and others that leave it at many depths."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    line = [("user", f"w{i} x") for i in range(150)]
    rows = [(c, t, *line[t]) for c, n in ((40, 150), (41, 150), (60, 149), (81, 75), (100, 20), (9, 2)) for t in range(n)]
    both(spark, rows + [(100, 20, "user", "another"), (100, 21, "user", "end " * 20_000)])


def test_small_tables(spark):
    both(spark, [])
    both(spark, [(7, 0, "user", "only")])
    both(spark, [(1, None, None, None), (1, None, None, None)])


def test_against_sql(spark):
    sf = SF01
    want = duckdb.sql(prefix_trie.ORACLE.replace("FROM conversations", f"FROM '{sf}/conversations.parquet'")).fetchall()
    rows = got(prefix_trie.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet")))
    assert rows == sorted(tuple(-1 if x is None else x for x in r) for r in want)
    raw = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    assert rows == plain(raw)
