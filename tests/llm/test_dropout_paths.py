"""Numbered paths of op10_dropout: calls per chunk, generations, the pair table, byte pieces."""

import cProfile
import pstats
import random

import numpy as np
import pytest

from pitchload.llm import sp_dropout


@pytest.fixture(scope="module")
def proto():
    with open(sp_dropout.MODEL, "rb") as f:
        return f.read()


def made_texts(n, seed=1):
    """Words of syllables, some of them frequent, with odd characters, line ends and long chunks."""
    rng = random.Random(seed)
    parts = ["the", "in", "tion", "er", "Re", "ed", "ing", "han", "é", "日本", "▁", "\x00", "7", "-", "😀"]
    words = ["".join(rng.choices(parts, [9] * 8 + [1] * 7, k=rng.randint(1, 6))) for _ in range(300)] + ["ab" * 40, " ", "\n"]
    return [" ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_known_chunks_cost_no_calls_each(proto):
    codec = sp_dropout.Codec(proto)
    text = "the international organisation of words and things " * 400
    first = codec.encode(text, 3)
    counted = cProfile.Profile()
    again = counted.runcall(codec.encode, text, 3)
    assert again == first and codec.decode(again) == text
    assert pstats.Stats(counted).total_calls < len(sp_dropout._chunks.findall(" " + text)) / 2


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_generations_and_blocks_change_nothing(proto, dropout, monkeypatch):
    some = made_texts(60)
    docs = [None if d % 7 == 0 else -d if d % 5 == 0 else d for d in range(60)]
    want = sp_dropout.Codec(proto, dropout=dropout).encode_many(some, docs)
    monkeypatch.setattr(sp_dropout, "BLOCK", 37)
    for most in (0, 50, 400):
        monkeypatch.setattr(sp_dropout, "CACHE", most)
        codec = sp_dropout.Codec(proto, dropout=dropout)
        for a in range(0, 60, 20):
            got = codec.encode_many(some[a:a + 20], docs[a:a + 20])
            assert [x.tolist() for x in got] == [x.tolist() for x in want[a:a + 20]]
            assert codec.paths.n <= most


def test_paths_used_again_stay(proto):
    some = made_texts(30)
    codec = sp_dropout.Codec(proto, dropout=0.5)
    first = [codec.encode(t, d) for d, t in enumerate(some)]
    before = codec.paths
    codec.paths = before.used()
    assert 0 < codec.paths.n < before.n and 0 < len(codec.paths.of) < len(before.of) and not codec.paths.again.all.any()
    assert codec.paths.mix.n == codec.paths.behind.n == codec.paths.step.all[codec.paths.n]
    assert {c: before.piece.all[p + 1] - before.piece.all[p] for c, p in before.of.items() if c in codec.paths.of} == {
        c: codec.paths.piece.all[p + 1] - codec.paths.piece.all[p] for c, p in codec.paths.of.items()}
    assert [codec.encode(t, d) for d, t in enumerate(some)] == first


def test_a_late_skip_has_a_heap(proto, monkeypatch):
    some = made_texts(20, 2)
    want = [x.tolist() for x in sp_dropout.Codec(proto, dropout=0.5).encode_many(some, list(range(20)))]
    for rounds, short in ((3, 64), (62, 2), (0, 64)):
        monkeypatch.setattr(sp_dropout, "ROUNDS", rounds)
        monkeypatch.setattr(sp_dropout, "SHORT", short)
        assert [x.tolist() for x in sp_dropout.Codec(proto, dropout=0.5).encode_many(some, list(range(20)))] == want


def test_pair_table_holds_every_merge(proto):
    codec = sp_dropout.Codec(proto)
    l = np.array([x >> 24 for x in codec.merge])
    r = np.array([x & 0xFFFFFF for x in codec.merge])
    assert codec._pair(l, r).tolist() == list(codec.merge.values())
    rng = np.random.default_rng(0)
    l, r = rng.integers(-300, 32000, (2, 100_000))
    none = sp_dropout._NONE << 24
    want = [codec.merge.get(a << 24 | b, none) if a >= 0 <= b else none for a, b in zip(l.tolist(), r.tolist())]
    assert codec._pair(l, r).tolist() == want


def test_byte_pieces_of_every_length(proto):
    codec = sp_dropout.Codec(proto)
    points = [0, 0x7F, 0x80, 0x7FF, 0x800, 0xD800, 0xDFFF, 0xFFFF, 0x10000, 0x10FFFF]
    ids, count = codec._pack(np.array([5] + [-1 - p for p in points] + [9], np.int32))
    want = [[5]] + [codec.byte[list(chr(p).encode("utf-8", "surrogatepass"))].tolist() for p in points] + [[9]]
    assert ids.tolist() == sum(want, []) and count.tolist() == list(map(len, want))


def test_no_chunks(proto):
    codec = sp_dropout.Codec(proto)
    assert codec.encode_many([], []) == [] and codec.chunks([], np.zeros(0, np.uint64)) == []
    assert [x.tolist() for x in codec.encode_many(["", ""], [1, None])] == [[], []]
