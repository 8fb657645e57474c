"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary of a trained BPE model gives the merges. Text becomes symbols (a blank is U+2581, one
stands before the text); adjacent pairs whose union is a piece enter an agenda, the best piece first,
the leftmost of equals. A candidate that the agenda yields is skipped if a keyed hash of (seed, doc_id,
place of the chunk in its text, borders of the candidate in the chunk) says so; skipped candidates leave
the agenda. Characters outside the vocabulary become byte pieces, and so does U+2581 itself, so that
decoding gives back the text. Without dropout the pieces are those of the model's own encoder.

No piece spans the border between a word and the next blank, or a newline, so chunks (blanks and the
word behind them) are encoded apart. Every occurrence of a chunk draws its own skips. What an agenda does
depends on the rounds in which it skips only, so a worker keeps, for a chunk and a set of skipped rounds,
the candidates that follow and the pieces if none of them is skipped. An occurrence first follows the path
without skips; if it skips a candidate there it goes on with the path behind that skip, and so forth. Paths
are numbered and lie in flat arrays, where each candidate holds the number of the path behind its skip, so
that all occurrences of a block go one path further at once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.llm.textnp import slices, splitmix, splitmix_int

MODEL = "/opt/tokenizers/piece_bpe_32k.model"    # any BPE model of SentencePiece with byte pieces
SEED, DROPOUT = 7, 0.1
CACHE = 300_000          # paths kept; beyond that those go that no later block used, or all if more than half were used
SHORT = 64               # characters; a longer chunk has a heap as agenda
ROUNDS = 62              # rounds of an agenda that fit in a set of skips; an occurrence with a later skip has a heap
SLICE = 1 << 20          # characters of texts that are encoded together
BLOCK = 1 << 18          # chunks whose paths are followed together
_BLANK = "▁"
_chunks = re.compile(r" *[^ \n]+|\n| +")
_U = np.uint64
_NONE = 1 << 28          # priority of a pair that is no piece
_FAR = _NONE << 32
_M64 = (1 << 64) - 1
_A, _B, _C, _D = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9


class _Rows:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.all, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, more) -> None:
        n = self.n + len(more)
        if n > len(self.all):
            wide = np.zeros(max(n, len(self.all) * 3 // 2), self.all.dtype)
            wide[:self.n] = self.all[:self.n]
            self.all = wide
        self.all[self.n:n] = more
        self.n = n


class _Paths:
    """Paths of agendas, numbered from 0. Path p has the steps (candidates) from step[p] to step[p + 1] and
    the pieces from piece[p] to piece[p + 1]."""

    def __init__(self):
        self.of: dict[str, int] = {}                            # chunk -> its path without skips
        self.n = 0
        self.skips = _Rows(np.int64)                            # skipped rounds as bits
        self.turn = _Rows(np.int64)                             # the round of the first step
        self.again = _Rows(bool)                                # used by a later block than its first
        self.step, self.piece = _Rows(np.int64), _Rows(np.int64)
        self.mix, self.behind = _Rows(_U), _Rows(np.int32)      # a step's borders as one word; path behind its skip or -1
        self.pieces = _Rows("<i4")
        self.step.add([0])
        self.piece.add([0])

    def add(self, skips, turn, steps, mix, sizes, pieces) -> int:
        """Adds paths with so many steps and pieces each; returns the number of the first."""
        first = self.n
        self.n += len(skips)
        self.skips.add(skips)
        self.turn.add(turn)
        self.again.add(np.zeros(len(skips), bool))
        self.step.add(self.mix.n + np.cumsum(steps))
        self.piece.add(self.pieces.n + np.cumsum(sizes))
        self.mix.add(mix)
        self.behind.add(np.full(len(mix), -1, np.int32))
        self.pieces.add(pieces)
        return first

    def used(self) -> _Paths:
        """The paths that a later block has used, numbered anew. Who uses a path uses those before it, so none
        is cut off."""
        keep, got = self.again.all[:self.n], _Paths()
        number = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        steps, sizes = np.diff(self.step.all[:self.n + 1]), np.diff(self.piece.all[:self.n + 1])
        stay = np.repeat(keep, steps)
        got.add(self.skips.all[:self.n][keep], self.turn.all[:self.n][keep], steps[keep], self.mix.all[:self.mix.n][stay],
                sizes[keep], self.pieces.all[:self.pieces.n][np.repeat(keep, sizes)])
        behind = self.behind.all[:self.behind.n][stay]
        got.behind.all[:got.behind.n] = np.where(behind < 0, -1, number[behind])
        new = number.tolist()
        got.of = {c: new[p] for c, p in self.of.items() if new[p] >= 0}
        return got


class Codec:
    """Encoder and decoder for one model, seed and rate. `proto` is the model file's bytes."""

    def __init__(self, proto: bytes, seed: int = SEED, dropout: float = DROPOUT):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if not any(sp.is_byte(i) for i in range(size)):
            raise ValueError("the model has no byte pieces")
        self.byte = np.zeros(256, np.int32)
        for i in range(size):
            if sp.is_byte(i):
                self.byte[int(pieces[i][1:-1], 16)] = i
        self.id = {pieces[i]: i for i in plain}
        score = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(score)}
        # merge of the pieces l, r -> (priority of the union, its id) as one int, smaller first
        self.merge: dict[int, int] = {}
        for i in plain:
            p = pieces[i]
            for cut in range(1, len(p)):
                l, r = self.id.get(p[:cut]), self.id.get(p[cut:])
                if l is not None and r is not None:
                    self.merge[l << 24 | r] = place[sp.get_score(i)] << 24 | i
        # the same in arrays: a pair stands in the slot of its hash or, where that is taken, in the next free one
        bits = len(self.merge).bit_length() + 2
        self.shift = _U(64 - bits)
        self.slot_keys = np.full((1 << bits) + len(self.merge) + 1, -1, np.int64)
        self.slot_values = np.full(len(self.slot_keys), _NONE << 24, np.int64)
        pairs = np.array(list(self.merge), np.int64)
        values = np.array(list(self.merge.values()), np.int64)
        at = self._slot(pairs)
        while len(pairs):
            free = np.flatnonzero(self.slot_keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.slot_keys[at[free]], self.slot_values[at[free]] = pairs[free], values[free]
            rest = np.ones(len(pairs), bool)
            rest[free] = False
            pairs, values, at = pairs[rest], values[rest], at[rest] + 1
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1 and p != _BLANK:
                self.of_char[ord(p)] = i
        self.of_char[ord(" ")] = self.id[_BLANK]
        self.bytes = [b""] * size
        for i in plain:
            self.bytes[i] = pieces[i].replace(_BLANK, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            self.bytes[i] = bytes([b])
        self.seed = seed
        self.limit = int(dropout * (1 << 32))
        self.paths = _Paths()

    def keys(self, docs: list, counts: list[int]) -> np.ndarray:
        """One key for each chunk of texts with so many chunks: a hash of seed, doc_id and place."""
        doc = np.array([splitmix_int(self.seed ^ (splitmix_int(1) if d is None else int(d) & _M64)) for d in docs], _U)
        n = np.array(counts, np.int64)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return splitmix(np.repeat(doc, n) ^ splitmix(place.astype(_U)))

    def _skip(self, key, a, b, c):
        """Whether the candidate that joins symbols [a, b) and [b, c) of a chunk is skipped; for ints or arrays."""
        if isinstance(key, int):
            x = (key ^ (a * _A + b * _B + c * _C)) & _M64
            return (((x ^ x >> 29) * _D) & _M64) >> 32 < self.limit
        return self._drawn(key ^ self._mix(a, b, c))

    def _mix(self, a, b, c):
        return a.astype(_U) * _U(_A) + b.astype(_U) * _U(_B) + c.astype(_U) * _U(_C)

    def _drawn(self, x):
        """`_skip` for an array of keys combined with the candidates' borders."""
        return ((x ^ (x >> _U(29))) * _U(_D)) >> _U(32) < _U(self.limit)

    def chunks(self, chunks: list[str], key: np.ndarray) -> list[bytes]:
        """Piece ids of chunks with one key each, as little-endian 32-bit integers."""
        ids, sizes = self._encoded(chunks, key)
        ends = (4 * np.cumsum(sizes)).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0] + ends, ends)]

    def _encoded(self, chunks: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of chunks with one key each, one after the other, and how many each has."""
        parts = [self._block(chunks[a:a + BLOCK], key[a:a + BLOCK]) for a in range(0, len(chunks), BLOCK)]
        if not parts:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts))

    def _block(self, chunks: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`_encoded` for chunks whose paths are followed together."""
        paths = self.paths
        known = paths.n
        path = np.fromiter(map(paths.of.get, chunks, repeat(-1)), np.int64, len(chunks))
        lost = np.flatnonzero(path < 0)
        if len(lost):
            new: dict[str, int] = {}
            path[lost] = np.fromiter((new.setdefault(c, known + len(new)) if len(c) <= SHORT else -1
                                      for c in map(chunks.__getitem__, lost.tolist())), np.int64, len(lost))
            if new:
                self._learn(list(new), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64))
                paths.of.update(new)
        late = np.flatnonzero(path < 0).tolist()
        at = np.flatnonzero(path >= 0)
        while len(at):
            own = path[at]
            paths.again.all[own[own < known]] = True
            start = paths.step.all[own]
            m = paths.step.all[own + 1] - start
            edge = np.cumsum(m)
            step = np.arange(edge[-1]) + np.repeat(start - (edge - m), m)
            hit = np.flatnonzero(self._drawn(paths.mix.all[step] ^ np.repeat(key[at], m)))
            row = np.searchsorted(edge, hit, side="right")
            head = np.ones(len(hit), bool)                      # the first hit of its occurrence
            head[1:] = row[1:] != row[:-1]
            row, step = row[head], step[hit[head]]
            at, own = at[row], own[row]
            turn = paths.turn.all[own] + step - start[row]
            if len(at) and turn.max() >= ROUNDS:
                fits = turn < ROUNDS
                late += at[~fits].tolist()
                at, own, step, turn = at[fits], own[fits], step[fits], turn[fits]
            behind = paths.behind.all[step].astype(np.int64)
            lost = np.flatnonzero(behind < 0)
            if len(lost):
                new_, one, back = np.unique(step[lost], return_index=True, return_inverse=True)
                one = lost[one]
                skips = paths.skips.all[own[one]] | np.int64(1) << turn[one]
                first = self._learn(list(map(chunks.__getitem__, at[one].tolist())), skips, turn[one] + 1)
                paths.behind.all[new_] = first + np.arange(len(new_))
                behind[lost] = first + back
            path[at] = behind
        begin = paths.piece.all[path]
        m = paths.piece.all[path + 1] - begin
        own_ids = {k: self._pack(np.array(self._by_heap(self._ids([chunks[k]])[0].tolist(), int(key[k])), np.int64))[0]
                   for k in late}
        for k, ids in own_ids.items():
            begin[k], m[k] = 0, len(ids)
        edge = np.cumsum(m)
        out = paths.pieces.all.take(np.arange(int(m.sum())) + np.repeat(begin - (edge - m), m), mode="clip")
        for k, ids in own_ids.items():
            out[edge[k] - m[k]:edge[k]] = ids
        if paths.n > CACHE:
            kept = np.count_nonzero(paths.again.all[:paths.n])
            self.paths = paths.used() if 2 * kept <= CACHE else _Paths()
        return out, m

    def _learn(self, chunks: list[str], skips: np.ndarray, turn: np.ndarray) -> int:
        """Works out the paths of different (chunk, skipped rounds); `turn` is the round behind the last skip."""
        return self.paths.add(skips, turn, *self._by_array(chunks, skips, turn))

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters (-1 - code point outside the vocabulary) and the chunks' first positions."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.of_char[code], np.cumsum(size) - size

    def _pack(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with characters outside the vocabulary as their byte pieces, and the number of pieces of each id."""
        if (ids >= 0).all():
            return ids, np.ones(len(ids), np.int64)
        code = -1 - ids
        more = (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        count = more + 1
        row = np.repeat(np.arange(len(ids)), count)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        code, more = code[row], more[row]
        lead = np.array([0, 0xC0, 0xE0, 0xF0])[more]
        part = code >> 6 * (more - turn)
        byte = np.where(turn == 0, lead | part, 0x80 | part & 63)
        return np.where(code >= 0, self.byte[byte & 255], ids[row]), count

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(_U) * _U(_A) >> self.shift).astype(np.int64)

    def _pair(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Priority (_NONE: no piece) << 24 | id of the unions of ids."""
        want = l.astype(np.int64) << 24 | r                     # negative with a character outside the vocabulary
        at = self._slot(want)
        have = self.slot_keys[at]
        got = np.where(have == want, self.slot_values[at], _NONE << 24)
        other = np.flatnonzero((have != want) & (have >= 0))
        while len(other):
            at[other] += 1
            have = self.slot_keys[at[other]]
            same = have == want[other]
            got[other[same]] = self.slot_values[at[other[same]]]
            other = other[~same & (have >= 0)]
        got[want < 0] = _NONE << 24
        return got

    def _by_array(self, chunks: list[str], skips: np.ndarray, turn: np.ndarray) -> tuple:
        """The agendas of many chunks at once: in each round every chunk's agenda yields its best candidate,
        which is skipped in the rounds that are bits of `skips`.

        An agenda is a run of `rank`, priority and position in one integer, so that a run's minimum is
        the best candidate and the leftmost of equals. Returns for each chunk the number of candidates from
        the round `turn` on, their borders as words for `_drawn`, the number of pieces and the pieces.
        """
        ids, first = self._ids(chunks)
        n, k = len(ids), len(chunks)
        size = np.diff(np.append(first, n))
        last = first + size                                     # behind a chunk; `after` of its last symbol
        after = np.arange(1, n + 1)
        before = np.arange(-1, n)                               # of a chunk's first symbol: not read
        alive = np.ones(n, bool)
        value = np.full(n, _NONE << 24, np.int64)
        value[:-1] = self._pair(ids[:-1], ids[1:])
        value[last - 1] = _NONE << 24
        rank = value >> 24 << 32 | np.arange(n)
        union = (value & 0xFFFFFF).astype(np.int32)
        most, told, t = int(turn.max()), [], 0
        open_, starts, where = np.arange(k), first, None        # chunks that may have candidates, their runs
        while len(open_):
            best = np.minimum.reduceat(rank if where is None else rank[where], starts)
            some = best < _FAR
            ch, i = open_, best & 0xFFFFFFFF
            if not some.all():
                ch, i = ch[some], i[some]
                if 4 * len(ch) < 3 * len(open_):                # look only at the runs that still have candidates
                    open_ = ch
                    edge = np.cumsum(size[ch])
                    starts = edge - size[ch]
                    where = np.arange(int(edge[-1]) if len(edge) else 0) + np.repeat(first[ch] - starts, size[ch])
                if not len(ch):
                    break
            b = after[i]
            c = after[b]
            if self.limit:
                f = first[ch]
                mix = self._mix(i - f, b - f, c - f)
                if t < most:
                    tell = turn[ch] <= t
                    told.append((ch[tell], mix[tell]))
                    skip = (skips[ch] >> t & 1).astype(bool)
                    rank[i[skip]] = _FAR
                    ch, i, b, c = ch[~skip], i[~skip], b[~skip], c[~skip]
                else:
                    told.append((ch, mix))
            t += 1
            ids[i] = u = union[i]
            after[i] = c
            alive[b] = False
            rank[b] = rank[i] = _FAR
            right = c < last[ch]
            r, a = c[right], i[right]
            before[r] = a
            left = i > first[ch]
            l = before[i[left]]
            value = self._pair(np.concatenate((u[right], ids[l])), np.concatenate((ids[r], u[left])))
            a = np.concatenate((a, l))
            rank[a] = value >> 24 << 32 | a
            union[a] = value & 0xFFFFFF
        left = np.flatnonzero(alive)
        pieces, count = self._pack(ids[left])
        sizes = np.add.reduceat(count, np.searchsorted(left, first))
        steps = np.bincount(np.concatenate([x for x, _ in told]), minlength=k) if told else np.zeros(k, np.int64)
        path = np.zeros(int(steps.sum()), _U)
        begin = np.cumsum(steps) - steps - turn
        for t, (ch, mix) in enumerate(told):
            path[begin[ch] + t] = mix
        return steps, path, sizes, pieces

    def _by_heap(self, ids: list[int], key: int) -> list[int]:
        """The agenda as a heap of (priority, start, middle, end); stale candidates are passed over."""
        n = len(ids)
        ids, after, before = ids[:], list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and ids[a] >= 0 <= ids[b]:
                got = self.merge.get(ids[a] << 24 | ids[b])
                if got is not None:
                    heap.append((got >> 24, a, b, after[b], got & 0xFFFFFF))

        for a in range(n - 1):
            offer(a)
        heapq.heapify(heap)
        dead = [False] * n
        while heap:
            _, a, b, c, new = heapq.heappop(heap)
            if dead[a] or after[a] != b or dead[b] or after[b] != c:
                continue
            if self.limit and self._skip(key, a, b, c):
                continue
            ids[a], after[a], dead[b] = new, c, True
            if c < n:
                before[c] = a
            for x in ((before[a], a) if before[a] >= 0 else (a,)):
                have = len(heap)
                offer(x)
                if len(heap) > have:
                    heapq.heappush(heap, heap.pop())
        out, a = [], 0
        while a < n:
            out.append(ids[a])
            a = after[a]
        return out

    def encode_many(self, texts: list[str], docs: list) -> list[np.ndarray]:
        """Piece ids of texts, each with its doc_id (or None); an empty text has none."""
        split = [_chunks.findall(" " + t) if t else [] for t in texts]
        counts = [len(c) for c in split]
        ids, sizes = self._encoded([c for part in split for c in part], self.keys(docs, counts))
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts, dtype=np.int64))].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str, doc=0) -> list[int]:
        """Piece ids of one text."""
        return self.encode_many([text], [doc])[0].tolist()

    def decode(self, ids) -> str:
        """The text of piece ids."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_codecs: dict = {}


def _codec(proto: bytes, seed: int, dropout: float) -> Codec:
    """One codec per worker process, so that its cache lasts over tasks."""
    at = (hashlib.md5(proto).digest(), seed, dropout)
    if at not in _codecs:
        _codecs.clear()
        _codecs[at] = Codec(proto, seed, dropout)
    return _codecs[at]


def _batches(proto, seed, dropout, keep_ids):
    def run(batches):
        codec = _codec(proto, seed, dropout)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            for a, b in slices(texts, SLICE):
                rows, part = [], texts[a:b]
                for t, ids in zip(part, codec.encode_many(part, docs[a:b])):
                    rows.append((len(ids), codec.decode(ids.tolist()) == t, hashlib.sha256(ids.tobytes()).hexdigest(), ids))
                out = pd.DataFrame(rows, columns=["n_tokens", "lossless", "ids_sha256", "token_ids"])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].astype("Int64").array)
                yield out if keep_ids else out.drop(columns="token_ids")
    return run


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT,
           keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, lossless, ids_sha256, token_ids) for every row of `docs`.

    `lossless` says that decoding gave back the text; the digest is of the ids as little-endian 32-bit
    integers. The model file (a path the driver can read) travels to the tasks with the code. A null or
    empty text has no tokens. Rows are judged one by one: repeated rows give equal results, an empty
    table an empty one; a null doc_id draws like one more id; columns other than doc_id and text are
    ignored. Of candidates with equal scores the leftmost comes first. A very long text is encoded alone.
    """
    with open(model, "rb") as f:
        proto = f.read()
    schema = "doc_id long, n_tokens long, lossless boolean, ids_sha256 string" + ", token_ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        _batches(proto, seed, dropout, keep_ids), schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """`tokens` with a column `text` decoded from `token_ids` (null where that is null)."""
    with open(model, "rb") as f:
        proto = f.read()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = _codec(proto, SEED, DROPOUT)
        return ids.map(lambda x: None if x is None else codec.decode(x))

    return tokens.withColumn("text", text("token_ids"))
