"""Chat transcripts: recover who speaks by a hidden Markov model, then render canonical turns.

Rows of a conversation are cut into lines. A line shows a speaker marker (the row's role on its first
line, or `User:`, `<|assistant|>`, `[system]` and the like in the text), whether it opens its row, its
length and how it ends. States are the roles. What lines look like in each role and who follows whom is
counted over the lines whose rows name a speaker; Viterbi then gives every line its most likely role.

A conversation may be of any length. Rows are dealt in order to slices of bounded size. A slice that
holds a part of a conversation yields that part's best score from every entry role to every exit role
(a max-plus matrix); the matrices of neighbouring parts give the roles at the cuts, and each slice is
then decoded by itself between fixed ends.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.session import cut

ROLES = ("system", "user", "assistant")
#: fixed values: names of the speakers
NAMES = {"system": 0, "sys": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "prompter": 1, "question": 1, "q": 1,
         "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "answer": 2, "a": 2, "chatbot": 2}
SLICE = 20_000            # rows (expected) that one task decodes
RIGHT = 0.98              # trust in a marker
_S = len(ROLES)
_marker = re.compile(r"\s*(?:#+\s*|\*\*)?(?:<\|(?:im_start\|>)?|\[|<)?\s*(" + "|".join(sorted(NAMES, key=len, reverse=True))
                     + r")\s*(?:\|>|\]|>|(?:\*\*)?\s*:(?:\*\*)?)\s*", re.I)
_end = re.compile(r"\s*<\|(?:im_end|end|eot_id)\|>\s*$")
_KINDS = 2 * 5 * 3        # looks of a line: opens its row or not, length, ending


def named(role) -> int:
    """State of a role's name; -1 if it names none."""
    return NAMES.get(role.strip().lower(), -1) if isinstance(role, str) else -1


def lines(role, text) -> list[tuple[int, int, str]]:
    """(marker, look, text) of a row's lines; the marker's text is taken off. Empty lines belong to the
    line before; a row without text has one empty line."""
    out: list[list] = []
    for part in (text if isinstance(text, str) else "").split("\n"):
        part = _end.sub("", part)
        m = _marker.match(part)
        if m:
            out.append([NAMES[m[1].lower()], part[m.end():]])
        elif out and not part.strip():
            out[-1][1] += "\n" + part
        else:
            out.append([-1, part])
    if out[0][0] < 0:
        out[0][0] = named(role)
    rows = []
    for k, (marker, t) in enumerate(out):
        t = t.strip()
        n = len(t.split())
        size = 0 if not n else 1 if n < 12 else 2 if n < 40 else 3 if n < 120 else 4
        ending = 0 if t.endswith("?") else 1 if t.endswith((".", "!", ":")) else 2
        rows.append((marker, ((k == 0) * 5 + size) * 3 + ending, t))
    return rows


class Model:
    """Log-probabilities: start (S), go (2 x S x S, inside a row and to the next row), look (S x kinds)."""

    def __init__(self, counts: dict[tuple, int]):
        start, go, look = np.ones(_S), np.ones((2, _S, _S)), np.ones((_S, _KINDS)) * 0.1
        go[0] += np.eye(_S) * 20                       # lines of a row mostly stay with their speaker
        for (kind, a, b), n in counts.items():
            if kind == "start":
                start[a] += n
            elif kind == "look":
                look[a, b] += n
            else:
                go[0 if kind == "in" else 1, a, b] += n
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True)).tolist()
        self.start, self.go, self.look = norm(start), norm(go), norm(look)
        right, wrong = math.log(RIGHT), math.log((1 - RIGHT) / (_S - 1))
        self.mark = [[right if m == s else wrong for s in range(_S)] for m in range(_S)] + [[0.0] * _S]

    def emit(self, marker: int, look: int) -> list[float]:
        return [self.mark[marker][s] + self.look[s][look] for s in range(_S)]

    def step(self, before: list[float], marker: int, look: int, to: list[list[float]]):
        """Viterbi's next scores and where they come from (the lower state of equals)."""
        e, new, back = self.emit(marker, look), [], []
        for s in range(_S):
            best = max(range(_S), key=lambda r: before[r] + to[r][s])
            back.append(best)
            new.append(before[best] + to[best][s] + e[s])
        return new, back

    def decode(self, seq: list[tuple[int, int, bool]], entry: int | None, exit_: int | None) -> list[int]:
        """States of lines (marker, look, opens its row); `entry` is the state before (None: a
        conversation's start), `exit_` the last line's state (None: the best)."""
        score, backs = None, []
        for marker, look, opens in seq:
            if score is None and entry is None:
                score, back = [a + b for a, b in zip(self.start, self.emit(marker, look))], [0] * _S
            elif score is None:
                e, to = self.emit(marker, look), self.go[int(opens)][entry]
                score, back = [to[s] + e[s] for s in range(_S)], [entry] * _S
            else:
                score, back = self.step(score, marker, look, self.go[int(opens)])
            backs.append(back)
        state = max(range(_S), key=lambda s: score[s]) if exit_ is None else exit_
        out = [state]
        for back in reversed(backs[1:]):
            state = back[state]
            out.append(state)
        return out[::-1]

    def matrix(self, seq: list[tuple[int, int, bool]]) -> np.ndarray:
        """Best scores of the lines from an entry state (row _S: a conversation's start) to each exit state."""
        m = None
        for marker, look, opens in seq:
            e = np.array(self.emit(marker, look))
            if m is None:
                m = np.vstack([np.array(self.go[int(opens)]), self.start]) + e
            else:
                m = (m[:, :, None] + np.array(self.go[int(opens)])[None]).max(1) + e
        return m


def _row_states(markers: list[int]) -> list[int]:
    """Speakers of a row's lines as the markers name them; -1 before the first."""
    out, now = [], -1
    for m in markers:
        now = m if m >= 0 else now
        out.append(now)
    return out


def _sliced(batches):
    """Rows of an ordered partition with slice, place in it and the lines' markers and looks."""
    from pyspark import TaskContext
    part, seq = TaskContext.get().partitionId(), 0
    for pdf in batches:
        found = [lines(r, t) for r, t in zip(pdf["role"], pdf["text"])]
        yield pd.DataFrame({"slice": part, "seq": np.arange(seq, seq + len(pdf)), "conv_id": pdf["conv_id"].astype("Int64"),
                            "turn": pdf["turn"].astype("Int64"), "role": pdf["role"], "text": pdf["text"],
                            "marker": [[x[0] for x in f] for f in found], "look": [[x[1] for x in f] for f in found]})
        seq += len(pdf)


def _conversations(pdf: pd.DataFrame):
    """(conv_id, first row, last row + 1) of a sorted slice; null is a conversation too."""
    conv = [None if pd.isna(c) else int(c) for c in pdf["conv_id"]]
    a = 0
    for b in range(1, len(conv) + 1):
        if b == len(conv) or conv[b] != conv[a]:
            yield conv[a], a, b
            a = b


def _sequence(pdf: pd.DataFrame, a: int, b: int) -> list[tuple[int, int, bool]]:
    return [(m, k, i == 0) for ms, ks in zip(pdf["marker"].iloc[a:b], pdf["look"].iloc[a:b]) for i, (m, k) in enumerate(zip(ms, ks))]


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a slice (kind, a, b, n), and the first and last known speakers at its ends for the pairs
    that the cut parts (kind `first`/`last`: a the speaker or -1, b the conversation or null)."""
    pdf = pdf.sort_values("seq")
    n: dict[tuple, int] = {}

    def add(kind, a, b=0):
        n[kind, a, b] = n.get((kind, a, b), 0) + 1

    convs = list(_conversations(pdf))
    ends = []
    for k, (conv, a, b) in enumerate(convs):
        before = None
        for i, (ms, ks) in enumerate(zip(pdf["marker"].iloc[a:b], pdf["look"].iloc[a:b])):
            state = _row_states(list(ms))
            for s, look in zip(state, ks):
                if s >= 0:
                    add("look", s, int(look))
            for s, t in zip(state, state[1:]):
                if s >= 0 <= t:
                    add("in", s, t)
            if i == 0 and k > 0 and state[0] >= 0:
                add("start", state[0])
            if i and before >= 0 <= state[0]:
                add("next", before, state[0])
            if i == 0 and k == 0:
                ends.append(("first", state[0], conv))
            before = state[-1]
        if k == len(convs) - 1:
            ends.append(("last", before, conv))
    rows = [(int(pdf["slice"].iloc[0]), *key, None, c) for key, c in n.items()]
    rows += [(int(pdf["slice"].iloc[0]), kind, s, 0, conv, 1) for kind, s, conv in ends]
    out = pd.DataFrame(rows, columns=["slice", "kind", "a", "b", "conv", "n"])
    return out.astype({"conv": "Int64"})


_COUNT = "slice long, kind string, a long, b long, conv long, n long"


def _learn(sliced: DataFrame) -> Model:
    raw = sliced.select("slice", "seq", "conv_id", "marker", "look").groupBy("slice").applyInPandas(_count, _COUNT)
    raw = cut(raw, "counts")
    inner = raw.where("kind not in ('first', 'last')").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = {(r.kind, r.a, r.b): r.n for r in inner.collect()}             # at most a few hundred rows
    ends: dict[int, dict] = {}
    for r in raw.where("kind in ('first', 'last')").collect():              # two rows a slice
        ends.setdefault(r.slice, {})[r.kind] = (r.a, r.conv)
    before = None
    for k in sorted(ends):
        state, conv = ends[k]["first"]
        if state >= 0:
            if before is None or before[1] != conv:
                counts["start", state, 0] = counts.get(("start", state, 0), 0) + 1
            elif before[0] >= 0:
                counts["next", before[0], state] = counts.get(("next", before[0], state), 0) + 1
        before = ends[k]["last"]
    return Model(counts)


def _cuts(sliced: DataFrame, model: Model) -> dict[tuple[int, bool], tuple[int | None, int | None]]:
    """Entry and exit states of every slice's first and last conversation: (slice, is the last) -> states.
    Conversations that end inside a slice have no fixed exit, those that begin there no entry."""
    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        convs = list(_conversations(pdf))
        rows = []
        for k in sorted({0, len(convs) - 1}):
            conv, a, b = convs[k]
            rows.append((int(pdf["slice"].iloc[0]), k == len(convs) - 1, k == 0, conv,
                         model.matrix(_sequence(pdf, a, b)).ravel().tolist()))
        return pd.DataFrame(rows, columns=["slice", "last", "first", "conv", "m"]).astype({"conv": "Int64"})

    got = (sliced.select("slice", "seq", "conv_id", "marker", "look").groupBy("slice")
           .applyInPandas(part, "slice long, last boolean, first boolean, conv long, m array<double>"))
    rows = sorted(got.collect(), key=lambda r: (r.slice, r.last))            # two rows a slice, 12 numbers each
    chains: list[list] = []
    for r in rows:
        if chains and r.first and chains[-1][-1].last and chains[-1][-1].conv == r.conv and chains[-1][-1].slice < r.slice:
            chains[-1].append(r)
        else:
            chains.append([r])
    out = {}
    for chain in chains:
        if len(chain) == 1:
            continue
        score, backs = None, []
        for r in chain:
            m = np.array(r.m).reshape(_S + 1, _S)
            if score is None:
                score = m[_S]
                backs.append(None)
            else:
                every = score[:, None] + m[:_S]
                backs.append(every.argmax(0))
                score = every.max(0)
        state = int(score.argmax())
        for r, back in zip(reversed(chain), reversed(backs)):
            entry = None if back is None else int(back[state])
            out[r.slice, r.last] = (entry, state)
            if r.first:
                out[r.slice, "first"] = (entry, state)
            state = entry
    return out


def canonical(conversations: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(conv_id, turn, part, role, text, rendered), one row per turn part of one speaker.

    Input is (conv_id, turn, role, text); other columns are ignored. Rows are ordered by conversation
    and turn, then by role and text; nulls come first. A null or unknown role gives no marker, a null
    text counts as empty (one part with an empty text). `part` numbers a row's parts from 0: a row is
    split where the recovered speaker changes. Rows with a null conv_id are one conversation. Equal
    rows all stay. An empty table gives an empty table.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    schema = "conv_id long, turn long, part int, role string, text string, rendered string"
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    keys = ["conv_id", "turn", F.xxhash64("role", "text"), "place"]
    sliced = (rows.withColumn("place", F.monotonically_increasing_id())      # deals equal rows to several slices too
              .repartitionByRange(-(-n // slice_rows), *keys).sortWithinPartitions(*keys).drop("place")
              .mapInPandas(_sliced, "slice long, seq long, conv_id long, turn long, role string, text string, "
                                    "marker array<int>, look array<int>"))
    sliced = cut(sliced, "slices")
    model = _learn(sliced)
    cuts = spark.sparkContext.broadcast((model, _cuts(sliced, model)))

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        model, fixed = cuts.value
        pdf = pdf.sort_values("seq")
        me = int(pdf["slice"].iloc[0])
        convs = list(_conversations(pdf))
        out = []
        for k, (conv, a, b) in enumerate(convs):
            entry, exit_ = (fixed.get((me, "first")) or (None, None)) if k == 0 else (None, None)
            if k == len(convs) - 1:
                entry, exit_ = fixed.get((me, True)) or (entry, exit_)
            states = iter(model.decode(_sequence(pdf, a, b), entry, exit_))
            for turn, role, text in zip(pdf["turn"].iloc[a:b], pdf["role"].iloc[a:b], pdf["text"].iloc[a:b]):
                parts: list[list] = []
                for _, _, line in lines(role, text):
                    s = next(states)
                    if parts and parts[-1][0] == s:
                        parts[-1][1].append(line)
                    else:
                        parts.append([s, [line]])
                for i, (s, ls) in enumerate(parts):
                    t = "\n".join(ls)
                    out.append((conv, turn, i, ROLES[s], t, f"<|{ROLES[s]}|>\n{t}\n<|end|>"))
        return pd.DataFrame(out, columns=["conv_id", "turn", "part", "role", "text", "rendered"]).astype(
            {"conv_id": "Int64", "turn": "Int64"})

    return sliced.select("slice", "seq", "conv_id", "turn", "role", "text", "marker", "look").groupBy("slice").applyInPandas(decode, schema)
