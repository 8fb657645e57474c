"""Ordered per-key building blocks that stay parallel inside a hot key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one
task. One key may hold a third of all rows, so the ordered operators here never
partition by the key alone:

* ``number_rows`` gives each row its 1-based position ``rn`` inside its key.
  Rows are counted per (key, time bucket) -- a partial aggregate -- the bucket
  counts are prefix-summed per key (a table ~1000x smaller than the rows), and
  the offset is joined back on (key, bucket). A (key, bucket) group is bounded
  because a key holds at most one row per timestamp.
* ``segment`` cuts a key into fixed-size row segments ``(rn-1) div size`` and
  copies the last ``before`` / first ``after`` rows of each neighbour in as
  halo rows, so ``lag``/``lead`` up to that distance are exact inside the
  (key, segment) window.
* ``scan`` computes forward fills, backward fills and running sums over a
  whole key in two levels: inside the segment with a window, across segments
  with a window over one summary row per segment, joined back on
  (key, segment).

All windows partition by ``keys + [segment]``; every group is bounded by the
segment size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per ordered segment: ~33 minutes of 25 Hz tracking for one key.
SEGMENT_ROWS = 50_000
# Time bucket used while numbering rows (milliseconds).
BUCKET_MS = 60_000

SEG = "_seg"
HALO = "_halo"


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` in which NULL equals NULL, so no row is lost for a NULL key."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def number_rows(df: DataFrame, keys: list[str], order: list[str | Column], bucket: Column,
                out: str = "rn") -> DataFrame:
    """Add ``out`` = 1-based row number of each row inside its key by ``order``.

    ``bucket`` must be non-decreasing along ``order`` (e.g. ``floor(ts_ms/60000)``). Rows
    with a NULL key form a key of their own; a NULL time comes first.
    """
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_bkt", F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_boff"))
    j = join_null_safe(b, offs, [*keys, "_bkt"])
    wr = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return j.withColumn(out, (F.col("_boff") + F.row_number().over(wr)).cast("long")).drop("_bkt", "_boff")


def segment(df: DataFrame, rn: str = "rn", size: int = SEGMENT_ROWS, before: int = 0,
            after: int = 0) -> DataFrame:
    """Add ``_seg`` and ``_halo``; duplicate neighbour rows as halo rows.

    One pass: each row explodes into its own segment plus, near a boundary, a halo
    copy for the neighbouring segment (no union re-reading the input).
    """
    if before > size or after > size:
        raise ValueError("halo larger than a segment")
    pos = (F.col(rn) - 1) % size
    seg = F.floor((F.col(rn) - 1) / size)
    targets = [F.struct(seg.alias("s"), F.lit(False).alias("h"))]
    if before:
        targets.append(F.when(pos >= size - before, F.struct((seg + 1).alias("s"), F.lit(True).alias("h"))))
    if after:
        targets.append(F.when((pos < after) & (seg > 0), F.struct((seg - 1).alias("s"), F.lit(True).alias("h"))))
    t = F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull())) if len(targets) > 1 else targets[0]
    cols = [c for c in df.columns if c not in (SEG, HALO)]
    return df.select(*cols, t.alias("_t")).select(*cols, F.col("_t.s").alias(SEG), F.col("_t.h").alias(HALO))


def seg_window(keys: list[str], rn: str = "rn") -> Window:
    return Window.partitionBy(*keys, SEG).orderBy(rn)


@dataclass(frozen=True)
class Scan:
    """One scan output.

    kind: ``ffill`` last non-null at or before; ``ffill_excl`` strictly before;
    ``bfill`` first non-null at or after; ``bfill_excl`` strictly after;
    ``cumsum`` running sum including the row; ``cummax`` running max.
    """
    out: str
    col: str | Column
    kind: str


def scan(df: DataFrame, keys: list[str], specs: list[Scan], rn: str = "rn",
         size: int = SEGMENT_ROWS) -> DataFrame:
    """Whole-key scans in two levels (see module doc). ``rn`` must be 1..n per key."""
    seg = F.floor((F.col(rn) - 1) / size)
    d = df.withColumn(SEG, seg)
    vals = {}
    for i, s in enumerate(specs):
        c = F.col(s.col) if isinstance(s.col, str) else s.col
        vals[s.out] = f"_v{i}"
        d = d.withColumn(f"_v{i}", c)

    asc = Window.partitionBy(*keys, SEG).orderBy(F.col(rn).asc())
    desc = Window.partitionBy(*keys, SEG).orderBy(F.col(rn).desc())
    upto = Window.unboundedPreceding
    local = []
    for s in specs:
        v = F.col(vals[s.out])
        if s.kind == "ffill":
            e = F.last(v, True).over(asc.rowsBetween(upto, 0))
        elif s.kind == "ffill_excl":
            e = F.last(v, True).over(asc.rowsBetween(upto, -1))
        elif s.kind == "bfill":
            e = F.last(v, True).over(desc.rowsBetween(upto, 0))
        elif s.kind == "bfill_excl":
            e = F.last(v, True).over(desc.rowsBetween(upto, -1))
        elif s.kind == "cumsum":
            e = F.sum(v).over(asc.rowsBetween(upto, 0))
        elif s.kind == "cummax":
            e = F.max(v).over(asc.rowsBetween(upto, 0))
        else:
            raise ValueError(s.kind)
        local.append(e.alias(f"_l_{s.out}"))
    d = d.select("*", *local)

    # one summary row per (key, segment)
    summ = []
    for s in specs:
        v = F.col(vals[s.out])
        keep = F.when(v.isNotNull(), F.col(rn))
        if s.kind in ("ffill", "ffill_excl"):
            summ.append(F.max_by(v, keep).alias(f"_s_{s.out}"))
        elif s.kind in ("bfill", "bfill_excl"):
            summ.append(F.min_by(v, keep).alias(f"_s_{s.out}"))
        elif s.kind == "cumsum":
            summ.append(F.sum(v).alias(f"_s_{s.out}"))
        else:
            summ.append(F.max(v).alias(f"_s_{s.out}"))
    sm = d.groupBy(*keys, SEG).agg(*summ)
    ws = Window.partitionBy(*keys).orderBy(F.col(SEG).asc())
    wsd = Window.partitionBy(*keys).orderBy(F.col(SEG).desc())
    carry = []
    for s in specs:
        c = F.col(f"_s_{s.out}")
        if s.kind in ("ffill", "ffill_excl"):
            e = F.last(c, True).over(ws.rowsBetween(upto, -1))
        elif s.kind in ("bfill", "bfill_excl"):
            e = F.last(c, True).over(wsd.rowsBetween(upto, -1))
        elif s.kind == "cumsum":
            e = F.sum(c).over(ws.rowsBetween(upto, -1))
        else:
            e = F.max(c).over(ws.rowsBetween(upto, -1))
        carry.append(e.alias(f"_c_{s.out}"))
    sm = sm.select(*keys, SEG, *carry)
    j = join_null_safe(d, sm, [*keys, SEG])
    outs = []
    for s in specs:
        lc, cc = F.col(f"_l_{s.out}"), F.col(f"_c_{s.out}")
        if s.kind == "cumsum":
            e = F.when(cc.isNull(), lc).otherwise(lc + cc)
        elif s.kind == "cummax":
            e = F.greatest(lc, cc)
        else:
            e = F.coalesce(lc, cc)
        outs.append(e.alias(s.out))
    drop = [SEG] + list(vals.values()) + [f"_l_{s.out}" for s in specs] + [f"_c_{s.out}" for s in specs]
    return j.select("*", *outs).drop(*drop)


RANK_CELLS = 4_096


def dense_rank_global(df: DataFrame, col: str, out: str) -> DataFrame:
    """Dense rank (1..k) of the distinct values of the numeric ``col`` over the whole table.

    A global ``dense_rank()`` window runs in one task; here the span of the values is cut into
    ``RANK_CELLS`` cells of equal width, the distinct values are ranked inside each cell and shifted by
    the counts of the cells before it (one row per cell, broadcast). The span is an aggregate of the same
    plan (one row), so nothing is computed while planning and a value's cell follows from the value and
    the table's extremes alone, however often a plan is computed.
    """
    v = df.select(col).where(F.col(col).isNotNull()).distinct()
    span = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(col).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    v = v.crossJoin(F.broadcast(span)).withColumn("_p", F.floor(share * (RANK_CELLS - 1))).select(col, "_p")
    cnt = v.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offs = cnt.select("_p", F.coalesce(F.sum("_c").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    v = v.withColumn("_lr", F.row_number().over(Window.partitionBy("_p").orderBy(col)))
    return v.join(F.broadcast(offs), "_p").select(col, (F.col("_off") + F.col("_lr")).cast("int").alias(out))
