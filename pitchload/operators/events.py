"""Acceleration events: extract (open / extend / close automaton) and merge.

Extraction semantics, per key in time order over the enriched rows:

* IDLE: a row with ``start_event = 1`` opens an event (ts_start, v_init = its
  speed, maxima 0). A row is *good* when ``acc_event >= 0 or speed >= 4`` and it
  follows the previous row by less than 1 s.
* OPEN: the first good row moves to HAS_END; rows that are not good are skipped.
* HAS_END: good rows update the maxima and ts_end; the first row that is not
  good emits the event and returns to IDLE (it cannot open the next event).

So an event closes at the end of the first good run that has a row after its
opening row. Without a Python loop this becomes a gaps-and-islands problem:
rows are grouped by the next run end ``nx`` (the rows ``[previous end p, nx)``);
in a group the candidate opening rows are ``A`` (first start row after p+1) and
``B`` (start row at p or p+1, usable only when the previous run emitted
nothing, because then p's run closes nothing). Run k has an event iff A exists,
or B exists and run k-1 had none; runs with only B alternate and are resolved
by parity from the last run whose answer is fixed. All whole-key steps are
two-level scans (``sequence.scan``); the rest are aggregates and equi-joins on
unique (key, position) pairs, so a hot key is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.operators.sequence import (HALO, SEG, SEGMENT_ROWS, Scan, join_null_safe, number_rows, scan,
                                          seg_window, segment)

MERGE_GAP_MS = 500   # fixed value: events closer than 0.5 s are merged

EVENT_COLS = ["team", "jersey_number", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed"]


def extract_events(enriched: DataFrame, keys: list[str], ts: str = "ts_ms",
                   seg_rows: int = SEGMENT_ROWS, materialize=None) -> DataFrame:
    """Events from enriched rows carrying the flags of ``kinematics.enrich``.

    Output: keys, team, jersey_number, ts_start, ts_end (ms), duration (s),
    v_init, max_acc, max_speed. Events still open at the end are not emitted.
    ``materialize`` (e.g. ``session.cut``) is applied to the scanned row table and
    to the run table, each read more than once below.
    """
    mat = materialize or (lambda x: x)
    d = enriched.select(*keys, "rn", F.col(ts).alias("_ts"), "speed", "acc_actual", "start_event", "good",
                        "end_rn", "nx_mark", "nx_ts_mark", "team", "jersey_number")
    d = scan(d, keys, [Scan("pv", "end_rn", "ffill"),
                       Scan("re", "end_rn", "bfill"),
                       Scan("nx", "nx_mark", "bfill"),
                       Scan("nx_ts", "nx_ts_mark", "bfill"),
                       Scan("cum_ends", F.col("end_rn").isNotNull().cast("long"), "cumsum")],
             size=seg_rows)
    d = mat(d)

    pv, rn = F.col("pv"), F.col("rn")
    is_start = F.col("start_event") == 1
    cand = F.struct(rn.alias("rn"), F.col("_ts").alias("ts"), F.col("speed").alias("speed"))
    a_ord = F.when(is_start & (pv.isNull() | (rn > pv + 1)), rn)
    b_ord = F.when(is_start & pv.isNotNull() & ((rn == pv) | (rn == pv + 1)), rn)
    runs = (d.where(F.col("nx").isNotNull())
            .groupBy(*keys, "nx")
            .agg((F.coalesce(F.max("cum_ends"), F.lit(0)) + 1).alias("k"),
                 F.min_by(cand, a_ord).alias("A"), F.min(a_ord).alias("a_rn"),
                 F.min_by(cand, b_ord).alias("B"), F.min(b_ord).alias("b_rn"),
                 F.max("nx_ts").alias("ts_end"),
                 F.max("team").alias("team"), F.max("jersey_number").alias("jersey_number")))

    # fixed answer of a run: 1 (has an event) / 0 (none); NULL = depends on run k-1
    det = F.when(F.col("a_rn").isNotNull(), 2 * F.col("k") + 1) \
           .when(F.col("b_rn").isNull(), 2 * F.col("k"))
    runs = scan(runs.withColumn("_det", det), keys,
                [Scan("_di", "_det", "ffill"), Scan("_de", "_det", "ffill_excl")], rn="k", size=seg_rows)
    runs = mat(runs)
    k = F.col("k")
    di, de = F.coalesce(F.col("_di"), F.lit(0)), F.coalesce(F.col("_de"), F.lit(0))
    has = ((di % 2) + k - F.floor(di / 2)) % 2 == 1
    prev = ((de % 2) + (k - 1) - F.floor(de / 2)) % 2 == 1
    ev = (runs.where(has)
          .withColumn("o", F.when(F.col("b_rn").isNotNull() & ~prev, F.col("B")).otherwise(F.col("A")))
          .select(*keys, "nx", F.col("o.rn").alias("o_rn"), F.col("o.ts").alias("ts_start"),
                  F.col("o.speed").alias("v_init"), "ts_end", "team", "jersey_number"))

    # maxima over the good rows after the opening row up to the run end
    g = d.where(F.col("good") & F.col("re").isNotNull()).select(*keys, F.col("re").alias("nx"),
                                                                  "rn", "acc_actual", "speed")
    mx = (join_null_safe(g, ev.select(*keys, "nx", "o_rn"), [*keys, "nx"])
          .where(F.col("rn") > F.col("o_rn"))
          .groupBy(*keys, "nx")
          .agg(F.max("acc_actual").alias("_ma"), F.max("speed").alias("_ms")))
    out = join_null_safe(ev, mx, [*keys, "nx"], "left")
    return out.select(
        *keys, "team", "jersey_number", "ts_start", "ts_end",
        ((F.col("ts_end") - F.col("ts_start")) / F.lit(1000.0)).alias("duration"),
        "v_init",
        F.greatest(F.lit(0.0), F.coalesce(F.col("_ma"), F.lit(0.0))).alias("max_acc"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("_ms"), F.lit(0.0))).alias("max_speed"))


def merge_events(events: DataFrame, keys: list[str], gap_ms: int = MERGE_GAP_MS,
                 flush_open: bool = False, seg_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Merge consecutive events of a key that start less than ``gap_ms`` after the
    previous one ended. Events with duration <= 0 are ignored. A group keeps the first
    start and v_init, the last end and the maxima; its duration is recomputed.
    As in the live merger a group is only emitted once the next group starts, so each
    key's last group is dropped unless ``flush_open``.
    """
    e = events.where(F.col("duration") > 0)
    e = number_rows(e, keys, ["ts_start"], F.floor(F.col("ts_start") / 3_600_000), out="_er")
    s = segment(e, rn="_er", size=seg_rows, before=1)
    w = seg_window(keys, rn="_er")
    prev_end = F.lag("ts_end", 1).over(w)
    s = s.withColumn("_brk", F.when(prev_end.isNull() | (F.col("ts_start") - prev_end >= gap_ms), 1).otherwise(0))
    s = s.where(~F.col(HALO)).drop(HALO, SEG)
    s = scan(s, keys, [Scan("_grp", "_brk", "cumsum")], rn="_er", size=seg_rows)
    grp = (s.groupBy(*keys, "_grp")
           .agg(F.min("ts_start").alias("ts_start"), F.min_by("v_init", "ts_start").alias("v_init"),
                F.max("ts_end").alias("ts_end"), F.max("max_acc").alias("max_acc"),
                F.max("max_speed").alias("max_speed"),
                F.max_by("team", "ts_start").alias("team"),
                F.max_by("jersey_number", "ts_start").alias("jersey_number")))
    if not flush_open:
        last = grp.groupBy(*keys).agg(F.max("_grp").alias("_last"))
        grp = join_null_safe(grp, last, keys).where(F.col("_grp") < F.col("_last")).drop("_last")
    return grp.select(*keys, "team", "jersey_number", "ts_start", "ts_end",
                      ((F.col("ts_end") - F.col("ts_start")) / F.lit(1000.0)).alias("duration"),
                      "v_init", "max_acc", "max_speed")
