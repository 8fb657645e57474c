"""Filter, classify and score events."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchload.functions import scalar as S

# ---- fixed values (must equal the reference's) ----
# initial speed (km/h) and maximal voluntary acceleration (m/s^2) from the paper
PAPER_V_INIT_KMH = [0.0, 6.2, 11.4, 16.7]
PAPER_MAX_ACC = [6.01, 4.33, 3.20, 2.29]
# ---------------------------------------------------


# constant folding: the fit over four fixed points is computed once, not per row
FIT_SLOPE, FIT_INTERCEPT = statistics.linear_regression(PAPER_V_INIT_KMH, PAPER_MAX_ACC)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One-row least-squares fit of ``y`` on ``x`` over a whole table (mergeable centred sums)."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_count(y, x).alias("n_points"))


def filter_min_action(events: DataFrame) -> DataFrame:
    """Keep events with max_speed > 1.2 m/s and a speed gain > 0.9 m/s."""
    return events.where((F.col("max_speed") > F.lit(S.MIN_MAX_SPEED_ACTION))
                        & (F.col("max_speed") - F.col("v_init") > F.lit(S.MIN_SPEED_INCREASE_ACTION)))


CELLS = 4_096     # cells that a span of values is cut into
LEVELS = 2


def _interp(lo, hi):
    # numpy/pandas linear interpolation at q = 0.5: hi - (hi - lo) * 0.5
    return hi - (hi - lo) * F.lit(0.5)


def exact_medians(df: DataFrame, cols: list[str], outs: list[str]) -> DataFrame:
    """Exact medians of several columns as one row (pandas ``describe()['50%']``).

    Spark's ``median`` merges every distinct value in one task. Here the value of a rank is found by
    refinement: the span between the smallest and the largest value is cut into ``CELLS`` cells of equal
    width, one pass counts the values of each cell (a partial aggregate; with the cell's own smallest and
    largest value), and the cell that holds the rank is the next span. ``LEVELS`` passes narrow a span by
    ``CELLS ** LEVELS``; the last pass counts what is left by value. The windows that add up counts see
    ``CELLS`` rows a column, and the spans are a few rows that are broadcast. All of it is one plan: nothing
    is computed while planning, and counts, minima and maxima are the same however often a plan is run.
    NULLs and NaN are left out, as pandas does; a column without values has a NULL median.
    """
    each = [F.when(~F.isnan(F.col(c).cast("double")), F.struct(F.lit(i).alias("_k"), F.col(c).cast("double").alias("_v"))) for i, c in enumerate(cols)]
    values = df.select(F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("_x")).select("_x._k", "_x._v").where("_v IS NOT NULL")
    span = values.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    # the two middle ranks of each column
    span = span.select("_k", "_lo", "_hi", F.explode(F.array(F.lit(0), F.lit(1))).alias("_t"), "_n") \
        .select("_k", "_t", "_lo", "_hi", F.expr("(_n + 1 + _t) div 2").alias("_rank"))
    group = ["_k", "_t", "_rank"]

    def pick(counts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("_c").over(Window.partitionBy("_k", "_t").orderBy(order))
        return counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))

    def inside(span: DataFrame) -> DataFrame:
        s = F.broadcast(span.withColumnRenamed("_k", "_sk"))                 # two rows a column
        return values.join(s, (F.col("_k") == F.col("_sk")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_sk")

    half = lambda c: F.col(c) / F.lit(2.0)  # noqa: E731  (differences of halves stay finite)
    share = F.when(F.col("_hi") > F.col("_lo"), (half("_v") - half("_lo")) / (half("_hi") - half("_lo"))).otherwise(F.lit(0.0))
    for _ in range(LEVELS):
        cells = inside(span).withColumn("_cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        counts = cells.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        span = pick(counts, "_cell").select("_k", "_t", "_lo", "_hi", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
    found = pick(inside(span).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")), "_v")
    at = lambda i, t: F.max(F.when((F.col("_k") == i) & (F.col("_t") == t), F.col("_v")))
    return found.agg(*[_interp(at(i, 0), at(i, 1)).alias(o) for i, o in enumerate(outs)])


def exact_median(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return exact_medians(df, [col], [out or f"median_{col}"])


def class_thresholds(history: DataFrame) -> DataFrame:
    """Medians of historical max_acc and max_speed (one row)."""
    return exact_medians(history, ["max_acc", "max_speed"], ["acc_median", "speed_median"])


def classify(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add ``event_class``; ``thresholds`` is the one-row frame of ``class_thresholds``."""
    j = events.crossJoin(F.broadcast(thresholds))
    return j.withColumn("event_class", S.event_class("max_acc", "max_speed", "v_init", "duration",
                                                     "acc_median", "speed_median")) \
            .drop("acc_median", "speed_median")


def score(events: DataFrame, slope: float = FIT_SLOPE, intercept: float = FIT_INTERCEPT) -> DataFrame:
    """Add ``percAcc`` = max_acc / (slope * v_init[km/h] + intercept) * 100."""
    return events.withColumn("percAcc", S.perc_acc("max_acc", "v_init", slope, intercept))
