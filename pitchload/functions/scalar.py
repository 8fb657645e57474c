"""Scalar column functions (all built-in expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's) ---------------------------------
# speed zones in km/h, closed at both ends; anything else has no zone
SPEED_ZONES_KMH = [(1, 0.0, 11.0), (2, 11.001, 14.0), (3, 14.001, 19.0), (4, 19.001, 23.0),
                   (5, 23.001, 100.0)]
MS_TO_KMH = 3.6
CM_PER_M = 100.0
HIGH_VINIT = 4.0          # m/s, class rule
LONG_RUN = 4.0            # s, class rule
MIN_SPEED_GOOD = 4.0      # m/s, event continues at or above this speed
MIN_MAX_SPEED_ACTION = 1.2     # m/s
MIN_SPEED_INCREASE_ACTION = 0.9  # m/s
MIN_PERCACC_ROUTE = 10.0
ALERT_RED = 180.0
ALERT_ORANGE = 150.0
TEAM_LABELS = {0: "CH", 1: "PT"}
KICKOFF_VIDEO = "2019-06-05T20:45:00.000+0100"
VIDEO_OFFSET_S = 0.04
PITCH_SHIFT_X = 52.5
PITCH_SHIFT_Y = 34.0
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
CLASS_LABELS = ["Long increasing run", "Short increasing run", "High intensity run",
                "Low intensity run", "Feint", "High intensity sprint", "Low intensity sprint"]
# --------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cm_to_m(c) -> Column:
    return _c(c) / F.lit(CM_PER_M)


def mps_to_kmh(c) -> Column:
    return _c(c) * F.lit(MS_TO_KMH)


def speed_zone_kmh(kmh) -> Column:
    """Zone 1..5 of a km/h speed, NULL outside every closed band."""
    k = _c(kmh)
    e = None
    for zone, lo, hi in SPEED_ZONES_KMH:
        cond = (k >= F.lit(lo)) & (k <= F.lit(hi))
        e = F.when(cond, F.lit(zone)) if e is None else e.when(cond, F.lit(zone))
    return e.cast("int")


def speed_zone(speed_mps) -> Column:
    return speed_zone_kmh(mps_to_kmh(speed_mps))


def event_class(max_acc, max_speed, v_init, duration, acc_median, speed_median) -> Column:
    """Seven-way class; values equal to a median count as low."""
    a, s, v, d = _c(max_acc), _c(max_speed), _c(v_init), _c(duration)
    am, sm = _c(acc_median), _c(speed_median)
    lo_a, lo_s = a <= am, s <= sm
    return (F.when(lo_a & lo_s, F.when(d > LONG_RUN, F.lit(CLASS_LABELS[0])).otherwise(F.lit(CLASS_LABELS[1])))
            .when(lo_a & ~lo_s, F.when(v > HIGH_VINIT, F.lit(CLASS_LABELS[2])).otherwise(F.lit(CLASS_LABELS[3])))
            .when(~lo_a & lo_s, F.lit(CLASS_LABELS[4]))
            .when(~lo_a & ~lo_s, F.when(v > HIGH_VINIT, F.lit(CLASS_LABELS[5])).otherwise(F.lit(CLASS_LABELS[6])))
            .otherwise(F.lit("")))


def max_voluntary_acc(v_init_kmh, slope: float, intercept: float) -> Column:
    return F.lit(slope) * _c(v_init_kmh) + F.lit(intercept)


def perc_acc(max_acc, v_init_mps, slope: float, intercept: float) -> Column:
    """max_acc as % of the voluntary maximum at the start speed; NULL on a zero denominator."""
    vol = max_voluntary_acc(mps_to_kmh(v_init_mps), slope, intercept)
    return F.when(vol != 0, _c(max_acc) / vol * F.lit(100.0))


def parse_iso_ms(text) -> Column:
    """ISO text with offset -> epoch milliseconds (NULL when unparsable)."""
    return F.unix_millis(F.try_to_timestamp(_c(text), F.lit(ISO_FORMAT)))


def parse_iso(text) -> Column:
    return F.try_to_timestamp(_c(text), F.lit(ISO_FORMAT))


def time_diff_s(earlier_ms, later_ms) -> Column:
    """Seconds between two millisecond instants, as double."""
    return (_c(later_ms) - _c(earlier_ms)) / F.lit(1000.0)


def format_iso_ms(ms, offset: str = "+0100") -> Column:
    """Millisecond instant -> ``yyyy-MM-ddTHH:mm:ss.SSS`` wall time at ``offset`` + suffix.

    Pure integer arithmetic, so the text does not depend on the session time zone.
    """
    sign = 1 if offset[0] == "+" else -1
    shift_ms = sign * (int(offset[1:3]) * 3600 + int(offset[3:5]) * 60) * 1000
    local = _c(ms) + F.lit(shift_ms)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(local / 86_400_000).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), time_of_day(local), F.lit(offset))


def time_of_day(ms, offset_ms: int = 0) -> Column:
    """``HH:mm:ss.SSS`` of a millisecond instant (milliseconds since midnight -> text)."""
    t = (_c(ms) + F.lit(offset_ms)) % F.lit(86_400_000)
    h = F.floor(t / 3_600_000)
    m = F.floor((t % 3_600_000) / 60_000)
    s = F.floor((t % 60_000) / 1000)
    milli = t % 1000
    return F.format_string("%02d:%02d:%02d.%03d", h, m, s, milli)


def frame_ts_ms(frame, first_frame, fps, start_ms) -> Column:
    """Clock of a frame: start + (frame - first) / fps, counted in whole microseconds and cut to milliseconds."""
    first = _c(first_frame) if not isinstance(first_frame, (int, float)) else F.lit(first_frame)
    rate = _c(fps) if not isinstance(fps, (int, float)) else F.lit(fps)
    micros = F.round((_c(frame) - first) * F.lit(1e6) / rate)
    return _c(start_ms) + F.floor(micros / F.lit(1000.0)).cast("long")


def shift_pitch_x(x) -> Column:
    return _c(x) + F.lit(PITCH_SHIFT_X)


def shift_pitch_y(y) -> Column:
    return _c(y) + F.lit(PITCH_SHIFT_Y)


def team_label(team) -> Column:
    t = _c(team)
    e = None
    for k, v in TEAM_LABELS.items():
        e = F.when(t == k, F.lit(v)) if e is None else e.when(t == k, F.lit(v))
    return e.otherwise(t.cast("string"))


def team_player_label(team, jersey) -> Column:
    return F.concat_ws("-", team_label(team), _c(jersey).cast("string"))


def round_half_even(c, digits: int) -> Column:
    """numpy/pandas rounding: scale, round half to even on the double, scale back
    (3.405 -> 3.4, because 3.405 * 100 is exactly 340.5 in binary)."""
    f = float(10 ** digits)
    return F.rint(_c(c) * F.lit(f)) / F.lit(f)


def alert_band(perc) -> Column:
    """Display band: > 180 red; strictly between 150 and 180 orange; else none (NULL)."""
    p = _c(perc)
    return F.when(p > ALERT_RED, F.lit("red")).when((p > ALERT_ORANGE) & (p < ALERT_RED), F.lit("orange"))


def acc_sign(acc) -> Column:
    return F.when(_c(acc) >= 0, F.lit("green")).otherwise(F.lit("red"))


def video_offset_s(ts_ms, kickoff_ms) -> Column:
    """Seconds from kick-off of the video to the event start, plus one frame."""
    return time_diff_s(kickoff_ms, ts_ms) + F.lit(VIDEO_OFFSET_S)


def record_json(*cols) -> Column:
    return F.to_json(F.struct(*cols))


def teamjersey(jersey, team) -> Column:
    """Jersey and team digits concatenated as text, read back as int."""
    return F.concat(_c(jersey).cast("string"), _c(team).cast("string")).cast("int")


def safe_cast(c, to: str) -> Column:
    return _c(c).try_cast(to)
