"""Declared record schemas of the tracking pipeline.

Timestamps travel as ISO text with offset in the wire records; inside Spark
the order column is ``ts_ms`` (milliseconds, bigint), parsed once at ingest.
"""

from pyspark.sql import types as T

_I, _L, _D, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])

# raw positional rows (x, y in cm, speed in m/s)
INGESTION = _st(("timestamp", _S), ("team", _I), ("jersey_number", _I), ("x", _D), ("y", _D),
                ("speed", _D), ("half", _I), ("teamjersey", _I), ("player_id", _I))

# after the acceleration step (x, y in m)
TRACKING = _st(("timestamp", _S), ("team", _I), ("jersey_number", _I), ("x", _D), ("y", _D),
               ("speed", _D), ("player_id", _I), ("acc_actual", _D), ("acc_event", _D))

TRACKING_START = _st(*[(f.name, f.dataType) for f in TRACKING.fields],
                     ("speedzone", _I), ("dist", _D), ("start_event", _I))

EVENT = _st(("player_id", _I), ("team", _I), ("jersey_number", _I), ("ts_start", _S),
            ("ts_end", _S), ("duration", _D), ("v_init", _D), ("max_acc", _D), ("max_speed", _D))

CLASS_EVENT = _st(*[(f.name, f.dataType) for f in EVENT.fields], ("event_class", _S))

PERC_EVENT = _st(*[(f.name, f.dataType) for f in CLASS_EVENT.fields], ("percAcc", _D))

ZONE_SNAPSHOT = _st(("team", _I), ("player", _I), ("dist", T.MapType(_S, _D)))

# the declared SQL stream over the enriched topic (bigint ids)
ENRICHED_STREAM = _st(("timestamp", _S), ("team", _L), ("jersey_number", _L), ("x", _D), ("y", _D),
                      ("speed", _D), ("speedZone", _L), ("dist", _D), ("player_id", _L),
                      ("acc_actual", _D), ("acc_event", _D), ("start_event", _L))

HISTORY = _st(("max_acc", _D), ("max_speed", _D))

PERIOD_META = T.StructType([
    T.StructField("_iStartFrame", _L, True),
    T.StructField("_iEndFrame", _L, True),
])

MATCH_META = T.StructType([
    T.StructField("_iId", _L, True),
    T.StructField("_dtDate", _S, True),
    T.StructField("_iFrameRateFps", _I, True),
    T.StructField("period", T.ArrayType(PERIOD_META), True),
])
