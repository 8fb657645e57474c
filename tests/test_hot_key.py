"""One key holding all rows: results must not depend on how the key is split."""

from pyspark.sql import functions as F

from pitchload.operators import events as E
from pitchload.operators import kinematics as K
from pitchload.operators.sequence import SEG
from pitchload.plans.batch import Chain
from pitchload.session import cut
from pitchload.sources import tables
from tests.conftest import SF01


def _one_key(spark):
    raw = tables.tracking(spark, SF01)
    span = raw.agg(F.max("ts_ms")).first()[0] + 10_000
    # players one after another on a single key; rn is recomputed by the operators
    return raw.select(F.lit(1).alias("player_id"), "team", "jersey_number",
                      (F.col("ts_ms") + F.col("player_id") * span).alias("ts_ms"), "x", "y", "speed")


def test_single_hot_key_is_split_and_exact(spark):
    raw = _one_key(spark)
    cols = ["player_id", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed"]

    def run(seg):
        en = cut(K.enrich(raw, ["player_id"], seg_rows=seg))
        ex = cut(E.extract_events(en, ["player_id"], seg_rows=seg, materialize=cut))
        mg = E.merge_events(ex, ["player_id"], seg_rows=max(seg // 50, 2))
        return en, sorted(tuple(r) for r in ex.select(*cols).collect()), \
            sorted(tuple(r) for r in mg.select(*cols).collect())

    en_small, ex_small, mg_small = run(500)
    _, ex_big, mg_big = run(1_000_000)
    assert ex_small == ex_big and mg_small == mg_big and len(ex_big) > 100
    # the single key is processed as many (key, segment) groups
    from pitchload.operators.sequence import segment
    n_groups = segment(en_small.select("player_id", "rn"), size=500).select("player_id", SEG).distinct().count()
    assert n_groups >= 19


def test_match_and_player_keys(spark):
    """Two matches in one table, keyed by (match_id, player_id): each match reproduces
    the single-match events exactly."""
    from pitchload.plans.batch import Chain
    raw = tables.tracking(spark, SF01).drop("rn")
    two = raw.withColumn("match_id", F.lit(1)).unionByName(raw.withColumn("match_id", F.lit(2)))
    c2 = Chain(spark, SF01, keys=["match_id", "player_id"], source=two)
    c1 = Chain(spark, SF01)
    cols = ["player_id", "ts_start", "ts_end", "duration", "v_init", "max_acc", "max_speed"]
    one = sorted(tuple(r) for r in c1.merged().select(*cols).collect())
    for m in (1, 2):
        got = sorted(tuple(r) for r in c2.merged().where(F.col("match_id") == m).select(*cols).collect())
        assert got == one and len(got) == 151


def test_a_null_player_keeps_its_events(spark):
    """Rows without player_id are a key of their own through the whole chain: they get what player 3 gets."""
    from pitchload.operators import routes as RT
    from pitchload.operators import zones as ZN
    base = Chain(spark, SF01)
    player = F.when(F.col("player_id") != 3, F.col("player_id"))
    lost = Chain(spark, SF01, source=cut(base.raw().withColumn("player_id", player), "null-player"))

    def rows(chain, make, key):
        df = make(chain)
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                      for r in df.where(F.col("player_id").eqNullSafe(key)).drop("player_id").collect())
    makes = [lambda c: c.extracted().select("player_id", "ts_start", "ts_end", "v_init", "max_acc", "max_speed"),
             lambda c: c.merged().select("player_id", "ts_start", "ts_end", "v_init", "max_acc", "max_speed"),
             lambda c: ZN.zone_running(c.rows(), ["player_id"]).select("player_id", "ts_ms", "dist_1", "dist_5"),
             lambda c: RT.route_segments(RT.event_routes(c.merged(), c.raw(), ["player_id"]), ["player_id"])
             .select("player_id", "ts_ms", "segment_id")]
    for make in makes:
        want = rows(base, make, 3)
        assert rows(lost, make, None) == want and want
