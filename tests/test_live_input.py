import datetime as dt

from pyspark.sql import functions as F

from pitchload.plans import registry
from pitchload.sources import tables


def test_the_tracking_rows_are_computed_once_for_all_parts(spark, tmp_path, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), i % 3, "a", 0.5, "") for i in range(300)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    computed, view = spark.sparkContext.accumulator(0), tables.tracking

    def counted(spark, sf):
        @F.udf("double")
        def seen(x):
            computed.add(1)
            return x
        return view(spark, sf).withColumn("x", seen.asNondeterministic()("x"))

    want = sorted(view(spark, str(tmp_path)).select("player_id", "x", "y").collect())
    monkeypatch.setattr(tables, "tracking", counted)
    arrive = registry._arrivals(spark, registry._stored_chain(spark, str(tmp_path)), f"{tmp_path}/src")
    for k in range(registry.PARTS):
        arrive(k)
    got = spark.read.schema("player_id int, x double, y double").json(f"{tmp_path}/src")
    assert sorted(got.collect()) == want
    assert computed.value == len(rows)
