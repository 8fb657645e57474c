import numpy as np

from pitchload.llm import weak_quality


def test_texts_without_label_stay_where_they_are(spark):
    docs = spark.createDataFrame([(None if i % 500 == 7 else i - 2000, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(5)
    ids = [i - 2000 for i in range(0, 4000, 10)] + [10 ** 15, -2000]
    people = spark.createDataFrame([(i, weak_quality.GOOD) for i in ids], "doc_id long, people int").repartition(3)
    moved = [r.doc_id for r in weak_quality.maybe_labelled(docs, people, len(ids)).collect()]
    assert set(ids) - {10 ** 15} <= set(moved) and len(moved) == len(set(moved))
    assert len(moved) < 400 + 0.05 * 3600


def test_no_labelled_text_is_lost(spark):
    docs = spark.createDataFrame([(i, "plain words") for i in range(50)], "doc_id int, text string")
    for kind in ("int", "long"):
        people = spark.createDataFrame([(i, weak_quality.JUNK) for i in range(0, 50, 3)], f"doc_id {kind}, people int")
        found = weak_quality.maybe_labelled(docs, people, 17).join(people, "doc_id")
        assert sorted(r.doc_id for r in found.collect()) == list(range(0, 50, 3))
    none = people.limit(0)
    assert weak_quality.maybe_labelled(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), none, 0).count() == 0
    assert len(weak_quality.toxic_cues(docs, none)) == 0


def test_a_full_filter_still_keeps_every_id(spark, monkeypatch):
    monkeypatch.setattr(weak_quality, "ID_BITS", 64)
    docs = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text")
    people = spark.range(0, 1000, 2).selectExpr("id AS doc_id", "0 AS people")
    moved = {r.doc_id for r in weak_quality.maybe_labelled(docs, people, 500).collect()}
    assert moved >= set(range(0, 1000, 2))
    assert len(weak_quality.id_filter(people.selectExpr("xxhash64(doc_id) AS h"), 500)) == 1 and np.uint64(0) < weak_quality.id_filter(people.selectExpr("xxhash64(doc_id) AS h"), 500)[0]
