"""The pipeline against a plain version, and the subpackage's place in the registry."""

import hashlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from pitchload.llm import bm25_decon, pii_anchor, sp_dropout, weak_quality
from tests.conftest import SF001
from tests.llm.test_probminhash import brute


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    keep = {r.doc_id for r in weak_quality.judged(docs, labels).where("keep").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    assert 0 < len(rows) < docs.count()
    rows = [r for r, c in zip(rows, brute(rows)) if r[0] == c]
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    runs = [bm25_decon.runs(bm25_decon.word_hashes([t])[0]) for t in items]
    clean = []
    for d, t in rows:
        have = bm25_decon.runs(bm25_decon.word_hashes([t])[0])
        if not any(len(r) and np.isin(r, have).mean() >= 0.8 for r in runs):
            clean.append((d, t))
    with open(sp_dropout.MODEL, "rb") as f:
        codec = sp_dropout.Codec(f.read())
    want = {}
    for d, t in clean:
        t = pii_anchor.redact(t, pii_anchor.find(t))
        ids = codec.encode(t, d)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF001).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF001).count() == 0


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n[:2] == "op"} and "pipeline" in names
