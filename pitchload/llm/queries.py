"""Registered queries of the subpackage: one per operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchload.llm import (bm25_decon, html_template, multi_index, pii_anchor, prefix_trie, probminhash, sp_dropout, stream_dedup,
                           suffix_dedup, transcript_hmm, treap_search, url_lm, weak_quality)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and whether it is the one that stays."""
    got = probminhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", F.col("chosen").alias("stays"))


def op2_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op4_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_lm.judge(table(spark, sf_dir, "pages"))


def op7_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of every conversation."""
    return transcript_hmm.canonical(table(spark, sf_dir, "conversations"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the class probabilities and whether it stays."""
    return weak_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and the digest of what stays."""
    got = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item found in it."""
    return bm25_decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the base counts, the digest of the base spans and all spans."""
    got = pii_anchor.find_personal_data(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


def op10_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its token ids and whether they decode to the text."""
    return sp_dropout.encode(table(spark, sf_dir, "documents"), keep_ids=False)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations with their subtree sums."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its class of equal texts and whether it stays."""
    return stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op13_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return treap_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_template": op2_template,
    "op3_quality": op3_quality,
    "op4_url": op4_url,
    "op5_suffix": op5_suffix,
    "op6_bm25": op6_bm25,
    "op7_transcript": op7_transcript,
    "op8_multi_index": op8_multi_index,
    "op9_pii": op9_pii,
    "op10_dropout": op10_dropout,
    "op11_trie": op11_trie,
    "op12_dedup": op12_dedup,
    "op13_treap": op13_treap,
}

ORACLE: dict[str, str] = {
    "op4_url": url_lm.oracle(),
    "op11_trie": prefix_trie.ORACLE,
    "op12_dedup": stream_dedup.ORACLE,
    "op13_treap": treap_search.ORACLE,
}
