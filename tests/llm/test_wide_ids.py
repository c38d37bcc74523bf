"""Fingerprints of documents whose ids are beyond what a double holds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprint


@pytest.mark.parametrize("kind", ["hashes", "dense", "least"])
def test_every_document_has_its_next(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 200)
    ids = {"hashes": F.xxhash64("id"), "dense": F.lit(2**62 + 1) + F.col("id") * 3, "least": F.lit(-(2**63)) + F.col("id") * 700}[kind]
    docs = spark.range(6000).select(ids.alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text")).repartition(5)
    order = sorted(map(tuple, docs.collect()))
    assert len({i for i, _ in order}) == 6000
    want = []
    for k, (i, t) in enumerate(order):
        new = fingerprint.edited(t, order[(k + 1) % len(order)][1])
        want.append((i, hashlib.sha256(new.encode()).hexdigest()))
    together = "spark.sql.adaptive.coalescePartitions.enabled"  # ranges in one task follow one another by chance
    spark.conf.set(together, "false")
    try:
        out = fingerprint.compare_with_next(docs).select("doc_id", "edited_sha256").collect()
    finally:
        spark.conf.set(together, "true")
    out = sorted(map(tuple, out))
    assert (len(out), len(set(want) - set(out))) == (6000, 0) and out == want


def test_an_id_that_a_third_of_all_rows_share(spark, monkeypatch):
    """Its rows are cut into ranges by their texts' hashes; each document still has its next."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 100)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 70).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text of "), (F.col("id") % 997).cast("string")).alias("text")).repartition(6)
    order = sorted(map(tuple, docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text"), "text").collect()))
    want = sorted((i, hashlib.sha256(fingerprint.edited(t, order[(k + 1) % len(order)][2]).encode()).hexdigest()) for k, (i, _, t) in enumerate(order))
    held = fingerprint.in_order(docs).where("kind = 0 AND id = 70").groupBy("range").count().collect()
    assert len(held) >= 5 and max(r["count"] for r in held) < 400
    out = fingerprint.compare_with_next(docs).select("doc_id", "edited_sha256").collect()
    assert sorted(map(tuple, (r for r in out if r.doc_id is not None))) == want and len(out) == 3000
