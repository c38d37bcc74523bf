"""The pipeline's stages on nulls, repeats, empty tables and columns with the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.common import Workspace

DIR = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS
#: Names that the operators use inside.
INSIDE = "id label fit features feature n row rows kept spans n_bytes n_removed n_spans tie range kind score predicted component node rep key slot domain tokens copies whole rest last start cut _text _id _stays _tokens _copies _domain class_id ids bytes".split()


def rows(spark):
    long = " ".join(f"wort{i % 700}x{i}" for i in range(9000))
    given = [(1, "kalo mina tero sula grusch pfalt wenk drotz " * 3, "en", "src1"), (2, None, None, None), (3, "", "de", "src2"), (None, "drotz wenk", "en", "src1"), (None, None, None, None), (4, long, "en", "src1"), (4, long, "en", "src1"), (5, long + " end", "fr", "src3"), (6, "ieux aillon vorta oueau", "fr", None)]
    return spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in given], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("kind", ["odd", "empty", "clashing"])
def test_stages(spark, kind):
    docs = rows(spark)
    if kind == "empty":
        docs = docs.limit(0)
    if kind == "clashing":
        docs = docs.select("*", *[F.lit("clash").alias(c) for c in INSIDE])
    work, left = Workspace(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, DIR))
        left[name] = docs.collect()
        assert docs.columns == (["doc_id", "n_tokens", "ids"] if name == "byte_bpe" else COLUMNS)
    if kind == "empty":
        assert not any(left.values())
        return
    ids = {name: sorted(str(r.doc_id) for r in found) for name, found in left.items()}
    assert ids["toxicity"] == sorted(["1", "2", "3", "None", "None", "4", "4", "5", "6"])
    assert ids["minhash_near_dedup"] == ids["suffix_array_dedup"] == sorted(["1", "2", "None", "None", "4", "6"])
    assert set(ids["mixing"]) <= set(ids["suffix_array_dedup"]) and len(ids["byte_bpe"]) == len(ids["mixing"]) > 0
