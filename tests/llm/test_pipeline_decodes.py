"""The pipeline's last stage decodes what it encodes."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe

TEXTS = [None, "", "a  b", "line\n\nnext", "日本語 ñandú ß", "😀 \ufffd", "same", "same"]


def docs(spark, doc_id=lambda i: i):
    rows = [(doc_id(i), t, "en", "web", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_ids_give_back_the_texts(spark):
    for doc_id in (lambda i: i, lambda i: None):
        out = corpus_pipeline.encode(spark, docs(spark, doc_id), "")
        path = corpus_pipeline.importlib.import_module("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")
        got = sorted(bytes(r.bytes).decode() for r in bpe.decode(out, path).collect())
        assert got == sorted(t or "" for t in TEXTS) and out.columns == ["doc_id", "n_tokens", "ids"]


def test_ids_of_another_text_fail(spark, monkeypatch):
    whole = bpe.there_and_back
    monkeypatch.setattr(bpe, "there_and_back", lambda d, *a, **k: whole(d.withColumn("text", F.regexp_replace("text", "next", "last")), *a, **k))
    with pytest.raises(Exception, match="do not give back the text of document 3"):
        corpus_pipeline.encode(spark, docs(spark), "").collect()
