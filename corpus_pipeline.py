"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

Stages work on all that their predecessor kept; all but the last return the columns of documents.

Defined results: null and empty texts are not toxic unless the labels say so of nothing; they are equal to
one another, so the one with the smallest id stays; they lose nothing and have no token. Rows with a null id
are never copies, lose nothing and keep their null. Rows that share an id become one. Columns other than those
of documents are left out, whatever their names. Empty documents give an empty result.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, minhash, mixing, suffix_dedup, toxicity
from tessera.llm.common import Workspace, table, text_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    model = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id."""
    return minhash.remove(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats 50 bytes or more of a document with a smaller doc_id."""
    kept = suffix_dedup.remove(docs.select(*COLUMNS), as_text=True)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each source's share of the budget; one epoch, so that none comes twice."""
    return mixing.mix(docs.select(*COLUMNS), mixing.WEIGHTS, mixing.SHARE, epochs=1, seed=mixing.SEED).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian 32-bit integers) and their number; fails where decoding them does not give the text."""
    tokenizers = importlib.import_module("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.struct("doc_id", F.sha2(text_of().cast("binary"), 256).alias("sha256")).alias("row"), "text")
    both = bpe.there_and_back(rows, path, tokenizers.PATTERN, id_col="row")
    same = F.sha2("bytes", 256) == F.col("row.sha256")
    wrong = F.raise_error(F.concat(F.lit("the ids do not give back the text of document "), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))))
    ids = both.select("row.doc_id", F.when(same, F.col("ids")).otherwise(wrong.cast("binary")).alias("ids"))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.keep(docs)
    return docs
