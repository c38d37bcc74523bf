"""Token counts by a map-side two-tier lookup.

A pre-token is a run of spaces with the characters up to the next space. The model's pieces never
have a space after another character (checked when it is loaded), so pre-tokens are encoded on their
own and their lengths add up. The first tier is a table of the frequent pre-tokens of a bounded number of
texts (``SAMPLE_ROWS`` of at most ``SAMPLE_BYTES`` bytes, see common) and their token counts: at most
``table_size`` of them, a few MB, which is broadcast. The second tier is each worker's bounded cache: a
pre-token outside the table goes there and, failing that, to the model. So the corpus is read once and
nothing is shuffled. The table saves work and has no influence on the results, which are of all pre-tokens.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows repeat; ids may be
null; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memory_returned, prepare, slices, some_texts, text_of

#: Entries of the broadcast table, and bytes of the longest pre-token in it or in a cache.
TABLE_SIZE, WORD_CHARS = 1 << 16, 48
#: Entries of a worker's cache.
CACHE_SIZE = 400_000
#: U+2581 in a text is the same symbol as a space to the model.
_SPACES = " ▁"
_PARTS = re.compile(f"[{_SPACES}]+[^{_SPACES}]*").findall
_IRREGULAR = re.compile(f"^[{_SPACES}]|[{_SPACES}]{{2}}|▁|[{_SPACES}]$").search


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space (the model adds it again)."""
    if not text:
        return []
    if _IRREGULAR(text):
        return [p[1:] for p in _PARTS(" " + text)]
    return text.split(" ")


def piece_counter(model_path: str) -> Callable[[str], int]:
    """A function that gives the tokens of one pre-token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    crossing = re.compile("[^▁]▁").search
    if any(crossing(model.id_to_piece(i)) for i in range(len(model))) or model.encode("a  b", out_type=str) == model.encode("a b", out_type=str):
        raise ValueError("pieces of this model cross spaces, or it joins spaces; its pre-tokens cannot be encoded apart")
    encode = model.encode

    def count(word: str) -> int:
        # A lone run of spaces: the model keeps it as it is.
        return len(encode(word)) if word else 1

    return count


class LengthCache(dict):
    """Token counts: the frequent pre-tokens and, within bounds, those met lately."""

    def __init__(self, frequent: dict[str, int], count: Callable[[str], int]) -> None:
        super().__init__(frequent)
        self.frequent, self.count = frequent, count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= len(self.frequent) + CACHE_SIZE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def frequent_pretokens(texts: Iterable[str], table_size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens of some texts."""
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update(pretokens(t))
    return [w for w, _ in seen.most_common(2 * table_size) if len(w) <= WORD_CHARS][:table_size]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes, n_tokens and whether these exceed ``limit``."""
    spark = docs.sparkSession
    prepare(docs.sparkSession)
    count = piece_counter(model_path)
    frequent = {w: count(w) for w in frequent_pretokens(some_texts(docs, text_col), table_size)}
    shared = spark.sparkContext.broadcast(frequent)
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    kind = rows.schema[0].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = LengthCache(shared.value, piece_counter(model_path)).__getitem__
        with memory_returned():
            for b in slices(batches):
                texts = b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([sum(map(length, pretokens(t))) for t in texts], pa.int64())],
                    [id_col, "n_bytes", "n_tokens"],
                )

    out = rows.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
