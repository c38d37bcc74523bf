"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. An n-gram is the product
(binding) of its letters' vectors, each rolled (permuted) by its place from the end; a text is the sum (bundle) of
its n-grams, and a language is the sum of its training texts at unit length, less what all languages
have in common. A text gets the language whose prototype has the largest cosine with it.

Learning is one pass whose partial sums are at most languages x dimensions a task; they are added on
the executors and only languages x dimensions numbers reach the driver, whatever the corpus' size.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the
language that sorts first; repeated rows repeat; rows without a language do not teach; if nothing
can be learned, every text is ``und``; letters are what Unicode calls so (category L: no digits, fractions or
Roman numerals); more than ``MAX_LANGUAGES`` languages are an error; columns other than the named ones are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, prepare, slices, text_of

DIMENSIONS, NGRAM = 1024, 3
#: N-grams and letters whose vectors a worker remembers (4 bytes x dimensions each), and n-grams that are added up together.
CACHE_GRAMS, CACHE_LETTERS, TOGETHER = 20_000, 4_000, 2_000
#: Characters whose n-grams are counted together.
PIECE = 1 << 18
#: Languages at most (4 bytes x dimensions each are broadcast); more are an error.
MAX_LANGUAGES = 2_000
#: Runs of letters (Unicode category L), and a faster pattern that also takes numbers such as a half or a Roman numeral.
_LETTERS, _NEARLY = regex.compile(r"\p{L}+"), re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    text = text.lower()
    words = _NEARLY.findall(text)
    return words if "".join(words).isalpha() else _LETTERS.findall(text)


class Space:
    """Vectors of letters, n-grams and texts."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM) -> None:
        self.dimensions, self.n = dimensions, n
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((CACHE_GRAMS, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= CACHE_LETTERS:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64(zlib.crc32(b"letter %d" % code))).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def row(self, gram: int) -> int:
        """The row of an n-gram in the matrix; the number has 21 bits for each letter."""
        at = self.rows.get(gram)
        if at is None:
            at = self.rows[gram] = len(self.rows)
            vector = np.ones(self.dimensions, np.float32)
            for place in range(self.n):
                vector = vector * np.roll(self.letter(gram >> 21 * place & 0x1FFFFF), place)
            self.matrix[at] = vector
        return at

    def text(self, text: str) -> np.ndarray | None:
        """The bundle of a text at unit length; None if it has no letter."""
        words = words_of(text)
        if not words:
            return None
        text = f" {' '.join(words)} ".ljust(self.n)
        out = np.zeros(self.dimensions, np.float32)
        for begin in range(0, len(text) - self.n + 1, PIECE):
            self._add(text[begin : begin + PIECE + self.n - 1], out)
        size = float(np.sqrt(out @ out))
        return out / np.float32(size) if size else None

    def _add(self, text: str, out: np.ndarray) -> None:
        """Add the vectors of a piece's n-grams to ``out``."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        grams = codes[: len(codes) - self.n + 1]
        for place in range(1, self.n):
            grams = grams << 21 | codes[place : len(codes) - self.n + 1 + place]
        grams, counts = np.unique(grams, return_counts=True)
        for i in range(0, len(grams), TOGETHER):
            own = grams[i : i + TOGETHER].tolist()
            if len(self.rows) + sum(g not in self.rows for g in own) > CACHE_GRAMS:
                self.rows.clear()
            part = list(map(self.row, own))
            out += counts[i : i + TOGETHER].astype(np.float32) @ self.matrix[part]


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, n: int) -> Space:
    return _spaces.setdefault((dimensions, n), Space(dimensions, n))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, n: int = NGRAM) -> dict[str, np.ndarray]:
    """The prototype of each language, from all rows of ``docs`` with text and language."""

    prepare(docs.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = space(dimensions, n), {}
        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (v := own.text(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.rint(v * 1e6).astype(np.int64))], ["lang", "i", "v"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        sums.setdefault(r.lang, np.zeros(dimensions))[r.i] = r.v
        if len(sums) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if v.any()}
    if len(found) > 1:
        common = sum(found.values()) / len(found)
        found = {k: (v - common) / max(np.linalg.norm(v - common), 1e-12) for k, v in found.items()}
    return found


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, n: int = NGRAM) -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (how far the best cosine is towards 1)."""
    prepare(docs.sparkSession)
    names = list(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[k] for k in names], np.float32).reshape(len(names), dimensions))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space(dimensions, n)
        for b in slices(batches):
            langs, scores = [], []
            for text in b.column(1).to_pylist():
                v = own.text(text) if text is not None and names else None
                cosines = shared.value @ v if v is not None else None
                best = int(np.argmax(cosines)) if cosines is not None else -1
                langs.append(names[best] if best >= 0 else "und")
                scores.append(float(np.clip(cosines[best], 0, 1)) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """Contract columns: learned from rows outside the held-out quarter, predicted for all."""
    held_out = crc_mod("doc_id", 4) == 2
    prototypes = learn(docs.where(~held_out))
    return predict(docs, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
