"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed n-grams of characters (of lower-cased text, white space as one space) that a text has;
each is worth its log-count ratio between toxic and other texts, over all labelled training texts. A
logistic regression on these values, at unit length, is fitted by gradient descent. Ratios come from about
``LEARN_ROWS`` labelled texts at most, the regression from about ``FIT_ROWS`` of each label: those whose
ids have the smallest hashes, as far as their features take ``FIT_BYTES``. This sample of labels, two numbers a row, is
broadcast, so no text is shuffled.

Defined results: null and empty texts have no feature and get the score of the intercept alone; rows
without a label, or with a null one, do not teach; a text labelled more than once teaches once a
label row, and all rows that share a labelled id teach; if only one label (or none) is there, every score is next to that label (0 for none).
Repeated rows repeat; ids may be null; columns other than the named ones are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, crc_mod, memory_returned, prepare, slices, text_of

BITS, SIZES = 18, (4,)
#: Labelled texts from which ratios are learned, and of each label those on which the regression is fitted (about, at most).
LEARN_ROWS = 40_000
FIT_ROWS = 1_500
#: Bytes of features (4 each) that the regression is fitted on, at most, half for each label: those of the texts whose features have the smallest hashes.
FIT_BYTES = 48 << 20
#: Steps of the descent, what is added to counts, texts a feature must be in, and the penalty on squared weights.
STEPS, SMOOTH, LEAST, DECAY = 80, 0.3, 3, 1e-4
#: Characters whose n-grams are hashed together.
PIECE = 1 << 19
_SPACE = re.compile(r"\s+")
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Features:
    """The distinct hashed n-grams of texts."""

    def __init__(self, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> None:
        self.bits, self.sizes = bits, sizes
        self.mark = np.zeros(1 << bits, bool)

    def of(self, text: str) -> np.ndarray:
        text = f" {_SPACE.sub(' ', text.lower()).strip()} "
        if len(text) < 3:
            return np.zeros(0, np.int64)
        for size in self.sizes:
            for begin in range(0, len(text) - size + 1, PIECE):
                data = np.frombuffer(text[begin : begin + PIECE + size - 1].encode("utf-32-le", "surrogatepass"), "<u4")
                n = len(data) - size + 1
                h = np.full(n, size, np.uint64)
                for i in range(size):
                    h = h * _BASE + data[i : i + n]
                h *= _MIX
                h ^= h >> np.uint64(29)
                h *= _MIX
                self.mark[(h >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found


class Model:
    """Weights of features (already scaled) and the intercept."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, intercept: float) -> None:
        self.weights, self.ratios, self.intercept = weights.astype(np.float32), ratios.astype(np.float32), intercept

    def score(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        size = float(np.sqrt(r @ r)) or 1.0
        z = self.intercept + float(self.weights[found] @ r) / size
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def taught(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", learn_rows: int = LEARN_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About ``learn_rows`` of the labels at most (``id``, ``label``), of which about ``fit_rows`` of each label are marked ``fit``."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    number = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).cast("double")
    part = min(1.0, learn_rows / max(1, sum(number.values())))
    fit = {y: min(part, fit_rows / max(1, n)) for y, n in number.items()}
    return rows.where(draw < part).withColumn("fit", draw < F.when(F.col("label") == 1, fit.get(1, 1.0)).otherwise(fit.get(0, 1.0)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> Model:
    """The model of the texts that ``labels`` (see ``taught``) marks; the labels, which are bounded, are broadcast."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(labels.select("id", "label", "fit")), "id").select("text", "label", "fit")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Features(bits, sizes), np.zeros((2, (1 << bits) + 1), np.int64)
        names = ["label", "feature", "n", "features"]
        for b in slices(batches):
            labels_, fitted = [], []
            for text, label, fit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = own.of(text)
                sums[label][found] += 1
                sums[label][-1] += 1
                if fit:
                    labels_.append(label)
                    fitted.append(found.astype("<i4").tobytes())
            none = pa.nulls(len(fitted))
            yield pa.RecordBatch.from_arrays([pa.array(labels_, pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(fitted, pa.binary())], names)
        for label in (0, 1):
            has = np.flatnonzero(sums[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), label, np.int32)), pa.array(has.astype(np.int32)), pa.array(sums[label][has]), pa.nulls(len(has), pa.binary())], names)

    found = Workspace(docs.sparkSession, "toxicity").keep(rows.mapInArrow(run, "label int, feature int, n long, features binary"))
    number = np.zeros((2, (1 << bits) + 1))
    got = found.where("feature IS NOT NULL").groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most 2 x 2 ** bits rows
    number[got["label"].to_numpy(int), got["feature"].to_numpy(int)] = got["n"]
    texts = number[:, -1].copy()
    zero = np.zeros(1 << bits)
    if not texts.all():
        return Model(zero, zero, 30.0 if texts[1] > 0 else -30.0)
    rare = number[:, :-1].sum(0) < LEAST
    number = number[:, :-1] + SMOOTH
    ratios = np.log(number[1] / (texts[1] + 2 * SMOOTH)) - np.log(number[0] / (texts[0] + 2 * SMOOTH))
    ratios[rare] = 0
    taken = []
    for label in (0, 1):
        held = 0
        for r in found.where(f"features IS NOT NULL AND label = {label}").select("features").orderBy(F.xxhash64("features"), "features").toLocalIterator():
            held += len(r.features)
            if held > FIT_BYTES // 2:
                break
            taken.append((label, bytes(r.features)))
    return _fit(sorted(taken), ratios, texts)


def _fit(taken: list[tuple[int, bytes]], ratios: np.ndarray, texts: np.ndarray) -> Model:
    """Gradient descent (Adam) over rows of distinct features, in float32 and without copies of them."""
    found = [np.frombuffer(x, "<i4") for _, x in taken]
    label = np.array([y for y, _ in taken], np.float32)
    cut = np.r_[0, np.cumsum([len(x) for x in found])]
    column = np.concatenate(found) if found else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(cut))
    value = ratios.astype(np.float32)[column]
    size = np.sqrt(np.maximum(np.bincount(row, value * value, len(found)), 1e-12)).astype(np.float32)
    value /= size[row]
    # Labels weigh as the square roots of their numbers: between their shares and being equal.
    share = np.sqrt(texts) / np.sqrt(texts).sum()
    weight = np.where(label == 1, share[1] / max(1, label.sum()), share[0] / max(1, (1 - label).sum()))
    w, b = np.zeros(len(ratios)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    w += 1.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[column] * value, len(found)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        g = np.bincount(column, error[row] * value, len(w)) + DECAY * w
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.3 * (1 - step / (STEPS + 1))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model(w, ratios, b)


def score(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (score >= 0.5); columns of these names are replaced."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*names, text_of(text_col).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fitted = Features(bits, sizes), shared.value
        with memory_returned():
            for b in slices(batches):
                scores = pa.array([fitted.score(own.of(t)) for t in b.column(len(names)).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], scores], [*names, "score"])

    out = rows.mapInArrow(run, T.StructType([*rows.schema[: len(names)], T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fifth, within the bound."""
    return taught(labels.where(crc_mod("doc_id", 5) != 0))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: learned from labelled rows outside the held-out fifth, scored for all."""
    texts = docs.select("doc_id", "text")
    return score(texts, learn(texts, training_labels(labels))).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
