"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2 ** 32. So it does not depend on their order, and inserting or
deleting a paragraph adds or subtracts its vector. The first ``EQUAL`` lanes are a uniform hash of the
paragraph (equality); the other ``LIKE`` lanes hold the paragraph's three-word runs, each with a sign in
one lane, so that the cosine of two documents' lanes estimates what share of their runs they have in
common, however many paragraphs there are. A text of under 2 ** 31 bytes cannot make a lane of these wrap.

To pair each document with the next, documents are dealt to ranges of ids that start at ids of the
table; the first document of a range is also sent to the range before, as its end. An id that many rows share
is cut by a hash of their texts. No task sees more than its ranges, and nothing is collected but the ranges'
starts (at most ``MAX_RANGES``).

Defined results: a null text counts as empty; texts without a word have likeness 1 to each other and 0
to others; rows that share an id follow one another in the order of their texts' hashes, then texts; a row with a null id
is outside the order and is its own next; a single document is its own next; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, text_of
from .minhash import _hash_of, _mix

EQUAL, LIKE, RUN = 32, 256, 3
RANGE_ROWS, MAX_RANGES = 2000, 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Fingerprint:
    """A sum of paragraphs' vectors, modulo 2 ** 32 in each lane."""

    def __init__(self, lanes: np.ndarray | None = None) -> None:
        self.lanes = np.zeros(EQUAL + LIKE, np.uint32) if lanes is None else lanes

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        return cls(vector(text.split("\n")))

    def insert(self, paragraph: str) -> Fingerprint:
        return Fingerprint(self.lanes + vector([paragraph]))

    def delete(self, paragraph: str) -> Fingerprint:
        return Fingerprint(self.lanes - vector([paragraph]))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.lanes == other.lanes).all())

    __hash__ = None

    def likeness(self, other: Fingerprint) -> float:
        a, b = (x.lanes[EQUAL:].view(np.int32).astype(np.float64) for x in (self, other))
        size = math.sqrt(float(a @ a) * float(b @ b))
        if self == other:
            return 1.0
        if not size:
            return float(not a.any() and not b.any())
        return min(1.0, max(0.0, float(a @ b) / size))

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.astype("<u4").tobytes()).decode()


def vector(paragraphs: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors."""
    digests = b"".join(hashlib.shake_128(p.encode()).digest(4 * EQUAL) for p in paragraphs)
    equal = np.frombuffer(digests, "<u4").reshape(-1, EQUAL).sum(0, dtype=np.uint64)
    words: list[str] = []
    for p in paragraphs:
        own = p.lower().split()
        words += own
        if own:
            words += [""] * (RUN - 1)
    like = np.zeros(LIKE, np.int64)
    if words:
        h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
        real = np.fromiter(map(bool, words), bool, len(words))[: len(h) - RUN + 1]
        total = np.zeros(len(h) - RUN + 1, np.uint64)
        for i in range(RUN):
            total = _mix(total * _STEP + h[i : i + len(total)])
        total = total[real]
        sign = (total >> np.uint64(63)).astype(np.int64) * 2 - 1
        like = np.bincount((total % np.uint64(LIKE)).astype(np.int64), sign, LIKE).astype(np.int64)
    return np.concatenate([equal.astype(np.uint32), like.astype(np.uint32)])


def edited(text: str, following: str) -> str:
    """The text whose last half (rounded down) gives way to as many first code points of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _at_or_before(starts: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The last of ``starts`` (ascending pairs of id and tie) that is not after each pair; -1 before the first."""
    low, high = np.searchsorted(starts[:, 0], ids, "left"), np.searchsorted(starts[:, 0], ids, "right")
    home = high - 1
    at = np.flatnonzero(high > low)  # rows whose id some range starts with
    for x in np.unique(ids[at]):
        own = at[ids[at] == x]
        i, j = low[own[0]], high[own[0]]
        home[own] = i + np.searchsorted(starts[i:j, 1], tie[own], "right") - 1
    return home


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, kind, id, tie, text) dealt and sorted: kind 0 a document, 1 what ends a range, 2 one without an id.

    Ranges are cut at quantiles of the ids; an id that spans several quantiles is cut by ``tie``, a hash of the text.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    least, count = rows.agg(F.min("id"), F.count("id")).first()
    ranges = min(MAX_RANGES, max(1, math.ceil((count or 0) / RANGE_ROWS)))
    inner = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    times = Counter(inner or [])
    cuts = {(x, -(2**63) + k * 2**64 // m) for x, m in times.items() for k in range(m)}
    cuts = np.array(sorted(cuts | {(x, -(2**63)) for x in [least] if x is not None}), np.int64).reshape(-1, 2)

    def firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for b in slices(batches):
            b = b.filter(b.column(0).is_valid())
            ids, tie = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            home = np.maximum(_at_or_before(cuts, ids, tie), 0)
            order = np.lexsort((tie, ids, home))
            for i in order[np.r_[True, home[order][1:] != home[order][:-1]][: len(order)]].tolist():
                pair = (int(ids[i]), int(tie[i]))
                found[int(home[i])] = min(pair, found.get(int(home[i]), pair))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([p[0] for p in found.values()], pa.int64()), pa.array([p[1] for p in found.values()], pa.int64())], ["range", "id", "tie"])

    # quantiles are rounded to doubles, so a range starts at the smallest pair that is not below its cut
    least_of = rows.select("id", "tie").mapInArrow(firsts, "range int, id long, tie long").groupBy("range").agg(F.min(F.struct("id", "tie")).alias("x")).collect() if len(cuts) > 1 else []
    starts = np.array(sorted((r.x["id"], r.x["tie"]) for r in least_of), np.int64) if least_of else cuts

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in slices(batches):
            known = np.flatnonzero(~np.asarray(b.column(0).is_null()))
            ids, tie = (b.column(c).take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 2))
            home = np.maximum(_at_or_before(starts, ids, tie), 0) if len(ids) else known[:0]
            edge = np.flatnonzero((starts[home] == np.stack([ids, tie], 1)).all(1)) if len(ids) and len(starts) > 1 else known[:0]
            if len(starts) == 1 and len(ids):  # one range: it ends with its own first
                edge = np.flatnonzero(ids == starts[0, 0])
            lost = np.setdiff1d(np.arange(b.num_rows), known)
            take = pa.array(np.concatenate([known, known[edge], lost]))
            where = np.concatenate([home, (home[edge] - 1) % max(1, len(starts)), -1 - (seen + lost) % max(64, len(starts))])
            seen += len(lost)
            kind = np.repeat([0, 1, 2], [len(known), len(edge), len(lost)])
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(kind, pa.int32()), b.column(0).take(take), b.column(2).take(take), b.column(1).take(take)], ["range", "kind", "id", "tie", "text"])

    return rows.mapInArrow(deal, "range int, kind int, id long, tie long, text string").repartition("range").sortWithinPartitions("range", "kind", "id", "tie", "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses to it and to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        out: list[list] = [[] for _ in names]

        def say(doc, text: str, own: Fingerprint, following: str, after: Fingerprint) -> None:
            new = edited(text, following)
            changed = Fingerprint.of(new)
            for column, x in zip(out, (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), str(own), str(changed), own.likeness(changed), own.likeness(after)), strict=True):
                column.append(x)

        for b in slices(batches):
            for place, kind, doc, text in zip(*(b.column(c).to_pylist() for c in ("range", "kind", "id", "text")), strict=True):
                if kind == 1 and before is None:
                    continue
                own = Fingerprint.of(text)
                if before is not None:
                    say(*before[1:], text, own)
                before = None
                if kind == 2:
                    say(doc, text, own, text, own)
                elif kind == 0:
                    before = (place, doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names)
            out = [[] for _ in names]

    return in_order(docs, id_col, text_col).mapInArrow(run, schema)
