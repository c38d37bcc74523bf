"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of many texts are laid out in one array of byte tokens. An inverted
index leads from the rank of each adjacent token pair to the positions where the pair stands; ranks
are replayed in ascending order, each over all its positions at once, and only the neighbours of a
merged pair are looked at again. Every text is then the gathered tokens of its pre-tokens.

For the corpus, the frequent pre-tokens (of a bounded number of texts, ``SAMPLE_ROWS`` of at most
``SAMPLE_BYTES`` bytes, see common) are replayed once, on the driver; the table of their tokens (at
most ``TABLE_UNITS``, a few MB) is broadcast. Tasks replay what is not in it, the rare pre-tokens,
block by block. Blocks are bounded in bytes, so memory is too, and there is no shuffle: to replay each
rare pre-token once as well, all of them would have to be shuffled twice. The table saves work only.

Defined results: a null text counts as empty (no ids); ids and texts of repeated rows repeat; rows
keep their ``doc_id`` whatever it is, null included; other columns are left out.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import memory_returned, prepare, slices, some_texts, text_of

Step = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]
NONE = np.int32(2**31 - 1)
#: Bytes of text whose new pre-tokens are replayed together.
BLOCK_BYTES = 4 << 20
#: Units that a task remembers between blocks at most, besides the table, and the length from which a unit is long.
CACHE_UNITS, LONG_UNIT = 200_000, 256
#: Units of the table of frequent ones at most (each under LONG_UNIT characters).
TABLE_UNITS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class MergeReplay:
    """Encodes many byte strings at once by replaying merges in rank order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs: dict[int, int] = {}
        unsafe: set[int] = set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
                    unsafe.update(p for p, part in ((left, token[:i]), (right, token[i:])) if len(part) > 1 and p > rank)
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        #: Ranks whose merge can open a pair of a lower rank: these are replayed one position a word.
        self.unsafe = unsafe

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words one after another, and the number of tokens of each."""
        lengths = np.array([len(w) for w in words], np.int64)
        tokens = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tokens)
        if not n:
            return tokens, lengths
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[np.cumsum(lengths[lengths > 0]) - 1] = -1
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = -1
        rank = np.full(n, NONE, np.int32)
        alive = np.ones(n, bool)
        has = np.flatnonzero(after >= 0)
        rank[has] = self.rank_of(tokens[has], tokens[after[has]])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if len(at):
                at = at[np.argsort(rank[at], kind="stable")]
                own = rank[at]
                cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
                for r, part in zip(own[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(queue, r)
                    index[r].append(part)

        add(has)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if r in self.unsafe:
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                rest, at = at[~first], at[first]
            else:
                rest = at[:0]
                touching = after[at[:-1]] == at[1:]
                if touching.any():  # of pairs that overlap, the leftmost goes first
                    start = np.r_[True, ~touching]
                    began = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - began) % 2 == 0]
            gone = after[at]
            alive[gone] = False
            tokens[at] = r
            end = after[gone]
            after[at] = end
            inner = end >= 0
            before[end[inner]] = at[inner]
            rank[at[~inner]] = NONE
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([at[inner], left])
            if len(touched):
                touched = np.unique(touched)
                old = rank[touched]
                new = self.rank_of(tokens[touched], tokens[after[touched]])
                rank[touched] = new
                add(touched[new != old] if r not in self.unsafe else touched)
            if len(rest):
                add(rest[alive[rest]])
        return tokens[alive], np.bincount(word[alive], minlength=len(words)).astype(np.int64)


class _Units(dict):
    """Numbers units in the order in which they are first seen; ``fresh`` has those not yet encoded."""

    def __init__(self, fresh: list[str], lead: str) -> None:
        self.fresh, self.lead = fresh, lead

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self.fresh)
        self.fresh.append(self.lead + unit)
        return n


class BlockEncoder:
    """Encodes texts in blocks; remembers the tokens of units between blocks of a task, within bounds.

    A unit is what stands between two single spaces that have no other white space beside them,
    with the space before it. No match of the pattern crosses such a place, so a unit's matches do
    not depend on what surrounds it, and each distinct unit is matched and replayed once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.run = re.compile(r"\s\s|^ | $").search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.table: list[str] = []
        self.base = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.clear()

    def clear(self) -> None:
        """Forget all units but those of the table."""
        self.seen: list[str] = list(self.table)
        self.later, self.first = _Units(self.seen, " "), _Units(self.seen, "")
        for n, u in enumerate(self.table):
            if u.startswith(" "):
                self.later[u[1:]] = n
            else:
                self.first[u] = n
        self.tokens, self.lengths = self.base
        self.known = len(self.seen)

    def use(self, table: tuple[list[str], np.ndarray, np.ndarray]) -> None:
        """Start from a table of units, their tokens and these tokens' numbers."""
        self.table, self.base = table[0], table[1:]
        self.clear()

    def frequent(self, texts: list[str], units: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The table of the most frequent units of some texts, replayed together."""
        self.clear()
        number: Counter[int] = Counter()
        for t in texts:
            number.update(self.units(t).tolist())
        table = [self.seen[n] for n, _ in number.most_common() if len(self.seen[n]) < LONG_UNIT][:units]
        self.clear()
        tokens, lengths = self._encoded(table)
        return table, tokens, lengths

    def units(self, text: str) -> np.ndarray:
        parts = self.cut(text) if self.run(text) else text.split(" ")
        out = np.fromiter(map(self.later.__getitem__, parts[1:]), np.int64, len(parts) - 1)
        return np.concatenate([[self.first[parts[0]]], out])

    def _encoded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all units one after another, and the number of tokens of each."""
        matches = list(map(self.find, fresh))
        count = np.fromiter(map(len, matches), np.int64, len(matches))
        words: dict[str, int] = {}
        which = np.fromiter((words.setdefault(w, len(words)) for m in matches for w in m), np.int64, int(count.sum()))
        tokens, lengths = self.replay.encode([w.encode() for w in words])
        flat = tokens[spread((np.cumsum(lengths) - lengths)[which], lengths[which])]
        size = np.r_[0, np.cumsum(lengths[which])]
        ends = np.cumsum(count)
        return flat, size[ends] - size[ends - count]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        of = [self.units(t) for t in texts]
        fresh = self.seen[self.known :]
        flat, size = self._encoded(fresh)
        tokens, lengths = np.concatenate([self.tokens, flat]), np.concatenate([self.lengths, size])
        starts = np.cumsum(lengths) - lengths
        out = [tokens[spread(starts[u], lengths[u])] for u in of]
        long = [u for u in fresh if len(u) > LONG_UNIT]
        if len(self.seen) > len(self.table) + CACHE_UNITS or sum(map(len, long)) > 1 << 20:
            self.clear()
        else:
            self.tokens, self.lengths, self.known = tokens, lengths, len(self.seen)
        return out


_encoders: dict[tuple[str, str], BlockEncoder] = {}


def encoder(path: str, pattern: str) -> BlockEncoder:
    """The worker's encoder; it is built once a Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BlockEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for b in slices(batches):
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _encoding(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, T.StructField, Step]:
    """The rows to encode, the id's field, and the step from them to ids."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    kind = rows.schema[0]
    arrow = to_arrow_type(kind.dataType)
    table = docs.sparkSession.sparkContext.broadcast(BlockEncoder(load_ranks(ranks_path), pattern).frequent(some_texts(docs, text_col), TABLE_UNITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        own.use(table.value)
        with memory_returned(own):
            for ids, texts in _blocks(batches, block_bytes):
                encoded = own.encode(texts)
                for i in range(0, len(ids), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500], arrow), pa.array([e.astype("<u4").tobytes() for e in encoded[i : i + 500]], pa.binary())], [id_col, "ids"])

    return rows, kind, run


def _decoding(ranks_path: str, id_col: str) -> Step:
    """The step from rows of an id and ids to these and ``bytes``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        for b in slices(batches):
            out = []
            for x in b.column(1).to_pylist():
                ids = np.frombuffer(x, "<u4").astype(np.int64)
                out.append(flat[spread(starts[ids], lengths[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], [id_col, "ids", "bytes"])

    return run


def _schema(kind: T.StructField, *names: str) -> T.StructType:
    return T.StructType([T.StructField(kind.name, kind.dataType), *(T.StructField(n, T.BinaryType()) for n in names)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the token ids as little-endian 32-bit integers."""
    rows, kind, run = _encoding(docs, ranks_path, pattern, id_col, text_col, block_bytes)
    return rows.mapInArrow(run, _schema(kind, "ids"))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``encode`` with ``bytes``, what their ids stand for (the UTF-8 of the text)."""
    prepare(encoded.sparkSession)
    return encoded.select(id_col, "ids").mapInArrow(_decoding(ranks_path, id_col), _schema(encoded.schema[id_col], "ids", "bytes"))


def there_and_back(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``decode`` of ``encode``, both in one worker instead of one each."""
    rows, kind, run = _encoding(docs, ranks_path, pattern, id_col, text_col, block_bytes)
    back = _decoding(ranks_path, id_col)
    return rows.mapInArrow(lambda batches: back(run(batches)), _schema(kind, "ids", "bytes"))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Contract columns of an encoding and of what decoding it gives."""
    return there_and_back(docs, ranks_path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
