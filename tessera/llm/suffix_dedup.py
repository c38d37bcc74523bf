"""Substring dedup with a logarithmic family of sparse suffix arrays.

Every window of ``window`` bytes has an anchor: the leftmost of its ``GRAM``-byte strings with the
smallest hash (strings of a period that divides 8 come last). Neighbouring windows share anchors, so about one suffix in
18 is indexed, and equal windows have equal anchors. A suffix is kept with the bytes of all windows
it anchors: up to 34 before the anchor and 50 from it, so nothing has to be looked up in a text again.

A run is the suffixes of one shard in the order of all their bytes from the anchor on, a sparse suffix
array; shards are by a hash of the first ``GRAM`` bytes. Documents arrive in batches of ascending ids.
A batch's runs are merged with those of all levels (a stable sort of ordered runs, which merges them
in linear time). Common prefixes of neighbours in that array, and common suffixes of neighbours in the
array of what stands before the anchors, give the long matches: two suffixes have the window that
begins ``j`` bytes before their anchors in common if no neighbours between them share fewer than
``window - j`` bytes in the first array or than ``j`` bytes in the second. All are lengths of compared bytes;
hashes only choose anchors and shards, and find copies within a block, which are compared as bytes too.

A batch then becomes a level of size 1; levels of equal size merge into one of twice the size, so that
n batches are in at most log2(n) + 1 levels. Wholly duplicate suffixes are not indexed.

Hot groups: within a block of texts (bounded bytes) copies of a suffix are found before anything is
shuffled, and a task remembers (within bounds) those that had copies, so a passage that a third of
all documents hold reaches its shard about once a task. Places of copies within a document are kept
without their bytes. Heads that many different suffixes begin with are counted over all documents;
where those of one would take more than a quarter of a shard, its windows are dealt one by one, by all their bytes.
The number of shards follows the bytes of the corpus, which bounds the memory of a task.

Defined results: null texts count as empty; texts under ``window`` bytes lose nothing; repeats within
a document, and between rows that share a doc_id, are no duplicates; rows that share an id are taken
to share their text; rows with a null id are kept whole and compared with nothing; an empty table
gives an empty result; extra columns, whatever their names, stay in ``remove`` and are not read elsewhere.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, memory_returned, prepare, row_of, text_of

WINDOW, GRAM = 50, 16
#: Bytes of text that are looked at together; bytes of suffixes in a shard, from which their number follows.
BLOCK_BYTES, SHARD_BYTES, LEAST_SHARDS = 1 << 20, 8 << 20, 64
#: Groups of shards that are worked on one after another, which divides the disk that is held.
GROUPS = 2
#: Places whose anchors are found together (as many as fit a cache); bytes of suffixes that are copied together; bytes from which a packed run is compressed.
STRETCH, PIECE, COMPRESSED = 1 << 15, 1 << 18, 1 << 10
#: Bytes kept of suffixes for each byte of text, roughly; batches of a one-off run.
KEPT_PER_BYTE, BATCHES = 3.7, 3
#: Suffixes with copies that a task remembers, and heads that it counts.
REMEMBERED, COUNTED = 20_000, 20_000
#: Hot heads (8 bytes each) that tasks get at most, those with the most suffixes; it changes no result.
MAX_HOT = 1_000_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SCHEMA = "kind string, shard int, data binary"
#: Places of a window that its anchor can have, at most (bits of a number).
PLACES = 60
#: Keeps the first 0 to 8 bytes of a big-endian word.
_KEEP = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * r) - 1) for r in range(9)], np.uint64)
_SIZES = np.array([1 << 8 * b for b in range(8)], np.uint64)


def _loads(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as little-endian numbers."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _mix(h: np.ndarray, x: np.ndarray, c: np.uint64) -> np.ndarray:
    h = (h ^ x) * c
    return h ^ (h >> np.uint64(31))


def fingerprints(loads: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the strings of ``length`` (8 or more) bytes at ``starts``."""
    h = np.full(len(starts), length, np.uint64)
    for i, at in enumerate([*range(0, length - 8, 8), length - 8]):
        h = _mix(h, loads[starts + at], _C[i % 4])
    return _mix(h, h >> np.uint64(17), _C[1])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The items of every range, one after another; in pieces, as their places take 24 times the room of bytes."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, data.dtype)
    cuts = [0, *np.unique(np.searchsorted(ends, np.arange(PIECE, total, PIECE))).tolist(), len(ends)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i < j:
            out[ends[i] - lengths[i] : ends[j - 1]] = data[_ranges(starts[i:j], lengths[i:j])]
    return out


def places_of(window: int) -> int:
    """Places of a window, from its first byte on, at which its anchor can be."""
    return min(window - GRAM + 1, PLACES)


def _firsts(lengths: np.ndarray) -> np.ndarray:
    lengths = lengths.astype(np.int64)
    return np.cumsum(lengths) - lengths


@dataclass
class Run:
    """Suffixes: document, windows, place of the anchor among the bytes, number of places, where their bytes begin; the places of their first windows; bytes."""

    doc: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    times: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    data: np.ndarray
    window: int

    @property
    def lengths(self) -> np.ndarray:
        return self.windows.astype(np.int64) + (self.window - 1)

    def take(self, which: np.ndarray, places: bool = True) -> Run:
        """Some suffixes, in the order given, with the same bytes; without their places, if these are no longer asked for."""
        times = self.times[which] if places else np.zeros(len(which), np.uint32)
        at = _gather(self.at, _firsts(self.times)[which], times.astype(np.int64)) if places else self.at[:0]
        return Run(self.doc[which], self.windows[which], self.anchor[which], times, self.begin[which], at, self.data, self.window)

    def compact(self) -> Run:
        """With the bytes of the suffixes one after another, and no others."""
        return Run(self.doc, self.windows, self.anchor, self.times, _firsts(self.lengths), self.at, _gather(self.data, self.begin, self.lengths), self.window)

    def parts(self, cuts: np.ndarray) -> Iterator[Run]:
        """The runs between ``cuts`` of a compact run."""
        bytes_, places = np.r_[self.begin, len(self.data)], np.r_[_firsts(self.times), len(self.at)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield Run(self.doc[i:j], self.windows[i:j], self.anchor[i:j], self.times[i:j], self.begin[i:j] - bytes_[i], self.at[places[i] : places[j]], self.data[bytes_[i] : bytes_[j]], self.window)

    def pack(self, pack=zstandard.ZstdCompressor(level=1).compress) -> bytes:
        """A compact run as bytes."""
        head = np.array([len(self.doc), len(self.at), len(self.data), self.window], "<u4").tobytes()
        raw = b"".join([head, self.doc.astype("<i8"), self.windows.astype("u1"), self.anchor.astype("u1"), self.times.astype("<u4"), self.at.astype("<u4"), self.data])
        return b"\1" + pack(raw) if len(raw) >= COMPRESSED else b"\0" + raw

    @staticmethod
    def unpack(blob: bytes, unpack=zstandard.ZstdDecompressor().decompress) -> Run:
        raw = unpack(blob[1:]) if blob[0] else blob[1:]
        n, places, size, window = np.frombuffer(raw, "<u4", 4).tolist()
        at, cuts = 16, []
        for kind, wide, number in (("<i8", 8, n), ("u1", 1, n), ("u1", 1, n), ("<u4", 4, n), ("<u4", 4, places), ("u1", 1, size)):
            cuts.append(np.frombuffer(raw, kind, number, at))
            at += wide * number
        return Run(*cuts[:4], _firsts(cuts[1].astype(np.int64) + (window - 1)), *cuts[4:], window)

    @staticmethod
    def join(runs: list[Run], window: int) -> Run:
        kinds = {"doc": "<i8", "windows": "u1", "anchor": "u1", "times": "<u4", "begin": "<i8", "at": "<u4", "data": "u1"}
        both = Run(*(np.concatenate([np.zeros(0, k), *(getattr(r, f) for r in runs)]) for f, k in kinds.items()), window)
        both.begin += np.repeat(_firsts(np.array([len(r.data) for r in runs], np.int64)), [len(r.doc) for r in runs])
        return both


class Strings:
    """What stands from the anchors of a run on, and what stands before them (backwards), word by word."""

    def __init__(self, run: Run) -> None:
        pad = np.zeros(run.window + PLACES + 16, np.uint8)  # so that words can be read there
        self.loads = _loads(np.concatenate([pad, run.data, pad]))
        self.begin = run.begin + len(pad)
        self.anchor = self.begin + run.anchor
        self.end = self.begin + run.lengths

    def after(self, which: np.ndarray, k: int) -> np.ndarray:
        at = self.anchor[which] + 8 * k
        return self.loads[at].byteswap() & _KEEP[np.clip(self.end[which] - at, 0, 8)]

    def before(self, which: np.ndarray, k: int) -> np.ndarray:
        at = self.anchor[which] - 8 * (k + 1)
        return self.loads[at] & _KEEP[np.clip(at + 8 - self.begin[which], 0, 8)]


def suffix_array(n: int, word: Callable[[np.ndarray, int], np.ndarray], words: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``n`` strings, which ``word`` gives eight bytes at a time, and how many bytes each has in common with the one before it.

    ``groups``: they are ordered by these first, and strings of different groups have nothing in common.
    Sorts are stable, so strings that come as ordered runs are merged.
    """
    first = word(np.arange(n), 0)
    order = np.argsort(first, kind="stable") if groups is None else np.lexsort((first, groups))
    first = first[order]
    common = np.zeros(n, np.int16)
    common[1:] = 8 - np.searchsorted(_SIZES, first[1:] ^ first[:-1], "right")
    if groups is not None:
        common[1:][groups[order][1:] != groups[order][:-1]] = 0
    del first
    tie = common == 8
    for k in range(1, words):
        tied = tie.copy()
        tied[:-1] |= tie[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        which, with_last = order[at], tie[at]
        value, set_ = word(which, k), np.cumsum(~with_last)
        place = np.lexsort((value, set_))
        order[at], value = which[place], value[place]
        more = np.zeros(len(at), np.int16)
        more[1:] = 8 - np.searchsorted(_SIZES, value[1:] ^ value[:-1], "right")
        more[~with_last] = 0
        common[at] += more
        tie[at] = more == 8
    return order, common


def _anchors(loads: np.ndarray, n: int, span: int) -> np.ndarray:
    """The place of the anchor of the window that begins at each place: the first of ``span`` with the smallest hash."""
    out = np.empty(n - span + 1, np.uint32)
    for begin in range(0, len(out), STRETCH):
        end = min(begin + STRETCH + span - 1, n)
        # 31 bits of hash, below that the place, above it whether the string has a period that divides 8.
        low = _mix(loads[begin:end] * _C[0], loads[begin + 8 : end + 8], _C[1]) >> np.uint64(1)
        low &= np.uint64(0x7FFFFFFF00000000)
        low |= (loads[begin:end] == loads[begin + 8 : end + 8]).astype(np.uint64) << np.uint64(63)
        low |= np.arange(begin, end, dtype=np.uint64)
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            low = np.minimum(low[: len(low) - step], low[step:])
            reach += step
        out[begin : begin + len(low)] = low.astype(np.uint32)
    return out


def suffixes(texts: list[bytes], docs: np.ndarray, window: int = WINDOW, hot: np.ndarray | None = None, shards: int = 1, group: int = 0, groups: int = 1, places: np.ndarray | int = 0) -> tuple[Run, np.ndarray, np.ndarray, np.ndarray]:
    """The anchored suffixes of a block of texts whose shards are of the group; each one's fingerprint, shard and hash of its head.

    Windows of suffixes whose head is in ``hot`` (ascending) are suffixes of their own. ``places``: where the texts, if they are pieces, begin.
    """
    data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    n = len(data) - 16
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    loads = _loads(data)
    upto = begin + np.maximum(size - window + 1, 0)
    if not (upto > begin).any():
        return Run.join([], window), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _anchors(loads, n, places_of(window))
    # A suffix begins with a text, and where the anchor changes; it ends before the next, and with the last window of its text.
    at = np.union1d(np.flatnonzero(low[1:] != low[:-1]) + 1, begin[upto > begin])
    text = np.searchsorted(begin, at, "right") - 1
    windows = np.minimum(np.r_[at[1:], n], upto[text]) - at
    at, windows, text = (x[windows > 0] for x in (at, windows, text))
    anchors = low[at].astype(np.int64)
    del low
    heads = _mix(loads[anchors], loads[anchors + 8] * _C[2], _C[3])
    deal = heads
    if hot is not None and len(hot):
        split = np.minimum(np.searchsorted(hot, heads), len(hot) - 1)
        split = hot[split] == heads
        one = _ranges(at[split], windows[split])
        at, anchors, heads, text = (np.concatenate([x[~split], y]) for x, y in ((at, one), *((x, np.repeat(x[split], windows[split])) for x in (anchors, heads, text))))
        deal = np.concatenate([deal[~split], fingerprints(loads, one, window)])
        windows = np.concatenate([windows[~split], np.ones(len(one), np.int64)])
    home = (deal % np.uint64(shards)).astype(np.int64)
    if groups > 1:
        own = home % groups == group
        windows, at, anchors, heads, home, text = (x[own] for x in (windows, at, anchors, heads, home, text))
    # Equal suffixes have equal fingerprints; those of others, which are few, are told apart by their bytes.
    prints = _mix(_mix(heads, loads[at], _C[0]), loads[at + windows + (window - 9)], _C[2]) ^ (windows << 8 | anchors - at).astype(np.uint64)
    run = Run(docs[text], windows.astype(np.uint8), (anchors - at).astype(np.uint8), np.ones(len(at), np.uint32), at, (at - (begin - places)[text]).astype(np.uint32), data, window)
    return run, prints, home, heads


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open spans, by document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    other = np.r_[True, doc[1:] != doc[:-1]]
    group = np.cumsum(other) - 1
    base = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.r_[True, other[1:] | (start[1:] + base[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], reach[last] - base[last]


def _same(a: Run, i: np.ndarray, b: Run, j: np.ndarray) -> np.ndarray:
    """Whether suffixes i of a and j of b have the same bytes and the anchor at the same place."""
    same = (a.windows[i] == b.windows[j]) & (a.anchor[i] == b.anchor[j])
    size = a.lengths[i]
    p, q = a.begin[i], b.begin[j]
    if not len(p):
        return same
    left, right = _loads(a.data), _loads(b.data)
    i = np.flatnonzero(same)
    for k in range(0, a.window + PLACES, 8):
        at = np.minimum(k, size[i] - 8)
        equal = left[p[i] + at] == right[q[i] + at]
        same[i[~equal]] = False
        i = i[equal]
    return same


class Copies:
    """Leaves out copies of suffixes within a block, and of those that earlier blocks of a task had copies of."""

    def __init__(self, window: int) -> None:
        self.prints, self.run = np.zeros(0, np.uint64), Run.join([], window)

    def split(self, found: Run, prints: np.ndarray) -> tuple[Run, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Suffixes that are left, which these are, and the spans of others that copy a smaller document."""
        n = len(found.doc)
        order = np.argsort(prints)
        tie = prints[order][1:] == prints[order][:-1]
        some = order[np.r_[tie, False] | np.r_[False, tie]]
        some = some[np.lexsort((found.at[some], found.doc[some], prints[some]))]
        first = np.r_[True, prints[some][1:] != prints[some][:-1]][: len(some)]
        head = np.arange(n)
        head[some] = np.repeat(some[first], np.diff(np.r_[np.flatnonzero(first), len(some)]))
        at = np.flatnonzero(head != np.arange(n))
        copy = np.zeros(n, bool)
        copy[at] = _same(found, at, found, head[at])
        again = copy & (found.doc > found.doc[head])
        here = np.flatnonzero(copy & ~again)
        # What an earlier block had copies of, in a smaller document.
        lead = np.flatnonzero(~copy)
        if len(self.prints):
            known = np.minimum(np.searchsorted(self.prints, prints[lead]), len(self.prints) - 1)
            hit = self.prints[known] == prints[lead]
            hit[hit] = _same(found, lead[hit], self.run, known[hit])
            lead, known = lead[hit], known[hit]
            before = found.doc[lead] > self.run.doc[known]
            again[lead[before]] = True
            again[here] = again[head[here]]
            self.run.doc[known] = np.minimum(self.run.doc[known], found.doc[lead])
        gone = np.flatnonzero(again)
        start = found.at[gone].astype(np.int64)
        spans = merged(found.doc[gone], start, start + found.lengths[gone])
        stay = np.flatnonzero(~copy & ~again)
        rest = found.take(stay)
        # Other places of a copy in the same document go with it.
        here = here[~again[here]]
        if len(here):
            owner = np.empty(n, np.int64)
            owner[stay] = np.arange(len(stay))
            of = np.concatenate([np.arange(len(stay)), owner[head[here]]])
            place = np.concatenate([rest.at, found.at[here]])
            by = np.lexsort((place, of))
            rest.at, rest.times = place[by], np.bincount(of, minlength=len(stay)).astype(np.uint32)
        self._remember(found, prints, np.unique(head[copy]))
        return rest, stay, spans

    def _remember(self, found: Run, prints: np.ndarray, lead: np.ndarray) -> None:
        lead = lead[~np.isin(prints[lead], self.prints)][: max(0, REMEMBERED - len(self.prints))]
        if len(lead):
            both, all_ = Run.join([self.run, found.take(lead, places=False).compact()], found.window), np.concatenate([self.prints, prints[lead]])
            order = np.argsort(all_)
            self.prints, self.run = all_[order], both.take(order, places=False)


def _thinned(common: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """What neighbours have in common where only some strings are kept."""
    at = np.flatnonzero(keep)
    if not len(at):
        return common[:0]
    out = np.minimum.reduceat(common, np.r_[0, at[:-1] + 1])[: len(at)]
    # The last segment reaches to the end of the array; it must end at the last string kept.
    out[-1] = common[(at[-2] + 1 if len(at) > 1 else 0) : at[-1] + 1].min()
    return out


def matches(run: Run, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a run, and for its first ``fresh`` suffixes the windows (bits) that a smaller document of the run has too."""
    strings, window, n = Strings(run), run.window, len(run.doc)
    span = places_of(window) - 1
    order, common = suffix_array(n, strings.after, -(-window // 8))
    hits = np.zeros(n, np.uint64)
    # Suffixes that begin alike, where one of the new ones is not in the smallest document.
    first = np.flatnonzero(common < GRAM)
    least = np.minimum.reduceat(run.doc[order], first) if n else run.doc[:0]
    most = np.maximum.reduceat(np.where(order < fresh, run.doc[order], np.iinfo(np.int64).min), first) if n else run.doc[:0]
    shared = np.repeat(most > least, np.diff(np.r_[first, n]))
    at = np.flatnonzero(shared)
    which, right = order[at], np.minimum(common[at], window)
    head = np.cumsum(right < GRAM)
    for again in (True, False):
        if not len(which):
            return order, hits
        back, left = suffix_array(len(which), lambda w, k, which=which: strings.before(which[w], k), -(-span // 8), head)
        near = np.maximum(right, np.r_[right[1:], 0])
        far = np.empty_like(near)
        far[back] = np.maximum(left, np.r_[left[1:], 0])
        if again:  # those that have no window in common with any neighbour
            keep = near + np.minimum(far, span) >= window
            which, right, head = which[keep], _thinned(right, keep), head[keep]
    doc, anchor, windows = run.doc[which], run.anchor[which].astype(np.int64), run.windows[which].astype(np.int64)
    rank = np.empty_like(back)
    rank[back] = np.arange(len(back))
    for j in range(span + 1):
        part = np.flatnonzero((anchor >= j) & (anchor - windows < j) & (near >= window - j) & (far >= j))
        if len(part) < 2:
            continue
        key = np.cumsum(right < window - j)[part] * np.int64(len(which) + 1) + np.cumsum(left < j)[rank[part]]
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        least = np.repeat(np.minimum.reduceat(doc[part[by]], start), np.diff(np.r_[start, len(by)]))
        hit = part[by[doc[part[by]] > least]]
        hits[which[hit]] |= np.uint64(1) << (anchor[hit] - j).astype(np.uint64)
    return order, hits


def scan(new: Run, old: Run, merging: int = 0) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], Run]:
    """Spans of ``new`` that a smaller document of either has too; and, merged in order, its suffixes that are not wholly such and the last ``merging`` of old."""
    n, window = len(new.doc), new.window
    both = Run.join([new, old], window)
    order, hits = matches(both, n)
    some = np.flatnonzero(hits[:n])
    bits = ((hits[some][:, None] >> np.arange(places_of(window) + 2, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    whole = np.zeros(len(both.doc), bool)
    whole[some] = bits.sum(1) == both.windows[some]
    before = np.zeros_like(bits)
    before[:, 1:] = bits[:, :-1]
    row, low = np.nonzero(bits & ~before)
    _, high = np.nonzero(before & ~bits)
    own = some[row]
    times = new.times[own].astype(np.int64)
    place = _gather(new.at, _firsts(new.times)[own], times).astype(np.int64)
    spans = merged(np.repeat(new.doc[own], times), place + np.repeat(low, times), place + np.repeat(high, times) + (window - 1))
    keep = ~whole
    keep[n : len(keep) - merging] = False
    return spans, both.take(order[keep[order]], places=False).compact()


def _pack_spans(spans: tuple[np.ndarray, ...]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([x.astype("<i8") for x in spans]).tobytes())


def _blocks(batches: Iterable[pa.RecordBatch], size: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Documents, places and bytes of about ``size`` bytes of texts together; longer texts come in pieces that have all windows between them, each once."""
    docs, places, texts, held = [], [], [], 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = t.encode()
            for at in range(0, max(1, len(data) - window + 1), size):
                docs.append(d)
                places.append(at)
                texts.append(data[at : at + size + window - 1])
                held += len(texts[-1])
                if held >= size:
                    yield np.array(docs, np.int64), np.array(places, np.int64), texts
                    docs, places, texts, held = [], [], [], 0
    if docs:
        yield np.array(docs, np.int64), np.array(places, np.int64), texts


def batch_runs(docs: DataFrame, shards: int, window: int = WINDOW, hot: np.ndarray | None = None, group: int = 0, groups: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of each block and shard of the group (kind ``new``), and the spans that repeat within a block or task (kind ``spans``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            copies = Copies(window)
            for ids, places, texts in _blocks(batches, block_bytes, window):
                found, prints, home, _ = suffixes(texts, ids, window, hot, shards, group, groups, places)
                if not len(found.doc):
                    continue
                rest, stay, spans = copies.split(found, prints)
                kinds, homes, blobs = [], [], []
                if len(spans[0]):
                    kinds.append("spans")
                    homes.append(zlib.crc32(np.int64(ids[0]).tobytes()) % (shards // groups) * groups + group)
                    blobs.append(_pack_spans(spans))
                if len(stay):
                    home = home[stay]
                    order, _ = suffix_array(len(stay), Strings(rest).after, -(-window // 8), home)
                    home, rest = home[order], rest.take(order).compact()
                    first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
                    for s, part in zip(home[first].tolist(), rest.parts(np.r_[first, len(home)]), strict=True):
                        kinds.append("new")
                        homes.append(s)
                        blobs.append(part.pack())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(homes, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "shard", "data"])

    return docs.mapInArrow(run, _SCHEMA)


def hot_heads(docs: DataFrame, window: int = WINDOW, bound: int = SHARD_BYTES // 4) -> np.ndarray:
    """Hashes (ascending) of heads whose different suffixes take more than ``bound`` bytes, over all documents (doc_id, text).

    Tasks count copies once a block, and each hands on its ``COUNTED`` heads with the most; there are ``MAX_HOT`` at most.
    """

    def most(heads: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        heads, at = np.unique(heads, return_inverse=True)
        number = np.bincount(at, number, len(heads)).astype(np.int64)
        top = np.argsort(-number, kind="stable")[:size]
        return heads[top], number[top]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            seen, number, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
            for ids, _, texts in _blocks(batches, BLOCK_BYTES, window):
                _, prints, _, heads = suffixes(texts, ids, window)
                own, times = np.unique(heads[np.unique(prints, return_index=True)[1]], return_counts=True)
                seen.append(own)
                number.append(times)
                held += len(own)
                if held > 20 * COUNTED:
                    held = 0
                    seen, number = ([x] for x in most(np.concatenate(seen), np.concatenate(number), COUNTED))
            heads, times = most(np.concatenate(seen), np.concatenate(number), COUNTED)
            yield pa.RecordBatch.from_arrays([pa.array(heads[times > 1].view(np.int64)), pa.array(times[times > 1])], ["head", "n"])

    found = docs.mapInArrow(run, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * window - GRAM) > bound).orderBy(F.desc("n"), "head").limit(MAX_HOT)
    return np.sort(np.array([r.head for r in found.select("head").toLocalIterator()], np.int64).view(np.uint64))


class SuffixIndex:
    """The levels of an index; ``add`` takes documents whose ids are larger than all before."""

    def __init__(self, spark: SparkSession, shards: int, window: int = WINDOW, hot: np.ndarray | None = None, group: int = 0, groups: int = 1, workspace: Workspace | None = None) -> None:
        if window <= GRAM:
            raise ValueError(f"windows of {GRAM} bytes or fewer are not supported")
        self.spark, self.shards, self.window, self.hot, self.group, self.groups = spark, shards, window, hot, group, groups
        self.work = workspace or Workspace(spark, "suffix")
        #: (size in batches, table of runs, its path), largest first.
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.spans: list[DataFrame] = []

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Scan a batch (doc_id, text) against all levels and index it; the spans found in it.

        ``last``: nothing follows, so that the batch need not be indexed.
        """
        size, merging = 1, []
        while self.levels and len(merging) < len(self.levels) and self.levels[-1 - len(merging)][0] == size:
            merging.append(self.levels[-1 - len(merging)])
            size *= 2
        stay = [x for x in self.levels if x not in merging]
        runs = batch_runs(docs, self.shards, self.window, self.hot, self.group, self.groups)
        for _, table, _ in stay:
            runs = runs.unionAll(table.select(F.lit("stay").alias("kind"), "shard", "data"))
        for _, table, _ in merging:
            runs = runs.unionAll(table.select(F.lit("merge").alias("kind"), "shard", "data"))
        window = self.window

        def work(group: pa.Table) -> pa.Table:
            with memory_returned():
                shard = group.column("shard")[0].as_py()
                of: dict[str, list[Run]] = {"new": [], "stay": [], "merge": []}
                kinds, blobs = [], []
                for kind, blob in zip(group.column("kind").to_pylist(), group.column("data"), strict=True):
                    if kind == "spans":
                        kinds.append(kind)
                        blobs.append(blob.as_py())
                    else:
                        of[kind].append(Run.unpack(blob.as_buffer()))
                new = Run.join(of.pop("new"), window)
                old, merges = Run.join(of["stay"] + of["merge"], window), sum(len(r.doc) for r in of["merge"])
                of.clear()
                spans, level = scan(new, old, merges)
                if len(spans[0]):
                    kinds.append("spans")
                    blobs.append(_pack_spans(spans))
                if not last and len(level.doc):
                    kinds.append("level")
                    blobs.append(level.pack())
                return pa.table({"kind": pa.array(kinds, pa.string()), "shard": pa.array([shard] * len(kinds), pa.int32()), "data": pa.array(blobs, pa.binary())})

        done, path = self.work.write(runs.groupBy("shard").applyInArrow(work, _SCHEMA))
        for _, _, old in merging:
            self.work.drop(old)
        if last:
            self.levels = stay
        else:
            self.levels = [*stay, (size, done.where("kind = 'level'"), path)]
        # A level that is merged later takes its file with it, so spans stand in a table of their own.
        self.spans.append(done.where("kind = 'spans'") if last else self.work.keep(done.where("kind = 'spans'")))
        return self.spans[-1]

    def close(self) -> None:
        """Remove the levels; spans stay."""
        for _, _, path in self.levels:
            self.work.drop(path)
        self.levels = []


def unpacked(spans: list[DataFrame]) -> DataFrame:
    """All spans found: doc_id and ``spans``, pairs of 64-bit start and end; several rows a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
                doc, start, end = raw.reshape(3, -1)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                offsets = (np.r_[first, len(doc)] * 16).astype("<i4")
                pairs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.stack([start, end], 1).tobytes())])
                whole = pa.RecordBatch.from_arrays([pa.array(doc[first]), pairs], ["doc_id", "spans"])
                for i in range(0, len(first), 20_000):
                    yield whole.slice(i, 20_000)

    out = spans[0]
    for x in spans[1:]:
        out = out.unionAll(x)
    return out.select("data").mapInArrow(run, "doc_id long, spans binary")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """Spans of all documents that repeat a smaller document: doc_id, ``spans`` (list of packed pairs)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = GROUPS * math.ceil(max(LEAST_SHARDS, total * KEPT_PER_BYTE / SHARD_BYTES) / GROUPS)
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *map(int, cuts), None]
    spans: list[DataFrame] = []
    work = Workspace(spark, "suffix")
    hot = hot_heads(rows, window)
    for group in range(GROUPS):
        index = SuffixIndex(spark, shards, window, hot, group, GROUPS, work)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = rows
            part = part if low is None else part.where(F.col("doc_id") > low)
            part = part if high is None else part.where(F.col("doc_id") <= high)
            index.add(part, last=high is None)
        index.close()
        spans += index.spans
    out, path = work.write(unpacked(spans).groupBy("doc_id").agg(F.collect_list("spans").alias("spans")))
    work.clear(path)
    return out


def _cut(text: bytes, parts: list[bytes] | None) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, and maximal removed runs."""
    if not parts:
        return text, 0, 0
    pairs = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
    _, start, end = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
    end = np.minimum(end, len(text))
    edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((end - start).sum()), len(start)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES, as_text: bool = False) -> DataFrame:
    """All columns of ``docs``, and ``kept`` (bytes; ``as_text``: a string, without characters that a cut has parted), ``n_bytes``, ``n_removed``, ``n_spans``; of these, columns of the same names are replaced."""
    spans = find_spans(docs, id_col, text_col, window, batches).select(F.col("doc_id").alias("id"), "spans")
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    rows = docs.select(row_of(names), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(spans, "id", "left").select("row", "text", "spans")
    schema = T.StructType([rows.schema["row"], T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])

    def run(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            out = [_cut(t, s) for t, s in zip(texts, b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([x[0].decode(errors="ignore") for x in out], pa.string()) if as_text else pa.array([x[0] for x in out], pa.binary()), *(pa.array(v, pa.int64()) for v in (list(map(len, texts)), [x[1] for x in out], [x[2] for x in out]))],
                ["row", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return rows.mapInArrow(run, schema).select("row.*", "kept", "n_bytes", "n_removed", "n_spans")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Contract columns."""
    return remove(docs.select("doc_id", "text"), window=window).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
