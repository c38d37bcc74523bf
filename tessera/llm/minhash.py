"""MinHash near-dedup with DartMinHash signatures.

A text is its distinct word shingles, each an element with a weight (1, or its count with
``weighted``). Every element owns a region, its weight by an axis of ranks, on which darts fall as a
Poisson process that hashes of element, weight layer and rank cell decide. A dart has a coordinate;
of the darts in a text's regions the earliest of each coordinate is its minhash. Ranks are only
searched up to (k ln k + 4k) / total weight, twice as far for the few texts with a coordinate left.

Texts with equal elements are one class from the start. For the rest, ``BANDS`` bands of ``ROWS``
coordinates deal texts to buckets. In rounds, each bucket's members are compared with one member (the
one that shares most buckets with others, then the first by a hash): a pair is checked exactly, on the texts, and found links join
classes. What is left in buckets that still hold several classes is compared pair by pair, in
blocks and by signature, and pairs whose signatures agree in ``NEAR`` of the coordinates (over five
standard deviations below the threshold) are checked exactly too. So no link in a common bucket is
passed over, while groups of copies cost one comparison a member.

Defined results: texts with fewer words than a shingle are one element, those without words are all
equal; a null text counts as empty; rows with a null id are their own class (null) and stay; rows
that share an id are one document, linked to what any of them is like; an empty table gives an empty result; of
several equal or near documents the one with the smallest id stays, and of rows that share it the one whose text
(null as empty), then whose columns as JSON, come first; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, memory_returned, prepare, row_of, slices, text_of
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Share of equal coordinates below which a pair is not checked in the last round; one of similarity 0.8 has less with probability 3e-5.
NEAR = 0.65
ROUNDS, BLOCK = 2, 1500
#: Copies from which a group of equal texts is large, and large groups or buckets that are broadcast at most (32 bytes each).
LARGE, MAX_LARGE = 500, 100_000
#: Words whose hashes a worker remembers.
CACHE_WORDS = 150_000
_A, _B, _C, _D = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


_hash_of = _WordHashes()


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's distinct word shingles, ascending, and their counts."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = np.fromiter(map(_hash_of.__getitem__, parts), np.uint64, len(parts))
    if len(own) < words:
        own = np.concatenate([own, np.zeros(words - len(own), np.uint64)])
    h = np.zeros(len(own) - words + 1, np.uint64)
    for i in range(words):
        h = _mix(h * _C + own[i : i + len(h)])
    return np.unique(h, return_counts=True)


def dart_minhash(elements: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """For each text the ``k`` minhashes (64-bit names of darts); texts without elements get zeros."""
    out = np.zeros((len(elements), k), np.uint64)
    left = np.array([i for i, e in enumerate(elements) if len(e)], np.int64)
    reach = k * math.log(k) + 4 * k
    while len(left):
        size = np.array([len(elements[i]) for i in left])
        total = np.array([float(weights[i].sum()) for i in left])
        owner = np.repeat(np.arange(len(left)), size)
        h = np.concatenate([elements[i] for i in left])
        w = np.concatenate([weights[i] for i in left]).astype(np.float64)
        far = (reach / total)[owner]
        # Each element's region is cut into layers of weight 1 and cells of rank 1.
        layers = np.ceil(w).astype(np.int64)
        cells = np.ceil(far).astype(np.int64)
        count = layers * cells
        at = np.repeat(np.arange(len(h)), count)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        layer, cell = inner // cells[at], inner % cells[at]
        seed = _mix(h[at] ^ _mix(layer.astype(np.uint64) * _C + cell.astype(np.uint64) * _D + _A))
        owner, w, far = owner[at], w[at] - layer, np.minimum(far[at], cell + 1.0)
        rank = cell.astype(np.float64)
        ranks, names, slots = [], [], []
        dart = 0
        while len(seed):
            dart += 1
            draw = _mix(seed + np.uint64(dart * int(_D) % 2**64))
            rank = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            on = rank < far
            if not on.any():
                break
            seed, owner, w, far, rank = seed[on], owner[on], w[on], far[on], rank[on]
            name = _mix(draw[on] ^ _C)
            hit = ((_mix(name ^ _D) >> np.uint64(11)).astype(np.float64) / 2.0**53) < w
            ranks.append(rank[hit])
            names.append(name[hit])
            slots.append(owner[hit] * k + (name[hit] % np.uint64(k)).astype(np.int64))
        found, filled = np.zeros(len(left) * k, np.uint64), np.zeros(len(left) * k, bool)
        if ranks:
            rank, name, slot = map(np.concatenate, (ranks, names, slots))
            order = np.lexsort((-rank, slot))
            slot, name = slot[order], name[order]
            last = np.flatnonzero(np.r_[slot[1:] != slot[:-1], True])
            found[slot[last]], filled[slot[last]] = name[last], True
        whole = filled.reshape(-1, k).all(1)
        out[left[whole]] = found.reshape(-1, k)[whole]
        left, reach = left[~whole], reach * 2
    return out


def sketch(docs: DataFrame, weighted: bool = False, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id``, ``fa`` and ``fb`` (a fingerprint of the elements), ``n`` elements, ``bands`` and ``sig`` of docs (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        with memory_returned(_hash_of):
            for batch in slices(batches):
                texts = batch.column(1).to_pylist()
                for i in range(0, len(texts), 50):
                    own = [shingles(t, words) for t in texts[i : i + 50]]
                    weights = [c if weighted else np.ones(len(c), np.int64) for _, c in own]
                    signature = dart_minhash([h for h, _ in own], weights, k)
                    band = np.zeros((len(own), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _C
                    for r in range(rows):
                        band = _mix(band * _D + signature[:, r::rows])
                    unit = [h * np.uint64(2) + np.uint64(1) if not weighted else h + c.astype(np.uint64) * _C for (h, c) in own]
                    fa = [int(_mix(u).sum(dtype=np.uint64).view(np.int64)) for u in unit]
                    fb = [int(_mix(u ^ _B).sum(dtype=np.uint64).view(np.int64)) for u in unit]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, len(own)),
                            pa.array(fa, pa.int64()),
                            pa.array(fb, pa.int64()),
                            pa.array([int(w.sum()) for w in weights], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel())),
                            pa.array([s.astype("<u2").tobytes() for s in signature], pa.binary()),
                        ],
                        ["id", "fa", "fb", "n", "bands", "sig"],
                    )

    return docs.mapInArrow(run, "id long, fa long, fb long, n long, bands array<long>, sig binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    """The (weighted) Jaccard similarity of two texts' shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if weighted:
        both = int(np.minimum(a[1][i], b[1][j]).sum())
        either = int(a[1].sum() + b[1].sum()) - both
    else:
        both = len(i)
        either = len(a[0]) + len(b[0]) - both
    return both / either if either else 1.0


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, weighted: bool = False, words: int = WORDS) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts have at least the threshold's similarity."""
    schema = "u long, v long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        with memory_returned(_hash_of):
            for b in slices(batches):
                u, v = b.column(0).to_pylist(), b.column(1).to_pylist()
                hit = []
                for i, (p, q, s, t) in enumerate(zip(u, v, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    if p not in known:  # rows come by u, whose shingles are used again
                        known = {p: shingles(s, words)}
                    if similarity(known[p], shingles(t, words), weighted) >= threshold:
                        hit.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit, pa.int64())), b.column(1).take(pa.array(hit, pa.int64()))], ["u", "v"])

    right = docs.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    left = docs.select(F.col("id").alias("u"), F.col("text").alias("tu"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "tu", "tv").mapInArrow(run, schema)


class _Block:
    """Members of a bucket that are compared with one another: those of part i with those of part j."""

    def __init__(self, group: pa.Table, k: int, threshold: float) -> None:
        self.key, self.i, self.j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        self.own, self.ids, self.classes, self.n = (group.column(c).to_numpy() for c in ("own", "id", "component", "n"))
        self.sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(self.ids), k)
        self.bands = np.array(group.column("bands").to_pylist(), np.int64)
        self.threshold = threshold

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of part i with those that it has to be compared with on the texts: of another class (as ``classes`` is then), alike by signature, and in no earlier common bucket."""
        ids, n, sig, bands = self.ids, self.n, self.sig, self.bands
        second = np.flatnonzero(self.own == self.j)
        for x in np.flatnonzero(self.own == self.i):
            y = second[(self.classes[second] != self.classes[x]) & (ids[second] != ids[x])]
            y = y[np.minimum(n[y], n[x]) >= self.threshold * np.maximum(n[y], n[x])]
            if self.i == self.j:
                y = y[ids[y] > ids[x]]
            y = y[(sig[y] == sig[x]).mean(1) >= NEAR] if len(y) else y
            if len(y):
                y = y[bands[x][np.argmax(bands[y] == bands[x], 1)] == self.key]
            if len(y):
                yield int(x), y


def _leftover_links(rest: DataFrame, texts: DataFrame, threshold: float, weighted: bool, work: Workspace, k: int) -> DataFrame:
    """Links (u, v) between different classes in common buckets.

    ``rest``: key, id, component, n, sig, bands. Buckets are cut into blocks, and blocks are compared two by two,
    a pair only in its first common bucket: first by signature, which leaves the few members that are like some
    other; only these get their texts, in their blocks, so that neither pairs nor other texts are written.
    """
    # Buckets of one block are not looked up; larger ones are, in a broadcast table while they are few.
    sizes = work.keep(rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_LARGE else sizes
    rows = rest.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sig", "bands")

    def alike(group: pa.Table) -> pa.Table:
        some = np.zeros(group.num_rows, bool)
        for x, y in _Block(group, k, threshold).pairs():
            some[x] = True
            some[y] = True
        return group.filter(pa.array(some))

    def run(group: pa.Table) -> pa.Table:
        block, texts_ = _Block(group, k, threshold), group.column("text")
        sets: dict[int, tuple] = {}
        us, vs = [], []
        for x, found in block.pairs():
            for z in found.tolist():
                classes = block.classes
                if classes[z] == classes[x]:
                    continue
                for p in (x, z):
                    if p not in sets:
                        sets[p] = shingles(texts_[p].as_py())
                if similarity(sets[x], sets[z], weighted) >= threshold:
                    us.append(int(block.ids[x]))
                    vs.append(int(block.ids[z]))
                    # From here on they are one class in this group, and need no more comparisons.
                    block.classes = np.where(classes == classes[z], classes[x], classes)
        _hash_of.clear()
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    near = work.keep(rows.groupBy("key", "i", "j").applyInArrow(alike, rows.schema))
    return near.join(texts, "id").groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """One row per id (not null) of ``docs``: its id, ``class_id``, the smallest id that links lead to, and its number of ``rows``."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    all_ = work.keep(sketch(texts, weighted))
    equal = ["fa", "fb", "n"]
    firsts = work.keep(all_.groupBy(*equal).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # Large groups of equal texts are looked up in a broadcast table (bounded), so that none of them lands in one task.
    large = firsts.where(F.col("copies") >= LARGE).orderBy(F.desc("copies"), *equal).limit(MAX_LARGE).select(*equal, F.col("rep").alias("known"))
    large = work.keep(large)
    named = all_.select("id", *equal).join(F.broadcast(large), equal, "left")
    others = named.where("known IS NULL").join(firsts.join(F.broadcast(large), equal, "left_anti"), equal).select("id", "rep")
    named = work.keep(others.unionAll(named.where("known IS NOT NULL").select("id", F.col("known").alias("rep"))))
    member = work.keep(named.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.count(F.lit(1)).alias("rows")))
    # The texts of rows that share an id belong together.
    found = work.keep(named.join(member.where("rep < other").select("id", F.col("rep").alias("v")), "id").where("rep <> v").select(F.col("rep").alias("u"), "v"))
    reps = all_.join(firsts.select("rep"), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id", *equal])
    bucket = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    bucket = work.keep(bucket.join(shared, "key"))
    # Texts that share buckets with most others are compared with first: what a group of edited copies comes from.
    central = bucket.groupBy("id").agg(F.sum("members").alias("central"))
    bucket = work.keep(bucket.join(central, "id").select("id", "n", "key", "central"))
    classes = bucket.select(F.col("id").alias("node"), F.col("id").alias("component")).distinct()
    for r in range(ROUNDS):
        first = F.struct((F.xxhash64("id", F.lit(r)) if r else -F.col("central")).alias("p"), F.col("id").alias("id"), F.col("n").alias("n"))
        lead = bucket.groupBy("key").agg(F.min(first).alias("lead")).select("key", F.col("lead.id").alias("u"), F.col("lead.n").alias("nu"))
        pairs = bucket.join(lead, "key").where("id <> u").where(F.least("n", "nu") >= threshold * F.greatest("n", "nu")).groupBy("u", F.col("id").alias("v")).agg(F.count(F.lit(1)).alias("times"))
        if r == 0:  # the first of each text only: the one with which it shares most buckets
            pairs = pairs.groupBy("v").agg(F.max(F.struct("times", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")
        else:
            a, b = classes.toDF("u", "cu"), classes.toDF("v", "cv")
            pairs = pairs.join(a, "u").join(b, "v").where("cu <> cv").select("u", "v")
        links = work.keep(verify(work.keep(pairs), texts, threshold, weighted))
        found = found.unionAll(links)
        joined = components(found, work)
        classes = work.keep(bucket.select(F.col("id").alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    labelled = bucket.join(classes, F.col("id") == F.col("node")).select("key", "id", "n", "component")
    several = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rest = work.keep(labelled.join(several, "key", "left_semi"))
    rest = rest.join(all_.dropDuplicates(["id", *equal]).select("id", "sig", "bands"), "id")
    links = work.keep(_leftover_links(rest, texts, threshold, weighted, work, BANDS * ROWS))
    joined = work.keep(components(found.unionAll(links), work))
    out = member.join(joined, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("class_id"), "rows")
    out, path = work.write(out)
    work.clear(path)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id and whether it stays; rows with a null id stay by themselves."""
    found = near_classes(docs).select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
    return found.unionAll(docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def remove(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, and those with a null id; columns as they are."""
    stay = near_classes(docs).where("id = class_id")
    rows = docs.select(row_of(docs.columns), F.col("doc_id").cast("long").alias("id"))
    single = rows.join(stay.where("rows = 1").select("id"), "id", "left_semi")
    several = rows.join(stay.where("rows > 1").select("id"), "id", "left_semi")
    first = several.groupBy("id").agg(F.min_by("row", F.struct(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.to_json("row"))).alias("row"))
    return single.select("row").unionAll(first.select("row")).unionAll(rows.where("id IS NULL").select("row")).select("row.*")
