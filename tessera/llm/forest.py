"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors (of one label) become one, with its number. Each of ``TREES`` trees splits the space
recursively by random directions at a random place near the median of a bounded sample; vectors
within a margin of the split go to both sides (spill), so that two vectors within the threshold are
seldom parted, and hardly ever in all trees. Within each leaf and label all pairs are compared by
cosine in double precision, block by block where a leaf is large, so no leaf is capped. A pair that
meets in several leaves counts in the first of them only. Each leaf gives a row for each vector: its
number of links there and the smallest vector that the leaf's links lead to; numbers are summed and
these stars are united by connected components. No pair is ever written.

The first splits are fitted on at most ``SAMPLE`` vectors (the smallest hashes), as deep as these support.
Leaves that are then still large are split further in rounds of ``LEVELS`` levels, each leaf by a sample
of its own vectors, so that leaves keep their size, and comparisons stay in proportion, however many
vectors there are. What cannot be parted (nearly all within the margin) is compared in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those with a
null label, have no link and are their own component; vectors of different lengths have no link; rows
that share an id are one vector (the one that sorts first); rows with a null id are left by themselves,
with a null component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, prepare, slices
from .components import components

THRESHOLD = 0.98
TREES, LEAF, SAMPLE, SEED = 5, 400, 20_000, 7
#: Components of all sampled vectors together, at most.
SAMPLE_NUMBERS = 4_000_000
#: Half of the spilled band, in standard deviations of how far apart a pair at the threshold projects.
MARGIN = 1.0
#: Sampled vectors that a split needs, and vectors that are compared with as many at once.
LEAST, BLOCK = 24, 2000
#: Leaves of so many times the size asked for are split further: levels a round, vectors of a leaf that it is fitted on (about), rounds at most, depth of a tree at most.
LARGE, LEVELS, OWN, ROUNDS, DEEPEST = 4, 4, 1_000, 12, 44
_TREE = 48


class Tree:
    """Splits of one random-projection tree: nodes in the order of a heap, leaves named by their path."""

    def __init__(self, sample: np.ndarray, depth: int, margin: float, rng: np.random.Generator) -> None:
        self.margin = margin
        self.splits: dict[int, tuple[np.ndarray, float]] = {}
        self._split(1, sample, depth, rng)

    def _split(self, node: int, sample: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        if depth <= 0 or len(sample) < LEAST:
            return
        direction = rng.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction)
        at = sample @ direction
        cut = float(np.quantile(at, rng.uniform(0.4, 0.6)))
        left, right = at <= cut + self.margin, at > cut - self.margin
        if left.mean() > 0.85 or right.mean() > 0.85:  # too dense to part here
            return
        self.splits[node] = (direction, cut)
        self._split(2 * node, sample[left], depth - 1, rng)
        self._split(2 * node + 1, sample[right], depth - 1, rng)

    def leaves(self, vectors: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Leaves with the vectors in them."""
        out, todo = [], [(1, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node not in self.splits:
                out.append((node, rows))
                continue
            direction, cut = self.splits[node]
            at = vectors[rows] @ direction
            todo += [(2 * node, rows[at <= cut + self.margin]), (2 * node + 1, rows[at > cut - self.margin])]
        return out


@lru_cache(maxsize=1024)
def _direction(tree: int, depth: int, size: int) -> np.ndarray:
    """The direction of all splits of a tree at a depth, below those that are fitted on the first sample."""
    d = np.random.default_rng([SEED, tree, depth, size]).standard_normal(size)
    return d / np.linalg.norm(d)


def _cuts(at: np.ndarray, margin: float, seed: int) -> np.ndarray:
    """Cuts of a subtree of ``LEVELS`` levels (by heap number; NaN: no split) from the projections of some of a leaf's vectors."""
    rng, cuts, members = np.random.default_rng(seed), np.full(1 << LEVELS, np.nan), {1: np.arange(len(at))}
    for node in range(1, 1 << LEVELS):
        own = members.get(node, ())
        if len(own) < LEAST:
            continue
        p = at[own, node.bit_length() - 1]
        cut = float(np.quantile(p, rng.uniform(0.4, 0.6)))
        left, right = p <= cut + margin, p > cut - margin
        if left.mean() <= 0.85 and right.mean() <= 0.85:
            cuts[node] = cut
            members[2 * node], members[2 * node + 1] = own[left], own[right]
    return cuts


def _routed(at: np.ndarray, cuts: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of rows and, beside them, the heap numbers of the subtree's leaves they get to."""
    row, node = np.arange(len(at)), np.ones(len(at), np.int64)
    done = []
    for level in range(LEVELS):
        cut = cuts[row, node]
        stay = np.isnan(cut)
        done.append((row[stay], node[stay]))
        row, node, cut = row[~stay], node[~stay], cut[~stay]
        p = at[row, level]
        left, right = p <= cut + margin[row], p > cut - margin[row]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    done.append((row, node))
    return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def _list(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _grown(codes: DataFrame, single: DataFrame, margin_of: float, leaf: int, work: Workspace) -> DataFrame:
    """``codes`` (id, label, size, leaf) with the large leaves split further, in rounds."""
    place = "id long, label string, size int, leaf long, n long"
    path, codes = None, codes.withColumn("stuck", F.lit(False))
    by = ["label", "size", "leaf"]
    for _ in range(ROUNDS):
        large = codes.where("NOT stuck").groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE * leaf)
        large, large_path = work.write(large)
        if large.isEmpty():
            break
        same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
        rows = codes.alias("c").join(large.alias("l"), same).select("c.id", *[f"c.{c}" for c in by], "l.n").join(single.select("id", "vector"), "id")

        def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 2000):
                size, code = b.column("size").to_numpy(), b.column("leaf").to_numpy()
                out = np.zeros((b.num_rows, LEVELS), np.float32)
                depth = np.array([(c & (1 << _TREE) - 1).bit_length() - 1 for c in code.tolist()], np.int64)
                for s, t, d in {*zip(size.tolist(), (code >> _TREE).tolist(), depth.tolist(), strict=True)}:
                    own = np.flatnonzero((size == s) & (code >> _TREE == t) & (depth == d))
                    unit = _unit(_matrix(b.column("vector").take(pa.array(own))))
                    out[own] = unit @ np.stack([_direction(t, d + level, s) for level in range(LEVELS)], 1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "size", "leaf", "n")), _list(out)], ["id", "label", "size", "leaf", "n", "at"])

        at, at_path = work.write(rows.select("id", *by, "n", "vector").mapInArrow(project, place + ", at array<float>"))

        def fit_leaf(group: pa.Table) -> pa.Table:
            size, code = group.column("size")[0].as_py(), group.column("leaf")[0].as_py()
            cuts = _cuts(_matrix(group.column("at")), margin_of / math.sqrt(max(1, size)), code)
            if (code & (1 << _TREE) - 1).bit_length() + LEVELS > DEEPEST:
                cuts[:] = np.nan
            return pa.table({"label": group.column("label").slice(0, 1), "size": group.column("size").slice(0, 1), "leaf": group.column("leaf").slice(0, 1), "cuts": _list(cuts[None])})

        some = at.where(F.pmod(F.xxhash64("id", "leaf"), F.col("n")) < OWN).select(*by, "at")
        cuts = work.keep(some.groupBy(*by).applyInArrow(fit_leaf, "label string, size int, leaf long, cuts array<double>"))

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 2000):
                size = b.column("size").to_numpy()
                row, node = _routed(_matrix(b.column("at")), _matrix(b.column("cuts")), margin_of / np.sqrt(np.maximum(1, size)))
                depth = np.floor(np.log2(node)).astype(np.int64)
                code = b.column("leaf").to_numpy()[row]
                inner = ((code & (1 << _TREE) - 1) << depth) + (node - (np.int64(1) << depth))
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("id").take(where), b.column("label").take(where), b.column("size").take(where), pa.array((code >> _TREE << _TREE) + inner), pa.array(node == 1)], ["id", "label", "size", "leaf", "stuck"])

        same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
        split = at.alias("c").join(cuts.alias("l"), same).select("c.id", *[f"c.{c}" for c in by], "c.at", "l.cuts").mapInArrow(route, "id long, label string, size int, leaf long, stuck boolean")
        rest = codes.alias("c").join(large.alias("l"), same, "left_anti").select("id", *by, "stuck")
        before = path
        # A leaf without cuts (too few of its sample) stays as it is.
        lost = at.alias("c").join(cuts.alias("l"), same, "left_anti").select("id", *by, F.lit(True).alias("stuck"))
        codes, path = work.write(rest.unionAll(split).unionAll(lost))
        for p in (before, large_path, at_path):
            if p:
                work.drop(p)
    return codes.drop("stuck")


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fit(sample: np.ndarray, depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> list[Tree]:
    """A forest over unit vectors."""
    margin = MARGIN * math.sqrt(2 * (1 - threshold)) / math.sqrt(max(1, sample.shape[1])) / 2
    return [Tree(sample, depth, margin, np.random.default_rng(SEED + i)) for i in range(trees)]


def _widest(forest: list[Tree], sample: np.ndarray) -> float:
    """The largest share of the sample that one leaf holds."""
    return max((len(rows) / len(sample) for tree in forest for _, rows in tree.leaves(sample)), default=1.0) if len(sample) else 1.0


def _groups(rows: DataFrame) -> DataFrame:
    """Rows of (key, ...) with blocks i and j of their key that they are compared in."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that the links (a, b) lead to from each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, times, own = (group.column(c).to_numpy() for c in ("id", "times", "own"))
        here = group.column("leaf")[0].as_py()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        flat = group.column("vector").combine_chunks()
        vectors = _unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        lists = group.column("leaves").to_pylist()
        codes = np.full((len(ids), max(map(len, lists))), -1, np.int64)
        for r, x in enumerate(lists):
            codes[r, : len(x)] = x
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, ends = np.zeros(len(ids), np.int64), []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            a, b = np.nonzero(vectors[part] @ vectors[right].T >= threshold)
            a, b = part[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            ends.append((a, b))
            for k in range(0, len(a), 20_000):
                p, q = a[k : k + 20_000], b[k : k + 20_000]
                before = np.where(codes[p] < here, codes[p], -1)
                met = ((before[:, :, None] == codes[q][:, None, :]) & (before >= 0)[:, :, None]).any((1, 2))
                p, q = p[~met], q[~met]
                links += np.bincount(p, times[q], len(ids)).astype(np.int64) + np.bincount(q, times[p], len(ids)).astype(np.int64)
        a, b = (np.concatenate([x[s] for x in ends]) if ends else np.zeros(0, np.int64) for s in (0, 1))
        root = ids[_roots(len(ids), a, b)]
        has = (links > 0) | (root != ids)
        return pa.table({"id": ids[has], "links": links[has], "root": root[has]})

    return run


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """One row per id: id, n_links and component_id."""
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    work = Workspace(spark, "forest")
    named = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>").alias("vector"))
    named = named.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    named = work.keep(named.select("id", "label", "vector", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("label", "vector").alias("fa"), F.xxhash64("vector", F.lit("b"), "label").alias("fb")))
    good = named.where("sound")
    single = work.keep(good.groupBy("fa", "fb").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.min_by("vector", "id").alias("vector"), F.first("label").alias("label")))
    largest = single.groupBy("label", F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max_by("size", "n"), F.sum("n")).first()
    depth = max(0, math.ceil(math.log2(max(1, (largest[0] or 1) / leaf))))
    size = largest[1] or 1
    taken = single.where(F.size("vector") == size).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, SAMPLE_NUMBERS // size))).collect()
    sampled = _unit([r.vector for r in taken]) if taken else np.zeros((0, size))
    fitted = fit(sampled, depth, threshold, trees)
    forest = spark.sparkContext.broadcast(fitted)
    others = (largest[2] or 0) - single.where(F.size("vector") == size).count()
    # Leaves are as large as the sample shows; vectors of other lengths begin in one leaf, or in one of each tree if they are many.
    grows = max(_widest(fitted, sampled) * ((largest[2] or 0) - others), others) > LARGE * leaf
    roots = trees if others > LARGE * leaf else 1

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[list[int]] = [[] for _ in range(b.num_rows)]
            wide = np.array([len(x) for x in b.column(2).to_pylist()])
            fits = np.flatnonzero(wide == size)
            if len(fits):
                unit = _unit(b.column(2).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), -1))
                for t, tree in enumerate(forest.value):
                    for node, rows in tree.leaves(unit):
                        for r in fits[rows].tolist():
                            lists[r].append((t << _TREE) + node)
            for r in np.flatnonzero(wide != size).tolist():
                lists[r] += [(t << _TREE) + 1 for t in range(roots)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(lists, pa.list_(pa.int64()))], ["id", "label", "vector", "times", "leaves"])

    dealt = single.select("id", "label", "vector", "times").mapInArrow(deal, "id long, label string, vector array<float>, times long, leaves array<long>")
    if grows:
        codes = work.keep(dealt.select("id", "label", F.size("vector").alias("size"), F.explode("leaves").alias("leaf")))
        codes = _grown(codes, single, MARGIN * math.sqrt(2 * (1 - threshold)) / 2, leaf, work)
        leaves = codes.groupBy("id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
        dealt = single.select("id", "label", "vector", "times").join(leaves, "id")
    rows = dealt.withColumn("leaf", F.explode("leaves")).withColumn("key", F.struct("label", F.size("vector").alias("size"), "leaf"))
    found = work.keep(_groups(rows).groupBy("key", "i", "j").applyInArrow(_compare(threshold), "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")), work)
    of = single.select("fa", "fb", F.col("id").alias("rep"), "times").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    out = good.select("id", "fa", "fb").join(of, ["fa", "fb"]).select("id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.unionAll(named.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))


def classify(vectors: DataFrame) -> DataFrame:
    """Contract columns."""
    out = near_links(vectors).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionAll(vectors.where("vec_id IS NULL").select(F.col("vec_id").cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True)))
