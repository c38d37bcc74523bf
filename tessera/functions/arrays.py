"""The collection operators on array columns, by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import default_for

Lambda = Callable[[Column], Column]


def map_(a: Column, f: Lambda) -> Column:
    return F.transform(a, f)


def flat_map(a: Column, f: Lambda) -> Column:
    return F.flatten(F.transform(a, f))


def filter_(a: Column, p: Lambda) -> Column:
    return F.filter(a, p)


def find(a: Column, p: Lambda) -> Column:
    """The first item that fits, or none."""
    return F.get(F.filter(a, p), F.lit(0))


def index(a: Column, i: Column | int) -> Column:
    """The item at a 0-based place; none if there is none (negative places too)."""
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def slice_(a: Column, start: Column | int, end: Column | int) -> Column:
    """Items from ``start`` to before ``end``; negative places count from the end."""
    n = F.size(a)

    def place(x: Column | int) -> Column:
        x = F.lit(x) if isinstance(x, int) else x
        return F.least(F.greatest(F.when(x < 0, x + n).otherwise(x), F.lit(0)), n)

    return F.slice(a, place(start) + 1, F.greatest(place(end) - place(start), F.lit(0)))


def sort(a: Column, key: Lambda) -> Column:
    """Ascending and stable."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def zip_(a: Column, b: Column) -> Column:
    """Pairs by place, up to the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_0"), y.alias("_1")))


def sequence(start: Column | int, end: Column | int) -> Column:
    """start, start + 1, ..., end - 1; empty if the end is not after the start."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.when(end > start, F.sequence(start, F.greatest(end - 1, start))).otherwise(F.filter(F.sequence(start, start), lambda _: F.lit(False)))


def to_columnar(a: Column, fields: list[str]) -> Column:
    """An array of structs as a struct of arrays."""
    def field(name: str) -> Column:
        return F.transform(a, lambda x: x[name]).alias(name)

    return F.struct(*[field(f) for f in fields])


def from_columnar(columns: dict[str, Column]) -> Column:
    """Arrays as an array of structs, up to the shortest; no columns give no rows."""
    if not columns:
        return F.array().cast(T.ArrayType(T.StructType([])))
    n = F.least(*[F.size(c) for c in columns.values()]) if len(columns) > 1 else F.size(next(iter(columns.values())))
    return F.transform(F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(k) for k, c in columns.items()]), lambda x: F.struct(*[x[k].alias(k) for k in columns]))


def count(a: Column) -> Column:
    """Items, none ones too."""
    return F.size(a).cast("long")


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def sum_(a: Column, kind: T.DataType) -> Column:
    """The sum, of the items' type; 0 for none."""
    return F.aggregate(a, default_for(kind), lambda acc, x: (acc + x).cast(kind))


def mean(a: Column) -> Column:
    """The mean; NaN for no items."""
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(total / F.greatest(F.size(a), F.lit(1)))


def min_(a: Column) -> Column:
    return F.array_min(a)


def max_(a: Column) -> Column:
    return F.array_max(a)


def all_(a: Column) -> Column:
    return F.forall(a, lambda x: x)


def any_(a: Column) -> Column:
    return F.exists(a, lambda x: x)


def contains(a: Column, x: Column) -> Column:
    return F.exists(a, lambda y: y.eqNullSafe(x))


def distinct(a: Column) -> Column:
    return F.array_distinct(a)


def fold(a: Column, start: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, start, f)


#: Items that ``scan`` gathers before it appends them to its result, so that long arrays are not copied at every item.
CHUNK = 64


def bound(x: Column, f: Lambda) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def scan(a: Column, start: Column, f: Callable[[Column, Column], Column], kind: T.DataType) -> Column:
    """The accumulators after each item, without the start."""
    none = F.array().cast(T.ArrayType(kind))
    begin = F.struct(start.cast(kind).alias("acc"), none.alias("part"), F.array().cast(T.ArrayType(T.ArrayType(kind))).alias("out"))

    def step(s: Column, x: Column) -> Column:
        def moved(new: Column) -> Column:
            part = F.concat(s["part"], F.array(new))
            full = F.size(s["part"]) >= CHUNK - 1
            return F.struct(new.alias("acc"), F.when(full, none).otherwise(part).alias("part"), F.when(full, F.concat(s["out"], F.array(part))).otherwise(s["out"]).alias("out"))

        return bound(f(s["acc"], x).cast(kind), moved)

    return F.aggregate(a, begin, step, lambda s: F.concat(F.flatten(s["out"]), s["part"]))


def lag(a: Column, n: int, kind: T.DataType) -> Column:
    """Items moved back by n places; gaps take the type's default."""
    return F.transform(a, lambda _, i: F.when((i >= n) & (i - n < F.size(a)), F.get(a, i - n)).otherwise(default_for(kind)))


def lead(a: Column, n: int, kind: T.DataType) -> Column:
    return lag(a, -n, kind)


def rolling_mean(a: Column, preceding: int, following: int) -> Column:
    return F.transform(a, lambda _, i: mean(slice_(a, F.greatest(i - preceding, F.lit(0)), i + following + 1)))


def _ranked(a: Column, down: bool = False) -> Column:
    """For each item its rank and dense rank (none first): one sort, one pass over neighbours, one sort back."""
    keyed = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    keyed = F.reverse(keyed) if down else keyed
    # Whether an item differs from the one before it in the order.
    steps = F.transform(keyed, lambda s, p: F.struct(s["i"].alias("i"), ((p == 0) | ~F.get(keyed, p - 1)["x"].eqNullSafe(s["x"])).alias("new")))
    state = T.StructType([T.StructField(n, T.IntegerType()) for n in ("place", "rank", "dense", "i")])
    start = F.struct(*[F.lit(0).alias(n) for n in state.names])

    def step(acc: Column, s: Column) -> Column:
        place = acc["place"] + 1
        return F.struct(place.alias("place"), F.when(s["new"], place).otherwise(acc["rank"]).alias("rank"), (acc["dense"] + s["new"].cast("int")).alias("dense"), s["i"].alias("i"))

    return F.array_sort(F.transform(scan(steps, start, step, state), lambda s: F.struct(s["i"].alias("i"), s["rank"].alias("rank"), s["dense"].alias("dense"))))


def rank(a: Column) -> Column:
    return F.transform(_ranked(a), lambda s: s["rank"])


def rank_dense(a: Column) -> Column:
    return F.transform(_ranked(a), lambda s: s["dense"])


def rank_percentile(a: Column) -> Column:
    """(rank - 1) / (items - 1); 0 for a single item."""
    return F.transform(_ranked(a), lambda s: (s["rank"] - 1) / F.greatest(F.size(a) - 1, F.lit(1)))


def cume_dist(a: Column) -> Column:
    return F.transform(_ranked(a, down=True), lambda s: (F.size(a) - s["rank"] + 1) / F.size(a))


def group(a: Column, key: Lambda) -> Column:
    """{key, values} for each distinct key, in the order in which keys appear; values keep their order."""
    keys = F.array_distinct(F.transform(a, key))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(a, lambda x: key(x).eqNullSafe(k)).alias("values")))
