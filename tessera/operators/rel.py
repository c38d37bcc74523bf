"""Ordered collections of rows: a DataFrame and a lazy order.

The order is a list of hidden columns (``__o0``, ``__o1``, ...), not a row number: nothing is sorted or
numbered before an operator looks at positions. An unsorted source has no order, and operators that need
one refuse it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Items
from ..functions.types import default_for
from ..sources.staging import written
from . import ranges


class OrderError(ValueError):
    """An operator needs an order that the relation does not have."""


class Fields:
    """The columns of a row, as attributes or items; ``all()`` unpacks them."""

    def __init__(self, rel: Rel, alias: str | None = None) -> None:
        self._rel, self._alias = rel, alias

    def __getitem__(self, name: str | int) -> Column:
        name = self._rel.columns[name] if isinstance(name, int) else name
        if name not in self._rel.df.columns:
            raise KeyError(name)
        return F.col(f"{self._alias}.`{name}`" if self._alias else f"`{name}`")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def all(self) -> dict[str, Column]:
        return {c: self[c] for c in self._rel.columns}


Key = Callable[[Fields], Column]


def _named(out: Column | dict[str, Column]) -> dict[str, Column]:
    return out if isinstance(out, dict) else {"value": out}


class Rel:
    def __init__(self, df: DataFrame, order: Iterable[str] = ()) -> None:
        self.df, self.order = df, tuple(order)

    # Sources

    @classmethod
    def of(cls, df: DataFrame, *order_by: str | Column) -> Rel:
        """A relation over ``df``; with ``order_by`` it is ordered by these columns."""
        out = df
        for i, o in enumerate(order_by):
            out = out.withColumn(f"__o{i}", F.col(o) if isinstance(o, str) else o)
        return cls(out, [f"__o{i}" for i in range(len(order_by))])

    @classmethod
    def literal(cls, spark: SparkSession, rows: list, schema: str | T.StructType) -> Rel:
        """Constant rows, in the order in which they are given."""
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        whole = T.StructType([*kind.fields, T.StructField("__o0", T.LongType())])
        return cls(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], whole), ["__o0"])

    @classmethod
    def sequence(cls, spark: SparkSession, start: int, end: int) -> Rel:
        """start, start + 1, ..., end - 1 as ``value``."""
        return cls.of(spark.range(start, max(start, end)).select(F.col("id").alias("value")), "value")

    # Shape

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__o")]

    @property
    def rows(self) -> Fields:
        return Fields(self)

    def _need(self, what: str) -> list[str]:
        if not self.order:
            raise OrderError(f"{what} needs an order; sort first")
        return list(self.order)

    def _ordered(self, df: DataFrame, orders: list[Column]) -> Rel:
        """A relation whose hidden columns are ``orders``."""
        out = df.select(*[c for c in df.columns if not c.startswith("__o")], *[o.alias(f"__o{i}") for i, o in enumerate(orders)])
        return Rel(out, [f"__o{i}" for i in range(len(orders))])

    def frame(self, ordered: bool = False) -> DataFrame:
        """The visible columns; ``ordered``: sorted."""
        df = self.df.orderBy(*[F.col(o).asc_nulls_first() for o in self.order]) if ordered and self.order else self.df
        return df.select(*[F.col(f"`{c}`") for c in self.columns])

    def let(self) -> Rel:
        """These rows, evaluated once: a written table that every use reads."""
        return Rel(written(self.df), self.order)

    # Projection, filter, order

    def map(self, f: Callable[[Fields], Column | dict[str, Column]]) -> Rel:
        new = _named(f(self.rows))
        return Rel(self.df.select(*[c.alias(n) for n, c in new.items()], *self.order), self.order)

    def flat_map(self, f: Callable[[Fields], Column]) -> Rel:
        """The items of an array made from each row; structs become columns."""
        pos = self.df.select(*self.order, F.posexplode(f(self.rows)).alias("__p", "__x"))
        item = pos.schema["__x"].dataType
        own = [F.col("__x")[n].alias(n) for n in item.names] if isinstance(item, T.StructType) else [F.col("__x").alias("value")]
        new = [f"__o{i}" for i in range(len(self.order) + 1)]
        if not self.order:
            return Rel(pos.select(*own))
        return Rel(pos.select(*own, *self.order, F.col("__p").alias(new[-1])), new)

    def filter(self, p: Callable[[Fields], Column]) -> Rel:
        return Rel(self.df.where(p(self.rows)), self.order)

    def sort(self, *keys: Key) -> Rel:
        """Ascending by the keys, stable: the old order decides among equals."""
        return self._ordered(self.df, [k(self.rows) for k in keys] + [F.col(o) for o in self.order])

    def find(self, p: Callable[[Fields], Column]) -> Rel:
        """The first row that fits, if any."""
        return self.filter(p).slice(0, 1)

    def index(self, i: int) -> Rel:
        """The row at a 0-based place, if there is one."""
        return self.slice(i, i + 1) if i >= 0 else Rel(self.df.where(F.lit(False)), self.order)

    def slice(self, start: int, end: int) -> Rel:
        """Rows from ``start`` to before ``end``; negative places count from the end."""
        self._need("slice")
        if start < 0 or end < 0:
            n = self.df.count()
            start, end = (max(0, x + n) if x < 0 else x for x in (start, end))
        if end <= start:
            return Rel(self.df.where(F.lit(False)), self.order)
        df = self.df.orderBy(*[F.col(o).asc_nulls_first() for o in self.order])
        return Rel((df.offset(start) if start else df).limit(end - start), self.order)

    def append(self, other: Rel) -> Rel:
        """The rows of both, these first."""
        left, right = self.columns, other.columns
        if len(left) != len(right):
            raise ValueError("relations with other columns")
        n = max(len(self.order), len(other.order))
        same = [isinstance(self.df.schema[a].dataType, type(other.df.schema[b].dataType)) for a, b in zip(self.order, other.order, strict=False)]
        a, b = self, other
        if n and (not all(same) or len(self.order) != len(other.order)):
            a, b = self._renumbered(), other._renumbered()
            n = 1
        frames = [r.df.select(*[F.col(c).alias(d) for c, d in zip(r.columns, left, strict=True)], F.lit(k).alias("__o0"), *[F.col(o).alias(f"__o{i + 1}") for i, o in enumerate(r.order)]) for k, r in enumerate((a, b))]
        return Rel(frames[0].unionAll(frames[1]), [f"__o{i}" for i in range(n + 1)])

    def _renumbered(self) -> Rel:
        if not self.order:
            return Rel(self.df.withColumn("__o0", F.lit(0).cast("long")), ["__o0"])
        placed = ranges.with_index(self.df, list(self.order), "__idx")
        return self._ordered(placed, [F.col("__idx")])._without("__idx")

    def _without(self, name: str) -> Rel:
        return Rel(self.df.drop(name), self.order)

    def with_index(self, name: str = "index") -> Rel:
        """The rows with their dense 0-based place."""
        return Rel(ranges.with_index(self.df, self._need("index"), name), self.order)

    def zip(self, other: Rel) -> Rel:
        """Rows at equal places side by side, up to the shorter; names that clash get the suffix ``_1``."""
        a = ranges.with_index(self.df, self._need("zip"), "__idx").select("__idx", *self.columns)
        clash = {c: f"{c}_1" if c in self.columns else c for c in other.columns}
        b = ranges.with_index(other.df, other._need("zip"), "__idx").select("__idx", *[F.col(c).alias(n) for c, n in clash.items()])
        return self._ordered(a.join(b, "__idx"), [F.col("__idx")])._without("__idx")

    def distinct(self) -> Rel:
        return Rel(self.frame().distinct())

    # Columnar views

    def to_columnar(self) -> Rel:
        """One row of arrays, each a column in order."""
        items = Items(self.df, self.order)
        return Rel(self.df.agg(*[items.values(c).alias(c) for c in self.columns]))

    def from_columnar(self) -> Rel:
        """Rows from a row of arrays, up to the shortest."""
        from ..functions import arrays

        if not self.columns:
            return Rel(self.df.where(F.lit(False)))
        zipped = arrays.from_columnar({c: F.col(c) for c in self.columns})
        pos = self.df.select(*self.order, F.posexplode(zipped).alias("__p", "__x"))
        out = pos.select(*[F.col("__x")[c].alias(c) for c in self.columns], *[F.col(o) for o in self.order], F.col("__p").alias(f"__o{len(self.order)}"))
        return Rel(out, [f"__o{i}" for i in range(len(self.order) + 1)])

    def map_columnar(self, partition_by: Iterable[str] = (), **columns: Callable[[Windows], Column]) -> Rel:
        """Window columns beside the present ones; no array is built."""
        return self.windows(partition_by, **columns)

    def aggregate(self, f: Callable[[Items], dict[str, Column]]) -> DataFrame:
        """One row of aggregates over all rows."""
        return self.df.agg(*[c.alias(n) for n, c in f(Items(self.df, self.order)).items()])

    # Groups

    def group_map(self, key: Callable[[Fields], Column | dict[str, Column]], f: Callable[[Items], dict[str, Column]]) -> Rel:
        """One row for each key: the key's columns and aggregates of its rows."""
        keys = {("key" if n == "value" else n): c for n, c in _named(key(self.rows)).items()}
        out = f(Items(self.df, self.order))
        return Rel(self.df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in out.items()]))

    def group(self, key: Callable[[Fields], Column | dict[str, Column]]) -> Rel:
        """Each key with its rows as an array in order; prefer ``group_map`` where an aggregate will do."""
        return self.group_map(key, lambda items: {"values": items.values(*self.columns) if len(self.columns) > 1 else items.values(self.columns[0])})

    # Windows

    def windows(self, partition_by: Iterable[str] = (), **columns: Callable[[Windows], Column]) -> Rel:
        """Columns over the rows in order, by partition if there are keys; rows stay in their order."""
        keys = list(partition_by)
        if keys:
            w = Windows(self, Window.partitionBy(*keys))
            return Rel(self.df.withColumns({n: f(w) for n, f in columns.items()}), self.order)
        probe = Windows(self, None)
        order = self._need("a window")
        made = {n: (lambda own, f=f: f(Windows(self, None, own))) for n, f in columns.items()}
        for f in columns.values():
            f(probe)
        return Rel(ranges.over_frame(self.df, order, probe.reach, made), self.order)

    def ranks(self, key: Key, **names: str) -> Rel:
        """Columns by kind (rank, rank_dense, rank_percentile, cume_dist) over all rows: ``rank="r"``."""
        keyed = self.df.withColumn("__key", key(self.rows))
        return Rel(ranges.with_ranks(keyed, "__key", names).drop("__key"), self.order)

    def running_sum(self, value: Key, name: str) -> Rel:
        """``scan`` with addition."""
        return Rel(ranges.with_running_sum(self.df, self._need("scan"), value(self.rows), name), self.order)

    def scan(self, start: Column, f: Callable[[Column, Column], Column], value: Key, kind: T.DataType, name: str, partition_by: Iterable[str] = ()) -> Rel:
        """The accumulators of any function, by partition; each partition's values are one array."""
        from ..functions import arrays

        keys = list(partition_by)
        held = self.df.withColumn("__v", value(self.rows))
        item = F.struct(*[F.col(o) for o in self._need("scan")], F.struct(*[F.col(f"`{c}`") for c in [*self.columns, "__v"]]).alias("x"))
        rows = held.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__all"))
        accs = arrays.scan(F.transform("__all", lambda s: s["x"]["__v"]), start, f, kind)
        out = rows.select(F.explode(F.arrays_zip(F.col("__all").alias("s"), accs.alias("a"))).alias("z"))
        return Rel(out.select(*[F.col(f"z.s.x.`{c}`").alias(c) for c in self.columns], F.col("z.a").alias(name), *[F.col(f"z.s.{o}").alias(o) for o in self.order]), self.order)

    # Joins

    def _pair(self, other: Rel) -> tuple[DataFrame, DataFrame, Fields, Fields]:
        return self.df.alias("l"), other.df.alias("r"), Fields(self, "l"), Fields(other, "r")

    def flat_join(self, other: Rel, on: Callable[[Fields, Fields], Column], select: Callable[[Fields, Fields], dict[str, Column]], how: str = "inner") -> Rel:
        """``flat_map`` over the rows of ``other`` that fit: an inner (or left) join, in order."""
        l, r, lf, rf = self._pair(other)
        orders = [F.col(f"l.{o}") for o in self.order] + [F.col(f"r.{o}") for o in other.order] if self.order else []
        out = l.join(r, on(lf, rf), how).select(*[c.alias(n) for n, c in select(lf, rf).items()], *[o.alias(f"__o{i}") for i, o in enumerate(orders)])
        return Rel(out, [f"__o{i}" for i in range(len(orders))])

    def cross(self, other: Rel, select: Callable[[Fields, Fields], dict[str, Column]]) -> Rel:
        """All pairs: the product is what is asked for."""
        l, r, lf, rf = self._pair(other)
        orders = [F.col(f"l.{o}") for o in self.order] + [F.col(f"r.{o}") for o in other.order] if self.order else []
        out = l.crossJoin(r).select(*[c.alias(n) for n, c in select(lf, rf).items()], *[o.alias(f"__o{i}") for i, o in enumerate(orders)])
        return Rel(out, [f"__o{i}" for i in range(len(orders))])

    def lookup(self, other: Rel, keys: dict[str, str], take: Iterable[str], defaults: bool = True) -> Rel:
        """Columns of the first row of ``other`` with equal keys (own to other); else the types' defaults, or none."""
        take = list(take)
        item = F.struct(*[F.col(f"`{c}`") for c in take])
        first = F.min_by(item, F.struct(*other.order)) if other.order else F.first(item)
        firsts = other.df.groupBy(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(keys.values())]).agg(first.alias("__first"))
        on = [F.col(a).eqNullSafe(F.col(f"__k{i}")) for i, a in enumerate(keys)]
        out = self.df.join(firsts, on, "left")
        kinds = {c: other.df.schema[c].dataType for c in take}
        got = {c: F.col("__first")[c] for c in take}
        return Rel(out.select(*[F.col(f"`{c}`") for c in self.columns], *[(F.coalesce(x, default_for(kinds[c])) if defaults else x).alias(c) for c, x in got.items()], *self.order), self.order)

    def nest_join(self, other: Rel, keys: dict[str, str], name: str, take: Iterable[str]) -> Rel:
        """The rows of ``other`` with equal keys as an array column, in order; empty where there are none."""
        values = Items(other.df, other.order).values(*take)
        nested = other.df.groupBy(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(keys.values())]).agg(values.alias(name))
        kind = nested.schema[name].dataType
        out = self.df.join(nested, [F.col(a).eqNullSafe(F.col(f"__k{i}")) for i, a in enumerate(keys)], "left")
        return Rel(out.select(*[F.col(f"`{c}`") for c in self.columns], F.coalesce(F.col(name), F.array().cast(kind)).alias(name), *self.order), self.order)

    def semi(self, other: Rel, on: Callable[[Fields, Fields], Column]) -> Rel:
        """Rows that some row of ``other`` fits."""
        return self._kept(other, on, "left_semi")

    def anti(self, other: Rel, on: Callable[[Fields, Fields], Column]) -> Rel:
        """Rows that no row of ``other`` fits."""
        return self._kept(other, on, "left_anti")

    def _kept(self, other: Rel, on: Callable[[Fields, Fields], Column], how: str) -> Rel:
        l, r, lf, rf = self._pair(other)
        return Rel(l.join(r, on(lf, rf), how), self.order)

    def intersect(self, other: Rel) -> Rel:
        """Rows that ``other`` contains; repeats stay."""
        return self._kept(other, self._same(other), "left_semi")

    def except_(self, other: Rel) -> Rel:
        return self._kept(other, self._same(other), "left_anti")

    def _same(self, other: Rel) -> Callable[[Fields, Fields], Column]:
        def on(l: Fields, r: Fields) -> Column:
            parts = [l[a].eqNullSafe(r[b]) for a, b in zip(self.columns, other.columns, strict=True)]
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out

        return on

    # Iteration

    def loop_until_empty(self, step: Callable[[Rel], Rel], limit: int = 1000) -> Rel:
        """All generations one after another: this one, its step, that one's step, up to an empty one.

        Each generation is a written table, so plans do not grow and lost executors cost one step.
        """
        parts: list[DataFrame] = []
        now = self
        names = self.columns
        for _ in range(limit):
            order = now.order
            df = written(now.df.select(*names, *order))
            if df.isEmpty():
                break
            held = Rel(df, order)
            parts.append((held if order else Rel(df.withColumn("__o0", F.lit(0)), ["__o0"])).df)
            now = step(held)
        else:
            raise RuntimeError(f"not empty after {limit} generations")
        out: DataFrame | None = None
        for i, df in enumerate(parts):
            hidden = [c for c in df.columns if c.startswith("__o")]
            own = df.select(*names, F.struct(F.lit(i).alias("generation"), F.hash(*names).alias("tie")).alias("__o0")) if len({tuple(p.columns) for p in parts}) > 1 else df.select(*names, F.lit(i).alias("__o0"), *[F.col(h).alias(f"__o{k + 1}") for k, h in enumerate(hidden)])
            out = own if out is None else out.unionAll(own)
        if out is None:
            return Rel(self.df.where(F.lit(False)), self.order)
        return Rel(out, [c for c in out.columns if c.startswith("__o")])


class Windows:
    """Window functions over a relation's order; out-of-range places of lag and lead take the type's default."""

    def __init__(self, rel: Rel, by: object, ordered: object = None) -> None:
        self.rel, self.by, self.reach = rel, by, 0
        self.ordered = ordered

    def _window(self):
        if self.ordered is not None:
            return self.ordered
        orders = [F.col(o).asc_nulls_first() for o in self.rel._need("a window")]
        return self.by.orderBy(*orders) if self.by is not None else Window.orderBy(*orders)

    def lag(self, x: str, n: int = 1) -> Column:
        self.reach = max(self.reach, abs(n))
        from ..functions.types import default_value

        kind = self.rel.df.schema[x].dataType
        if isinstance(kind, (T.StructType, T.ArrayType)):
            # Spark takes no nested default: whether the place is there is asked apart, so that stored nones stay.
            there = F.lag(F.lit(True), n).over(self._window())
            return F.when(there.isNotNull(), F.lag(x, n).over(self._window())).otherwise(default_for(kind))
        return F.lag(x, n, default_value(kind)).over(self._window())

    def lead(self, x: str, n: int = 1) -> Column:
        return self.lag(x, -n)

    def rolling_mean(self, x: str, preceding: int, following: int) -> Column:
        self.reach = max(self.reach, preceding, following)
        return F.avg(x).over(self._window().rowsBetween(-preceding, following))

    def running(self, aggregate: Callable[[str], Column], x: str) -> Column:
        """A running aggregate (sum, min, max, count); with partitions only."""
        if self.by is None:
            raise ValueError("over all rows use running_sum")
        return aggregate(x).over(self._window().rowsBetween(Window.unboundedPreceding, 0))

    def _by_value(self, x: str):
        if self.by is None:
            raise ValueError("over all rows use ranks")
        return self.by.orderBy(F.col(x).asc_nulls_first())

    def rank(self, x: str) -> Column:
        return F.rank().over(self._by_value(x)).cast("int")

    def rank_dense(self, x: str) -> Column:
        return F.dense_rank().over(self._by_value(x)).cast("int")

    def rank_percentile(self, x: str) -> Column:
        return F.percent_rank().over(self._by_value(x))

    def cume_dist(self, x: str) -> Column:
        return F.cume_dist().over(self._by_value(x))
