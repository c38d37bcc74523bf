"""Aggregates with results for empty input: count and sum 0, mean NaN, all true, any false, min and max none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import default_for


class Items:
    """What a group or a whole relation offers to aggregate: each method is one aggregate Column.

    So a group is only made into an array where ``values`` asks for it.
    """

    def __init__(self, df: DataFrame, order: tuple[str, ...] = ()) -> None:
        self.df, self.order = df, order

    def _column(self, x: Column | str) -> Column:
        return self.df[x] if isinstance(x, str) else x

    def _type(self, x: Column | str) -> T.DataType:
        return self.df.schema[x].dataType if isinstance(x, str) else self.df.select(x).schema[0].dataType

    def count(self) -> Column:
        """Items, none ones too."""
        return F.count(F.lit(1))

    def is_empty(self) -> Column:
        return self.count() == 0

    def sum(self, x: Column | str) -> Column:
        """The sum, of the items' type."""
        kind = self._type(x)
        return F.coalesce(F.sum(self._column(x)).cast(kind), default_for(kind))

    def mean(self, x: Column | str) -> Column:
        return F.coalesce(F.avg(self._column(x)).cast("double"), F.lit(float("nan")))

    def min(self, x: Column | str) -> Column:
        return F.min(self._column(x))

    def max(self, x: Column | str) -> Column:
        return F.max(self._column(x))

    def all(self, p: Column | str) -> Column:
        return F.coalesce(F.bool_and(self._column(p)), F.lit(True))

    def any(self, p: Column | str) -> Column:
        return F.coalesce(F.bool_or(self._column(p)), F.lit(False))

    def contains(self, x: Column | str, value: Column) -> Column:
        return F.coalesce(F.bool_or(self._column(x).eqNullSafe(value)), F.lit(False))

    def values(self, *columns: Column | str) -> Column:
        """The items (or some columns of them) as an array in the relation's order."""
        own = [self._column(c) for c in columns or [c for c in self.df.columns if not c.startswith("__o")]]
        item = own[0] if len(columns) == 1 else F.struct(*own)
        if not self.order:
            return F.collect_list(F.struct(item.alias("x")))["x"]
        keyed = F.collect_list(F.struct(*[F.col(o) for o in self.order], item.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])

    def join_text(self, x: Column | str, sep: str) -> Column:
        """The texts in the relation's order with ``sep`` between them; empty for none."""
        return F.array_join(self.values(x), sep)

    def distinct_count(self, *columns: str) -> Column:
        """``distinct | count`` as one aggregate."""
        return F.count_distinct(F.struct(*[self._column(c) for c in columns]))

    def fold(self, start: Column, f, *columns: Column | str) -> Column:
        """A fold over the items in order, where no aggregate expresses it."""
        return F.aggregate(self.values(*columns), start, f)
