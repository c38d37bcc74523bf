"""Positions, ranks and running totals over a whole relation without one task that sees all rows.

Small inputs (by the optimizer's estimate) take a plain window. Others are cut into ranges of the whole
order, as many as there are shuffle partitions; each range is numbered by itself, and the ranges' totals,
one row each, are added. Ranks are found for distinct keys, which rows look up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written

#: An estimate from which nothing is known of the size; then, rows that are few.
UNKNOWN, SMALL_ROWS = 1 << 56, 10_000
#: Estimated bytes up to which one window without partitions is used.
SMALL_BYTES = 16 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame) -> bool:
    size = estimated_bytes(df)
    if size >= UNKNOWN:
        return len(df.select(F.lit(1)).take(SMALL_ROWS + 1)) <= SMALL_ROWS
    return size <= SMALL_BYTES


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df``, written, with ``__r``, the range of each row by the whole order, and ``__t``, which decides among rows that are equal in it.

    Spark samples the keys and cuts them into ranges of about equal size, as many as the session has shuffle
    partitions (adaptive execution unites neighbours that are small); a frequent first key, or even a constant one,
    is parted by the others and by ``__t``.
    """
    placed = df.withColumn("__t", F.monotonically_increasing_id())
    by = [F.col(o).asc_nulls_first() for o in [*order, "__t"]]
    cut = placed.repartitionByRange(ranges, *by) if ranges else placed.repartitionByRange(*by)
    return written(cut.withColumn("__r", F.spark_partition_id()))


def _before(df: DataFrame, *totals: Column) -> DataFrame:
    """For each range the sums of the ranges before it, and the sums of all."""
    sums = df.groupBy("__r").agg(*totals)
    names = [c for c in sums.columns if c != "__r"]
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sums.select("__r", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in names], *[F.sum(n).over(every).alias(f"{n}_all") for n in names])


def with_index(df: DataFrame, order: list[str], name: str = "__idx", small: bool | None = None) -> DataFrame:
    """``df`` with the dense 0-based place of each row."""
    by = [F.col(o).asc_nulls_first() for o in order]
    if is_small(df) if small is None else small:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long") - 1)
    cut = in_ranges(df, order)
    totals = _before(cut, F.count(F.lit(1)).alias("__n"))
    own = F.row_number().over(Window.partitionBy("__r").orderBy(*by, "__t")).cast("long") - 1
    return cut.withColumn("__own", own).join(F.broadcast(totals), "__r").withColumn(name, F.col("__own") + F.col("__n_before")).drop("__r", "__t", "__own", "__n_before", "__n_all")


def with_ranks(df: DataFrame, key: str, names: dict[str, str], small: bool | None = None) -> DataFrame:
    """``df`` with rank, rank_dense, rank_percentile or cume_dist of ``key`` (``names``: kind to column)."""
    by = F.col(key).asc_nulls_first()
    plain = {"rank": F.rank, "rank_dense": F.dense_rank, "rank_percentile": F.percent_rank, "cume_dist": F.cume_dist}
    if is_small(df) if small is None else small:
        w = Window.orderBy(by)
        for kind, name in names.items():
            out = plain[kind]().over(w)
            df = df.withColumn(name, out.cast("int") if kind in ("rank", "rank_dense") else out)
        return df
    # Ranks are of distinct keys, counted before anything is shuffled; rows only look them up.
    counts = written(df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")))
    n = counts.agg(F.sum("__n")).first()[0] or 0
    counts = with_running_sum(with_index(counts, ["__k"], "__dense"), ["__k"], F.col("__n"), "__upto")
    rank = F.col("__upto") - F.col("__n") + 1
    found = {
        "rank": rank.cast("int"),
        "rank_dense": (F.col("__dense") + 1).cast("int"),
        "rank_percentile": (rank - 1) / F.lit(max(n - 1, 1)),
        "cume_dist": F.col("__upto") / F.lit(max(n, 1)),
    }
    return df.join(counts, F.col(key).eqNullSafe(F.col("__k"))).select(*df.columns, *[found[k].alias(n) for k, n in names.items()])


def with_running_sum(df: DataFrame, order: list[str], value: Column, name: str, small: bool | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row."""
    by = [F.col(o).asc_nulls_first() for o in order]
    if is_small(df) if small is None else small:
        return df.withColumn(name, F.sum(value).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    cut = in_ranges(df.withColumn("__v", value), order)
    totals = _before(cut, F.sum("__v").alias("__s"))
    own = F.sum("__v").over(Window.partitionBy("__r").orderBy(*by, "__t").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__own", own).join(F.broadcast(totals), "__r").withColumn(name, F.col("__own") + F.col("__s_before")).drop("__v", "__r", "__t", "__own", "__s_before", "__s_all")


def over_frame(df: DataFrame, order: list[str], reach: int, columns: dict[str, object], small: bool | None = None, block: int = 1 << 16) -> DataFrame:
    """``df`` with window columns (name to Window -> Column) that look at most ``reach`` rows before or after.

    Larger inputs are cut into blocks of rows, each with copies of the rows within reach of it.
    """
    by = [F.col(o).asc_nulls_first() for o in order]
    if is_small(df) if small is None else small:
        return df.withColumns({n: f(Window.orderBy(*by)) for n, f in columns.items()})
    block = max(block, reach + 1)
    placed = with_index(df, order, "__idx", small=False)
    first, last = F.floor((F.col("__idx") - reach) / block), F.floor((F.col("__idx") + reach) / block)
    placed = placed.withColumn("__b", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    w = Window.partitionBy("__b").orderBy("__idx")
    out = placed.withColumns({n: f(w) for n, f in columns.items()})
    return out.where(F.col("__b") == F.floor(F.col("__idx") / block)).drop("__b", "__idx")
