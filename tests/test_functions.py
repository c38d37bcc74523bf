"""Scalar and array functions: edge cases of conversions, text, options, unions and nested operators."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays, convert, ops, option, temporal, text
from tessera.functions import math as M
from tessera.functions import types as K
from tessera.functions.enums import Enum


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


CASTS = [
    (-700, K.Int16, K.Int8, 68),
    (1000, K.Int32, K.Int8, -24),
    (-1, K.Int8, K.Uint8, 255),
    (-1, K.Int64, K.Uint16, 65535),
    (-1, K.Int32, K.Uint32, 4294967295),
    (-1, K.Int64, K.Uint64, 18446744073709551615),
    (4294967295, K.Uint32, K.Int32, -1),
    (2**63, K.Uint64, K.Int64, -(2**63)),
    (2**64 - 2, K.Uint64, K.Int8, -2),
    (8192.75, K.Float64, K.Int8, 127),
    (-6.75, K.Float64, K.Int32, -6),
    (-6.75, K.Float64, K.Uint32, 0),
    (1e30, K.Float64, K.Int64, 2**63 - 1),
    (-1e30, K.Float32, K.Int64, -(2**63)),
    (1e30, K.Float64, K.Uint64, 2**64 - 1),
    (float("nan"), K.Float64, K.Int16, 0),
    (5, K.Int8, K.Float64, 5.0),
]


@pytest.mark.parametrize("value,source,target,want", CASTS)
def test_casts(spark, value, source, target, want):
    x = F.lit(str(value)).cast(source.spark) if source is K.Uint64 else F.lit(value).cast(source.spark)
    assert one(spark, convert.to(x, target, source)) == want


@pytest.mark.parametrize("value,want", [(4.0, "4"), (-77008.0, "-77008"), (0.375, "0.375"), (6.5e-8, "0.000000065"), (3.5e11, "350000000000"), (-7.5e-6, "-0.0000075"), (0.0, "0"), (90210.125, "90210.125"), (4e22, "4" + "0" * 22)])
def test_float_text(spark, value, want):
    assert one(spark, convert.to_text(F.lit(value), K.Float64)) == want


def test_integer_division_and_remainder(spark):
    for a in (-7, 7):
        for b in (-2, 2):
            assert one(spark, ops.div(F.lit(a), F.lit(b), K.Int32)) == int(a / b)
            assert one(spark, ops.mod(F.lit(a), F.lit(b))) == math.fmod(a, b)
    assert one(spark, M.pow_(F.lit(3), F.lit(39), integer=True)) == 3**39


@pytest.mark.parametrize("a,b", [(17999999999999999999, 9000000000000000000), (2**64 - 1, 2), (2**64 - 1, 2**64 - 1), (2**64 - 2, 2**64 - 1), (0, 7), (2**63, 3), (10**19, 10**19 - 1)])
def test_division_of_unsigned_64_bits(spark, a, b):
    x, y = (F.lit(str(v)).cast(K.Uint64.spark) for v in (a, b))
    assert one(spark, ops.div(x, y, K.Uint64)) == a // b and one(spark, ops.mod(x, y)) == a % b


def test_text(spark):
    assert one(spark, text.length(F.lit("šípek 🌲"))) == 7
    assert one(spark, text.split(F.lit("a.b..c"), ".")) == ["a", "b", "", "c"]
    assert one(spark, text.split(F.lit("ab"), "")) == ["", "a", "b", ""]
    assert one(spark, text.split(F.lit("a\\Eb"), "\\E")) == ["a", "b"]
    assert one(spark, text.contains(F.lit("100%"), "%")) and not one(spark, text.contains(F.lit("100"), "%"))
    assert not one(spark, text.starts_with(F.lit("abc"), "_b"))
    assert one(spark, text.join(F.array().cast("array<string>"), ",")) == ""


def test_option(spark):
    none = option.none(K.Int32)
    assert one(spark, option.or_default(none, K.Int32)) == 0
    assert one(spark, option.map_or(none, F.lit(4), lambda x: x + 1)) == 4
    assert one(spark, option.zip_(F.lit(1), none)) is None
    assert one(spark, option.zip_(F.lit(1), F.lit(2)))["_1"] == 2


def test_enum(spark):
    shape = Enum(circle=T.DoubleType(), square=T.DoubleType(), empty=None)
    a, b, c = shape.of("circle", F.lit(2.0)), shape.of("circle", F.lit(3.0)), shape.of("empty")
    assert one(spark, ops.cmp(a, b)) == 0 and one(spark, ops.cmp(c, b)) == 2 and one(spark, ops.cmp(a, a)) == 1
    assert one(spark, shape.match(b, F.lit(0.0), circle=lambda r: r * 2)) == 6.0
    assert one(spark, ops.match(F.lit(3), ((1, 2), F.lit("low")), (3, F.lit("three")), otherwise=F.lit("more"))) == "three"


def test_arrays(spark):
    a = F.array(*map(F.lit, [8, 4, 31, 4, 1]))
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.sort(a, lambda x: -x)) == [31, 8, 4, 4, 1]
    assert one(spark, arrays.slice_(a, 1, -1)) == [4, 31, 4]
    assert one(spark, arrays.slice_(a, -2, 99)) == [4, 1]
    assert one(spark, arrays.index(a, -1)) is None and one(spark, arrays.index(a, 9)) is None
    assert one(spark, arrays.sequence(7, 3)) == [] and one(spark, arrays.sequence(3, 6)) == [3, 4, 5]
    assert one(spark, arrays.lag(a, 2, T.IntegerType())) == [0, 0, 8, 4, 31]
    assert one(spark, arrays.lead(a, 1, T.IntegerType())) == [4, 31, 4, 1, 0]
    assert one(spark, arrays.rank(a)) == [4, 2, 5, 2, 1] and one(spark, arrays.rank_dense(a)) == [3, 2, 4, 2, 1]
    assert one(spark, arrays.rolling_mean(a, 1, 1)) == pytest.approx([6, 43 / 3, 13, 12, 2.5])
    assert one(spark, arrays.scan(a, F.lit(0), lambda s, x: s + x, T.LongType())) == [8, 12, 43, 47, 48]
    assert one(spark, arrays.sum_(empty, T.IntegerType())) == 0 and math.isnan(one(spark, arrays.mean(empty)))
    assert one(spark, arrays.all_(F.array().cast("array<boolean>"))) and not one(spark, arrays.any_(F.array().cast("array<boolean>")))
    assert [tuple(x) for x in one(spark, arrays.zip_(a, F.array(F.lit("x"), F.lit("y"))))] == [(8, "x"), (4, "y")]
    assert [tuple(x) for x in one(spark, arrays.from_columnar({"p": a, "q": F.array(F.lit(1))}))] == [(8, 1)]
    rows = F.array(F.struct(F.lit(1).alias("n"), F.lit("x").alias("t")), F.struct(F.lit(2).alias("n"), F.lit("y").alias("t")))
    assert tuple(one(spark, arrays.to_columnar(rows, ["t", "n"]))) == (["x", "y"], [1, 2])
    assert [(g["key"], g["values"]) for g in one(spark, arrays.group(a, lambda x: x % 2))] == [(0, [8, 4, 4]), (1, [31, 1])]
    assert one(spark, arrays.cume_dist(F.array(*map(F.lit, "abbc")))) == [0.25, 0.75, 0.75, 1.0]
    assert one(spark, arrays.rank_percentile(F.array(*map(F.lit, "abbc")))) == pytest.approx([0, 1 / 3, 1 / 3, 1])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_long_arrays(spark, n):
    """Scans and ranks of arrays around the size of a chunk."""
    xs = [(i * 37) % 11 if i % 5 else None for i in range(n)]
    a = F.lit(",".join("" if x is None else str(x) for x in xs))
    a = F.transform(F.split(a, ","), lambda t: F.when(t != "", t).cast("int")) if n else F.array().cast("array<int>")
    got = spark.range(1).select(arrays.scan(a, F.lit(5), lambda s, x: (s * 3 + F.coalesce(x, F.lit(7))) % 1009, T.LongType()).alias("s"), arrays.rank(a).alias("r"), arrays.rank_dense(a).alias("d"), arrays.cume_dist(a).alias("c"), arrays.rank_percentile(a).alias("p")).first()
    accs, acc = [], 5
    for x in xs:
        acc = (acc * 3 + (7 if x is None else x)) % 1009
        accs.append(acc)
    key = lambda x: (x is not None, x or 0)
    order = sorted(map(key, xs))
    ranks = [order.index(key(x)) + 1 for x in xs]
    kinds = list(dict.fromkeys(order))
    assert got.s == accs and got.r == ranks and got.d == [kinds.index(key(x)) + 1 for x in xs]
    assert got.c == pytest.approx([(r - 1 + order.count(key(x))) / n for r, x in zip(ranks, xs, strict=True)])
    assert got.p == pytest.approx([(r - 1) / max(1, n - 1) for r in ranks])


def test_defaults(spark):
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.ArrayType(T.LongType()))])
    assert tuple(one(spark, K.default_for(kind))) == (0, "", [])
    assert one(spark, K.default_for(K.Bool)) is False


def test_local_times_that_a_zone_skips_or_repeats(spark):
    """Midnight of a change of clocks is refused where that is asked for; Spark's rule holds elsewhere."""
    midnight = lambda day, zone, **how: one(spark, temporal.date_to_timestamp(F.lit(day).cast("date"), zone, **how).cast("string"))
    assert midnight("2024-07-01", "Europe/Riga", strict=True) == midnight("2024-07-01", "Europe/Riga") == "2024-06-30 21:00:00"
    assert midnight("2018-11-04", "America/Sao_Paulo")  # skipped
    for day, zone in (("2018-11-04", "America/Sao_Paulo"), ("2018-02-18", "Asia/Beirut"), ("2021-03-28", "Asia/Beirut"), ("2021-11-07", "America/Havana")):
        local = midnight(day, zone)
        assert local
        if (day, zone) != ("2018-02-18", "Asia/Beirut"):
            with pytest.raises(Exception, match="no single instant"):
                midnight(day, zone, strict=True)


def test_time_wraps(spark):
    assert one(spark, temporal.time_add(F.lit(80_000_000_000), temporal.duration(F.lit(10_000_000_000)))) == 3_600_000_000
    assert one(spark, temporal.time_sub(F.lit(1), temporal.duration(F.lit(2)))) == temporal.DAY_US - 1
