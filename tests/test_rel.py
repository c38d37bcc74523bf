"""Relations: order, positions, windows over ranges, joins, iteration, tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import host
from tessera.functions import types as K
from tessera.operators import ranges
from tessera.operators.rel import OrderError, Rel
from tessera.plans import queries  # noqa: F401  (declares the host function)
from tessera.sources import tables


def ints(spark, xs):
    return Rel.literal(spark, [(x,) for x in xs], "x int")


def out(rel, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rel.frame(ordered=True).collect()]


def test_stable_sort_and_slices(spark):
    r = Rel.literal(spark, [(1, "a"), (0, "b"), (1, "c"), (0, "d")], "k int, t string")
    assert out(r.sort(lambda f: f.k), "t") == ["b", "d", "a", "c"]
    assert out(r.slice(1, 3), "t") == ["b", "c"] and out(r.slice(-3, -1), "t") == ["b", "c"]
    assert out(r.slice(3, 1), "t") == [] and out(r.index(-1), "t") == [] and out(r.index(2), "t") == ["c"]
    assert out(r.find(lambda f: f.k == 0), "t") == ["b"]


def test_order_is_asked_for(spark):
    with pytest.raises(OrderError):
        Rel(spark.range(3)).slice(0, 1)


def test_append_zip_flat_map(spark):
    a, b = ints(spark, [5, 3]), ints(spark, [9])
    assert out(a.append(b), "x") == [5, 3, 9]
    assert out(a.sort(lambda f: f.x).append(b), "x") == [3, 5, 9]
    assert out(a.zip(b), "x", "x_1") == [(5, 9)]
    assert out(a.flat_map(lambda f: F.array(f.x, f.x + 1)), "value") == [5, 6, 3, 4]
    assert out(ints(spark, []).append(b), "x") == [9]


def test_columnar(spark):
    r = Rel.literal(spark, [(9, 4), (70, 1), (6, 8)], "a int, b int")
    assert out(r.to_columnar().from_columnar(), "a", "b") == [(9, 4), (70, 1), (6, 8)]
    assert out(r.sort(lambda f: f.a).to_columnar().from_columnar(), "a", "b") == [(6, 8), (9, 4), (70, 1)]
    assert out(r.map_columnar(p=lambda w: w.lag("a"), q=lambda w: w.lead("b", 2)), "p", "q") == [(0, 8), (9, 0), (70, 0)]


def test_lag_keeps_stored_none(spark):
    r = Rel.literal(spark, [(1,), (None,), (3,)], "x int")
    assert out(r.windows(p=lambda w: w.lag("x")), "p") == [0, 1, None]


def test_lag_of_tuples(spark):
    r = Rel.literal(spark, [((1, "a"),), ((2, "b"),)], "x struct<n:int,t:string>")
    assert [tuple(x) for x in out(r.windows(p=lambda w: w.lag("x")), "p")] == [(0, ""), (1, "a")]


def test_group_fuses(spark):
    r = ints(spark, [7, 10, 3, 7, 20])
    g = r.group_map(lambda f: f.x % 2, lambda i: {"n": i.count(), "s": i.sum("x")})
    assert sorted(map(tuple, g.frame().collect())) == [(0, 2, 30), (1, 3, 17)]
    plan = g.df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "HashAggregate" in plan
    held = r.group(lambda f: f.x % 2).frame().collect()
    assert sorted((k, v) for k, v in held) == [(0, [10, 20]), (1, [7, 3, 7])]
    assert g.df.schema["s"].dataType == T.IntegerType()


def test_group_by_text_and_none(spark):
    r = Rel.literal(spark, [("reed", 1), ("rush", 2), (None, 3), ("reed", 4)], "t string, x int")
    assert sorted(map(tuple, r.group_map(lambda f: f.t, lambda i: {"s": i.sum("x")}).frame().collect()), key=str) == [("reed", 5), ("rush", 2), (None, 3)]
    arrays = Rel.literal(spark, [([1, 2], 1), ([1], 2), ([1, 2], 3), (None, 4), ([None], 5)], "a array<int>, x int")
    assert sorted(map(tuple, arrays.group_map(lambda f: f.a, lambda i: {"s": i.sum("x")}).frame().collect()), key=str) == sorted([([1, 2], 4), ([1], 2), ([None], 5), (None, 4)], key=str)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_ranges_agree_with_plain_windows(spark, n):
    df = spark.range(n).select(F.col("id"), (F.hash("id") % 17).alias("k"), F.when(F.col("id") % 10 > 0, F.hash("id", F.lit(1)) % 50).alias("v")).repartition(3)
    ranges_ = ranges.in_ranges(df.withColumn("one", F.lit(1)), ["one", "id"], 8)
    assert n < 1000 or 4 <= ranges_.select("__r").distinct().count() <= 8  # a constant first key is parted by the others
    for order in (["k", "id"], ["v", "id"]):
        a, b = (ranges.with_index(df, order, small=s).orderBy("id").collect() for s in (True, False))
        assert a == b
        a, b = (ranges.with_running_sum(df, order, F.col("id"), "s", small=s).orderBy("id").collect() for s in (True, False))
        assert a == b
        frame = {"m": lambda w: F.sum("id").over(w.rowsBetween(-2, 3)), "p": lambda w: F.lag("id", 2).over(w)}
        a, b = (ranges.over_frame(df, order, 3, frame, small=s, block=7).orderBy("id").collect() for s in (True, False))
        assert a == b
    for key in ("k", "v"):
        names = {"rank": "a", "rank_dense": "b", "rank_percentile": "c", "cume_dist": "d"}
        a, b = (ranges.with_ranks(df, key, names, small=s).orderBy("id").collect() for s in (True, False))
        assert a == b


def test_joins(spark):
    a = Rel.literal(spark, [(1, "x"), (2, "y"), (3, "z")], "k int, t string")
    b = Rel.literal(spark, [(1, 10), (1, 11), (3, 30)], "k int, v int")
    on = lambda l, r: l.k == r.k
    assert out(a.flat_join(b, on, lambda l, r: {"t": l.t, "v": r.v}), "t", "v") == [("x", 10), ("x", 11), ("z", 30)]
    assert out(a.lookup(b, {"k": "k"}, ["v"]), "v") == [10, 0, 30]
    assert out(a.lookup(b, {"k": "k"}, ["v"], defaults=False), "v") == [10, None, 30]
    assert out(a.nest_join(b, {"k": "k"}, "vs", ["v"]), "vs") == [[10, 11], [], [30]]
    assert out(a.semi(b, on), "t") == ["x", "z"] and out(a.anti(b, on), "t") == ["y"]
    assert out(a.map(lambda f: f.k).intersect(b.map(lambda f: f.k)), "value") == [1, 3]


def test_loop_until_empty(spark):
    r = Rel.literal(spark, [(1, 0), (5, 0)], "id int, depth int").loop_until_empty(lambda g: g.map(lambda f: {"id": f.id * 2, "depth": f.depth + 1}).filter(lambda f: f.id < 12))
    assert out(r, "id", "depth") == [(1, 0), (5, 0), (2, 1), (10, 1), (4, 2), (8, 3)]
    assert out(ints(spark, []).loop_until_empty(lambda g: g), "x") == []


def test_scan_and_fold(spark):
    r = ints(spark, [5, 3, 65])
    assert out(r.scan(F.lit(1), lambda a, x: a * 2 + x, lambda f: f.x, T.LongType(), "acc"), "acc") == [7, 17, 99]
    assert r.aggregate(lambda i: {"f": i.fold(F.lit(0), lambda a, x: a * 10 + x, "x")}).first()["f"] == 595


def test_files_and_capabilities(spark, tmp_path):
    files = tables.Files(spark, str(tmp_path))
    files.write_parquet(ints(spark, [3, 1]), "a/b", single=True)
    assert sorted(out(files.read_parquet("a/b"), "x")) == [1, 3]
    assert files.pull("a/b") == {"x": "Int32"}
    with pytest.raises(PermissionError):
        files.path("../up")
    with pytest.raises(tables.NotSupported):
        tables.Capabilities("sql").require("fs")
    tables.Capabilities("sql::raw", "fs").grant(spark)
    try:
        assert sorted(out(files.read_parquet("a/b"), "x")) == [1, 3] and out(tables.raw(spark, "SELECT 2 AS v"), "v") == [2]
        for refused in (lambda: tables.from_table(spark, "t"), lambda: tables.insert(ints(spark, [1]), "t"), lambda: tables.delete(spark, "t", lambda r: r.x > 0), lambda: tables.update(spark, "t", lambda r: r.x > 0, lambda r: {}), lambda: host.lookup(spark, "tessera::digits")):
            with pytest.raises(tables.NotSupported):
                refused()
        tables.Capabilities("sql").grant(spark)
        for refused in (lambda: files.read_parquet("a/b"), lambda: files.write_parquet(ints(spark, [1]), "c")):
            with pytest.raises(tables.NotSupported):
                refused()
    finally:
        tables.Capabilities().grant(spark)
    with pytest.raises(tables.NotSupported):
        tables.declared(T.MapType(T.StringType(), T.StringType()))


def test_arrow_and_parameters(spark):
    r = ints(spark, [3, 1])
    assert tables.to_arrow(r).to_pydict() == {"x": [3, 1]}
    assert out(tables.with_parameters(spark, {"a": 4, "t": "x"}, "a int, t string"), "a", "t") == [(4, "x")]
    assert out(tables.raw(spark, "SELECT :n + 1", "v int", n=4), "v") == [5]
    assert out(tables.raw(spark, "SELECT array_contains(:xs, 3) AND size(:xs) = 2", "v boolean", xs=[3, 4]), "v") == [True]
    assert out(tables.from_arrow(spark, tables.to_arrow(r)), "x") == [3, 1]


def test_shown_and_pulled(spark):
    r = Rel.of(spark.createDataFrame([(2, "b"), (1, "a")], "x int, t string"), "x")
    assert [line.replace(" ", "") for line in tables.show(r, 1).splitlines()[1:4:2]] == ["|x|t|", "|1|a|"]
    spark.sql("CREATE TABLE tessera_pulled (n INT, d DECIMAL(19,2), xs ARRAY<STRING>) USING parquet")
    try:
        assert tables.pull_table(spark, "tessera_pulled") == {"n": "Int32?", "d": "Decimal?", "xs": "[Text]?"}
    finally:
        spark.sql("DROP TABLE tessera_pulled")


def test_let_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)
    once = F.udf(lambda x: (seen.add(1), x)[1], "long")
    held = Rel(spark.range(5).select(once("id").alias("x"))).let()
    assert sorted(out(held.flat_join(held, lambda a, b: a.x == b.x, lambda a, b: {"x": b.x}), "x")) == [0, 1, 2, 3, 4] and seen.value == 5


def test_host_functions_check_their_arguments(spark):
    with pytest.raises(TypeError):
        host.FUNCTIONS["tessera::digits"](F.lit(1))
    with pytest.raises(ValueError):
        host.external("tessera::digits", [], K.Int32)(len)
    assert spark.range(1).select(host.lookup(spark, "tessera::digits")(F.lit("1203"), F.lit(10.0)).alias("x")).first()["x"] == 6


def test_filter_and_columns_reach_the_scan(spark):
    rows = Rel(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).filter(lambda r: r.l_quantity > 49).map(lambda r: {"k": r.l_orderkey})
    plan = rows.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
