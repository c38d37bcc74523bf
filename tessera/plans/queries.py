"""One query for each operator, over whole driver tables, with the SQL that states its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, convert, host, math, ops, option, temporal, text
from ..functions import types as K
from ..functions.enums import Enum
from ..operators.rel import Rel
from ..session import load
from ..sources import tables
from ..sources.staging import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def money(x):
    """Exact sums of doubles that hold cents."""
    return x.cast("decimal(18,2)")


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def q1_pricing_summary(spark, d):
    """filter | group_map(sum, mean, count) | sort."""
    rows = Rel(load(spark, d, "lineitem")).filter(lambda r: r.l_shipdate <= F.lit("1998-09-02").cast("timestamp_ntz"))
    out = rows.group_map(
        lambda r: {"l_returnflag": r.l_returnflag, "l_linestatus": r.l_linestatus},
        lambda g: {
            "sum_qty": g.sum(money(rows.rows.l_quantity)).cast("double"),
            "sum_base_price": F.coalesce(F.sum(money(rows.rows.l_extendedprice)), F.lit(0)).cast("double"),
            "sum_disc_price": F.coalesce(F.sum(money(rows.rows.l_extendedprice) * (1 - rows.rows.l_discount.cast("decimal(4,2)"))), F.lit(0)).cast("double"),
            "avg_qty": F.round(g.mean("l_quantity"), 4),
            "avg_disc": F.round(g.mean("l_discount"), 4),
            "n": g.count(),
        },
    )
    return out.sort(lambda r: r.l_returnflag, lambda r: r.l_linestatus).frame(ordered=True)


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) * 2 + 1 AS BIGINT) AS twice, l_discount > 0.05 AND NOT l_returnflag = 'R' AS cheap
FROM lineitem WHERE l_quantity >= 40 OR l_linestatus = 'F' AND l_tax < 0.02
""")
def map_filter_project(spark, d):
    rows = Rel(load(spark, d, "lineitem")).filter(lambda r: ops.or_(r.l_quantity >= 40, ops.and_(r.l_linestatus == "F", r.l_tax < 0.02)))
    return rows.map(lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "twice": r.l_quantity.cast("long") * 2 + 1, "cheap": (r.l_discount > 0.05) & ops.not_(r.l_returnflag == "R")}).frame()


@query("""
SELECT c_custkey, coalesce(o.o_orderkey, 0) AS first_order, coalesce(o.o_orderstatus, '') AS first_status
FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1) o ON o.o_custkey = c_custkey
""")
def find_index_lookup(spark, d):
    """map(find | or_default): the first match of each row, by a join."""
    orders = Rel.of(load(spark, d, "orders"), "o_orderdate", "o_orderkey")
    found = Rel(load(spark, d, "customer").select("c_custkey")).lookup(orders, {"c_custkey": "o_custkey"}, ["o_orderkey", "o_orderstatus"])
    return found.map(lambda r: {"c_custkey": r.c_custkey, "first_order": r.o_orderkey, "first_status": r.o_orderstatus}).frame()


@query("""
SELECT * FROM (SELECT 'find' AS what, o_orderkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderdate, o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'index' AS what, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 7)
""")
def find_and_index(spark, d):
    rows = Rel.of(load(spark, d, "orders"), "o_orderdate", "o_orderkey")
    found = rows.find(lambda r: r.o_totalprice > 100000).map(lambda r: {"what": F.lit("find"), "o_orderkey": r.o_orderkey})
    at = rows.index(7).map(lambda r: {"what": F.lit("index"), "o_orderkey": r.o_orderkey})
    return found.append(at).append(rows.index(-1).map(lambda r: {"what": F.lit("none"), "o_orderkey": r.o_orderkey})).frame()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def slice_topk(spark, d):
    rows = Rel(load(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return rows.sort(lambda r: -r.o_totalprice, lambda r: r.o_orderkey).slice(0, 50).frame()


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS i, count(*) OVER () AS n FROM part) WHERE i > n - 20 AND i <= n - 5")
def slice_from_end(spark, d):
    return Rel.of(load(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").slice(-20, -5).map(lambda r: {"p_partkey": r.p_partkey}).frame()


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def append_distinct(spark, d):
    a = Rel(load(spark, d, "customer")).map(lambda r: {"nationkey": r.c_nationkey})
    return a.append(Rel(load(spark, d, "supplier")).map(lambda r: {"nationkey": r.s_nationkey})).distinct().frame()


@query("""
SELECT a.p_partkey, b.s_suppkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) a
JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i FROM supplier) b USING (i)
""")
def zip_rows(spark, d):
    return Rel.of(load(spark, d, "part").select("p_partkey"), "p_partkey").zip(Rel.of(load(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")).map(lambda r: {"p_partkey": r.p_partkey, "s_suppkey": r.s_suppkey}).frame()


@query("SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def flat_map_join(spark, d):
    nations = Rel(load(spark, d, "region")).flat_join(Rel(load(spark, d, "nation")), lambda r, n: n.n_regionkey == r.r_regionkey, lambda r, n: {"r_name": r.r_name, "n_name": n.n_name, "n_nationkey": n.n_nationkey})
    return nations.flat_join(Rel(load(spark, d, "customer")), lambda n, c: c.c_nationkey == n.n_nationkey, lambda n, c: {"r_name": n.r_name, "n_name": n.n_name, "c_custkey": c.c_custkey}).frame()


@query("SELECT p_partkey, u.word FROM part, unnest(string_split(p_name, ' ')) AS u(word)")
def flat_map_items(spark, d):
    """flat_map over an array made from each row."""
    rows = Rel(load(spark, d, "part")).map(lambda r: {"item": arrays.map_(text.split(r.p_name, " "), lambda w: F.struct(r.p_partkey.alias("p_partkey"), w.alias("word")))})
    return rows.flat_map(lambda r: r.item).frame()


@query("SELECT n_nationkey, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS customers, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def nest_join(spark, d):
    customers = Rel.of(load(spark, d, "customer"), "c_custkey")
    nested = Rel(load(spark, d, "nation")).nest_join(customers, {"n_nationkey": "c_nationkey"}, "held", ["c_custkey"])
    return nested.map(lambda r: {"n_nationkey": r.n_nationkey, "customers": text.join(arrays.map_(r.held, lambda x: x.cast("string")), ","), "n": arrays.count(r.held)}).frame()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_contains(spark, d):
    orders = Rel(load(spark, d, "orders")).filter(lambda o: o.o_totalprice > 200000)
    return Rel(load(spark, d, "customer").select("c_custkey")).semi(orders, lambda c, o: o.o_custkey == c.c_custkey).frame()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_contains(spark, d):
    orders = Rel(load(spark, d, "orders")).filter(lambda o: o.o_totalprice > 200000)
    return Rel(load(spark, d, "customer").select("c_custkey")).anti(orders, lambda c, o: o.o_custkey == c.c_custkey).frame()


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def set_intersect(spark, d):
    suppliers = Rel(load(spark, d, "supplier")).filter(lambda s: s.s_acctbal > 0).map(lambda s: {"nationkey": s.s_nationkey})
    return Rel(load(spark, d, "customer")).map(lambda c: {"nationkey": c.c_nationkey}).intersect(suppliers).frame()


@query("SELECT p_partkey AS partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def set_except(spark, d):
    sold = Rel(load(spark, d, "lineitem")).filter(lambda x: x.l_quantity > 45).map(lambda x: {"partkey": x.l_partkey})
    return Rel(load(spark, d, "part")).map(lambda p: {"partkey": p.p_partkey}).except_(sold).frame()


@query("SELECT a.r_name AS first_region, b.n_name AS nation FROM region a, nation b")
def cross_pairs(spark, d):
    return Rel(load(spark, d, "region")).cross(Rel(load(spark, d, "nation")), lambda a, b: {"first_region": a.r_name, "nation": b.n_name}).frame()


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey AND n_nationkey <= s_nationkey + 2")
def theta_join(spark, d):
    return Rel(load(spark, d, "supplier")).flat_join(Rel(load(spark, d, "nation")), lambda s, n: (s.s_nationkey < n.n_nationkey) & (n.n_nationkey <= s.s_nationkey + 2), lambda s, n: {"s_suppkey": s.s_suppkey, "n_nationkey": n.n_nationkey}).frame()


@query("SELECT l_returnflag AS key, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top, max(l_tax > 0.07) AS some_taxed FROM lineitem GROUP BY l_returnflag")
def agg_minmax(spark, d):
    rows = Rel(load(spark, d, "lineitem").withColumn("taxed", F.col("l_tax") > 0.07))
    return rows.group_map(lambda r: r.l_returnflag, lambda g: {"first_ship": g.min("l_shipdate"), "top": g.max("l_extendedprice"), "some_taxed": g.max("taxed")}).frame()


@query("SELECT event_type AS key, bool_and(value >= 0) AS all_positive, bool_or(value > 95) AS any_large, bool_or(user_id = 7) AS has_user FROM events GROUP BY event_type")
def agg_all_any(spark, d):
    rows = Rel(load(spark, d, "events"))
    return rows.group_map(lambda r: r.event_type, lambda g: {"all_positive": g.all(F.col("value") >= 0), "any_large": g.any(F.col("value") > 95), "has_user": g.contains("user_id", F.lit(7))}).frame()


@query("SELECT CAST(0 AS BIGINT) AS n, true AS none, CAST(0 AS BIGINT) AS total, true AS is_nan, CAST(NULL AS DOUBLE) AS least, true AS every, false AS some, '' AS joined")
def agg_empty(spark, d):
    """Aggregates of no rows."""
    rows = Rel.of(load(spark, d, "events"), "event_id").filter(lambda r: r.event_id < 0)
    return rows.aggregate(lambda g: {"n": g.count(), "none": g.is_empty(), "total": g.sum("event_id"), "is_nan": F.isnan(g.mean("value")), "least": g.min("value"), "every": g.all(F.col("value") > 0), "some": g.any(F.col("value") > 0), "joined": g.join_text("event_type", ",")})


@query("SELECT n_regionkey AS key, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def text_join_group(spark, d):
    return Rel.of(load(spark, d, "nation"), "n_name").group_map(lambda r: r.n_regionkey, lambda g: {"names": g.join_text("n_name", "; ")}).frame()


@query("SELECT o_custkey AS key, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderdate, o_orderkey) AS keys, count(*) AS n FROM orders GROUP BY o_custkey")
def group_values(spark, d):
    """group with the rows of each key, in order."""
    grouped = Rel.of(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey").group(lambda r: r.o_custkey)
    return grouped.map(lambda r: {"key": r.key, "keys": text.join(arrays.map_(r["values"], lambda v: v["o_orderkey"].cast("string")), " "), "n": arrays.count(r["values"])}).frame()


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL HAVING count(*) > 10")
def group_tuple_having(spark, d):
    """group_map by a tuple | filter."""
    rows = Rel(load(spark, d, "orders"))
    out = rows.group_map(lambda r: {"y": F.year(r.o_orderdate), "status": r.o_orderstatus}, lambda g: {"n": g.count(), "total": F.coalesce(F.sum(money(F.col("o_totalprice"))), F.lit(0)).cast("double")})
    return out.filter(lambda r: r.n > 10).frame()


@query("SELECT CAST(count(DISTINCT (l_suppkey, l_returnflag)) AS BIGINT) AS n FROM lineitem")
def distinct_count(spark, d):
    return Rel(load(spark, d, "lineitem")).aggregate(lambda g: {"n": g.distinct_count("l_suppkey", "l_returnflag")})


@query("SELECT event_id, coalesce(lag(user_id, 1) OVER w, 0) AS before, coalesce(lead(user_id, 2) OVER w, 0) AS later, coalesce(lead(event_type, 1) OVER w, '') AS following FROM events WINDOW w AS (ORDER BY ts, event_id)")
def win_lag_lead(spark, d):
    rows = Rel.of(load(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id")
    return rows.windows(before=lambda w: w.lag("user_id", 1), later=lambda w: w.lag("user_id", -2), following=lambda w: w.lead("event_type", 1)).map(lambda r: {c: r[c] for c in ("event_id", "before", "later", "following")}).frame()


@query("SELECT event_id, coalesce(lag(event_id, 1) OVER w, 0) AS before, coalesce(lead(event_id, 1) OVER w, 0) AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead_by_user(spark, d):
    rows = Rel.of(load(spark, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id")
    return rows.windows(["user_id"], before=lambda w: w.lag("event_id"), following=lambda w: w.lead("event_id")).map(lambda r: {c: r[c] for c in ("event_id", "before", "following")}).frame()


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS mean FROM events")
def win_rolling_mean(spark, d):
    rows = Rel.of(load(spark, d, "events").select("event_id", "ts", "user_id", "value"), "ts", "event_id")
    return rows.map_columnar(["user_id"], m=lambda w: w.rolling_mean("value", 2, 1)).map(lambda r: {"event_id": r.event_id, "mean": F.round(r.m, 6)}).frame()


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM events")
def win_rolling_mean_all(spark, d):
    rows = Rel.of(load(spark, d, "events").select("event_id", "ts", "value"), "ts", "event_id")
    return rows.windows(m=lambda w: w.rolling_mean("value", 3, 3)).map(lambda r: {"event_id": r.event_id, "mean": F.round(r.m, 6)}).frame()


def _ranks(kind: str, sql: str) -> None:
    def run(spark, d):
        rows = Rel(load(spark, d, "part").select("p_partkey", "p_size"))
        return rows.ranks(lambda r: r.p_size, **{kind: "value"}).map(lambda r: {"p_partkey": r.p_partkey, "value": r["value"]}).frame()

    def by_type(spark, d):
        rows = Rel.of(load(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
        return rows.windows(["p_brand"], value=lambda w: getattr(w, kind)("p_size")).map(lambda r: {"p_partkey": r.p_partkey, "value": r["value"]}).frame()

    run.__name__, by_type.__name__ = f"win_{kind}", f"win_{kind}_by_brand"
    query(f"SELECT p_partkey, {sql} OVER (ORDER BY p_size){'::INTEGER' if kind in ('rank', 'rank_dense') else ''} AS value FROM part")(run)
    query(f"SELECT p_partkey, {sql} OVER (PARTITION BY p_brand ORDER BY p_size){'::INTEGER' if kind in ('rank', 'rank_dense') else ''} AS value FROM part")(by_type)


for _kind, _sql in (("rank", "rank()"), ("rank_dense", "dense_rank()"), ("rank_percentile", "percent_rank()"), ("cume_dist", "cume_dist()")):
    _ranks(_kind, _sql)


@query("SELECT event_id, CAST(sum(user_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def scan_running_sum(spark, d):
    return Rel.of(load(spark, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id").running_sum(lambda r: r.user_id, "total").map(lambda r: {"event_id": r.event_id, "total": r.total}).frame()


@query("SELECT event_id, CAST(sum(user_id * 2 + 1) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS acc FROM events")
def scan_any_function(spark, d):
    """scan with an arbitrary accumulator, by partition."""
    rows = Rel.of(load(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id")
    return rows.scan(F.lit(0), lambda acc, x: acc + x * 2 + 1, lambda r: r.user_id, T.LongType(), "acc", ["event_type", "user_id"]).map(lambda r: {"event_id": r.event_id, "acc": r.acc}).frame()


@query("SELECT user_id AS key, CAST(sum(event_id) AS BIGINT) AS total, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS last FROM events GROUP BY user_id")
def fold_sum(spark, d):
    """fold with a tuple accumulator over each group's rows in order."""
    rows = Rel.of(load(spark, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id")
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))
    out = rows.group_map(lambda r: r.user_id, lambda g: {"acc": g.fold(start, lambda a, x: F.struct((a["total"] + x).alias("total"), x.alias("last")), "event_id")})
    return out.map(lambda r: {"key": r.key, "total": r.acc["total"], "last": r.acc["last"]}).frame()


@query("SELECT n_nationkey, n_name FROM nation")
def columnar_roundtrip(spark, d):
    """to_columnar | from_columnar."""
    return Rel.of(load(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").to_columnar().from_columnar().frame()


@query("SELECT s_suppkey, coalesce(lag(s_nationkey) OVER (ORDER BY s_suppkey), 0) AS before FROM supplier")
def map_columnar(spark, d):
    return Rel.of(load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").map_columnar(before=lambda w: w.lag("s_nationkey")).map(lambda r: {"s_suppkey": r.s_suppkey, "before": r.before}).frame()


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, max(l_shipdate) AS last FROM lineitem")
def aggregate_all(spark, d):
    return Rel(load(spark, d, "lineitem")).aggregate(lambda g: {"total": F.coalesce(F.sum(money(F.col("l_extendedprice"))), F.lit(0)).cast("double"), "n": g.count(), "last": g.max("l_shipdate")})


@query("SELECT range AS value FROM range(5, 1005)")
def sequence_range(spark, d):
    return Rel.sequence(spark, 5, 1005).append(Rel.sequence(spark, 7, 3)).frame()


@query("SELECT n_nationkey, CAST(unnest(range(0, n_nationkey % 4)) AS BIGINT) AS i FROM nation")
def sequence_nested(spark, d):
    rows = Rel(load(spark, d, "nation")).map(lambda r: {"n_nationkey": r.n_nationkey, "xs": arrays.sequence(F.lit(0).cast("long"), (r.n_nationkey % 4).cast("long"))})
    return Rel(rows.df.select("n_nationkey", F.explode("xs").alias("i"))).frame()


@query("""
WITH RECURSIVE g AS (SELECT s_suppkey AS id, CAST(0 AS INTEGER) AS depth FROM supplier
UNION ALL SELECT id // 2, depth + 1 FROM g WHERE id // 2 > 0) SELECT id, depth FROM g
""")
def loop_until_empty(spark, d):
    """Generations of a hierarchy (each id's parent is its half) from every supplier, until none is left."""
    start = Rel(load(spark, d, "supplier")).map(lambda r: {"id": r.s_suppkey, "depth": F.lit(0)})
    up = lambda g: g.map(lambda r: {"id": ops.div(r.id, F.lit(2), K.Int64), "depth": r.depth + 1}).filter(lambda r: r.id > 0)
    return start.loop_until_empty(up).frame()


_WRAP = "((x % {m} + {m} + {h}) % {m} - {h})"


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_orderkey * 1000003 - 40000 * l_linenumber AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(""" + _WRAP.format(m=256, h=128) + """ AS INTEGER) AS i8, CAST(""" + _WRAP.format(m=65536, h=32768) + """ AS INTEGER) AS i16,
       CAST(""" + _WRAP.format(m=4294967296, h=2147483648) + """ AS BIGINT) AS i32, CAST((x % 256 + 256) % 256 AS INTEGER) AS u8,
       CAST((x % 65536 + 65536) % 65536 AS INTEGER) AS u16, CAST((x % 4294967296 + 4294967296) % 4294967296 AS BIGINT) AS u32,
       CASE WHEN x < 0 THEN CAST(CAST(x AS HUGEINT) + 18446744073709551616 AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS u64 FROM s
""")
def casts_wrap(spark, d):
    """Integer conversions wrap at the target's width."""
    x = F.col("x")
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 1000003 - 40000 * F.col("l_linenumber")).alias("x"))
    as_ = lambda t, kind: convert.to(x, t, K.Int64).cast(kind)
    return rows.select("l_orderkey", "l_linenumber", as_(K.Int8, "int").alias("i8"), as_(K.Int16, "int").alias("i16"), as_(K.Int32, "long").alias("i32"), as_(K.Uint8, "int").alias("u8"), as_(K.Uint16, "int").alias("u16"), as_(K.Uint32, "long").alias("u32"), as_(K.Uint64, "string").alias("u64"))


@query("""
WITH s AS (SELECT p_partkey, p_retailprice * 3.7 - 4000 AS x FROM part)
SELECT p_partkey, CAST(greatest(-128, least(127, trunc(x))) AS INTEGER) AS i8, CAST(greatest(0, least(255, trunc(x))) AS INTEGER) AS u8,
       CAST(trunc(x) AS BIGINT) AS i64, CAST(greatest(0, trunc(x)) AS BIGINT) AS u32 FROM s
""")
def casts_trunc(spark, d):
    """Float conversions truncate and saturate."""
    x = F.col("x")
    rows = load(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 3.7 - 4000).alias("x"))
    as_ = lambda t, kind: convert.to(x, t, K.Float64).cast(kind)
    return rows.select("p_partkey", as_(K.Int8, "int").alias("i8"), as_(K.Uint8, "int").alias("u8"), as_(K.Int64, "long").alias("i64"), as_(K.Uint32, "long").alias("u32"))


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size, CAST(CAST(p_size AS BIGINT) * 250000000 AS VARCHAR) AS large, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS big,
       CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) ELSE CAST(p_size // 4 AS VARCHAR) || CASE p_size % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END AS quarter FROM part
""")
def to_text(spark, d):
    r = load(spark, d, "part")
    return r.select("p_partkey", convert.to_text(F.col("p_size"), K.Int32).alias("size"), convert.to_text(F.col("p_size") * F.lit(250000000.0), K.Float64).alias("large"), convert.to_text(F.col("p_size") > 25, K.Bool).alias("big"), convert.to_text(F.col("p_size") / F.lit(4.0), K.Float64).alias("quarter"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, starts_with(text, 'Th') AS a, contains(text, '%') AS b, ends_with(text, '.') AS c, lang || '/' || source AS place, chr(CAST(65 + doc_id % 26 AS INTEGER)) AS letter FROM documents")
def text_funcs(spark, d):
    rows = Rel(load(spark, d, "documents"))
    return rows.map(lambda r: {"doc_id": r.doc_id, "n": text.length(r.text).cast("long"), "a": text.starts_with(r.text, "Th"), "b": text.contains(r.text, "%"), "c": text.ends_with(r.text, "."), "place": text.concat(r.lang, F.lit("/"), r.source), "letter": text.from_ascii(65 + r.doc_id % 26)}).frame()


@query("SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, string_split(p_name, ' ')[1] AS head, array_to_string(string_split(p_name, ' '), '+') AS joined FROM part")
def text_split(spark, d):
    rows = Rel(load(spark, d, "part")).map(lambda r: {"p_partkey": r.p_partkey, "parts": text.split(r.p_name, " ")})
    return rows.map(lambda r: {"p_partkey": r.p_partkey, "n": arrays.count(r.parts), "head": arrays.index(r.parts, 0), "joined": text.join(r.parts, "+")}).frame()


@query("""
SELECT s_suppkey, abs(s_acctbal) AS size, CAST(pow(s_nationkey, 3) AS BIGINT) AS cube, CAST((s_nationkey - 12) // 5 AS BIGINT) AS q, CAST((s_nationkey - 12) % 5 AS BIGINT) AS r,
       -s_nationkey AS minus, s_acctbal / 4.0 AS part, round(pi() * s_nationkey, 6) AS turn FROM supplier
""")
def math_funcs(spark, d):
    rows = Rel(load(spark, d, "supplier"))
    return rows.map(lambda s: {"s_suppkey": s.s_suppkey, "size": math.abs_(s.s_acctbal), "cube": math.pow_(s.s_nationkey, F.lit(3), integer=True), "q": ops.div(s.s_nationkey - 12, F.lit(5), K.Int32).cast("long"), "r": ops.mod(s.s_nationkey - 12, F.lit(5)).cast("long"), "minus": ops.neg(s.s_nationkey), "part": ops.div(s.s_acctbal, F.lit(4.0), K.Float64), "turn": F.round(math.pi() * s.s_nationkey, 6)}).frame()


@query("""
WITH o AS (SELECT event_id, nullif(user_id % 5, 0) AS u, nullif(event_type, 'click') AS t FROM events)
SELECT event_id, u IS NOT NULL AS some, t IS NULL AS none, coalesce(u, -1) AS other, coalesce(t, '') AS dflt, u * 10 AS mapped, CASE WHEN u > 2 THEN u END AS flat,
       coalesce(u + 1, 100) AS map_or, u IS NOT NULL AND t IS NOT NULL AS both FROM o
""")
def option_funcs(spark, d):
    rows = Rel(load(spark, d, "events")).map(lambda r: {"event_id": r.event_id, "u": F.nullif(r.user_id % 5, F.lit(0)), "t": F.nullif(r.event_type, F.lit("click"))})
    return rows.map(lambda r: {"event_id": r.event_id, "some": option.is_some(r.u), "none": option.is_none(r.t), "other": option.or_else(r.u, F.lit(-1)), "dflt": option.or_default(r.t, K.Text), "mapped": option.map_(r.u, lambda x: x * 10), "flat": option.flat_map(r.u, lambda x: F.when(x > 2, x)), "map_or": option.map_or(r.u, F.lit(100), lambda x: x + 1), "both": option.is_some(option.zip_(r.u, r.t))}).frame()


ACTION = Enum(view=None, click=T.LongType(), paid=T.DoubleType())


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS tag,
       CASE event_type WHEN 'click' THEN 'user ' || user_id WHEN 'purchase' THEN 'paid' ELSE 'other' END AS said,
       CASE WHEN event_type = 'click' AND user_id = 7 THEN 1 WHEN event_type = 'purchase' OR event_type = 'click' AND user_id > 7 THEN 2 ELSE 0 END AS against FROM events
""")
def enum_match(spark, d):
    rows = Rel(load(spark, d, "events"))
    kind = lambda r: F.when(r.event_type == "click", ACTION.of("click", r.user_id)).when(r.event_type == "purchase", ACTION.of("paid", r.value)).otherwise(ACTION.of("view"))
    made = rows.map(lambda r: {"event_id": r.event_id, "action": kind(r)})
    return made.map(lambda r: {"event_id": r.event_id, "tag": r.action["_t"].cast("int"), "said": ACTION.match(r.action, F.lit("other"), click=lambda u: F.concat(F.lit("user "), u.cast("string")), paid=F.lit("paid")), "against": ops.cmp(r.action, ACTION.of("click", F.lit(7))).cast("int")}).frame()


@query("""
SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN (a.n_regionkey, a.n_name) < (b.n_regionkey, b.n_name) THEN 0 WHEN (a.n_regionkey, a.n_name) = (b.n_regionkey, b.n_name) THEN 1 ELSE 2 END AS tuples,
       CASE WHEN [a.n_regionkey, a.n_nationkey] < [b.n_regionkey] THEN 0 ELSE 2 END AS lists FROM nation a, nation b
""")
def cmp_nested(spark, d):
    n = Rel(load(spark, d, "nation"))
    return n.cross(n, lambda a, b: {"a": a.n_nationkey, "b": b.n_nationkey, "tuples": ops.cmp(F.struct(a.n_regionkey, a.n_name), F.struct(b.n_regionkey, b.n_name)).cast("int"), "lists": ops.cmp(F.array(a.n_regionkey, a.n_nationkey), F.array(b.n_regionkey)).cast("int")}).frame()


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def date_parts(spark, d):
    rows = Rel(load(spark, d, "orders")).map(lambda r: {"o_orderkey": r.o_orderkey, "day": r.o_orderdate.cast("date")})
    rows = rows.map(lambda r: {"o_orderkey": r.o_orderkey, "p": temporal.year_month_day(r.day), "days": ops.div(temporal.micros(temporal.date_sub(r.day, F.lit("1992-01-01").cast("date"))), F.lit(temporal.DAY_US), K.Int64)})
    return rows.map(lambda r: {"o_orderkey": r.o_orderkey, "y": r.p["year"], "m": r.p["month"].cast("int"), "d": r.p["day"].cast("int"), "days": r.days}).frame()


@query("""
SELECT event_id, epoch_us(CAST(ts AS DATE)::TIMESTAMP - INTERVAL 5 HOUR - INTERVAL 30 MINUTE) AS midnight, CAST(epoch_us(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE) // 86400000000 AS INTEGER) AS local_day, CAST(-19800000000 AS BIGINT) AS gap FROM events
""")
def date_tz(spark, d):
    """Local midnight, local date and offset of a zone without clock changes."""
    tz = "Asia/Kolkata"
    rows = Rel(load(spark, d, "events"))
    return rows.map(lambda r: {"event_id": r.event_id, "midnight": temporal.micros_epoch(temporal.date_to_timestamp(r.ts.cast("date"), tz)), "local_day": temporal.days_epoch(temporal.timestamp_to_date(r.ts, tz)), "gap": temporal.micros(temporal.timezone_offset(tz, r.ts.cast("date")))}).frame()


@query("""
SELECT event_id, epoch_us(ts) % 86400000000 AS t, (epoch_us(ts) + 72000000000) % 86400000000 AS later, (epoch_us(ts) % 86400000000 + 86400000000 - 72000000000) % 86400000000 AS earlier, epoch_us(ts) % 86400000000 - 43200000000 AS from_noon FROM events
""")
def time_arith(spark, d):
    """Times of day wrap in 24 hours."""
    rows = Rel(load(spark, d, "events")).map(lambda r: {"event_id": r.event_id, "t": temporal.time_of_day(r.ts)})
    hours = temporal.duration(F.lit(72_000_000_000))
    return rows.map(lambda r: {"event_id": r.event_id, "t": r.t, "later": temporal.time_add(r.t, hours), "earlier": temporal.time_sub(r.t, hours), "from_noon": temporal.micros(temporal.time_diff(r.t, F.lit(43_200_000_000)))}).frame()


@query("SELECT user_id AS key, CAST(sum(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) AS BIGINT) AS total, CAST(min(epoch_us(TIMESTAMP '2024-01-01') - epoch_us(ts)) AS BIGINT) AS least FROM events GROUP BY user_id")
def duration_sum(spark, d):
    rows = Rel(load(spark, d, "events")).map(lambda r: {"user_id": r.user_id, "age": temporal.timestamp_sub(r.ts, F.lit("2024-01-01").cast("timestamp_ntz"))})
    out = rows.group_map(lambda r: r.user_id, lambda g: {"total": g.sum("age"), "least": g.min(ops.neg(F.col("age")))})
    return out.map(lambda r: {"key": r.key, "total": temporal.micros(r.total), "least": temporal.micros(r.least)}).frame()


@query("SELECT o_orderpriority AS key, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(0.25 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority")
def decimal_sum(spark, d):
    rows = Rel(load(spark, d, "orders")).map(lambda r: {"o_orderpriority": r.o_orderpriority, "x": temporal.decimal(temporal.decimal(r.o_totalprice) - temporal.decimal(F.lit(0.25)))})
    return rows.group_map(lambda r: r.o_orderpriority, lambda g: {"total": g.sum("x").cast("double")}).sort(lambda r: r.total).frame()


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS a FROM embeddings)
SELECT vec_id, CAST(len(list_filter(a, lambda x: x > 0)) AS BIGINT) AS positive, CAST(list_sum(a) AS BIGINT) AS total, list_min(a) AS least, list_max(a) AS most, list_sort(a)[3] AS third,
       array_to_string(list_sort(a)[2:4], ',') AS some, a[1] + a[2] AS pair, len(list_distinct(a)) AS kinds, list_contains(a, 0) AS zero FROM e
""")
def hof_nested(spark, d):
    """The operators on arrays inside rows."""
    rows = Rel(load(spark, d, "embeddings")).map(lambda r: {"vec_id": r.vec_id, "a": arrays.map_(r.embedding, lambda x: F.round(x.cast("double") * 1000).cast("long"))})
    return rows.map(lambda r: {"vec_id": r.vec_id, "positive": arrays.count(arrays.filter_(r.a, lambda x: x > 0)), "total": arrays.sum_(r.a, T.LongType()), "least": arrays.min_(r.a), "most": arrays.max_(r.a), "third": arrays.index(arrays.sort(r.a, lambda x: x), 2), "some": text.join(arrays.map_(arrays.slice_(arrays.sort(r.a, lambda x: x), 1, 4), lambda x: x.cast("string")), ","), "pair": arrays.index(arrays.map_(arrays.zip_(r.a, arrays.slice_(r.a, 1, 1000)), lambda p: p["_0"] + p["_1"]), 0), "kinds": arrays.count(arrays.distinct(r.a)), "zero": arrays.contains(r.a, F.lit(0))}).frame()


@query("""
WITH g AS (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, array_to_string(list_prepend(0, a[1:len(a)-1]), ',') AS before, CAST(list_reduce(list_prepend(1, a), lambda x, y: (x * 31 + y) % 100003) AS BIGINT) AS folded, CAST(len(a) AS INTEGER) AS top FROM g
""")
def nested_windows(spark, d):
    """lag, rank, fold and scan inside rows."""
    rows = Rel.of(load(spark, d, "nation"), "n_nationkey").group_map(lambda r: {"n_regionkey": r.n_regionkey}, lambda g: {"a": g.values("n_nationkey")})
    step = lambda acc, x: (acc * 31 + x) % 100003
    scan = lambda a: arrays.scan(a, F.lit(1), step, T.LongType())
    return rows.map(lambda r: {"n_regionkey": r.n_regionkey, "before": text.join(arrays.map_(arrays.lag(r.a, 1, T.IntegerType()), lambda x: x.cast("string")), ","), "folded": arrays.index(scan(r.a), F.size(r.a) - 1), "top": arrays.max_(arrays.rank(r.a))}).frame()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_roundtrip(spark, d):
    files = tables.Files(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    nation = load(spark, d, "nation")
    files.write_parquet(Rel.of(nation, "n_nationkey"), "out/nation")
    back = files.read_parquet("out/nation")
    if back.df.schema != nation.schema or not nation.exceptAll(back.df).isEmpty() or not back.df.exceptAll(nation).isEmpty():
        raise RuntimeError("the rows read back are not the rows written")
    return back.frame()


@query("SELECT * FROM (VALUES ('n_nationkey', 'Int32'), ('n_name', 'Text'), ('n_regionkey', 'Int32'), ('gap', 'Int32?')) t(name, kind)")
def pull_schema(spark, d):
    files = tables.Files(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    files.write_parquet(Rel(load(spark, d, "nation").withColumn("gap", F.nullif("n_regionkey", F.lit(2)))), "t", single=True)
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', '{k}')" for n, k in files.pull("t").items()) + " AS t(name, kind)")


def _copy(spark: SparkSession, d: str, name: str) -> str:
    own = f"tessera_{name}_{uuid.uuid4().hex[:10]}"
    load(spark, d, name).write.format("parquet").saveAsTable(own)
    return own


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 100, NULL FROM region")
def insert_rows(spark, d):
    own = _copy(spark, d, "region")
    tables.insert(Rel(load(spark, d, "region")).map(lambda r: {"r_regionkey": r.r_regionkey + 100}), own)
    return tables.from_table(spark, own, ["r_regionkey", "r_name"]).frame()


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
def update_rows(spark, d):
    own = _copy(spark, d, "nation")
    tables.update(spark, own, lambda r: r.n_regionkey == 1, lambda r: {"n_name": F.concat(r.n_name, F.lit("!")), "n_regionkey": F.lit(9)})
    return tables.from_table(spark, own).frame()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT n_regionkey = 2")
def delete_rows(spark, d):
    own = _copy(spark, d, "nation")
    tables.delete(spark, own, lambda r: r.n_regionkey == 2)
    return tables.from_table(spark, own).frame()


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, upper(r_name) AS name FROM region WHERE r_regionkey >= 2")
def raw_sql(spark, d):
    load(spark, d, "region").createOrReplaceTempView("tessera_region")
    return tables.raw(spark, "SELECT r_regionkey, upper(r_name) FROM tessera_region WHERE r_regionkey >= :low", "k long, name string", low=2).frame()


@query("SELECT * FROM (VALUES (11, 'Lime kiln', 0), (4, 'Weir', 1), (7, '', 2)) t(id, title, place)")
def literal_rows(spark, d):
    return Rel.literal(spark, [(11, "Lime kiln"), (4, "Weir"), (7, "")], "id int, title string").with_index("place").map(lambda r: {"id": r.id, "title": r.title, "place": r.place.cast("int")}).frame()


@query("SELECT p_partkey, 0 AS i, '' AS t, false AS b, CAST(0 AS DOUBLE) AS f, CAST(0 AS BIGINT) AS n FROM part")
def defaults(spark, d):
    """convert::default of scalars and arrays."""
    return Rel(load(spark, d, "part")).map(lambda r: {"p_partkey": r.p_partkey, "i": K.default_for(K.Int32), "t": K.default_for(K.Text), "b": K.default_for(K.Bool), "f": K.default_for(K.Float64), "n": arrays.count(K.default_for(T.ArrayType(T.LongType())))}).frame()


@query("SELECT event_type AS key, count(*) AS n, CAST(max(user_id) AS BIGINT) AS top FROM events GROUP BY event_type")
def stream_groups(spark, d):
    """group_map over the events as files that arrive."""
    from .. import streaming

    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    load(spark, d, "events").write.parquet(f"{folder}/in")
    rows = streaming.arriving(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    grouped = rows.group_map(lambda r: r.event_type, lambda g: {"n": g.count(), "top": g.max("user_id")})
    streaming.each_batch(grouped, lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/checkpoint", "complete")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT o_orderstatus || '/' || left(o_orderpriority, 1) AS kind, count(*) AS n, CAST(min(o_orderkey) AS BIGINT) AS first FROM orders GROUP BY 1")
def group_array_keys(spark, d):
    """group_map by an array, compared item by item."""
    rows = Rel(load(spark, d, "orders"))
    out = rows.group_map(lambda r: {"k": F.array(r.o_orderstatus, F.substring(r.o_orderpriority, 1, 1))}, lambda g: {"n": g.count(), "first": g.min("o_orderkey")})
    return out.map(lambda r: {"kind": text.join(r.k, "/"), "n": r.n, "first": r["first"].cast("long")}).frame()


@query("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_date_keys(spark, d):
    """group_map by a tuple of a date and a text."""
    out = Rel(load(spark, d, "lineitem")).group_map(lambda r: {"day": F.to_date(r.l_shipdate), "l_linestatus": r.l_linestatus}, lambda g: {"n": g.count()})
    return out.map(lambda r: {"day": r.day.cast("string"), "l_linestatus": r.l_linestatus, "n": r.n}).frame()


@query("""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS narrow, CAST(l_partkey AS DOUBLE) / 8 AS wide, CAST(CAST(l_partkey AS FLOAT) AS DOUBLE) AS whole,
       CAST(l_discount > 0.05 AS INTEGER) AS flag FROM lineitem
""")
def casts_float(spark, d):
    """to_float32 and to_float64."""
    return Rel(load(spark, d, "lineitem")).map(lambda r: {"l_orderkey": r.l_orderkey, "l_linenumber": r.l_linenumber, "narrow": convert.to(r.l_extendedprice, K.Float32, K.Float64).cast("double"), "wide": convert.to(r.l_partkey, K.Float64, K.Int64) / 8, "whole": convert.to(r.l_partkey, K.Float32, K.Int64).cast("double"), "flag": ops.if_(r.l_discount > 0.05, F.lit(1), F.lit(0))}).frame()


@query("""
WITH x AS (SELECT o_orderkey, CAST(17999999999999999999 - o_orderkey AS DECIMAL(20,0)) AS a, CAST(o_custkey * 9000000000000 + 7 AS DECIMAL(20,0)) AS b FROM orders)
SELECT o_orderkey, CAST((CAST(a AS HUGEINT) // CAST(b AS HUGEINT)) AS BIGINT) AS q, CAST((CAST(a AS HUGEINT) % CAST(b AS HUGEINT)) AS VARCHAR) AS r FROM x
""")
def uint64_division(spark, d):
    """Whole division and remainder of unsigned 64-bit integers."""
    kind = K.Uint64.spark
    rows = Rel(load(spark, d, "orders")).map(lambda r: {"o_orderkey": r.o_orderkey, "a": (F.lit("17999999999999999999").cast(kind) - r.o_orderkey.cast(kind)).cast(kind), "b": (r.o_custkey.cast(kind) * F.lit("9000000000000").cast(kind) + F.lit(7)).cast(kind)})
    return rows.map(lambda r: {"o_orderkey": r.o_orderkey, "q": ops.div(r.a, r.b, K.Uint64).cast("long"), "r": ops.mod(r.a, r.b).cast(kind).cast("string")}).frame()


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS \"from\", CAST(c_nationkey + 3 AS BIGINT) AS upto, CAST(NULL AS BIGINT) AS open, CAST(3 AS BIGINT) AS n FROM customer")
def range_values(spark, d):
    """a..b, with open ends, and the sequence of such a range."""
    rows = Rel(load(spark, d, "customer")).map(lambda r: {"c_custkey": r.c_custkey, "r": ops.range_(r.c_nationkey.cast("long"), r.c_nationkey.cast("long") + 3), "tail": ops.range_(r.c_nationkey.cast("long"), None)})
    return rows.map(lambda r: {"c_custkey": r.c_custkey, "from": r.r["start"], "upto": r.r["end"], "open": r.tail["end"], "n": arrays.count(arrays.sequence(r.r["start"], r.r["end"]))}).frame()


@query("""
WITH t AS (SELECT s_nationkey AS k, count(*) AS n, sum(CAST(s_acctbal AS DECIMAL(18,2))) AS total FROM supplier GROUP BY s_nationkey)
SELECT CAST(a.k AS BIGINT) AS k, a.n, CAST(a.total AS DOUBLE) AS total, count(*) AS as_many FROM t a JOIN t b ON b.n >= a.n GROUP BY ALL
""")
def let_shared(spark, d):
    """A relation that is used twice and evaluated once."""
    t = Rel(load(spark, d, "supplier")).group_map(lambda r: {"k": r.s_nationkey}, lambda g: {"n": g.count(), "total": g.sum(money(F.col("s_acctbal")))}).let()
    pairs = t.flat_join(t, lambda a, b: b.n >= a.n, lambda a, b: {"k": a.k.cast("long"), "n": a.n, "total": a.total.cast("double")})
    return pairs.group_map(lambda r: {"k": r.k, "n": r.n, "total": r.total}, lambda g: {"as_many": g.count()}).frame()


@host.external("tessera::digits", [K.Int64, K.Int32], K.Int32)
def digits(x, base):
    """The sum of the digits of x in a base."""
    total = x * 0
    while (x > 0).any():
        total, x = total + x % base, x // base
    return total


@query("""
SELECT p_partkey, CAST(list_sum([CAST(c AS INTEGER) FOR c IN string_split(CAST(p_partkey AS VARCHAR), '')]) AS INTEGER) AS tens, bit_count(CAST(p_partkey AS BIGINT))::INTEGER AS ones,
       CAST(list_sum([CAST(c AS INTEGER) FOR c IN string_split(CAST(p_size AS VARCHAR), '')]) AS INTEGER) AS by_sql FROM part
""")
def host_function(spark, d):
    """A typed function of the host, called on columns and, by its registered name, in raw SQL."""
    load(spark, d, "part").createOrReplaceTempView("tessera_part")
    own = digits.register(spark)
    rows = tables.raw(spark, f"SELECT p_partkey, {own}(CAST(p_size AS BIGINT), 10) AS by_sql FROM tessera_part")
    call = host.lookup(spark, "tessera::digits")
    return rows.map(lambda r: {"p_partkey": r.p_partkey, "tens": call(r.p_partkey, F.lit(10)), "ones": call(r.p_partkey, F.lit(2)), "by_sql": r.by_sql}).frame()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_roundtrip(spark, d):
    """A small relation as an Arrow table and back."""
    table = tables.to_arrow(Rel.of(load(spark, d, "nation"), "n_nationkey"))
    if table.column("n_nationkey").to_pylist() != sorted(table.column("n_nationkey").to_pylist()):
        raise RuntimeError("the Arrow table is not in the relation's order")
    return tables.from_arrow(spark, table).frame()


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark, d):
    """A relation written as CSV and read again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/csv"
    rows = Rel(load(spark, d, "customer")).map(lambda r: {"c_custkey": r.c_custkey, "c_name": r.c_name, "c_mktsegment": r.c_mktsegment})
    tables.write_csv(rows, path)
    return spark.read.schema(rows.df.schema).csv(path, header=True)


@query("""
SELECT e.event_id, CASE e.event_type WHEN 'click' THEN 'click ' || (e.user_id % 3) ELSE 'other' END AS said FROM events e WHERE e.user_id % 7 IN (1, 3, 5) AND e.value >= 10
""")
def query_parameters(spark, d):
    """Parameters that are scalars, arrays and tagged unions, in raw SQL and as a relation."""
    load(spark, d, "events").createOrReplaceTempView("tessera_events")
    least = Enum(least=T.DoubleType(), none=None)
    rows = tables.raw(spark, "SELECT event_id, event_type, user_id, value FROM tessera_events WHERE array_contains(:own, user_id % :n)", own=[1, 3, 5], n=7)
    held = tables.with_parameters(spark, {"kinds": ["click", "tap"], "by": 3, "bound": (least.tag("least"), 10.0)}, T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("by", T.IntegerType()), T.StructField("bound", least.type)]))
    fits = lambda r, p: least.match(p.bound, F.lit(True), least=lambda x: r.value >= x)
    return rows.flat_join(held, fits, lambda r, p: {"event_id": r.event_id, "said": F.when(arrays.contains(p.kinds, r.event_type), F.concat(F.lit("click "), (r.user_id % p.by).cast("string"))).otherwise("other")}).frame()
