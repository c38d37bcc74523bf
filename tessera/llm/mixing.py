"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are (domain, language, source). A budget of tokens goes down the tree: the root's to domains,
each domain's to its languages, each language's to its sources, in proportion to weights, but never
more to a node than its leaves hold in ``epochs`` passes. What a node cannot take goes to its siblings
by their weights (again within what they hold); so it only reaches an ancestor's siblings, since an ancestor
that is short was given less from the start. A leaf then takes whole epochs of all its documents, and of
the next epoch the prefix that still fits, in the order of a hash of seed, epoch and doc_id.

The prefix is found in two steps, so that no leaf is sorted as a whole: sums of 4096 slots of the hash
give each leaf's slot of the cut, and only documents in that slot are put in order. Documents are joined
with the table of leaves, which is broadcast while it has at most ``MAX_BROADCAST`` rows.

Tokens here are runs of characters other than space, tab and line ends.

Defined results: nulls in domain, language or source are leaves named '' (weight as others that are not
named, 1); a null text has no tokens; a leaf without tokens gives nothing; nodes of weight 0 give nothing;
documents without tokens are taken where the prefix reaches them; repeated rows are taken separately; other
columns stay as they are, whatever their names; if
the budget is over what there is, everything is taken ``epochs`` times; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, row_of

LEVELS = ["domain", "lang", "source"]
TOKEN = "[^ \\t\\n\\r]+"
#: Rows of the leaf table up to which it is broadcast (under 200 bytes each).
MAX_BROADCAST = 50_000


def domain_of_source() -> Column:
    """The domain of a source of the test tables: its number modulo 4, else ``other``."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS bigint)") % 4).cast("string"))).otherwise(F.lit("other"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    named = weights.get(level) or {}
    if not named:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for pair in sorted(named.items()) for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1.0))


def _share(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """``children`` (parents, child, cap, weight, budget of the parent) with ``given``: the budget by weight, within caps."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))  # one row a domain
    usable = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0))
    rows = children.withColumn("w", usable).withColumn("c", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0.0)))
    before = by.orderBy(F.try_divide("c", "w").asc_nulls_first(), child).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", F.try_divide(F.col("budget") - F.coalesce(F.sum("c").over(before), F.lit(0.0)), F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("short", F.col("w") * F.col("level") < F.col("c"))
    # Once one child is not full, neither are those after it: the first such level holds for all.
    first = F.min(F.when(F.col("short"), F.struct(F.try_divide("c", "w").alias("r"), F.col(child), F.col("level")))).over(by)
    given = F.when(first.isNull(), F.col("c")).otherwise(F.least(F.col("c"), F.col("w") * first["level"]))
    return rows.withColumn("given", given).drop("w", "c", "level", "short")


def quotas(leaves: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """Each leaf's ``quota`` of tokens; ``leaves`` has the levels and ``tokens``."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    held = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double")).withColumn("budget", F.lit(float(math.floor(total * share))))
    for i, level in enumerate(LEVELS):
        parents = LEVELS[:i]
        nodes = held.groupBy(*parents, level).agg(F.sum("cap").alias("cap"), F.min("budget").alias("budget")).withColumn("weight", _weight(level, weights))
        given = _share(nodes, parents, level).select(*parents, level, F.col("given").alias("_given"))
        held = held.join(given, [*parents, level]).withColumn("budget", F.col("_given")).drop("_given")
    return held.select(*LEVELS, "tokens", F.floor("budget").cast("long").alias("quota"))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int = 2, seed: int = 0, domain: Column | None = None) -> DataFrame:
    """Rows of ``docs`` that are taken, with ``_domain``, ``_tokens`` and ``_copies`` (1 to ``epochs``); columns of these three names are replaced."""
    work = Workspace(docs.sparkSession, "mixing")
    names = [c for c in docs.columns if c.lower() not in ("_domain", "_tokens", "_copies")]
    leaf = [F.coalesce(x.cast("string"), F.lit("")).alias(c) for c, x in zip(LEVELS, (domain if domain is not None else domain_of_source(), F.col("lang"), F.col("source")), strict=True)]
    tokens = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    placed = docs.select(row_of(names), F.col("doc_id").alias("id"), *leaf, tokens.alias("tokens"))
    narrow, narrow_path = work.write(placed.drop("row"))
    leaves, leaves_path = work.write(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")))
    quota = quotas(leaves, weights, share, epochs).where("tokens > 0 AND quota > 0")
    quota = work.keep(quota.select(*LEVELS, F.expr("quota div tokens AS whole"), F.expr("quota % tokens AS rest")))
    few = quota.count() <= MAX_BROADCAST

    def with_leaf(rows: DataFrame, table: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(table) if few else table, LEVELS)
        name = F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit("")))
        return rows.withColumn("key", F.md5(name.cast("binary"))).withColumn("slot", F.substring("key", 1, 3))

    slots = with_leaf(narrow, quota).groupBy(*LEVELS, "slot", "rest").agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("end", F.sum("n").over(upto)).where("end > rest")
    cut = slots.groupBy(*LEVELS).agg(F.min(F.struct("slot", (F.col("end") - F.col("n")).alias("start"))).alias("cut"))
    table = work.keep(quota.join(cut, LEVELS).select(*LEVELS, "whole", "rest", F.col("cut.slot").alias("last"), F.col("cut.start").alias("start")))
    work.drop(narrow_path)
    work.drop(leaves_path)
    rows = with_leaf(placed, table)
    copies = F.col("whole") + F.when(F.col("slot") < F.col("last"), 1).otherwise(0)
    outside = rows.where("slot <> last").withColumn("copies", copies)
    order = Window.partitionBy(*LEVELS, "slot").orderBy("key", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.where("slot = last").withColumn("copies", F.col("whole") + (F.col("start") + F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    out = ["row", F.col("domain").alias("_domain"), F.col("tokens").alias("_tokens"), F.col("copies").cast("int").alias("_copies")]
    return outside.select(*out).unionAll(inside.select(*out)).where("_copies > 0").select("row.*", "_domain", "_tokens", "_copies")


#: The weights of the query: domains and languages; sources of a language share alike.
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
SHARE, EPOCHS, SEED = 0.6, 2, 17


def mixture(docs: DataFrame) -> DataFrame:
    """The query: documents taken, with their leaf, tokens and copies."""
    taken = mix(docs.select("doc_id", "text", "lang", "source"), WEIGHTS, SHARE, EPOCHS, SEED)
    return taken.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"))
