"""Readers for the driver tables and the graphs we derive from them.

Every reader selects only the columns it needs and expresses filters as plain
column comparisons so that Catalyst pushes them into the Parquet scan
(``PushedFilters`` / ``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_div

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _year_filter(col, years) -> F.Column:
    """OR of [Jan 1, Jan 1 next year) ranges: pushable, unlike year(col) IN (...).
    ``None``: every year."""
    if years is None:
        return F.lit(True)
    conds = [(col >= F.lit(_dt.datetime(y, 1, 1))) & (col < F.lit(_dt.datetime(y + 1, 1, 1)))
             for y in sorted(set(int(y) for y in years))]
    return reduce(lambda a, b: a | b, conds)


def trade_pairs(spark: SparkSession, sf_dir: str, years=None,
                scale: float = 1000.0) -> DataFrame:
    """Undirected nation-pair trade volume per order year (all years, or those given).

    ``(snapshot INT, i BIGINT, j BIGINT, w DOUBLE)`` with i > j: customer nation and
    supplier nation of every line item, sum(l_quantity) / scale per order year,
    lines within one nation excluded.  Join order and strategy are left to
    Catalyst/AQE: the dimension sides are broadcast only when their measured size
    is under the broadcast threshold; the aggregate is partial before its shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    od = od.filter(_year_filter(F.col("o_orderdate"), years))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(cu, F.col("o_custkey") == cu.c_custkey)
           .join(su, F.col("l_suppkey") == su.s_suppkey)
           .filter(F.col("c_nationkey") != F.col("s_nationkey")))
    return (j.groupBy(F.year("o_orderdate").cast("int").alias("snapshot"),
                      F.greatest("c_nationkey", "s_nationkey").cast("bigint").alias("i"),
                      F.least("c_nationkey", "s_nationkey").cast("bigint").alias("j"))
             .agg((F.sum("l_quantity") / F.lit(float(scale))).alias("w")))


def symmetric(pairs: DataFrame, keys=("snapshot",), i="i", j="j", w="w") -> DataFrame:
    """Both directions ``(keys..., src, dst, w)`` from a canonical half."""
    ks = list(keys)
    ends = F.explode(F.array(F.struct(F.col(i).alias("src"), F.col(j).alias("dst")),
                             F.struct(F.col(j).alias("src"), F.col(i).alias("dst"))))
    return (pairs.select(*ks, ends.alias("_e"), F.col(w).alias("w"))
                 .select(*ks, "_e.src", "_e.dst", "w"))


def trade_edges(spark: SparkSession, sf_dir: str, years=None,
                scale: float = 1000.0) -> DataFrame:
    """Trade graph edges ``(snapshot, src, dst, w)``, both directions, no zeros."""
    return symmetric(trade_pairs(spark, sf_dir, years, scale).filter(F.col("w") != 0))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node BIGINT, x ARRAY<DOUBLE>)`` from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("node"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def activity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cube ``(row BIGINT, col INT, slice INT, value DOUBLE)``.

    row = user_id, slice = week (weeks since Monday, 5 January 1970), col = day of
    that week (0-6), value = sum of event values that day.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-05"))
    return (ev.groupBy(F.col("user_id").cast("bigint").alias("row"),
                       F.pmod(day, F.lit(7)).cast("int").alias("col"),
                       floor_div(day, 7).cast("int").alias("slice"))
              .agg(F.sum("value").alias("value")))


def nation_points(spark: SparkSession, sf_dir: str, years=None,
                  scale: float = 1000.0) -> DataFrame:
    """Trade profile of every nation per order year as a 2-D point
    ``(snapshot INT, node BIGINT, x ARRAY<DOUBLE>)``:
    x = [ln(1 + exported quantity / scale), ln(1 + imported quantity / scale)].
    Exports are keyed by the supplier's nation, imports by the customer's.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    od = od.filter(_year_filter(F.col("o_orderdate"), years))
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(cu, F.col("o_custkey") == cu.c_custkey)
           .join(su, F.col("l_suppkey") == su.s_suppkey)
           .select(F.year("o_orderdate").cast("int").alias("snapshot"),
                   "c_nationkey", "s_nationkey", "l_quantity"))
    # one pass: each line counts as an export of its supplier nation and an
    # import of its customer nation
    flows = j.select("snapshot", F.explode(F.array(
        F.struct(F.col("s_nationkey").cast("bigint").alias("node"),
                 F.col("l_quantity").alias("ex"), F.lit(0.0).alias("im")),
        F.struct(F.col("c_nationkey").cast("bigint").alias("node"),
                 F.lit(0.0).alias("ex"), F.col("l_quantity").alias("im")))).alias("f"))
    agg = (flows.groupBy("snapshot", F.col("f.node").alias("node"))
                .agg(F.sum("f.ex").alias("ex"), F.sum("f.im").alias("im")))
    s = F.lit(float(scale))
    return agg.select("snapshot", "node",
                      F.array(F.log(F.lit(1.0) + F.col("ex") / s),
                              F.log(F.lit(1.0) + F.col("im") / s)).alias("x"))
