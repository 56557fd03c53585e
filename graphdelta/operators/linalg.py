"""Sparse linear algebra on COO edge tables, as joins and aggregations.

An edge table is ``(keys..., src BIGINT, dst BIGINT, w DOUBLE)`` holding both
directions of every undirected edge, no zeros.  ``keys`` (e.g. ``["snapshot"]``)
name independent graphs that are processed together in one job.  There are no
blocks and no dense n x n matrices: the diagonal is a ``(node, deg)`` column,
a vector is ``(keys..., node, x)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..functions.scalar import inv_degree as _inv_degree


def _k(keys) -> list[str]:
    return list(keys or [])


HUB_ROWS = 100_000  # rows of one join key that a task takes


def find_hubs(big: DataFrame, on: list[str], bucket: int = HUB_ROWS) -> DataFrame:
    """Keys with more than ``bucket`` rows and how many parts each is split into: at
    most rows / ``bucket`` rows, from a partially aggregated count."""
    return (big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > bucket)
            .select(*on, F.ceil(F.col("_n") / F.lit(bucket)).cast("int").alias("_parts")))


def hub_join(big: DataFrame, small: DataFrame, on: list[str], by: str,
             bucket: int = HUB_ROWS, hubs: DataFrame | None = None) -> DataFrame:
    """Inner join in which a key with more than ``bucket`` rows of ``big`` (a hub) is
    split by hash of the column ``by``; its rows of ``small`` go to every part.

    The table of hubs has at most rows / ``bucket`` rows, so Spark measures it as
    small and broadcasts it; keys that are no hubs stay whole.  ``hubs`` gives it where
    the caller knows it, for some of the columns ``on`` or for all.
    """
    hubs = find_hubs(big, on, bucket) if hubs is None else hubs
    hub_on = [c for c in on if c in hubs.columns]
    parts = F.coalesce("_parts", F.lit(1))
    dealt = (big.join(hubs, hub_on, "left")
             .withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts"))
    spread = (small.join(hubs, hub_on, "left")
              .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"))
    return dealt.join(spread, on + ["_part"]).drop("_part")


def scope_filter(scope: str = "all", block_size: int | None = None,
                 i: str = "i", j: str = "j") -> F.Column:
    """Which canonical pairs (i > j) take part.

    ``all``: every pair.  ``cross_block``: only pairs whose endpoints fall in
    different tiles of size ``block_size`` with the row tile above the column
    tile -- the original extracted edges from lower off-diagonal tiles only.
    """
    if scope == "all":
        return F.col(i) > F.col(j)
    if scope == "cross_block":
        if not block_size:
            raise ValueError("scope='cross_block' needs block_size")
        return floor_div(i, block_size) > floor_div(j, block_size)
    raise ValueError(f"unknown scope {scope!r}")


def half_edges(edges: DataFrame, keys=("snapshot",), scope: str = "all",
               block_size: int | None = None) -> DataFrame:
    """Each undirected edge once: ``(keys..., i, j, w)`` with i > j."""
    e = edges.select(*_k(keys), F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    return e.filter(scope_filter(scope, block_size)).filter(F.col("w") != 0)


def degree(edges: DataFrame, keys=("snapshot",)) -> DataFrame:
    """Weighted degree (row sums) ``(keys..., node, deg)``."""
    return (edges.groupBy(*_k(keys), F.col("src").alias("node"))
                 .agg(F.sum("w").alias("deg")))


def inv_degree(edges: DataFrame, keys=("snapshot",), power: float = -0.5) -> DataFrame:
    """``deg ** power`` per node, 0 where the degree is 0."""
    return degree(edges, keys).select(*_k(keys), "node", "deg",
                                      _inv_degree("deg", power).alias("inv"))


def row_normalize(edges: DataFrame, keys=("snapshot",), bucket: int = HUB_ROWS) -> DataFrame:
    """Transition matrix P = D^-1 A as ``(keys..., src, dst, p)``."""
    ks = _k(keys)
    deg = degree(edges, keys).withColumnRenamed("node", "src")
    return (hub_join(edges, deg, ks + ["src"], "dst", bucket)
                 .select(*ks, "src", "dst",
                         F.when(F.col("deg") != 0, F.col("w") / F.col("deg"))
                          .otherwise(F.lit(0.0)).alias("p")))


def matvec(edges: DataFrame, vec: DataFrame, keys=("snapshot",), w: str = "w",
           x: str = "x", bucket: int = HUB_ROWS) -> DataFrame:
    """A . x for a scalar vector ``(keys..., node, x)`` -> ``(keys..., node, x)``.

    Join on the column index, multiply, sum per row index.  A node whose row has
    no edge to a node of the vector gets no row (its value is 0).
    """
    ks = _k(keys)
    v = vec.select(*ks, F.col("node").alias("dst"), F.col(x).alias("_x"))
    return (hub_join(edges, v, ks + ["dst"], "src", bucket)
                 .groupBy(*ks, F.col("src").alias("node"))
                 .agg(F.sum(F.col(w) * F.col("_x")).alias("x")))


def matmul(a: DataFrame, b: DataFrame, keys=("snapshot",), bucket: int = HUB_ROWS) -> DataFrame:
    """A . B for COO matrices ``(keys..., src, dst, w)``.

    Equi-join on the inner index and a partial+final sum per output cell; entries
    that cancel to exactly 0 are dropped (COO has no zeros).
    """
    ks = _k(keys)
    aa = a.select(*ks, F.col("src").alias("r"), F.col("dst").alias("m"), F.col("w").alias("wa"))
    bb = b.select(*ks, F.col("src").alias("m"), F.col("dst").alias("c"), F.col("w").alias("wb"))
    return (hub_join(aa, bb, ks + ["m"], "r", bucket)
              .groupBy(*ks, F.col("r").alias("src"), F.col("c").alias("dst"))
              .agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
              .filter(F.col("w") != 0))


def mat_add(a: DataFrame, b: DataFrame, alpha: float = 1.0, keys=("snapshot",)) -> DataFrame:
    """A + alpha * B in COO (C4); ``alpha=-1`` is the subtraction."""
    ks = _k(keys)
    bb = b.select(*ks, "src", "dst", (F.col("w") * F.lit(float(alpha))).alias("w"))
    return (a.select(*ks, "src", "dst", "w").unionByName(bb)
             .groupBy(*ks, "src", "dst").agg(F.sum("w").alias("w"))
             .filter(F.col("w") != 0))


def laplacian(edges: DataFrame, keys=("snapshot",)) -> DataFrame:
    """D - A in COO: degrees on the diagonal, -w off it."""
    ks = _k(keys)
    diag = degree(edges, keys).select(*ks, F.col("node").alias("src"),
                                      F.col("node").alias("dst"), F.col("deg").alias("w"))
    return mat_add(diag, edges, -1.0, keys)


def profile(edges: DataFrame, keys=("snapshot",)) -> DataFrame:
    """One row per graph: node and edge counts, index range, weight stats."""
    ks = _k(keys)
    if not ks:
        raise ValueError("profile needs a graph key column")
    nodes = degree(edges, keys).groupBy(*ks).agg(F.count("*").alias("n_nodes"))
    stats = (edges.groupBy(*ks)
                  .agg(F.count("*").alias("n_entries"),
                       F.min(F.least("src", "dst")).alias("min_node"),
                       F.max(F.greatest("src", "dst")).alias("max_node"),
                       F.sum("w").alias("total_w"),
                       F.min("w").alias("min_w"),
                       F.max("w").alias("max_w")))
    return stats.join(nodes, ks)


def tile_edges(edges: DataFrame, block_size: int, keys=("snapshot",)) -> DataFrame:
    """Tile coordinates of every entry: ``(keys..., bi, bj, r, c, w)``.

    COO needs no zero padding: a node beyond the last full tile simply lands in a
    tile of its own.
    """
    p = F.lit(int(block_size))
    return edges.select(*_k(keys),
                        floor_div("src", block_size).alias("bi"),
                        floor_div("dst", block_size).alias("bj"),
                        F.pmod(F.col("src"), p).cast("int").alias("r"),
                        F.pmod(F.col("dst"), p).cast("int").alias("c"),
                        "w")
