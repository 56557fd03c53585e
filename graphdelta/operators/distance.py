"""Commute-time-like edge distances (G4), exactly or by a hash-seeded sketch.

d(u, v) = sum_t (z_t[u] - z_t[v])^2, where z_t is the walk series applied to the
t-th column of B^T W Q.  ``exact`` takes Q = I (one slot per half edge, the
sketch's expectation); ``sketch`` takes k = int(ceil(log2 n)/eps) random
+-1/sqrt(k) columns.  Not multiplied by the graph volume.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DEFAULT_D, DEFAULT_EPS, DEFAULT_TOL, series_length, sketch_width
from .linalg import HUB_ROWS, find_hubs, half_edges, hub_join
from .walk import (BROADCAST_LIMIT, MAX_WIDTH, ROWS_PER_TASK, _fits, incidence_exact,
                   incidence_sketch, walk_series, xcols, vector_width)


def solve_columns(edges: DataFrame, keys=("snapshot",), mode: str = "sketch",
                  eps: float = DEFAULT_EPS, tol: float = DEFAULT_TOL, d: int = DEFAULT_D,
                  weight_power: float = 1.0, scope: str = "all",
                  block_size: int | None = None, seed: int = 0,
                  max_width: int = MAX_WIDTH, n_nodes: int | None = None,
                  sign_hash: str = "md5", independent: bool = False,
                  broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The solved columns z ``(keys..., chunk, node, x...)`` for every graph."""
    ks = list(keys)
    half = half_edges(edges, ks, scope, block_size)
    if mode == "exact":
        b = incidence_exact(half, ks, weight_power, max_width)
    elif mode == "sketch":
        if n_nodes is None:
            # one scalar: the largest node count of the graphs in the batch
            n_nodes = (edges.groupBy(*ks).agg(F.countDistinct("src").alias("n"))
                            .agg(F.max("n")).first()[0] or 0)
        k = sketch_width(int(n_nodes), eps)
        b = incidence_sketch(half, k, ks, seed, weight_power, max_width, sign_hash, independent)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return walk_series(edges, b, series_length(tol, d), ks, broadcast_limit)


def gather_pairs(pairs: DataFrame, z: DataFrame, keys=("snapshot",),
                 broadcast_limit: int = BROADCAST_LIMIT, bucket: int = HUB_ROWS) -> DataFrame:
    """sum over slots of (z[i] - z[j])^2 for ``pairs (keys..., i, j)`` (C6 + D3).

    Pairs whose endpoints have no solved row get no output row (distance 0).  Where the
    solved vector is too large to broadcast, both joins shuffle, and an end with more
    than ``bucket`` pairs is split by the other end in either of them.
    """
    ks = list(keys)
    width = vector_width(z)
    cols = xcols(width)
    zi = z.select(*ks, "chunk", "node", *cols).toDF(*ks, "chunk", "i", *["a" + c for c in cols])
    zj = z.select(*ks, "chunk", "node", *cols).toDF(*ks, "chunk", "j", *["b" + c for c in cols])
    p = pairs.select(*ks, "i", "j")
    n_rows, n_chunks = (z.groupBy(*ks, "chunk").agg(F.count("*").alias("n"))
                        .agg(F.sum("n"), F.count("*")).first())
    fits = _fits(n_rows or 0, width, broadcast_limit)
    if fits:
        zi, zj = F.broadcast(zi), F.broadcast(zj)
        # pairs x chunks joined rows per task, not the pair table's bytes, set
        # the partition count (capped by the configured shuffle partitions)
        n_parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        work = max(1, math.ceil(p.count() * max(n_chunks, 1) / ROWS_PER_TASK))
        p = p.repartition(min(n_parts, work), *ks, "i", "j")
    sq = F.expr(" + ".join(f"(a{c} - b{c}) * (a{c} - b{c})" for c in cols))
    if fits:
        joined = p.join(zi, ks + ["i"]).join(zj, ks + ["chunk", "j"])
    else:
        # hubs among j are counted on the pairs, not on pairs times chunks
        joined = hub_join(hub_join(p, zi, ks + ["i"], "j", bucket), zj, ks + ["chunk", "j"], "i",
                          hubs=find_hubs(p, ks + ["j"], bucket))
    return joined.groupBy(*ks, "i", "j").agg(F.sum(sq).alias("d"))


def pair_distance(edges: DataFrame, pairs: DataFrame | None = None, keys=("snapshot",),
                  mode: str = "sketch", eps: float = DEFAULT_EPS, tol: float = DEFAULT_TOL,
                  d: int = DEFAULT_D, weight_power: float = 1.0, scope: str = "all",
                  block_size: int | None = None, seed: int = 0,
                  n_nodes: int | None = None, sign_hash: str = "md5",
                  materialize: bool = True, independent: bool = False,
                  broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Distances ``(keys..., i, j, d)``; default pairs = the graph's half edges in scope.

    ``materialize`` checkpoints the edge table first (it is read four times);
    pass False when the caller already did."""
    ks = list(keys)
    if materialize:
        edges = edges.checkpoint(eager=True)
    z = solve_columns(edges, ks, mode, eps, tol, d, weight_power, scope, block_size, seed,
                      n_nodes=n_nodes, sign_hash=sign_hash, independent=independent,
                      broadcast_limit=broadcast_limit)
    if pairs is None:
        pairs = half_edges(edges, ks, scope, block_size).select(*ks, "i", "j")
    dist = gather_pairs(pairs, z, ks, broadcast_limit)
    return (pairs.select(*ks, "i", "j").join(dist, ks + ["i", "j"], "left")
                 .select(*ks, "i", "j", F.coalesce(F.col("d"), F.lit(0.0)).alias("d")))
