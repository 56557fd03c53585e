"""The literal materialised solver (G2, G3 as written): chain product of
Neumann factors and preconditioned Richardson steps, on COO joins.

    S = D^-1/2 A D^-1/2
    C = (I + S^(2^(d-2))) ... (I + S^2)(I + S) D^-1/2       (d - 1 factors)
    Z = D^-1/2 C,  y <- y - Z (D - A) y + Z b,  q - 1 times from y = 0

Each product is a join + aggregate, and the powers of S fill in quickly, so
this form costs O(n^2) per product on any connected graph; ``walk_series``
computes the same vector without materialising a product.  Kept as an operator
of its own (and as the reference the series is tested against), for small
graphs only.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DEFAULT_D, DEFAULT_TOL
from .linalg import degree, laplacian, mat_add, matmul, matvec


def _diag(deg: DataFrame, ks, col: str) -> DataFrame:
    return deg.select(*ks, F.col("node").alias("src"), F.col("node").alias("dst"),
                      F.col(col).alias("w")).filter(F.col("w") != 0)


def chain_product(edges: DataFrame, d: int = DEFAULT_D, keys=("snapshot",)) -> DataFrame:
    """C as COO ``(keys..., src, dst, w)``."""
    ks = list(keys)
    deg = degree(edges, ks).withColumn(
        "isq", F.when(F.col("deg") > 0, F.pow(F.col("deg"), F.lit(-0.5))).otherwise(F.lit(0.0)))
    isq = deg.select(*ks, "node", "isq")
    s = (edges.join(isq.withColumnRenamed("node", "src").withColumnRenamed("isq", "a"), ks + ["src"])
              .join(isq.withColumnRenamed("node", "dst").withColumnRenamed("isq", "b"), ks + ["dst"])
              .select(*ks, "src", "dst", (F.col("a") * F.col("w") * F.col("b")).alias("w")))
    ident = _diag(deg.withColumn("one", F.lit(1.0)), ks, "one")
    factors = max(d, 1) - 1
    powers = list(itertools.accumulate(  # S, S^2, S^4, ...
        range(1, factors), lambda p, _: matmul(p, p, ks).checkpoint(eager=True), initial=s))
    return functools.reduce(
        lambda c, p: matmul(mat_add(p, ident, 1.0, ks), c, ks).checkpoint(eager=True),
        powers[:factors], _diag(deg, ks, "isq"))


def richardson_solve(edges: DataFrame, b: DataFrame, tol: float = DEFAULT_TOL,
                     d: int = DEFAULT_D, keys=("snapshot",)) -> DataFrame:
    """y after q - 1 preconditioned Richardson steps for scalar right-hand sides
    ``b (keys..., slot, node, x)``; ``slot`` is carried as an extra key."""
    ks = list(keys)
    q = -int(math.ceil(math.log(tol)))
    c = chain_product(edges, d, ks)
    deg = degree(edges, ks).withColumn(
        "isq", F.when(F.col("deg") > 0, F.pow(F.col("deg"), F.lit(-0.5))).otherwise(F.lit(0.0)))
    z = (c.join(deg.select(*ks, F.col("node").alias("src"), "isq"), ks + ["src"])
          .select(*ks, "src", "dst", (F.col("isq") * F.col("w")).alias("w")))
    z2 = matmul(z, laplacian(edges, ks), ks).checkpoint(eager=True)
    slots = b.select(*ks, "slot").distinct()
    zs = z.join(F.broadcast(slots), ks)
    z2s = z2.join(F.broadcast(slots), ks)
    chi = matvec(zs, b, ks + ["slot"]).checkpoint(eager=True)
    y = chi.filter(F.lit(False))  # y = 0: an empty sparse vector
    for _ in range(max(q - 1, 0)):
        t = matvec(z2s, y, ks + ["slot"]).select(*ks, "slot", "node", (-F.col("x")).alias("x"))
        y = (y.unionByName(t).unionByName(chi)
              .groupBy(*ks, "slot", "node").agg(F.sum("x").alias("x"))
              .checkpoint(eager=True))
    return y
