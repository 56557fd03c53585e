"""Change scores, the cumulative cut and the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DEFAULT_D, DEFAULT_EPS, DEFAULT_THRESHOLD, DEFAULT_TOL
from .distance import pair_distance
from .linalg import scope_filter
from .ordered import running_sum
from .tiles import scored_pairs
from .walk import BROADCAST_LIMIT

NO_MAGNITUDE = -2000       # below that of every positive double
GROUP_BROADCAST = 100_000  # groups, counted, up to which their bounds are broadcast


def _with_key(df: DataFrame, keys) -> tuple[DataFrame, list[str], bool]:
    """Guarantee at least one grouping key (a constant one if none is given) so
    that per-group tables are always joined on a key, never cross joined."""
    ks = list(keys or [])
    if ks:
        return df, ks, False
    return df.withColumn("_g", F.lit(0)), ["_g"], True


def weight_change(edges: DataFrame, s1, s2, group_keys=(), snapshot: str = "snapshot",
                  scope: str = "all", block_size: int | None = None) -> DataFrame:
    """Canonical pairs whose weight differs between two snapshots (C4 + B7 + B9).

    ``(group_keys..., i, j, w1, w2, abs_da)``; a pair absent from a snapshot has
    weight 0 there (full outer join + coalesce).
    """
    gk = list(group_keys)
    half = edges.filter(F.col("src") > F.col("dst")).select(
        *gk, snapshot, F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    a = half.filter(F.col(snapshot) == F.lit(s1)).select(*gk, "i", "j", F.col("w").alias("w1"))
    b = half.filter(F.col(snapshot) == F.lit(s2)).select(*gk, "i", "j", F.col("w").alias("w2"))
    da = F.abs(F.coalesce(F.col("w1"), F.lit(0.0)) - F.coalesce(F.col("w2"), F.lit(0.0)))
    return (a.join(b, gk + ["i", "j"], "full_outer")
             .select(*gk, "i", "j", "w1", "w2", da.alias("abs_da"))
             .filter((F.col("abs_da") != 0) & scope_filter(scope, block_size)))


def delta_e(change: DataFrame, dist: DataFrame, s1, s2, group_keys=(),
            snapshot: str = "snapshot") -> DataFrame:
    """dE = |A1 - A2| * |d1 - d2| per changed pair (G5); a pair missing from a
    snapshot's distance table has distance 0 there (C5)."""
    gk = list(group_keys)
    d1 = dist.filter(F.col(snapshot) == F.lit(s1)).select(*gk, "i", "j", F.col("d").alias("d1"))
    d2 = dist.filter(F.col(snapshot) == F.lit(s2)).select(*gk, "i", "j", F.col("d").alias("d2"))
    out = (change.join(d1, gk + ["i", "j"], "left").join(d2, gk + ["i", "j"], "left")
                 .withColumn("d1", F.coalesce("d1", F.lit(0.0)))
                 .withColumn("d2", F.coalesce("d2", F.lit(0.0))))
    return out.withColumn("delta_e", F.col("abs_da") * F.abs(F.col("d1") - F.col("d2")))


def anomaly_cut(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD, group_keys=(),
                value: str = "delta_e", on_none: str = "all",
                n_partitions: int | None = None) -> DataFrame:
    """Running sum in ascending (value, i, j) order and the anomaly flag.

    A row is anomalous from the first row whose running sum exceeds the threshold
    (strictly) to the end.  When no running sum exceeds it the original flags
    *every* row (``on_none='all'``); ``on_none='empty'`` flags none.  Whether one
    exceeds it is read off the running sums themselves: a separately added total
    may differ from the last of them by rounding.
    """
    df, gk, added = _with_key(scores, group_keys)
    rs = running_sum(df, value, [value, "i", "j"], gk, "running_sum", n_partitions)
    largest = rs.groupBy(*gk).agg(F.max("running_sum").alias("_largest"))  # one row per group
    # without keys it is one row; a join by key would shuffle all rows to meet it
    out = rs.join(F.broadcast(largest) if added else largest, gk)
    none_exceeds = F.col("_largest") <= F.lit(float(threshold))
    if on_none == "all":
        flag = (F.col("running_sum") > F.lit(float(threshold))) | none_exceeds
    elif on_none == "empty":
        flag = F.col("running_sum") > F.lit(float(threshold))
    else:
        raise ValueError(f"unknown on_none {on_none!r}")
    out = out.withColumn("anomalous", flag).drop("_largest")
    return out.drop("_g") if added else out


def banded_cut(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD, group_keys=(),
               value: str = "delta_e", on_none: str = "all",
               n_partitions: int | None = None) -> DataFrame:
    """The flag of ``anomaly_cut`` without ordering all rows (E3, E4): ``scores`` with
    ``anomalous``, no running sum.

    Values, which are not negative, are summed by binary magnitude (zeros on their own),
    at most some 2,100 sums a group; these say in which magnitude the running sum passes
    the threshold.  Rows of lower magnitudes are not anomalous, those of higher ones are,
    and only the rows of that one magnitude, the band, are ordered by (value, i, j).
    ``scores`` is read twice: hand in a stored or checkpointed table.  Sums are added in
    another order than in ``anomaly_cut``, so a running sum that equals the threshold up
    to rounding may fall on the other side.
    """
    if on_none not in ("all", "empty"):
        raise ValueError(f"unknown on_none {on_none!r}")
    df, gk, added = _with_key(scores, group_keys)
    t = F.lit(float(threshold))
    df = df.withColumn("_mag", F.when(F.col(value) > 0, F.floor(F.log2(value)).cast("int"))
                       .otherwise(F.lit(NO_MAGNITUDE)))
    sums = df.groupBy(*gk, "_mag").agg(F.sum(value).alias("_s"))
    upto = Window.partitionBy(*gk).orderBy("_mag").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.col("_upto") > t
    bounds = (sums.withColumn("_upto", F.sum("_s").over(upto)).groupBy(*gk).agg(
        F.min(F.when(passed, F.col("_mag"))).alias("_cut"),
        F.coalesce(F.max(F.when(~passed, F.col("_upto"))), F.lit(0.0)).alias("_before"))
        .checkpoint(eager=True))  # one row per group
    if bounds.count() <= GROUP_BROADCAST:
        bounds = F.broadcast(bounds)
    at = df.join(bounds, gk)
    in_band = F.coalesce(F.col("_mag") == F.col("_cut"), F.lit(False))
    rest = at.filter(~in_band).withColumn(
        "anomalous", F.coalesce(F.col("_mag") > F.col("_cut"), F.lit(on_none == "all")))
    band = running_sum(at.filter(in_band), value, [value, "i", "j"], gk, "_run", n_partitions)
    last = band.groupBy(*gk).agg(F.max("_run").alias("_last"))
    # the magnitudes say that the sum is passed here: by the last row of the band, if
    # rounding hides it
    band = band.join(last, gk).withColumn(
        "anomalous", (F.col("_before") + F.col("_run") > t) | (F.col("_run") == F.col("_last")))
    out = rest.unionByName(band.drop("_run", "_last")).drop("_mag", "_cut", "_before")
    return out.drop("_g") if added else out


def anomalous_nodes(flagged: DataFrame, group_keys=()) -> DataFrame:
    """Distinct endpoints of the anomalous edges ``(group_keys..., node)`` (F2)."""
    gk = list(group_keys)
    return (flagged.filter(F.col("anomalous"))
                   .select(*gk, F.explode(F.array("i", "j")).alias("node"))
                   .distinct())


def detect(edges: DataFrame, s1, s2, group_keys=(), snapshot: str = "snapshot",
           mode: str = "sketch", threshold: float = DEFAULT_THRESHOLD, scope: str = "all",
           block_size: int | None = None, eps: float = DEFAULT_EPS, tol: float = DEFAULT_TOL,
           d: int = DEFAULT_D, weight_power: float = 1.0, seed: int = 0,
           on_none: str = "all", n_nodes: int | None = None, sign_hash: str = "md5",
           independent: bool = False, broadcast_limit: int = BROADCAST_LIMIT,
           nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two snapshots -> (scored changed pairs with the cut, anomalous nodes).

    Both snapshots (and every ``group_keys`` value, e.g. candidate sigmas) go
    through one batched walk.  Distances are computed only for the changed pairs
    that are edges of the snapshot -- the only ones the score reads.

    ``mode='sketch'`` works on any graph; ``'exact'`` has a slot for every half edge,
    so its vectors hold nodes x edges numbers: for small graphs only.  With
    ``independent`` each snapshot draws its own signs.  Vectors of up to
    ``broadcast_limit`` bytes, counted, are broadcast; the result is the same.

    ``nodes (node)``, every end of an edge, lets two snapshots that turn out to be dense
    be held and walked as tiles of weights (``tiles.scored_pairs``): same signs, terms
    and scores.  Other graphs are walked as rows, whether it is given or not.
    """
    gk = list(group_keys)
    if nodes is not None and not gk and (mode, scope, sign_hash, independent) == ("sketch", "all", "md5", False):
        scores = scored_pairs(edges, nodes, s1, s2, eps, tol, d, weight_power, seed, n_nodes, snapshot)
        if scores is not None:
            flagged = anomaly_cut(scores, threshold, on_none=on_none)
            return flagged, anomalous_nodes(flagged)
    # The edge table feeds the change join, the incidence, the degrees and P:
    # materialise it once so its (possibly huge) input plan runs once.
    e = edges.filter(F.col(snapshot).isin(s1, s2)).checkpoint(eager=True)
    change = weight_change(e, s1, s2, gk, snapshot, scope, block_size).checkpoint(eager=True)
    pairs = (change.filter(F.col("w1").isNotNull()).select(*gk, F.lit(s1).alias(snapshot), "i", "j")
             .unionByName(change.filter(F.col("w2").isNotNull())
                          .select(*gk, F.lit(s2).alias(snapshot), "i", "j")))
    dist = pair_distance(e, pairs, gk + [snapshot], mode, eps, tol, d, weight_power, scope,
                         block_size, seed, n_nodes, sign_hash=sign_hash, materialize=False,
                         independent=independent, broadcast_limit=broadcast_limit)
    scores = delta_e(change, dist, s1, s2, gk, snapshot).drop("w1", "w2").checkpoint(eager=True)
    flagged = anomaly_cut(scores, threshold, gk, on_none=on_none)
    return flagged, anomalous_nodes(flagged, gk)
