"""Comparing a detection with a known truth, and tuning the kernel width
(C7-C9, D4, D6, E6, G7-G9, G11).

The sweep carries ``sigma`` as a grouping key through graph construction, the
walk, the scores and the comparison, so all candidate widths (and the truth)
are evaluated by one batched job instead of one job per candidate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import rbf_graph
from .score import anomalous_nodes, detect


def edge_diff(truth: DataFrame, pred: DataFrame, group_keys=(), value: str = "delta_e") -> DataFrame:
    """``truth - pred`` per ordered pair (i, j) over the union of both key sets,
    absent = 0 (C7) -> ``(group_keys..., i, j, diff)``."""
    gk = list(group_keys)
    t = truth.select(*gk, "i", "j", F.col(value).alias("_t"))
    p = pred.select(*gk, "i", "j", F.col(value).alias("_p"))
    return (t.join(p, gk + ["i", "j"], "full_outer")
             .select(*gk, "i", "j",
                     (F.coalesce("_t", F.lit(0.0)) - F.coalesce("_p", F.lit(0.0))).alias("diff")))


def squared_loss(diff: DataFrame, group_keys=()) -> DataFrame:
    """sum(diff^2) (D4) -> ``(group_keys..., loss)``."""
    gk = list(group_keys)
    return diff.groupBy(*gk).agg(F.sum(F.col("diff") * F.col("diff")).alias("loss"))


def node_mismatch(truth_nodes: DataFrame, pred_nodes: DataFrame, group_keys=(),
                  groups: DataFrame | None = None) -> DataFrame:
    """Per group: nodes in exactly one of the two sets (C8), via a full outer
    join -> ``(group_keys..., n_truth, n_pred, n_mismatch)``.

    Two empty sets agree.  Without keys there is always one row; with keys,
    ``groups (group_keys...)`` names the groups that must have one even if both
    of their sets are empty.
    """
    gk = list(group_keys)
    t = truth_nodes.select(*gk, "node", F.lit(1).alias("_t"))
    p = pred_nodes.select(*gk, "node", F.lit(1).alias("_p"))
    counts = t.join(p, gk + ["node"], "full_outer").groupBy(*gk).agg(
        F.count("_t").alias("n_truth"), F.count("_p").alias("n_pred"),
        F.count_if(F.col("_t").isNull() | F.col("_p").isNull()).alias("n_mismatch"))
    if gk and groups is not None:
        counts = groups.select(*gk).distinct().join(counts, gk, "left").na.fill(
            0, ["n_truth", "n_pred", "n_mismatch"])
    return counts


def same_nodes(truth_nodes: DataFrame, pred_nodes: DataFrame, group_keys=(),
               groups: DataFrame | None = None) -> DataFrame:
    """Node-set equality (C8) -> ``(group_keys..., n_truth, n_pred, n_mismatch, same)``."""
    m = node_mismatch(truth_nodes, pred_nodes, group_keys, groups)
    return m.withColumn("same", F.col("n_mismatch") == 0)


def rank_agreement(ranked: DataFrame, known: DataFrame, n: int, factor: float = 1.0,
                   group_keys=()) -> DataFrame:
    """1 - factor * sum (i - j)^2 / (N (N^2 - 1)).

    ``ranked`` / ``known``: ``(group_keys..., node, pos)``; a node of ``ranked``
    missing from ``known`` takes position N; with N = 1 there is nothing to order and
    the agreement is 1.  The original used ``^`` (XOR) and
    integer division and had no factor 6; we compute the arithmetic it intended,
    with ``factor=6`` giving Spearman's rho.
    """
    gk = list(group_keys)
    k = known.select(*gk, "node", F.col("pos").alias("_kpos"))
    j = ranked.join(k, gk + ["node"], "left").withColumn(
        "_kpos", F.coalesce(F.col("_kpos"), F.lit(int(n)).cast("bigint")))
    spread = float(n) * (float(n) * float(n) - 1.0)
    off = j.groupBy(*gk).agg(F.sum(F.pow(F.col("pos") - F.col("_kpos"), 2)).alias("_off"))
    rho = F.lit(1.0) - F.lit(float(factor)) * F.col("_off") / F.lit(spread) if spread else F.lit(1.0)
    return off.select(*gk, rho.alias("rho"))


def secant_step(trace: DataFrame, run: str = "run_id", first_step: float = 0.4) -> DataFrame:
    """Next sigma per trace row (E6): the first row of a run steps by +0.4, later
    rows take ``sigma - lr * (loss - prev_loss) / (sigma - prev_sigma)``.

    A repeated sigma has no slope: the next one is NULL.  Trace: ``(run_id, iter,
    sigma, loss, learning_rate)``; the window is per run (one run = a few iterations).
    """
    w = Window.partitionBy(run).orderBy("iter")
    prev_s = F.lag("sigma").over(w)
    prev_l = F.lag("loss").over(w)
    slope = F.try_divide(F.col("loss") - prev_l, F.col("sigma") - prev_s)
    step = F.col("sigma") - F.col("learning_rate") * slope
    return trace.withColumn("next_sigma",
                            F.when(prev_s.isNull(), F.col("sigma") + F.lit(first_step))
                             .otherwise(step))


def trace_summary(trace: DataFrame, by: str = "learning_rate") -> DataFrame:
    """Per run: first / last sigma and loss, the best loss and where."""
    first = F.min_by
    last = F.max_by
    return trace.groupBy(by).agg(
        F.count("*").alias("n_iter"),
        first("sigma", "iter").alias("first_sigma"),
        last("sigma", "iter").alias("last_sigma"),
        first("loss", "iter").alias("first_loss"),
        last("loss", "iter").alias("last_loss"),
        F.min("loss").alias("min_loss"),
        F.min_by("iter", F.struct("loss", "iter")).alias("argmin_iter"))


def _detected(points: DataFrame, keys, s1, s2, snapshot: str, min_weight: float,
              detect_opts: dict, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph and detection of ``points (keys..., sigma, snapshot, node, x)``."""
    ks = list(keys)
    graph = ks if "sigma" in ks else ks + ["sigma"]
    edges = rbf_graph(points, "sigma", min_weight, keys=graph + [snapshot], dims=dims)
    flagged, _ = detect(edges.select(*ks, snapshot, "src", "dst", "w"), s1, s2, ks, snapshot,
                        **detect_opts)
    flagged = flagged.checkpoint(eager=True)
    return flagged, anomalous_nodes(flagged, ks)


def _compared(flagged: DataFrame, nodes: DataFrame, truth: DataFrame, truth_nodes: DataFrame,
              groups: DataFrame, keys) -> DataFrame:
    """``(groups..., loss, same, n_nodes)``; the truth carries the keys, one copy for
    each group."""
    ks = list(keys)
    loss = squared_loss(edge_diff(truth, flagged, ks), ks)
    same = same_nodes(truth_nodes, nodes, ks, groups)
    return groups.join(loss, ks, "left").join(same, ks, "left").select(
        *groups.columns, F.coalesce("loss", F.lit(0.0)).alias("loss"), "same",
        F.col("n_pred").cast("bigint").alias("n_nodes"))


def _for_each(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Every row of ``df`` with each of a few parameter rows (a literal list)."""
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    return df.withColumn("_each", F.explode(each)).select(
        *df.columns, *[F.col(f"_each.{n}").alias(n) for n in names])


def sigma_sweep(points: DataFrame, sigmas, truth_sigma: float, s1, s2,
                snapshot: str = "snapshot", mode: str = "sketch", threshold: float = 0.1,
                min_weight: float = 0.0, **detect_opts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluate every candidate sigma against the detection at ``truth_sigma``.

    ``points``: ``(snapshot, node, x ARRAY<DOUBLE>)`` holding both snapshots.
    Returns ``(summary, flagged, nodes)`` where summary is
    ``(sigma, loss, same, n_nodes)``: the squared loss of the dE lists and
    whether the anomalous node sets match; the truth itself is included.
    """
    cands = [(s,) for s in sorted({float(s) for s in sigmas} | {float(truth_sigma)})]
    flagged, nodes = _detected(
        _for_each(points.checkpoint(eager=True), cands, ["sigma"]), ["sigma"], s1, s2, snapshot,
        min_weight, dict(detect_opts, mode=mode, threshold=threshold))
    at_truth = F.col("sigma") == F.lit(float(truth_sigma))
    summary = _compared(flagged, nodes,
                        _for_each(flagged.filter(at_truth).drop("sigma"), cands, ["sigma"]),
                        _for_each(nodes.filter(at_truth).drop("sigma"), cands, ["sigma"]),
                        points.sparkSession.createDataFrame(cands, "sigma double"), ["sigma"])
    return summary, flagged, nodes


def evaluate_sigma(points: DataFrame, sigma: float, truth_sigma: float, s1, s2,
                   **kw) -> DataFrame:
    """One candidate against the truth (G7): ``(sigma, loss, same, n_nodes, score)`` where
    score is 0 on a node-set match and the loss otherwise (the search objective)."""
    summary, _, _ = sigma_sweep(points, [sigma], truth_sigma, s1, s2, **kw)
    return (summary.filter(F.col("sigma") == F.lit(float(sigma)))
                   .withColumn("score", F.when(F.col("same"), F.lit(0.0)).otherwise(F.col("loss"))))


TRACE = "run_id int, learning_rate double, iter int, sigma double, loss double, same boolean"
TRUTH_RUN = -1


def calibrate_sigma(points: DataFrame, truth_sigma: float, s1, s2, starts, learning_rates,
                    iterations: int = 20, snapshot: str = "snapshot", mode: str = "sketch",
                    threshold: float = 0.1, min_weight: float = 0.0, **detect_opts) -> DataFrame:
    """Secant search for sigma until the anomalous nodes match the truth (G9), from
    every start with every learning rate -> the trace ``(run_id, learning_rate, iter,
    sigma, loss, same)``, one row for each sigma tried.

    The trace is the whole state.  Each round judges the current sigma of all open
    runs in one batched pass (the run is a graph key; the first round has the truth
    as a run of its own), adds a row to each, and takes their next sigma from
    ``secant_step``.  A run is closed by a match after its first row, by a step that
    does not move or has no slope, at sigma 0, or after ``iterations`` rounds.  Per
    round a row of scalars for each run reaches the driver.

    The sketch is as wide as the nodes of ``points`` ask for, in every round, also
    where a narrow sigma leaves some without an edge (``n_nodes`` overrides it).
    """
    spark = points.sparkSession
    points = points.checkpoint(eager=True)
    n_nodes, lo, hi = points.agg(F.countDistinct("node"), F.min(F.size("x")),
                                 F.max(F.size("x"))).first()
    if lo != hi:
        raise ValueError(f"points must share one dimension (found {lo}..{hi})")
    opts = dict({"n_nodes": n_nodes}, **detect_opts, mode=mode, threshold=threshold)
    rates = {i: float(lr) for i, (lr, _) in enumerate(itertools.product(learning_rates, starts))}
    open_runs = {i: float(s) for i, (_, s) in enumerate(itertools.product(learning_rates, starts))}
    trace: list[tuple] = []
    truth = truth_nodes = None
    for it in range(iterations):
        at_truth = {} if truth else {TRUTH_RUN: float(truth_sigma)}
        flagged, nodes = _detected(
            _for_each(points, list((open_runs | at_truth).items()), ["run_id", "sigma"]),
            ["run_id"], s1, s2, snapshot, min_weight, opts, lo)
        is_truth = F.col("run_id") == TRUTH_RUN
        if at_truth:
            truth = flagged.filter(is_truth).drop("run_id")
            truth_nodes = nodes.filter(is_truth).drop("run_id")
        runs = [(i,) for i in open_runs]
        now = spark.createDataFrame([(i, rates[i], it, s) for i, s in open_runs.items()],
                                    "run_id int, learning_rate double, iter int, sigma double")
        judged = _compared(flagged.filter(~is_truth), nodes.filter(~is_truth),
                           _for_each(truth, runs, ["run_id"]),
                           _for_each(truth_nodes, runs, ["run_id"]), now, ["run_id"])
        # of the rows before, the step needs the last one of each open run alone
        before = [r for r in trace if r[0] in open_runs and r[2] == it - 1]
        stepped = secant_step(judged.drop("n_nodes").unionByName(spark.createDataFrame(before, TRACE)))
        rows = stepped.filter(F.col("iter") == it).collect()
        trace += [(r.run_id, r.learning_rate, it, r.sigma, r.loss, r.same) for r in rows]
        open_runs = {r.run_id: r.next_sigma for r in rows if (not r.same or it == 0)
                     and r.next_sigma is not None and r.next_sigma != r.sigma and r.next_sigma != 0}
        if not open_runs:
            break
    return spark.createDataFrame(trace, TRACE)
