"""The registered queries: each reads the driver tables (or what Spark derives
from them) and returns a DataFrame with rounded doubles and explicit types.

Inputs, fixed for every query (chosen so the driver tables exercise the method):

* trade graph: nations as nodes, ``sum(l_quantity)/1000`` per order year as the
  weight of a nation pair; every year is a snapshot, and where two snapshots are
  compared they are 1997 and 1998;
* activity grid: events as ``row = user_id``, ``col = day of week``, one slice per
  week; where two weeks are compared they are the first two of January 2024;
* embedding points: ``embeddings.embedding`` as 64-d points;
* nation trade profiles: 2-d points per nation and year, for the sigma sweep.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import month_index, sketch_width
from ..operators import evaluate as ev
from ..operators import kernel, linalg, perturb, score
from ..operators.distance import pair_distance, solve_columns
from ..operators.ordered import dense_index
from ..operators.walk import incidence_sketch, vector_width, xcols
from ..session import ensure_checkpoint_dir
from ..sources import snapshots, tables

# Parameters of the registered queries.
YEARS = (1997, 1998)
S1, S2 = YEARS
TILE = 5                      # tile size for the cross_block scope and tiling
SIGMA = 1.0 / math.sqrt(2.0)  # kernel width of the original runs
SWEEP = (0.1, 0.25, 0.5, 1.0)
EVAL_THRESHOLD = 0.3          # flags some of the nodes under either seed
SWEEP_THRESHOLD = 0.06        # flags some of the nodes at the truth, not all
LEARNING_RATES, STARTS, ITERATIONS = (0.5, 20.0), (0.25, 1.0), 20
GRID_SPACING = 7              # a tile is a week of seven users
WEEKS = (2817, 2818)          # weeks since Monday, 5 January 1970
ROUND = 9


def _r(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), ROUND).alias(name or (c if isinstance(c, str) else None))


def _edges(spark, sf):
    """All order years."""
    return tables.trade_edges(spark, sf)


def _kept_edges(spark, sf):
    """All order years, read and joined once for queries that use the graph several times."""
    return _edges(spark, sf).checkpoint(eager=True)


def _pair_edges(spark, sf):
    """The two years that are compared."""
    return tables.trade_edges(spark, sf, YEARS)


def to_long(vec: DataFrame, keys=("snapshot",), n_slots: int | None = None) -> DataFrame:
    """Wide vector -> ``(keys..., slot, node, x)``; padding slots dropped."""
    ks = list(keys)
    width = vector_width(vec)
    out = vec.select(*ks, "chunk", "node", F.posexplode(F.array(*xcols(width))).alias("u", "x"))
    out = out.select(*ks, (F.col("chunk") * F.lit(width) + F.col("u")).cast("bigint").alias("slot"),
                     "node", "x")
    if n_slots is not None:
        out = out.filter(F.col("slot") < F.lit(int(n_slots)))
    return out


# ---------------------------------------------------------------- graph basics

def q_trade_edges(spark, sf):
    return _edges(spark, sf).select("snapshot", "src", "dst", _r("w"))


def q_degree(spark, sf):
    return linalg.degree(_edges(spark, sf)).select("snapshot", "node", _r("deg"))


def q_inv_degree(spark, sf):
    return linalg.inv_degree(_edges(spark, sf), power=-0.5).select(
        "snapshot", "node", _r("deg"), _r("inv"))


def q_graph_profile(spark, sf):
    p = linalg.profile(_kept_edges(spark, sf))
    return p.select("snapshot", "n_entries", "n_nodes", "min_node", "max_node",
                    _r("total_w"), _r("min_w"), _r("max_w"))


def q_half_edges_cross_block(spark, sf):
    h = linalg.half_edges(_edges(spark, sf), ["snapshot"], "cross_block", TILE)
    return h.select("snapshot", "i", "j", _r("w"))


def q_tile_edges(spark, sf):
    t = linalg.tile_edges(_edges(spark, sf), TILE)
    return t.select("snapshot", "bi", "bj", "r", "c", _r("w"))


def _stored(spark, df: DataFrame, write) -> str:
    """Where ``write(df, path)`` has put it: a fresh folder beside the checkpoints."""
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    write(df, path)
    return path


def q_tiles_roundtrip(spark, sf):
    """Dense tiles as stored: size and content of each."""
    tiles = snapshots.to_tiles(_edges(spark, sf), TILE)
    path = _stored(spark, tiles, lambda t, p: t.write.parquet(p))
    flat = F.flatten("values")
    return spark.read.parquet(path).select(
        "snapshot", "bi", "bj", F.size("values").alias("n_rows"), F.size(flat).alias("n_cells"),
        F.size(F.filter(flat, lambda v: v != 0)).alias("n_entries"),
        _r(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v), "total"),
        _r(F.element_at(flat, 2), "second"))


def q_whole_tile(spark, sf):
    """Every snapshot as one dense tile, written, read and turned back into edges."""
    e = _kept_edges(spark, sf)
    n = e.agg(F.max("src")).first()[0] + 1
    path = _stored(spark, snapshots.to_tiles(e, n), lambda t, p: t.write.parquet(p))
    return snapshots.read_tiles(spark.read.parquet(path)).select("snapshot", "src", "dst", _r("w"))


def q_stored_edge_list(spark, sf):
    """The edge list without weights of every snapshot, from a stored graph."""
    path = _stored(spark, _edges(spark, sf), lambda e, p: snapshots.write_snapshot(e, p, TILE))
    return snapshots.edge_pairs(snapshots.read_snapshot(spark, path))


def q_stored_tiles(spark, sf):
    """The graph stored by tiles; the diagonal ones are written once more with twice the
    weight; then a manifest of the tiles on and under the diagonal is read."""
    e = _kept_edges(spark, sf)
    path = _stored(spark, e, lambda t, p: snapshots.write_tiles(t, p, TILE))
    tile = [F.floor(F.col(c) / TILE).cast("bigint") for c in ("src", "dst")]
    twice = e.filter(tile[0] == tile[1]).withColumn("w", F.col("w") * 2)
    snapshots.write_tiles(twice, path, TILE)
    manifest = _stored(spark, e.select("snapshot", tile[0].alias("bi"), tile[1].alias("bj")).distinct(),
                       lambda m, p: m.write.parquet(p))
    wanted = spark.read.parquet(manifest).filter("bi >= bj")
    return snapshots.read_tiles_of(spark, path, wanted).select(
        "snapshot", "bi", "bj", "src", "dst", _r("w"))


def q_stored_result(spark, sf):
    """A detection's result, written as the truth and read back: the scored pairs, and
    for each whether its ends are among the stored nodes."""
    flagged, nodes = score.detect(_pair_edges(spark, sf), S1, S2)
    base = _stored(spark, flagged, lambda f, p: snapshots.write_result(f, nodes, p, True)) + "/truth"
    pairs, found = spark.read.parquet(base + "/delta_e"), spark.read.parquet(base + "/nodes")
    ends = found.select(F.col("node"), F.lit(True).alias("known"))
    return (pairs.join(ends.withColumnsRenamed({"node": "i", "known": "i_found"}), "i", "left")
            .join(ends.withColumnsRenamed({"node": "j", "known": "j_found"}), "j", "left")
            .select("i", "j", _r("delta_e"), "anomalous",
                    F.coalesce("i_found", F.lit(False)).alias("i_found"),
                    F.coalesce("j_found", F.lit(False)).alias("j_found")))


def q_stored_trace(spark, sf):
    path = _stored(spark, _sweep_trace(spark, sf), snapshots.write_trace)
    return spark.read.parquet(path).select("run_id", "iter", _r("sigma"), _r("loss"), _r("learning_rate"))


def q_edge_order(spark, sf):
    """Place of every pair in the order in which edge lists are shown."""
    h = linalg.half_edges(_edges(spark, sf))
    return dense_index(h, ["j", "i"], ["snapshot"], "place").select("snapshot", "i", "j", "place")


def q_matvec(spark, sf):
    e = _kept_edges(spark, sf)
    x = linalg.inv_degree(e, power=-0.5).select("snapshot", "node", F.col("inv").alias("x"))
    return linalg.matvec(e, x).select("snapshot", "node", _r("x"))


def q_matmul(spark, sf):
    e = _kept_edges(spark, sf)
    return linalg.matmul(e, e).select("snapshot", "src", "dst", _r("w"))


def q_mat_subtract(spark, sf):
    e = _pair_edges(spark, sf)
    a = e.filter(F.col("snapshot") == S1).drop("snapshot")
    b = e.filter(F.col("snapshot") == S2).drop("snapshot")
    return linalg.mat_add(a, b, -1.0, keys=()).select("src", "dst", _r("w"))


def q_chain_product(spark, sf):
    from ..operators.chain import chain_product
    return chain_product(_kept_edges(spark, sf), 3).select("snapshot", "src", "dst", _r("w"))


def q_laplacian(spark, sf):
    return linalg.laplacian(_kept_edges(spark, sf)).select("snapshot", "src", "dst", _r("w"))


# ---------------------------------------------------------------- walk / distances

def q_incidence_project(spark, sf):
    e = _kept_edges(spark, sf)
    n = e.groupBy("snapshot").agg(F.countDistinct("src").alias("n")).agg(F.max("n")).first()[0]
    k = sketch_width(n)
    b = incidence_sketch(linalg.half_edges(e), k)
    return to_long(b, n_slots=k).select("snapshot", "slot", "node", _r("x"))


def q_walk_series(spark, sf):
    e = _kept_edges(spark, sf)
    z = solve_columns(e, mode="exact")
    n_slots = linalg.half_edges(e).groupBy("snapshot").count() \
        .agg(F.max("count")).first()[0]
    return to_long(z, n_slots=n_slots).select("snapshot", "slot", "node", _r("x"))


def q_pair_distance_exact(spark, sf):
    return pair_distance(_edges(spark, sf), mode="exact").select("snapshot", "i", "j", _r("d"))


def q_pair_distance_sketch(spark, sf):
    return pair_distance(_edges(spark, sf), mode="sketch").select("snapshot", "i", "j", _r("d"))


# ---------------------------------------------------------------- detection

FLAG_COLS = ["i", "j", "abs_da", "d1", "d2", "delta_e", "running_sum"]


def _flag_out(flagged, keys=()):
    return flagged.select(*keys, "i", "j", _r("abs_da"), _r("d1"), _r("d2"), _r("delta_e"),
                          _r("running_sum"), "anomalous")


def q_delta_e(spark, sf):
    e = _pair_edges(spark, sf)
    ch = score.weight_change(e, S1, S2)
    pairs = (ch.filter(F.col("w1").isNotNull()).select(F.lit(S1).alias("snapshot"), "i", "j")
             .unionByName(ch.filter(F.col("w2").isNotNull())
                          .select(F.lit(S2).alias("snapshot"), "i", "j")))
    dist = pair_distance(e, pairs)
    d = score.delta_e(ch, dist, S1, S2)
    return d.select("i", "j", _r("abs_da"), _r("d1"), _r("d2"), _r("delta_e"))


def q_detect_trade(spark, sf):
    """Exactly, with a slot for every half edge: for graphs as small as this one."""
    flagged, _ = score.detect(_pair_edges(spark, sf), S1, S2, mode="exact")
    return _flag_out(flagged)


def q_anomaly_cut(spark, sf):
    flagged, _ = score.detect(_pair_edges(spark, sf), S1, S2)
    return _flag_out(flagged.filter("anomalous"))


def q_banded_cut(spark, sf):
    """The flags alone, from sums by magnitude and one ordered band."""
    scored, _ = score.detect(_pair_edges(spark, sf), S1, S2)
    scores = scored.drop("anomalous", "running_sum").checkpoint(eager=True)
    return score.banded_cut(scores).select("i", "j", _r("delta_e"), "anomalous")


def q_anomalous_nodes(spark, sf):
    _, nodes = score.detect(_pair_edges(spark, sf), S1, S2)
    return nodes.select(F.col("node").cast("bigint"))


def q_detect_trade_cross_block(spark, sf):
    flagged, _ = score.detect(_pair_edges(spark, sf), S1, S2, scope="cross_block",
                              block_size=TILE)
    return _flag_out(flagged)


def q_detect_trade_sketch(spark, sf):
    flagged, _ = score.detect(_pair_edges(spark, sf), S1, S2)
    return _flag_out(flagged)


def q_detect_trade_empty_cut(spark, sf):
    """A threshold no running sum reaches: 'all' flags every pair (the original),
    so the node set is every endpoint."""
    _, nodes = score.detect(_pair_edges(spark, sf), S1, S2, threshold=10.0)
    return nodes.select(F.col("node").cast("bigint"))


# ---------------------------------------------------------------- grids and kernels

def q_month_index(spark, sf):
    o = tables.table(spark, sf, "orders").select("o_orderdate")
    return (o.groupBy(month_index(F.year("o_orderdate"), F.month("o_orderdate")).alias("month_idx"))
             .agg(F.count("*").cast("bigint").alias("n_orders")))


def _grid_extent(spark, sf):
    ev_ = tables.table(spark, sf, "events").select("user_id")
    return int(ev_.agg(F.max("user_id")).first()[0]) + 1, 7


def q_time_slice(spark, sf):
    cube = tables.activity_cube(spark, sf)
    return kernel.time_slice(cube, WEEKS[1]).select("row", "col", _r("value"))


def _clean_weeks(spark, sf):
    """All weeks, every cell: absent ones hold the missing value until it is cleaned."""
    nrows, ncols = _grid_extent(spark, sf)
    cube = tables.activity_cube(spark, sf)
    return kernel.clean_grid(kernel.dense_grid(cube, nrows, ncols, fill=-9999.0, keys=["slice"])), nrows, ncols


def q_missing_to_zero(spark, sf):
    g, _, _ = _clean_weeks(spark, sf)
    return g.select("slice", "row", "col", _r("value"))


def q_downsample(spark, sf):
    g, nrows, ncols = _clean_weeks(spark, sf)
    t = kernel.downsample(g, GRID_SPACING, nrows, ncols, keys=["slice"], tail="keep")
    return t.select("slice", "node", "row", "col", _r("value"))


def _activity_tiles(spark, sf, weeks=None):
    nrows, ncols = _grid_extent(spark, sf)
    cube = tables.activity_cube(spark, sf)
    if weeks:
        cube = cube.filter(F.col("slice").isin(*weeks))
    grid = cube.select(F.col("slice").alias("snapshot"), "row", "col", "value")
    return kernel.downsample(grid, GRID_SPACING, nrows, ncols, keys=["snapshot"], tail="keep")


def q_rbf_graph_grid(spark, sf):
    return kernel.grid_graph(_activity_tiles(spark, sf), SIGMA, keys=["snapshot"], digits=ROUND)


def q_detect_activity(spark, sf):
    """Two weeks, every pair of tiles with a weight."""
    grid = _activity_tiles(spark, sf, WEEKS).checkpoint(eager=True)
    g = kernel.grid_graph(grid, SIGMA, keys=["snapshot"])
    flagged, _ = score.detect(g, WEEKS[0], WEEKS[1], nodes=grid)
    return _flag_out(flagged)


def q_rbf_graph_vec(spark, sf):
    p = tables.embedding_points(spark, sf)
    return kernel.rbf_graph(p, SIGMA, digits=ROUND)


def q_rbf_graph_pruned(spark, sf):
    p = tables.embedding_points(spark, sf)
    return kernel.rbf_graph(p, SIGMA, min_weight=math.exp(-2.0), digits=ROUND)


def q_top_fraction(spark, sf):
    t = perturb.top_fraction(tables.embedding_points(spark, sf))
    return t.select("node", _r("norm"), F.col("pos").cast("bigint"))


def q_perturb(spark, sf):
    p = perturb.perturb(tables.embedding_points(spark, sf))
    from ..functions.scalar import l2_norm
    return p.select("node", _r("shift"), "anomalous", _r(l2_norm("x"), "norm"))


def q_detect_perturbed(spark, sf):
    """The synthetic experiment on real vectors: embeddings as snapshot 1, a
    perturbed copy (noise on all, a shift on the top 10% by norm) as snapshot 2,
    Gaussian graphs at sigma = 1/sqrt(2), sketch detection; per node whether it
    was planted and whether it was found."""
    pts = tables.embedding_points(spark, sf)
    both = perturb.two_snapshots(pts, seed=0).checkpoint(eager=True)
    g = kernel.rbf_graph(both, SIGMA, keys=["snapshot"])
    _, nodes = score.detect(g, 1, 2, mode="sketch", nodes=pts)
    planted = perturb.top_fraction(pts).select("node", F.lit(True).alias("planted"))
    found = nodes.select("node", F.lit(True).alias("found"))
    return (planted.join(found, "node", "full_outer")
                   .select(F.col("node").cast("bigint"),
                           F.coalesce("planted", F.lit(False)).alias("planted"),
                           F.coalesce("found", F.lit(False)).alias("found")))


# ---------------------------------------------------------------- evaluation

def _truth_and_pred(spark, sf):
    """The detection under two seeds: one is the truth, the other the prediction."""
    e = _pair_edges(spark, sf).checkpoint(eager=True)
    out = []
    for seed in (0, 1):
        flagged, nodes = score.detect(e, S1, S2, threshold=EVAL_THRESHOLD, seed=seed)
        out += [flagged.checkpoint(eager=True), nodes.checkpoint(eager=True)]
    return e, *out


def q_edge_diff(spark, sf):
    _, truth, _, pred, _ = _truth_and_pred(spark, sf)
    return ev.edge_diff(truth, pred).select("i", "j", _r("diff"))


def q_squared_loss(spark, sf):
    _, truth, _, pred, _ = _truth_and_pred(spark, sf)
    return ev.squared_loss(ev.edge_diff(truth, pred)).select(_r("loss"))


def q_same_nodes(spark, sf):
    _, _, tn, _, pn = _truth_and_pred(spark, sf)
    return ev.same_nodes(tn, pn).select("n_truth", "n_pred", "n_mismatch", "same")


def _node_ranks(flagged):
    """Nodes ranked by the largest dE of an incident changed pair (desc, node)."""
    per = (flagged.select(F.explode(F.array("i", "j")).alias("node"), "delta_e")
                  .groupBy("node").agg(F.max("delta_e").alias("score"))
                  .withColumn("neg", -F.col("score")))
    return dense_index(per, ["neg", "node"], [], "pos").select("node", "pos")


def q_rank_agreement(spark, sf):
    e, truth, _, pred, _ = _truth_and_pred(spark, sf)
    n = linalg.degree(e).select("node").distinct().count()
    return ev.rank_agreement(_node_ranks(pred), _node_ranks(truth), n, 6.0).select(_r("rho"))


def _sweep(spark, sf):
    pts = tables.nation_points(spark, sf, YEARS)
    return ev.sigma_sweep(pts, SWEEP, SIGMA, S1, S2, threshold=SWEEP_THRESHOLD)


def q_sigma_sweep(spark, sf):
    summary, _, _ = _sweep(spark, sf)
    return summary.select(_r("sigma"), _r("loss"), "same", "n_nodes")


def q_evaluate_sigma(spark, sf):
    pts = tables.nation_points(spark, sf, YEARS)
    one = ev.evaluate_sigma(pts, SWEEP[2], SIGMA, S1, S2, threshold=SWEEP_THRESHOLD)
    return one.select(_r("sigma"), _r("loss"), "same", "n_nodes", _r("score"))


def _sweep_trace(spark, sf):
    """The candidates in order as the trace of one run for each learning rate."""
    summary, _, _ = _sweep(spark, sf)
    s = summary.filter(F.col("sigma") != F.lit(SIGMA))
    t = dense_index(s, ["sigma"], [], "iter")
    rates = F.array(*[F.struct(F.lit(i).alias("run_id"), F.lit(float(lr)).alias("learning_rate"))
                      for i, lr in enumerate(LEARNING_RATES)])
    return t.select(F.col("iter").cast("int"), "sigma", "loss", F.explode(rates).alias("run")).select(
        "run.run_id", "iter", "sigma", "loss", "run.learning_rate")


def q_secant_step(spark, sf):
    s = ev.secant_step(_sweep_trace(spark, sf))
    return s.select("run_id", "iter", _r("sigma"), _r("loss"), _r("next_sigma"))


def q_trace_summary(spark, sf):
    s = ev.trace_summary(_sweep_trace(spark, sf))
    return s.select(_r("learning_rate"), F.col("n_iter").cast("bigint"), _r("first_sigma"),
                    _r("last_sigma"), _r("first_loss"), _r("last_loss"), _r("min_loss"),
                    F.col("argmin_iter").cast("int"))


def q_calibrate_sigma(spark, sf):
    """Up to 20 rounds of four runs, by the same walk as all detections."""
    pts = tables.nation_points(spark, sf, YEARS)
    tr = ev.calibrate_sigma(pts, SIGMA, S1, S2, STARTS, LEARNING_RATES, ITERATIONS,
                            threshold=SWEEP_THRESHOLD)
    return tr.select("run_id", "iter", _r("sigma"), _r("loss"), "same", _r("learning_rate"))


QUERIES = {
    "trade_edges": q_trade_edges,
    "degree": q_degree,
    "inv_degree": q_inv_degree,
    "graph_profile": q_graph_profile,
    "half_edges_cross_block": q_half_edges_cross_block,
    "tile_edges": q_tile_edges,
    "tiles_roundtrip": q_tiles_roundtrip,
    "whole_tile": q_whole_tile,
    "stored_edge_list": q_stored_edge_list,
    "stored_tiles": q_stored_tiles,
    "stored_result": q_stored_result,
    "stored_trace": q_stored_trace,
    "edge_order": q_edge_order,
    "matvec": q_matvec,
    "matmul": q_matmul,
    "mat_subtract": q_mat_subtract,
    "laplacian": q_laplacian,
    "chain_product": q_chain_product,
    "incidence_project": q_incidence_project,
    "walk_series": q_walk_series,
    "pair_distance_exact": q_pair_distance_exact,
    "pair_distance_sketch": q_pair_distance_sketch,
    "delta_e": q_delta_e,
    "detect_trade": q_detect_trade,
    "anomaly_cut": q_anomaly_cut,
    "banded_cut": q_banded_cut,
    "anomalous_nodes": q_anomalous_nodes,
    "detect_trade_cross_block": q_detect_trade_cross_block,
    "detect_trade_sketch": q_detect_trade_sketch,
    "detect_trade_empty_cut": q_detect_trade_empty_cut,
    "month_index": q_month_index,
    "time_slice": q_time_slice,
    "missing_to_zero": q_missing_to_zero,
    "downsample": q_downsample,
    "rbf_graph_grid": q_rbf_graph_grid,
    "detect_activity": q_detect_activity,
    "rbf_graph_vec": q_rbf_graph_vec,
    "rbf_graph_pruned": q_rbf_graph_pruned,
    "top_fraction": q_top_fraction,
    "detect_perturbed": q_detect_perturbed,
    "perturb": q_perturb,
    "edge_diff": q_edge_diff,
    "squared_loss": q_squared_loss,
    "same_nodes": q_same_nodes,
    "rank_agreement": q_rank_agreement,
    "sigma_sweep": q_sigma_sweep,
    "evaluate_sigma": q_evaluate_sigma,
    "secant_step": q_secant_step,
    "trace_summary": q_trace_summary,
    "calibrate_sigma": q_calibrate_sigma,
}
