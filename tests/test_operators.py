"""Small operator fixtures (FIXTURES.md section 3) and brute-force checks."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdelta.functions.scalar import floor_div, month_index, series_length, sketch_width
from graphdelta.operators import evaluate as ev
from graphdelta.operators import kernel, linalg, perturb, score
from graphdelta.operators.ordered import dense_index, running_sum
from graphdelta.operators.walk import incidence_exact, walk_series, xcols
from graphdelta.sources import snapshots
from conftest import G1, G2, edges_df

SIG = 1 / math.sqrt(2)


def test_sketch_width_and_series_length():
    assert [sketch_width(n, 0.1) for n in (8, 64, 256, 16200)] == [30, 60, 80, 140]
    assert [series_length(t, d) for t, d in ((1e-2, 3), (1e-2, 1), (1e-4, 3), (0.5, 3))] == [12, 3, 32, 0]


def test_floor_div_is_exact_for_all_ids(spark):
    ids = [0, 1, 7, -1, -7, -8, 2**55 - 1, -2**55 - 1, 2**63 - 1, -2**63]
    df = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    for p in (1, 7, 2**30):
        got = {r.id: r.q for r in df.select("id", floor_div("id", p).alias("q")).collect()}
        assert got == {i: i // p for i in ids}


def test_tiles_and_scope_of_large_ids(spark):
    p, far = 2**30, 2**55 - 1
    e = spark.createDataFrame([(1, far, far - p, 1.0), (1, far, far + 1, 1.0)],
                              "snapshot INT, src BIGINT, dst BIGINT, w DOUBLE")
    t = {(r.bi, r.bj) for r in linalg.tile_edges(e, p).collect()}
    assert t == {(far // p, (far - p) // p), (far // p, (far + 1) // p)}
    back = e.select("snapshot", F.col("dst").alias("src"), F.col("src").alias("dst"), "w").union(e)
    half = {(r.i, r.j) for r in linalg.half_edges(back, scope="cross_block", block_size=p).collect()}
    assert half == {(far, far - p), (far + 1, far)}


def test_month_index(spark):
    df = spark.createDataFrame([(1994, 1), (1995, 1), (2002, 12), (1981, 5), (1990, 13)], "y INT, m INT")
    assert [r.i for r in df.select(month_index("y", "m").alias("i")).collect()] == [144, 156, 251, None, None]


def test_rbf_small(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "node BIGINT, x ARRAY<DOUBLE>")
    g = {(r.src, r.dst): r.w for r in kernel.rbf_graph(pts, SIG).collect()}
    assert len(g) == 6 and all(a != b for a, b in g)
    assert g[(0, 1)] == pytest.approx(0.367879441, abs=1e-9) == g[(1, 0)]
    assert g[(0, 2)] == pytest.approx(0.018315639, abs=1e-9)
    assert g[(1, 2)] == pytest.approx(0.006737947, abs=1e-9)


def test_rbf_underflow(spark):
    a, b = math.sqrt(745.13), math.sqrt(745.14)
    pts = spark.createDataFrame([(0, [0.0]), (1, [a]), (2, [a + b])], "node BIGINT, x ARRAY<DOUBLE>")
    g = {(r.src, r.dst): r.w for r in kernel.rbf_graph(pts, SIG, proj_dims=1).collect()}
    assert g[(0, 1)] == pytest.approx(5e-324) and g[(0, 1)] > 0
    assert (1, 2) not in g and (0, 2) not in g


@pytest.mark.parametrize("min_weight,block_rows", [(0.0, 4), (math.exp(-2.0), 3), (0.0, 256)])
def test_rbf_matches_brute_force(spark, min_weight, block_rows):
    rng = np.random.default_rng(7)
    # a crowded cluster (forces salted sub-blocks) plus spread-out points
    x = np.vstack([rng.normal(0, 0.3, (40, 3)), rng.uniform(-60, 60, (30, 3))])
    pts = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))],
                                "node BIGINT, x ARRAY<DOUBLE>")
    got = {(r.src, r.dst): r.w for r in kernel.rbf_graph(pts, SIG, min_weight, block_rows=block_rows).collect()}
    want = {}
    for i in range(len(x)):
        for j in range(len(x)):
            if i != j:
                w = math.exp(-float(((x[i] - x[j]) ** 2).sum()) / (2 * SIG * SIG))
                if w != 0 and (not min_weight or w >= min_weight):
                    want[(i, j)] = w
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_downsample(spark):
    grid = [[1, 3, 0, 0, 9], [0, 2, 0, -4, 9], [5, 5, 0, 7, 9], [5, 5, 8, 0, 9]]
    rows = [(r, c, float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    df = spark.createDataFrame(rows, "row INT, col INT, value DOUBLE")
    t = {(r.row, r.col): r.value for r in kernel.downsample(df, 2, 4, 5).collect()}
    assert t == {(0, 0): 2.0, (0, 2): 0.0, (2, 0): 5.0, (2, 2): 7.5}


def test_squared_loss_and_edge_diff(spark):
    t = spark.createDataFrame([(4, 1, 2.0), (5, 0, 1.0)], "i BIGINT, j BIGINT, delta_e DOUBLE")
    p = spark.createDataFrame([(4, 1, 1.5), (6, 2, 0.5)], "i BIGINT, j BIGINT, delta_e DOUBLE")
    assert ev.squared_loss(ev.edge_diff(t, p)).first().loss == pytest.approx(1.5)


def test_secant_step(spark):
    tr = spark.createDataFrame([(0, 0, 1.0, 2.0, 0.5), (0, 1, 1.4, 1.5, 0.5)],
                               "run_id INT, iter INT, sigma DOUBLE, loss DOUBLE, learning_rate DOUBLE")
    got = [r.next_sigma for r in ev.secant_step(tr).orderBy("iter").collect()]
    assert got == pytest.approx([1.4, 2.025])


def test_same_nodes(spark):
    a = spark.createDataFrame([(0, 1), (0, 2)], "g INT, node BIGINT")
    b = spark.createDataFrame([(0, 2), (0, 1)], "g INT, node BIGINT")
    c = spark.createDataFrame([(0, 2)], "g INT, node BIGINT")
    assert ev.same_nodes(a, b, ["g"]).first().same
    assert not ev.same_nodes(a, c, ["g"]).first().same


def test_running_sum_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    vals = np.where(rng.random(3000) < 0.4, 0.0, rng.random(3000).round(2))
    rows = [(int(i), int(j), float(v)) for (i, j), v in zip(rng.integers(0, 10 ** 6, (3000, 2)), vals)]
    rows = list({(i, j): (i, j, v) for i, j, v in rows}.values())
    df = spark.createDataFrame(rows, "i BIGINT, j BIGINT, v DOUBLE")
    got = {(r.i, r.j): r.running_sum for r in running_sum(df, "v", ["v", "i", "j"], n_partitions=7).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    cum = np.cumsum([r[2] for r in order])
    assert all(got[(r[0], r[1])] == pytest.approx(c, abs=1e-9) for r, c in zip(order, cum))


def test_dense_index_contiguous(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("v"), "id")
    out = dense_index(df, ["v", "id"], ["g"], "idx", n_partitions=5).collect()
    for g in range(3):
        idx = sorted((r.v, r.id, r.idx) for r in out if r.g == g)
        assert [t[2] for t in idx] == list(range(len(idx)))


def test_walk_matches_dense_series(spark):
    rng = np.random.default_rng(3)
    n = 9
    A = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.5), 1)
    A = A + A.T
    g = {(i, j): A[i, j] for i in range(n) for j in range(i) if A[i, j] != 0}
    e = edges_df(spark, {1: g})
    half = linalg.half_edges(e)
    b = incidence_exact(half)
    K = 7
    z = walk_series(e, b, K)
    # dense reference: z = sum_{j<K} P^j D^-1 b for every slot
    deg = A.sum(1)
    inv = np.where(deg > 0, 1.0 / np.where(deg > 0, deg, 1), 0.0)
    P = inv[:, None] * A
    edges = sorted(g, key=lambda ij: (ij[1], ij[0]))
    B = np.zeros((n, len(edges)))
    for s, (i, j) in enumerate(edges):
        B[i, s], B[j, s] = g[(i, j)], -g[(i, j)]
    c = inv[:, None] * B
    Z, term = np.zeros_like(c), c.copy()
    for _ in range(K):
        Z += term
        term = P @ term
    width = len([cn for cn in z.columns if cn.startswith("x")])
    got = np.zeros_like(Z)
    for r in z.collect():
        for u, cn in enumerate(xcols(width)):
            slot = r.chunk * width + u
            if slot < len(edges):
                got[r.node, slot] = r[cn]
    assert np.allclose(got[deg > 0], Z[deg > 0], atol=1e-12)


def test_tiles_roundtrip_with_tail(spark):
    g = {(6, 0): 1.5, (5, 2): 0.25, (3, 1): 2.0}
    e = edges_df(spark, {1: g})
    back = snapshots.read_tiles(snapshots.to_tiles(e, 4))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))


def test_snapshot_write_read(spark, tmp_path):
    e = edges_df(spark, {1: {(1, 0): 1.0}, 2: {(2, 1): 3.0}})
    path = str(tmp_path / "snap")
    snapshots.write_snapshot(e, path, block_size=2)
    back = snapshots.read_snapshot(spark, path, [2])
    assert sorted((r.src, r.dst, r.w) for r in back.collect()) == [(1, 2, 3.0), (2, 1, 3.0)]


def test_matmul_matches_numpy(spark):
    g = {(1, 0): 2.0, (2, 1): 1.0, (2, 0): 0.5}
    e = edges_df(spark, {1: g})
    A = np.zeros((3, 3))
    for (i, j), w in g.items():
        A[i, j] = A[j, i] = w
    got = {(r.src, r.dst): r.w for r in linalg.matmul(e, e).collect()}
    AA = A @ A
    assert got == {(i, j): pytest.approx(AA[i, j]) for i in range(3) for j in range(3) if AA[i, j] != 0}


def test_cube_slice_is_partition_pruned(spark, tmp_path):
    from graphdelta.sources.tables import activity_cube
    from conftest import SF001
    path = str(tmp_path / "cube")
    snapshots.write_cube(activity_cube(spark, SF001), path)
    sl = snapshots.read_slice(spark, path, 1)
    plan = sl._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slice" in plan
    direct = kernel.time_slice(activity_cube(spark, SF001), 1)
    assert sorted(map(tuple, sl.collect())) == sorted(map(tuple, direct.collect()))


def test_independent_signs_differ_per_snapshot(spark):
    from graphdelta.operators.walk import incidence_sketch
    g = {(1, 0): 1.0, (2, 1): 1.0, (3, 2): 1.0}
    e = edges_df(spark, {1: g, 2: g})
    half = linalg.half_edges(e)
    shared = {(r.snapshot, r.chunk, r.node): r.x0 for r in incidence_sketch(half, 8).collect()}
    indep = {(r.snapshot, r.chunk, r.node): r.x0 for r in incidence_sketch(half, 8, independent=True).collect()}
    assert all(shared[(1, c, n)] == shared[(2, c, n)] for (s, c, n) in shared if s == 1)
    assert any(indep[(1, c, n)] != indep[(2, c, n)] for (s, c, n) in indep if s == 1)


def test_result_trace_locations_written(spark, tmp_path):
    flagged = spark.createDataFrame([(7, 0, 0.38, True), (7, 6, 0.02, False)],
                                    "i BIGINT, j BIGINT, delta_e DOUBLE, anomalous BOOLEAN")
    nodes = spark.createDataFrame([(0,), (7,)], "node BIGINT")
    base = snapshots.write_result(flagged, nodes, str(tmp_path / "res"), ground_truth=True)
    assert base.endswith("/truth")
    assert sorted(r.node for r in spark.read.parquet(base + "/nodes").collect()) == [0, 7]
    snapshots.write_result(flagged.limit(1), nodes, str(tmp_path / "res"), ground_truth=True)
    assert spark.read.parquet(base + "/delta_e").count() == 1          # overwritten
    tr = spark.createDataFrame([(0, 1.0, 0.0, 0.5)], "iter INT, sigma DOUBLE, loss DOUBLE, learning_rate DOUBLE")
    snapshots.write_trace(tr, str(tmp_path / "trace"))
    assert spark.read.parquet(str(tmp_path / "trace")).first().sigma == 1.0
    tiles = spark.createDataFrame([(0, 0, 0, 1.0)], "node BIGINT, row INT, col INT, value DOUBLE")
    snapshots.write_node_locations(tiles, str(tmp_path / "loc"))
    assert spark.read.parquet(str(tmp_path / "loc")).columns == ["node", "row", "col"]


def test_edge_order(spark):
    df = spark.createDataFrame([(3, 1), (2, 0), (5, 0), (4, 1)], "i BIGINT, j BIGINT")
    assert [(r.i, r.j) for r in snapshots.edge_order(df).collect()] == [(2, 0), (5, 0), (3, 1), (4, 1)]


def test_rbf_rejects_mixed_dimensions(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0])], "node BIGINT, x ARRAY<DOUBLE>")
    with pytest.raises(ValueError):
        kernel.rbf_graph(pts, SIG)


def test_downsample_tails_keys_and_counted_elements(spark):
    df = spark.createDataFrame([(s, r, c, float((r * 5 + c) % 4 - 1)) for s in (1, 2) for r in range(5)
                                for c in range(5)], "s INT, row BIGINT, col INT, value DOUBLE")
    for tail, keep, n in (("drop", "positive", 4), ("keep", "positive", 9), ("keep", "nonzero", 9)):
        got = {(r.s, r.row, r.col): r.value
               for r in kernel.downsample(df, 2, 5, 5, ["s"], tail, keep).collect()}
        assert len(got) == 2 * n
        for (_, r0, c0), v in got.items():
            cells = [float((r * 5 + c) % 4 - 1) for r in range(r0, min(r0 + 2, 5)) for c in range(c0, min(c0 + 2, 5))]
            cells = [x for x in cells if (x > 0 if keep == "positive" else x != 0)]
            assert v == pytest.approx(sum(cells) / len(cells) if cells else 0.0)


def test_cut_reads_the_running_sum_itself(spark):
    """0.1 + 0.2 + 0.3 is 0.6000000000000001 in order, 0.6 otherwise: one row is past 0.6."""
    df = spark.createDataFrame([(1, 0, 0.3), (2, 0, 0.2), (3, 0, 0.1)], "i BIGINT, j BIGINT, delta_e DOUBLE")
    got = {r.i: r.anomalous for r in score.anomaly_cut(df, 0.6).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert all(r.anomalous for r in score.anomaly_cut(df, 0.7).collect())


def test_top_fraction_counts_each_key(spark):
    pts = spark.createDataFrame([(g, i, [float(i)]) for g, n in ((1, 20), (2, 40)) for i in range(n)],
                                "g INT, node BIGINT, x ARRAY<DOUBLE>")
    got = sorted((r.g, r.node) for r in perturb.top_fraction(pts, 0.1, ["g"]).collect())
    assert got == [(1, 18), (1, 19), (2, 36), (2, 37), (2, 38), (2, 39)]


def test_empty_node_sets_agree(spark):
    none = spark.createDataFrame([], "node BIGINT")
    assert ev.same_nodes(none, none).first().same
    keyed = spark.createDataFrame([(1, 5)], "g INT, node BIGINT")
    groups = spark.createDataFrame([(1,), (2,)], "g INT")
    got = {r.g: (r.n_truth, r.n_pred, r.same) for r in ev.same_nodes(keyed, keyed.limit(0), ["g"], groups).collect()}
    assert got == {1: (1, 0, False), 2: (0, 0, True)}


def test_degenerate_steps_and_ranks(spark):
    tr = spark.createDataFrame([(0, 0, 1.0, 2.0, 0.5), (0, 1, 1.0, 3.0, 0.5)],
                               "run_id INT, iter INT, sigma DOUBLE, loss DOUBLE, learning_rate DOUBLE")
    assert {r.iter: r.next_sigma for r in ev.secant_step(tr).collect()} == {0: 1.4, 1: None}
    one = spark.createDataFrame([(7, 0)], "node BIGINT, pos BIGINT")
    assert ev.rank_agreement(one, one, 1, 6.0).first().rho == 1.0


def test_crowded_cells_are_split_before_any_join_by_cell(spark):
    """All points in one cell: sub-blocks of block_rows, and the same graph."""
    pts = spark.createDataFrame([(i, [i / 1000.0, 0.0]) for i in range(60)], "node BIGINT, x ARRAY<DOUBLE>")
    a, b = ({(r.src, r.dst): r.w for r in kernel.rbf_graph(pts, SIG, block_rows=n).collect()} for n in (7, 1000))
    assert a == b and len(a) == 60 * 59


def test_hubs_are_split_and_change_nothing(spark):
    """A star: with a bucket of 3 its centre is dealt to parts; same products."""
    pairs = [(0, i, 1.0 + i) for i in range(1, 20)] + [(3, 4, 2.0)]
    e = spark.createDataFrame([(1, a, b, w) for x in pairs for a, b, w in (x, (x[1], x[0], x[2]))],
                              "snapshot INT, src BIGINT, dst BIGINT, w DOUBLE")
    v = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "snapshot INT, node BIGINT, x DOUBLE")
    for f in (lambda b: linalg.row_normalize(e, bucket=b), lambda b: linalg.matvec(e, v, bucket=b),
              lambda b: linalg.matmul(e, e, bucket=b)):
        one, split = (sorted(tuple(r) for r in f(b).collect()) for b in (10**6, 3))
        assert len(one) == len(split)
        assert all(x[:-1] == y[:-1] and x[-1] == pytest.approx(y[-1]) for x, y in zip(one, split))
    parts = linalg.hub_join(e, v.withColumnRenamed("node", "dst"), ["snapshot", "dst"], "src", 3)
    assert parts.count() == e.count()


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.75, 1.0, 6.5, 40.0, 1e6])
def test_banded_cut_equals_the_ordered_cut(spark, threshold):
    # exact in binary, so sums do not depend on their order; many ties and zeros
    values = [0.0, 0.0, 0.125, 0.125, 0.25, 0.25, 0.25, 1.0, 1.0, 1.5, 1.75, 4.0, 4.0, 4.0, 7.5]
    rows = [(g, n % 4, n, v * (g + 1)) for g in (0, 1) for n, v in enumerate(values)]
    rows += [(2, 0, n, 0.0) for n in range(3)]
    df = spark.createDataFrame(rows, "g INT, i BIGINT, j BIGINT, delta_e DOUBLE").repartition(5)
    for keys, on_none in ((["g"], "all"), (["g"], "empty"), ([], "all")):
        want = score.anomaly_cut(df, threshold, keys, on_none=on_none).drop("running_sum")
        got = score.banded_cut(df, threshold, keys, on_none=on_none)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_banded_cut_orders_the_band_alone(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id AS i", "0L AS j", "CAST(id AS DOUBLE) AS delta_e")
    seen = []
    ordered = score.running_sum
    monkeypatch.setattr(score, "running_sum", lambda d, *a: seen.append(d.count()) or ordered(d, *a))
    flagged = score.banded_cut(df, 1000.0).filter("anomalous").agg(F.min("i")).first()[0]
    assert flagged == 45 and seen == [32]               # 0 + .. + 45 > 1000; band 32 to 63
    with pytest.raises(ValueError):
        score.banded_cut(df, on_none="some")


def test_banded_cut_of_nothing(spark):
    df = spark.createDataFrame([], "i BIGINT, j BIGINT, delta_e DOUBLE")
    assert score.banded_cut(df, 0.1).collect() == []


def test_tiles_are_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "tiles")
    e = edges_df(spark, {1: {(i, j): i + j / 8 for i in range(7) for j in range(i)},
                         2: {(1, 0): 5.0}})
    snapshots.write_tiles(e, path, 3)
    snapshots.write_tiles(e.filter("snapshot = 1 AND src < 3 AND dst < 3")
                          .withColumn("w", F.col("w") + 100), path, 3)
    want = {(r.snapshot, r.src, r.dst): r.w + 100 * (r.snapshot == 1 and r.src < 3 and r.dst < 3)
            for r in e.collect()}
    manifest = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0), (1, 9, 9)],
                                     "snapshot INT, bi BIGINT, bj BIGINT")
    manifest.write.parquet(str(tmp_path / "manifest"))
    listed = spark.read.parquet(str(tmp_path / "manifest"))
    got = snapshots.read_tiles_of(spark, path, listed)
    assert {(r.snapshot, r.src, r.dst): r.w for r in got.collect()} == {
        k: w for k, w in want.items() if (k[0], k[1] // 3, k[2] // 3) in
        {(1, 0, 0), (1, 1, 0), (2, 0, 0)}}
    one = snapshots.read_tiles_of(spark, path, listed.filter("snapshot = 2"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert one.select("src", "dst", "w").orderBy("src").collect() == [(0, 1, 5.0), (1, 0, 5.0)]
    # every folder but the listed one is spoiled: it can only be answered without reading them
    for f in (tmp_path / "tiles").rglob("*.parquet"):
        if "snapshot=2" not in str(f):
            f.write_bytes(b"not parquet")
    assert one.count() == 2
    with pytest.raises(Exception):
        snapshots.read_tiles_of(spark, path, listed).count()


def test_hub_ends_of_pairs_are_split_and_change_nothing(spark):
    from graphdelta.operators.distance import gather_pairs
    z = spark.range(30).selectExpr("1 AS snapshot", "id AS node", "explode(array(0, 1)) AS chunk",
                                   "CAST(id AS DOUBLE) AS x0", "CAST(id * id AS DOUBLE) AS x1")
    pairs = spark.createDataFrame([(1, 29, j) for j in range(29)] + [(1, i, 0) for i in range(1, 29)],
                                  "snapshot INT, i BIGINT, j BIGINT")
    want = {(i, j): 2.0 * ((i - j) ** 2 + (i * i - j * j) ** 2) for _, i, j in pairs.collect()}
    for limit, bucket in ((1 << 30, 100), (0, 100), (0, 4)):
        got = gather_pairs(pairs, z, broadcast_limit=limit, bucket=bucket).collect()
        assert {(r.i, r.j): r.d for r in got} == want


def test_round_unit_is_round(spark):
    from graphdelta.functions.scalar import round_unit
    n = 40_000
    w = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.rand(3)).otherwise(
        (F.floor(F.rand(4) * 1e9) + 0.5) / 1e9).alias("w")).union(
        spark.createDataFrame([(0.0,), (1.0,), (5e-10,), (4.9e-10,), (None,), (5e-324,)], "w double"))
    assert w.where(~round_unit("w", 9).eqNullSafe(F.round("w", 9))).count() == 0


def test_rbf_blocks_compare_every_pair_once(spark):
    """Nulls, twice the same row, keys that are null and parts of cells: the pairs of the
    plain double loop, as often as it gives them; no table of points is joined row by row."""
    rng = random.Random(5)
    rows = [(k, i, [rng.gauss(0, 1.3) for _ in range(3)]) for k in (1, 2) for i in range(45)]
    rows += rows[:9] + [(1, 100, [1.0, None, 0.0]), (1, 101, None), (None, 1, [0.0, 0.0, 0.0]),
                        (None, 2, [0.0, 0.0, 0.0]), (1, None, [0.0, 0.0, 0.0])]
    pts = spark.createDataFrame(rows, "k int, node bigint, x array<double>")
    want = {}
    for a, (k, i, x) in enumerate(rows):
        for b, (m, j, y) in enumerate(rows):
            if a != b and k == m and None not in (k, i, j, x, y) and i != j and None not in x + y:
                d2 = sum((u - v) ** 2 for u, v in zip(x, y))
                if math.exp(-d2) >= 0.2:
                    key = (k, i, j, round(math.exp(-d2), 6))
                    want[key] = want.get(key, 0) + 1
    for block_rows in (4, 1000):
        g = kernel.rbf_graph(pts, SIG, 0.2, ["k"], block_rows=block_rows, dims=3, digits=6)
        got = {}
        for r in g.collect():
            got[tuple(r)] = got.get(tuple(r), 0) + 1
        assert got == want
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "node" not in "".join(
        ln.split("[")[1] for ln in plan.splitlines() if "HashJoin" in ln or "SortMergeJoin" in ln)


def test_walk_series_reads_its_graph_once(spark, monkeypatch):
    from graphdelta.plans import queries as Q
    edges, read = edges_df(spark, {1997: G1, 1998: G2}), spark.sparkContext.accumulator(0)
    n = edges.count()

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    monkeypatch.setattr(Q, "_edges", lambda spark, sf: edges.mapInArrow(seen, edges.schema))
    for query in (Q.q_walk_series, Q.q_incidence_project, Q.q_matmul):
        before = read.value
        query(spark, "").collect()
        assert read.value - before == n


@pytest.mark.parametrize("k", [10, 70])
def test_sketch_signs_are_digest_digits(spark, k):
    """Chunks that do and do not divide a digest, whose digits are cut out once a chunk."""
    import hashlib
    from graphdelta.operators.walk import incidence_sketch, vector_width
    half = spark.createDataFrame([(1, 7, 3, 2.0), (1, 9, 8, 0.5)], "snapshot int, i bigint, j bigint, w double")
    b = incidence_sketch(half, k, seed=4)
    width = vector_width(b)
    got = {(r.node, r.chunk * width + u): r[f"x{u}"] for r in b.collect() for u in range(width)}
    for i, j, w in ((7, 3, 2.0), (9, 8, 0.5)):
        digits = "".join(hashlib.md5(f"4|{i}|{j}|{n}".encode()).hexdigest() for n in range(-(-k // 32)))
        for t in range(k):
            x = w / math.sqrt(k) * (1 if digits[t] < "8" else -1)
            assert got[i, t] == pytest.approx(x) and got[j, t] == pytest.approx(-x)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert max(ln.count("substring(_digits") for ln in plan.splitlines()) == 1
