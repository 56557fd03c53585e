"""The golden 8-node detector fixture (FIXTURES.md section 2)."""
import pytest
from pyspark.sql import functions as F

from graphdelta.operators.distance import pair_distance
from graphdelta.operators.score import detect
from conftest import G1, G2, edges_df

TOL = 1e-8


def _rows(flagged):
    return {(r.i, r.j): r for r in flagged.collect()}


def test_scope_all_exact(spark):
    e = edges_df(spark, {1: G1, 2: G2})
    flagged, nodes = detect(e, 1, 2, mode="exact", threshold=0.1)
    rows = _rows(flagged)
    expect = {(7, 6): (0.3, 0.596776598, 0.531784337, 0.019497678, 0.019497678),
              (7, 3): (0.3, 0.661266325, 0.879063889, 0.065339269, 0.084836947),
              (7, 0): (0.9, 0.0, 0.426995572, 0.384296015, 0.469132962)}
    assert set(rows) == set(expect)
    for k, (da, d1, d2, de, cum) in expect.items():
        r = rows[k]
        assert r.abs_da == pytest.approx(da, abs=TOL)
        assert r.d1 == pytest.approx(d1, abs=TOL)
        assert r.d2 == pytest.approx(d2, abs=TOL)
        assert r.delta_e == pytest.approx(de, abs=TOL)
        assert r.running_sum == pytest.approx(cum, abs=TOL)
    assert sorted(r.node for r in nodes.collect()) == [0, 7]


def test_scope_cross_block_exact(spark):
    e = edges_df(spark, {1: G1, 2: G2})
    flagged, nodes = detect(e, 1, 2, mode="exact", scope="cross_block", block_size=4)
    rows = _rows(flagged)
    expect = {(7, 3): (0.3, 0.293818037, 0.249032636, 0.013435620, 0.013435620),
              (7, 0): (0.9, 0.0, 0.276410850, 0.248769765, 0.262205385)}
    assert set(rows) == set(expect)
    for k, (da, d1, d2, de, cum) in expect.items():
        r = rows[k]
        assert (r.abs_da, r.d1, r.d2, r.delta_e, r.running_sum) == pytest.approx(
            (da, d1, d2, de, cum), abs=TOL)
    assert sorted(r.node for r in nodes.collect()) == [0, 7]


@pytest.mark.parametrize("scope,threshold,expect", [
    ("all", 0.05, [0, 3, 7]),
    ("all", 10.0, [0, 3, 6, 7]),
    ("cross_block", 0.05, [0, 7]),
    ("cross_block", 10.0, [0, 3, 7]),
])
def test_anomalous_nodes_thresholds(spark, scope, threshold, expect):
    e = edges_df(spark, {1: G1, 2: G2})
    _, nodes = detect(e, 1, 2, mode="exact", scope=scope, block_size=4, threshold=threshold)
    assert sorted(r.node for r in nodes.collect()) == expect


def test_none_exceeds_empty_option(spark):
    e = edges_df(spark, {1: G1, 2: G2})
    _, nodes = detect(e, 1, 2, mode="exact", threshold=10.0, on_none="empty")
    assert nodes.count() == 0


def _dense_sketch(g, k, seed=0, K=12, n=8):
    """Distances of the half edges of one graph, with dense matrices."""
    import hashlib
    import numpy as np
    a, b = np.zeros((n, n)), np.zeros((n, k))
    for (i, j), w in g.items():
        a[i, j] = a[j, i] = w
        for t in range(k):
            digit = hashlib.md5(f"{seed}|{i}|{j}|{t // 32}".encode()).hexdigest()[t % 32]
            s = w * (1 if digit < "8" else -1) / np.sqrt(k)
            b[i, t] += s
            b[j, t] -= s
    deg = a.sum(1)
    c = b / deg[:, None]
    z = sum(np.linalg.matrix_power(a / deg[:, None], m) @ c for m in range(K))
    return {(i, j): float(((z[i] - z[j]) ** 2).sum()) for i in range(n) for j in range(i)}


@pytest.mark.parametrize("eps,seed", [(0.1, 0), (0.07, 5)])  # 30 and 42 slots: one digest, two
def test_sketch_equals_dense_matrices(spark, eps, seed):
    e = edges_df(spark, {1: G1, 2: G2})
    flagged, _ = detect(e, 1, 2, eps=eps, seed=seed)
    k = int(3 / eps)
    d1, d2 = _dense_sketch(G1, k, seed), _dense_sketch(G2, k, seed)
    rows = _rows(flagged)
    assert set(rows) == {(7, 6), (7, 3), (7, 0)}
    for p, r in rows.items():
        assert r.d1 == pytest.approx(d1[p] if p in G1 else 0.0, abs=TOL)
        assert r.d2 == pytest.approx(d2[p], abs=TOL)


def test_broadcast_limit_and_independent_signs_reach_the_walk(spark):
    e = edges_df(spark, {1: G1, 2: G2})
    a, b = (_rows(detect(e, 1, 2, broadcast_limit=x)[0]) for x in (0, 1 << 20))
    assert all(a[p].delta_e == pytest.approx(b[p].delta_e, abs=1e-12) for p in b)
    c = _rows(detect(e, 1, 2, independent=True)[0])
    assert any(abs(c[p].d1 - b[p].d1) > 1e-6 for p in b)


@pytest.mark.parametrize("power,expect", [(0.5, 0.7023760), (1.0, 0.5603022)])
def test_resistance_k12_non_bipartite(spark, power, expect):
    g = dict(G1)
    g[(3, 0)] = 0.5
    e = edges_df(spark, {1: g})
    pairs = spark.createDataFrame([(1, 4, 0)], "snapshot INT, i BIGINT, j BIGINT")
    d = pair_distance(e, pairs, mode="exact", weight_power=power).first().d
    assert d == pytest.approx(expect, abs=1e-7)


def test_no_change_no_scores(spark):
    e = edges_df(spark, {1: G1, 2: G1})
    flagged, nodes = detect(e, 1, 2)
    assert flagged.count() == 0 and nodes.count() == 0


def test_partitioning_invariance(spark):
    e = edges_df(spark, {1: G1, 2: G2})
    a = sorted((r.i, r.j, round(r.delta_e, 12), r.anomalous) for r in detect(e, 1, 2, mode="exact")[0].collect())
    e2 = e.repartition(7, F.rand(3)).sortWithinPartitions(F.rand(5))
    b = sorted((r.i, r.j, round(r.delta_e, 12), r.anomalous) for r in detect(e2, 1, 2, mode="exact")[0].collect())
    assert a == b


def _hubs(edges, bucket):
    """Destinations that the shuffle path splits."""
    from graphdelta.operators import linalg, walk
    salted, hot = walk._salted_edges(linalg.row_normalize(edges), ["snapshot"], 4, bucket, bucket)
    salted.unpersist()
    return hot.count()


def test_shuffle_path_with_salted_hubs(spark):
    """Vector too big to broadcast (limit 0) and every destination salted
    (bucket of 1 edge): same distances as the broadcast path."""
    from graphdelta.operators import walk
    from graphdelta.operators.linalg import half_edges
    e = edges_df(spark, {1: G1, 2: G2})
    b = walk.incidence_exact(half_edges(e))
    z1 = walk.walk_series(e, b, 12)
    z2 = walk.walk_series(e, b, 12, broadcast_limit=0, bucket_rows=1)
    assert _hubs(e, 1) > 0
    cols = [c for c in z1.columns if c.startswith("x")]
    a = {(r.snapshot, r.chunk, r.node): [r[c] for c in cols] for r in z1.collect()}
    bb = {(r.snapshot, r.chunk, r.node): [r[c] for c in cols] for r in z2.collect()}
    assert a.keys() == bb.keys()
    assert all(x == pytest.approx(y, abs=1e-12) for k in a for x, y in zip(a[k], bb[k]))


def test_series_equals_materialised_solver(spark):
    """walk_series == chain product + Richardson steps (the literal solver)."""
    import numpy as np
    from graphdelta.operators import walk
    from graphdelta.operators.chain import richardson_solve
    from graphdelta.operators.linalg import half_edges
    g = dict(G1)
    g[(3, 0)] = 0.5
    e = edges_df(spark, {1: g})
    b = walk.incidence_exact(half_edges(e))
    width = walk.vector_width(b)
    long_b = spark.createDataFrame(
        [(r.snapshot, r.chunk * width + u, r.node, r[f"x{u}"]) for r in b.collect()
         for u in range(width) if r[f"x{u}"] != 0],
        "snapshot INT, slot BIGINT, node BIGINT, x DOUBLE")
    for tol, d in ((1e-2, 3), (1e-2, 1), (1e-1, 2)):
        from graphdelta.functions.scalar import series_length
        z = walk.walk_series(e, b, series_length(tol, d))
        y = {(r.slot, r.node): r.x for r in richardson_solve(e, long_b, tol, d).collect()}
        for r in z.collect():
            for u in range(width):
                slot = r.chunk * width + u
                if slot < len(g):
                    assert r[f"x{u}"] == pytest.approx(y.get((slot, r.node), 0.0), abs=1e-12)


def test_salted_path_on_activity_graph(spark):
    """Real skewed graph (a clique of zero-valued tiles): the salted shuffle path
    and the broadcast path give the same solved columns."""
    from conftest import SF01
    from graphdelta.operators import kernel, walk
    from graphdelta.operators.linalg import half_edges
    from graphdelta.plans import queries as Q
    g = kernel.grid_graph(Q._activity_tiles(spark, SF01), Q.SIGMA, keys=["snapshot"]).checkpoint(eager=True)
    b = walk.incidence_sketch(half_edges(g), 16).checkpoint(eager=True)
    z1 = walk.walk_series(g, b, 3)
    z2 = walk.walk_series(g, b, 3, broadcast_limit=0, bucket_rows=5)
    assert _hubs(g, 5) > 0                 # hubs were salted
    cols = [c for c in z1.columns if c.startswith("x")]
    a = {(r.snapshot, r.chunk, r.node): [r[c] for c in cols] for r in z1.collect()}
    c = {(r.snapshot, r.chunk, r.node): [r[c] for c in cols] for r in z2.collect()}
    assert a.keys() == c.keys() and len(a) > 100
    assert all(x == pytest.approx(y, rel=1e-9, abs=1e-12) for k in a for x, y in zip(a[k], c[k]))


def test_doubling_equals_the_steps(spark, monkeypatch):
    """Numbers of terms with and without ones in binary, sparse and negative node ids,
    a node without edges to the rest, two graphs: the same columns."""
    from graphdelta.operators import walk
    from graphdelta.operators.linalg import half_edges
    moved = {s: {(13 * i - 40, 13 * j - 40): w for (i, j), w in g.items()} for s, g in ((1, G1), (2, G2))}
    moved[2][(500, 499)] = 2.5
    e = edges_df(spark, moved).checkpoint()
    b = walk.incidence_sketch(half_edges(e), 20).checkpoint()
    cols = walk.xcols(walk.vector_width(b))
    for K in (2, 6, 7):
        out = []
        for pays in (True, False):
            monkeypatch.setattr(walk, "_doubling_pays", lambda *a, pays=pays: pays)
            z = walk.walk_series(e, b, K)
            assert z.columns == ["snapshot", "chunk", "node", *cols]
            out.append({(r.snapshot, r.chunk, r.node): [r[c] for c in cols] for r in z.collect()})
        assert out[0].keys() == out[1].keys() and len(out[0]) == (8 + 10) * 3
        assert all(x == pytest.approx(y, abs=1e-12) for k in out[0] for x, y in zip(out[0][k], out[1][k]))


def test_doubling_only_where_it_pays():
    from graphdelta.operators.walk import _doubling_pays
    dense = dict(K=48, m=600, n_rows=1575, power_rows=100, cells=625, width=8)
    assert _doubling_pays(**dense, limit=1 << 20)
    assert not _doubling_pays(**dense, limit=1 << 10)                        # doesn't fit
    assert not _doubling_pays(**dict(dense, power_rows=2000), limit=1 << 20)  # more nodes than slots
    assert not _doubling_pays(**dict(dense, m=60), limit=1 << 20)            # sparse


def test_cells_are_numbered_in_blocks(spark, monkeypatch):
    from graphdelta.operators import kernel
    g = spark.createDataFrame([(1, 2, 3, 5.0), (2, 6, 4, 7.0)], "k INT, row BIGINT, col INT, value DOUBLE")
    for block in (1, 4, 35, 100_000):
        monkeypatch.setattr(kernel, "CELL_BLOCK", block)
        rows = kernel.dense_grid(g, 7, 5, 0.0, ["k"]).collect()
        want = {(k, r, c): 0.0 for k in (1, 2) for r in range(7) for c in range(5)}
        want[1, 2, 3], want[2, 6, 4] = 5.0, 7.0
        assert {(r.k, r.row, r.col): r.value for r in rows} == want and len(rows) == 70
