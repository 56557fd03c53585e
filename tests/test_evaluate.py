"""Sweep, calibration and perturbation on small inputs."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdelta.operators import evaluate as ev
from graphdelta.operators import perturb


def _points(spark, seed=0, n=10):
    rng = np.random.default_rng(seed)
    x1 = rng.normal(0, 1, (n, 2))
    x2 = x1 + rng.normal(0, 0.3, (n, 2))
    rows = [(s, i, [float(v) for v in x[i]]) for s, x in ((1, x1), (2, x2)) for i in range(n)]
    return spark.createDataFrame(rows, "snapshot INT, node BIGINT, x ARRAY<DOUBLE>")


def test_sigma_sweep_truth_row(spark):
    pts = _points(spark)
    summary, flagged, nodes = ev.sigma_sweep(pts, [0.5, 2.0], 1.0, 1, 2, mode="exact")
    rows = {r.sigma: r for r in summary.collect()}
    assert set(rows) == {0.5, 1.0, 2.0}
    assert rows[1.0].loss == 0.0 and rows[1.0].same
    assert rows[0.5].loss > 0 and rows[2.0].loss > 0
    assert flagged.select("sigma").distinct().count() == 3


def test_calibration_follows_the_secant_rule(spark):
    """Every run against the rule worked out from single evaluations; the threshold
    flags some of the nodes at the truth and not all."""
    pts = _points(spark, 1, 8).checkpoint()
    truth = 1.0
    starts, rates, rounds = (0.5, 2.0), (0.5, 3.0), 3
    _, flagged, _ = ev.sigma_sweep(pts, [], truth, 1, 2, mode="exact")
    sums = sorted(r.running_sum for r in flagged.select("running_sum").collect())
    opts = dict(mode="exact", threshold=sums[-3])
    _, _, nodes = ev.sigma_sweep(pts, [], truth, 1, 2, **opts)
    assert 0 < nodes.count() < 8
    trace = ev.calibrate_sigma(pts, truth, 1, 2, starts, rates, rounds, **opts).collect()
    runs = {}
    for r in trace:
        runs.setdefault(r.run_id, []).append(r)
    assert len(runs) == 4
    judged = {}
    sigmas = sorted({r.sigma for r in trace})
    summary, _, _ = ev.sigma_sweep(pts, sigmas, truth, 1, 2, **opts)
    for r in summary.collect():
        judged[r.sigma] = r
    moved = 0
    for run, (lr, start) in enumerate((lr, s) for lr in rates for s in starts):
        rows = sorted(runs[run], key=lambda r: r.iter)
        assert rows[0].sigma == start and {r.learning_rate for r in rows} == {lr}
        for n, r in enumerate(rows):
            assert r.iter == n and r.loss == pytest.approx(judged[r.sigma].loss) and r.same == judged[r.sigma].same
            if n == 0:
                step = r.sigma + 0.4
            else:
                p = rows[n - 1]
                step = r.sigma - lr * (r.loss - p.loss) / (r.sigma - p.sigma)
                moved += 1
            if n + 1 < len(rows):
                assert not (r.same and n > 0) and rows[n + 1].sigma == pytest.approx(step)
            else:
                assert n == rounds - 1 or (r.same and n > 0) or step in (r.sigma, 0.0)
    assert moved >= 3


def test_one_sigma_is_scored_by_loss_or_match(spark):
    pts = _points(spark, 1, 8)
    r = ev.evaluate_sigma(pts, 1.0, 1.0, 1, 2, mode="exact", threshold=0.05).first()
    assert r.same and r.loss == 0.0 and r.score == 0.0
    r = ev.evaluate_sigma(pts, 0.2, 1.0, 1, 2, mode="exact", threshold=0.05).first()
    assert r.loss > 0 and r.score == (0.0 if r.same else r.loss)


def test_calibration_query_walks_as_all_detections(monkeypatch):
    from graphdelta.plans import queries

    class Trace:
        def select(self, *columns):
            return self
    given = {}
    monkeypatch.setattr(queries.tables, "nation_points", lambda *a: None)
    monkeypatch.setattr(queries, "_r", lambda *a: None)
    monkeypatch.setattr(queries.ev, "calibrate_sigma", lambda *a, **k: given.update(k) or Trace())
    queries.q_calibrate_sigma(None, "")
    assert given == {"threshold": queries.SWEEP_THRESHOLD}


def test_top_fraction_and_perturb(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (30, 3))
    pts = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(30)],
                                "node BIGINT, x ARRAY<DOUBLE>")
    top = perturb.top_fraction(pts, 0.1).orderBy("pos").collect()
    norms = np.linalg.norm(x, axis=1)
    assert [r.node for r in top] == list(np.argsort(-norms)[:3])
    p1 = {r.node: (r.shift, r.anomalous) for r in perturb.perturb(pts, seed=5).collect()}
    p2 = {r.node: (r.shift, r.anomalous) for r in perturb.perturb(pts.repartition(4), seed=5).collect()}
    assert p1 == p2                                     # hash draws: partition independent
    assert sum(a for _, a in p1.values()) == 3
    shifts = np.array([s for s, a in p1.values() if not a])
    assert abs(shifts.mean()) < 1.0 and 0.2 < shifts.std() < 2.0


def test_rank_agreement(spark):
    r = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2)], "g INT, node BIGINT, pos BIGINT")
    k = spark.createDataFrame([(0, 1, 0), (0, 3, 1)], "g INT, node BIGINT, pos BIGINT")
    # node 2 missing from known -> position N=3; sum (i-j)^2 = 0 + (1-3)^2 + (2-1)^2 = 5
    rho = ev.rank_agreement(r, k, 3, 6.0, ["g"]).first().rho
    assert rho == pytest.approx(1 - 6 * 5 / (3 * 8))
