"""Detection on Gaussian graphs: whole graphs."""
import datetime as dt
import math
import random

import pytest

from graphdelta.operators import kernel, score, tiles
from graphdelta.operators.ordered import running_sum
from graphdelta.plans import queries as Q


def walk_plan(node):
    yield node
    for n in range(node.children().size()):
        yield from walk_plan(node.children().apply(n))


def test_activity_keeps_pairs_of_small_weight(spark, tmp_path):
    """Three tiles of users a week; weights of exp(-4) and exp(-9) are edges too."""
    week = [dt.datetime(1970, 1, 5) + dt.timedelta(weeks=n, days=2) for n in Q.WEEKS]
    rows = [(7 * tile, week[s], v) for s, values in enumerate(((10.0, 12.0, 15.0), (10.0, 13.0, 15.0)))
            for tile, v in enumerate(values)]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp, value double").write.parquet(
        str(tmp_path / "events.parquet"))
    got = {(r.i, r.j): r.abs_da for r in Q.q_detect_activity(spark, str(tmp_path)).collect()}
    change = pytest.approx(math.exp(-4) - math.exp(-9), abs=1e-9)
    assert got == {(1, 0): change, (2, 1): change}


def test_copies_of_a_point_stay_few():
    """Blocks grow with the points, up to their bytes, so a point is sent as often at ten
    times the size; blocks of 2,048 sent each of 100,000 points 50 times."""
    for n in (50_000, 100_000, 200_000):
        rows = kernel._block_size(n, 64)
        assert -(-n // rows) <= kernel.PARTS and rows * 64 * 8 <= kernel.BLOCK_BYTES
    assert kernel._block_size(10 ** 8, 64) * 64 * 8 == kernel.BLOCK_BYTES
    assert kernel._block_size(100, 64) == kernel.BLOCK_ROWS


@pytest.mark.parametrize("step,sent", [(0.25, "float"), (0.1, "double")])
def test_floats_are_sent_as_floats(spark, step, sent):
    rows = [(n, [n * step, n % 3 * step]) for n in range(20)]
    g = kernel.rbf_graph(spark.createDataFrame(rows, "node bigint, x array<double>"), 1.0)
    exchange = next(x for x in walk_plan(g._jdf.queryExecution().optimizedPlan()) if x.nodeName().startswith("Repartition"))
    assert f"x: array<{sent}>" in exchange.schema().simpleString().replace("x:array", "x: array")
    want = {(i, j): math.exp(-sum((a - b) ** 2 for a, b in zip(x, y)) / 2) for i, x in rows for j, y in rows if i != j}
    assert {(r.src, r.dst): r.w for r in g.collect()} == {k: pytest.approx(w, rel=1e-12) for k, w in want.items()}


def two_graphs(spark, n=34, seed=3):
    """Two dense snapshots; ids of either sign and many lengths, pairs that only one of
    them has or that don't change, one node without edges in the second."""
    rng = random.Random(seed)
    ids = sorted({rng.choice((-1, 1)) * rng.randrange(10 ** rng.choice((1, 3, 9, 18))) for _ in range(n)})
    rows = []
    for x, i in enumerate(ids):
        for j in ids[:x]:
            w = {1: rng.random(), 2: rng.random()}
            for s in (1, 2):
                if rng.random() < 0.9 and not (s == 2 and ids[0] in (i, j)):
                    v = w[1] if rng.random() < 0.1 else w[s]
                    rows += [(s, i, j, v), (s, j, i, v)]
    edges = spark.createDataFrame(rows, "snapshot int, src bigint, dst bigint, w double")
    return edges, spark.createDataFrame([(i,) for i in ids], "node bigint")


@pytest.mark.parametrize("size,power,seed", [(2, 1.0, 0), (5, 0.5, -7), (64, 1.0, 12)])
def test_tiles_score_as_rows_do(spark, size, power, seed):
    edges, nodes = two_graphs(spark)
    want, _ = score.detect(edges, 1, 2, weight_power=power, seed=seed)
    got = tiles.scored_pairs(edges, nodes, 1, 2, 0.1, 1e-2, 3, power, seed, size=size)
    cols = ["abs_da", "d1", "d2", "delta_e"]
    a, b = ({(r.i, r.j): [r[c] for c in cols] for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) > 400
    assert all(a[p] == pytest.approx(b[p], rel=1e-9, abs=1e-12) for p in a)


def test_dense_graphs_are_walked_as_tiles(spark, monkeypatch):
    """No row for an edge and a chunk of slots: the walk by rows isn't called."""
    edges, nodes = two_graphs(spark)
    want = [x.collect() for x in score.detect(edges, 1, 2, threshold=0.3)]
    with monkeypatch.context() as m:
        m.setattr(score, "pair_distance", None)
        got = score.detect(edges, 1, 2, threshold=0.3, nodes=nodes)
        flagged, found = got[0].collect(), got[1].collect()
    assert set(found) == set(want[1]) and got[0].columns == list(want[0][0].__fields__)
    assert {(r.i, r.j, r.anomalous) for r in flagged} == {(r.i, r.j, r.anomalous) for r in want[0]}


def test_other_graphs_are_walked_as_rows(spark, monkeypatch):
    edges, nodes = two_graphs(spark, 12)
    args = (1, 2, 0.1, 1e-2, 3)
    assert tiles.scored_pairs(edges.union(edges.limit(2)), nodes, *args) is None     # a pair twice
    many = nodes.union(spark.range(10 ** 6, 10 ** 6 + 100).toDF("node"))
    assert tiles.scored_pairs(edges, many, *args) is None                            # sparse
    assert tiles.scored_pairs(edges.limit(0), nodes, *args) is None
    with pytest.raises(Exception, match="lacks an end"):
        tiles.scored_pairs(edges, nodes.limit(5), *args)
    twice = edges.union(edges)
    a, b = (score.detect(twice, 1, 2, nodes=x)[0].collect() for x in (nodes, None))
    assert {(r.i, r.j) for r in a} == {(r.i, r.j) for r in b} and len(a) == len(b)


def test_running_sum_of_keys_and_nulls_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice((None, 1, 2)), n, rng.choice((None, 0.0, 0.25, 1.5))) for n in range(300)]
    df = spark.createDataFrame(rows, "g int, i bigint, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = running_sum(df, "v", ["v", "i"], ["g"], n_partitions=4)
        got = {(r.g, r.i): r.running_sum for r in out.where("g IS NOT NULL").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (1, 2):
        total = 0.0
        for _, i, v in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: (r[2], r[1])):
            total += v
            assert got[g, i] == total
        assert all(got[g, i] is None for k, i, v in rows if k == g and v is None)
    assert out.columns == ["g", "i", "v", "running_sum"]


def test_running_sum_shuffles_rows_once(spark):
    df = spark.range(50).selectExpr("id i", "0L j", "double(id) delta_e")
    plan = score.anomaly_cut(df, 10.0)._jdf.queryExecution().executedPlan().toString()
    rows = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert all("_pid" in ln or "_g" in ln for ln in rows)
    assert "SortMergeJoin" not in plan and "FileScan parquet" in plan
