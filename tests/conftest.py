import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphdelta.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="graphdelta-tests",
                      extra={"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


# Golden 8-node fixture (FIXTURES.md section 2): undirected weights per snapshot.
G1 = {(1, 0): 2.0, (2, 0): 1.0, (3, 1): 1.5, (3, 2): 1.0, (4, 0): 0.5, (5, 1): 0.7,
      (6, 2): 0.6, (7, 3): 0.4, (5, 4): 2.0, (6, 4): 1.0, (7, 5): 1.5, (7, 6): 1.0}
G2 = dict(G1)
G2[(7, 3)] = 0.1
G2[(7, 0)] = 0.9
G2[(7, 6)] = 1.3


def edges_df(spark, graphs: dict):
    """{snapshot: {(i, j): w}} -> edges (snapshot, src, dst, w), both directions."""
    rows = []
    for s, g in graphs.items():
        for (i, j), w in g.items():
            rows.append((s, i, j, float(w)))
            rows.append((s, j, i, float(w)))
    return spark.createDataFrame(rows, "snapshot INT, src BIGINT, dst BIGINT, w DOUBLE")
