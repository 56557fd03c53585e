"""DuckDB SQL for every registered query that SQL can express on whole tables.

The walk series is unrolled into K chained CTEs in the long form
``(keys..., slot, node, x)``; ranks and running sums are plain window
functions (fine for an oracle).  Builders below emit CTE lists so that the
detector's SQL is assembled the same way for each query that needs it.
"""

from __future__ import annotations

import itertools
import math

from ..functions.scalar import DEFAULT_D, DEFAULT_EPS, DEFAULT_THRESHOLD, DEFAULT_TOL, series_length
from . import queries as Q

R = Q.ROUND
SIG = repr(Q.SIGMA)


def rnd(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {R}) AS {name}"


def on(a: str, b: str, keys, extra: str = "") -> str:
    conds = [f"{a}.{k} = {b}.{k}" for k in keys]
    if extra:
        conds.append(extra)
    return " AND ".join(conds) if conds else "TRUE"


def kl(keys, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"{p}{k}" for k in keys)


def kc(keys, alias: str = "") -> str:
    """key list with a trailing comma, or empty."""
    return (kl(keys, alias) + ", ") if keys else ""


def with_sql(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{n} AS (\n{q}\n)" for n, q in ctes)
    return f"WITH {body}\n{final}"


# ------------------------------------------------------------------ inputs

def trade_ctes(years=None) -> list[tuple[str, str]]:
    only = f" AND year(o.o_orderdate) IN ({', '.join(map(str, years))})" if years else ""
    return [
        ("trade", f"""SELECT CAST(year(o.o_orderdate) AS INTEGER) AS snapshot,
       CAST(greatest(c.c_nationkey, s.s_nationkey) AS BIGINT) AS i,
       CAST(least(c.c_nationkey, s.s_nationkey) AS BIGINT) AS j,
       sum(l.l_quantity) / 1000.0 AS w
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE c.c_nationkey <> s.s_nationkey{only}
GROUP BY 1, 2, 3"""),
        ("edges", """SELECT snapshot, i AS src, j AS dst, w FROM trade WHERE w <> 0
UNION ALL SELECT snapshot, j AS src, i AS dst, w FROM trade WHERE w <> 0"""),
    ]


def nation_points_ctes(years=Q.YEARS) -> list[tuple[str, str]]:
    ys = ", ".join(str(y) for y in years)
    return [
        ("lines", f"""SELECT CAST(year(o.o_orderdate) AS INTEGER) AS snapshot, c.c_nationkey AS cn,
       s.s_nationkey AS sn, l.l_quantity AS q
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE year(o.o_orderdate) IN ({ys})"""),
        ("flows", """SELECT snapshot, node, sum(ex) AS ex, sum(im) AS im FROM (
  SELECT snapshot, CAST(sn AS BIGINT) AS node, q AS ex, 0.0 AS im FROM lines
  UNION ALL SELECT snapshot, CAST(cn AS BIGINT) AS node, 0.0 AS ex, q AS im FROM lines)
GROUP BY snapshot, node"""),
        ("points", """SELECT snapshot, node, [ln(1.0 + ex / 1000.0), ln(1.0 + im / 1000.0)] AS x
FROM flows"""),
    ]


def cube_cte() -> tuple[str, str]:
    return ("cube", """SELECT CAST(user_id AS BIGINT) AS row,
       CAST(date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) % 7 AS INTEGER) AS col,
       CAST(date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) // 7 AS INTEGER) AS slice,
       sum(value) AS value
FROM events GROUP BY 1, 2, 3""")


def clean_grid_ctes() -> list[tuple[str, str]]:
    return [
        cube_cte(),
        ("ext", "SELECT max(user_id) + 1 AS nrows FROM events"),
        ("cells", """SELECT slice, CAST(r AS BIGINT) AS row, CAST(c AS INTEGER) AS col FROM
  (SELECT DISTINCT slice FROM cube) ss,
  (SELECT unnest(range(0, nrows)) AS r FROM ext) rr,
  (SELECT unnest(range(0, 7)) AS c) cc"""),
        ("dense", """SELECT cells.slice, cells.row, cells.col, coalesce(s.value, -9999.0) AS value
FROM cells LEFT JOIN cube s
ON cells.slice = s.slice AND cells.row = s.row AND cells.col = s.col"""),
        ("clean", """SELECT slice, row, col, CASE WHEN value = -9999.0 THEN 0.0 ELSE CAST(value AS DOUBLE) END AS value
FROM dense"""),
    ]


def tiles_ctes(grid: str, keys, spacing: int = Q.GRID_SPACING, ncols: int = 7,
               name: str = "tiles") -> list[tuple[str, str]]:
    """Downsample ``grid(keys..., row, col, value)``: all tiles, the last ones smaller,
    mean of > 0."""
    s = max(spacing, 1)
    tc_n = -(-ncols // s)
    return [
        (f"{name}_n", f"SELECT CAST((max(user_id) + {s}) // {s} AS BIGINT) AS tr_n FROM events"),
        (f"{name}_all", f"""SELECT {kc(keys, 'g')}CAST(t AS BIGINT) AS node,
       CAST(t // {tc_n} AS BIGINT) AS tr, CAST(t % {tc_n} AS BIGINT) AS tc
FROM (SELECT unnest(range(0, tr_n * {tc_n})) AS t FROM {name}_n) tt,
     (SELECT DISTINCT {kl(keys) if keys else '1 AS one'} FROM {grid}) g"""),
        (f"{name}_mean", f"""SELECT {kc(keys)}CAST(row // {s} AS BIGINT) AS tr,
       CAST(col // {s} AS BIGINT) AS tc,
       avg(CASE WHEN value > 0 THEN value END) AS m
FROM {grid} GROUP BY ALL"""),
        (name, f"""SELECT {kc(keys, 'a')}a.node, CAST(a.tr * {s} AS BIGINT) AS row,
       CAST(a.tc * {s} AS INTEGER) AS col, coalesce(m.m, 0.0) AS value
FROM {name}_all a LEFT JOIN {name}_mean m ON {on('a', 'm', keys, 'a.tr = m.tr AND a.tc = m.tc')}"""),
    ]


def activity_tiles_ctes(weeks=None) -> list[tuple[str, str]]:
    only = f" WHERE slice IN ({', '.join(map(str, weeks))})" if weeks else ""
    return [cube_cte(),
            ("agrid", f"SELECT slice AS snapshot, row, col, value FROM cube{only}")
            ] + tiles_ctes("agrid", ["snapshot"], name="atiles")


def rbf_ctes(points: str, keys, sigma: str, name: str, min_weight: float = 0.0) -> list:
    """All ordered pairs of distinct nodes with a non-zero (>= min_weight) weight."""
    extra = f" AND w >= {repr(float(min_weight))}" if min_weight else ""
    return [(name + "_d", f"""SELECT {kc(keys, 'a')}a.node AS src, b.node AS dst,
  list_sum(list_transform(list_zip(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])),
           lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2, {sigma} AS sg
FROM {points} a JOIN {points} b ON {on('a', 'b', keys, 'a.node <> b.node')}"""),
            (name, f"""SELECT {kc(keys)}src, dst, w FROM (
  SELECT {kc(keys)}src, dst, exp(-(0.0 + d2) / (2.0 * sg * sg)) AS w FROM {name}_d)
WHERE w <> 0{extra}""")]


# ------------------------------------------------------------------ the method

def half_cte(E: str, keys, scope: str = "all", p: int | None = None, name: str = "half"):
    cond = "src > dst"
    if scope == "cross_block":
        cond = f"src // {p} > dst // {p}"
    return (name, f"SELECT {kc(keys)}src AS i, dst AS j, w FROM {E} WHERE {cond} AND w <> 0")


def incidence_exact_ctes(half: str, keys, name: str) -> list:
    return [
        (name + "_idx", f"""SELECT {kc(keys)}i, j, w,
  row_number() OVER (PARTITION BY {kl(keys)} ORDER BY j, i) - 1 AS slot FROM {half}"""),
        (name, f"""SELECT {kc(keys)}slot, node, sum(x) AS x FROM (
  SELECT {kc(keys)}slot, i AS node, w AS x FROM {name}_idx
  UNION ALL SELECT {kc(keys)}slot, j AS node, -w AS x FROM {name}_idx)
GROUP BY ALL"""),
    ]


def incidence_sketch_ctes(E: str, half: str, keys, name: str, eps: float = DEFAULT_EPS,
                          seed: int = 0) -> list:
    return [
        (name + "_k", f"""SELECT CAST(trunc(ceil(log2(max(n))) / {eps}) AS BIGINT) AS k FROM
  (SELECT {kc(keys)}count(DISTINCT src) AS n FROM {E} GROUP BY ALL)"""),
        (name + "_t", f"SELECT unnest(range(0, k)) AS t FROM {name}_k"),
        (name + "_s", f"""SELECT {kc(keys, 'h')}h.i, h.j, tt.t,
  (h.w * CASE WHEN substr(md5(concat_ws('|', {seed}, h.i, h.j, tt.t // 32)), 1 + CAST(tt.t % 32 AS INTEGER), 1) < '8'
              THEN 1.0 ELSE -1.0 END) * (1.0 / sqrt(kk.k)) AS v
FROM {half} h, {name}_t tt, {name}_k kk"""),
        (name, f"""SELECT {kc(keys)}t AS slot, node, sum(x) AS x FROM (
  SELECT {kc(keys)}t, i AS node, v AS x FROM {name}_s
  UNION ALL SELECT {kc(keys)}t, j AS node, -v AS x FROM {name}_s)
GROUP BY ALL"""),
    ]


def walk_ctes(E: str, B: str, keys, K: int, name: str) -> tuple[list, str]:
    """z = sum_{j<K} P^j (b/deg) in K unrolled CTEs; returns (ctes, final name)."""
    ctes = [
        (name + "_deg", f"SELECT {kc(keys)}src AS node, sum(w) AS deg FROM {E} GROUP BY ALL"),
        (name + "_P", f"""SELECT {kc(keys, 'e')}e.src, e.dst,
  CASE WHEN d.deg <> 0 THEN e.w / d.deg ELSE 0.0 END AS p
FROM {E} e JOIN {name}_deg d ON {on('e', 'd', keys, 'e.src = d.node')}"""),
        (name + "_slots", f"SELECT DISTINCT {kc(keys)}slot FROM {B}"),
        (name + "_c", f"""SELECT {kc(keys, 'd')}s.slot, d.node,
  coalesce(b.x, 0.0) * CASE WHEN d.deg <> 0 THEN 1.0 / d.deg ELSE 0.0 END AS x
FROM {name}_deg d JOIN {name}_slots s ON {on('d', 's', keys)}
LEFT JOIN {B} b ON {on('d', 'b', keys, 'b.slot = s.slot AND b.node = d.node')}"""),
    ]
    if K <= 0:
        ctes.append((name + "_z", f"SELECT {kc(keys)}slot, node, 0.0 AS x FROM {name}_c"))
        return ctes, name + "_z"
    prev = name + "_c"
    for step in range(1, K):
        cur = f"{name}_y{step}"
        ctes.append((cur, f"""SELECT {kc(keys)}slot, node, sum(x) AS x FROM (
  SELECT {kc(keys, 'p')}y.slot, p.src AS node, p.p * y.x AS x
  FROM {name}_P p JOIN {prev} y ON {on('p', 'y', keys, 'p.dst = y.node')}
  UNION ALL SELECT {kc(keys)}slot, node, x FROM {name}_c)
GROUP BY ALL"""))
        prev = cur
    return ctes, prev


def distance_ctes(pairs: str, Z: str, keys, name: str) -> list:
    return [(name, f"""SELECT {kc(keys, 'q')}q.i, q.j, sum((zi.x - zj.x) * (zi.x - zj.x)) AS d
FROM {pairs} q JOIN {Z} zi ON {on('q', 'zi', keys, 'zi.node = q.i')}
JOIN {Z} zj ON {on('q', 'zj', keys, 'zj.node = q.j AND zj.slot = zi.slot')}
GROUP BY ALL""")]


def solve_ctes(E: str, keys, mode: str, name: str, scope="all", p=None, seed: int = 0) -> tuple[list, str]:
    ctes = [half_cte(E, keys, scope, p, name + "_half")]
    if mode == "exact":
        ctes += incidence_exact_ctes(name + "_half", keys, name + "_b")
    else:
        ctes += incidence_sketch_ctes(E, name + "_half", keys, name + "_b", seed=seed)
    w, z = walk_ctes(E, name + "_b", keys, series_length(DEFAULT_TOL, DEFAULT_D), name + "_w")
    return ctes + w, z


def detect_ctes(E: str, s1, s2, gk, mode: str, name: str, scope="all", p=None,
                threshold: float = DEFAULT_THRESHOLD, snapshot: str = "snapshot", seed: int = 0) -> list:
    """CTEs ending in ``{name}`` (scored pairs with the cut) and ``{name}_nodes``."""
    keys = list(gk) + [snapshot]
    cond = "i > j" if scope == "all" else f"i // {p} > j // {p}"
    ctes = [
        (name + "_h", f"SELECT {kc(gk)}{snapshot}, src AS i, dst AS j, w FROM {E} WHERE src > dst"),
        (name + "_ch", f"""SELECT {kc(gk, 'a')}a.i, a.j, a.w1, b.w2,
  abs(coalesce(a.w1, 0.0) - coalesce(b.w2, 0.0)) AS abs_da FROM
  (SELECT {kc(gk)}i, j, w AS w1 FROM {name}_h WHERE {snapshot} = {s1}) a
  FULL OUTER JOIN
  (SELECT {kc(gk)}i, j, w AS w2 FROM {name}_h WHERE {snapshot} = {s2}) b
  ON {on('a', 'b', gk, 'a.i = b.i AND a.j = b.j')}"""),
        # the full outer join leaves one side's keys NULL: rebuild them
        (name + "_chg", f"""SELECT * FROM (
  SELECT {kc(gk)}i, j, w1, w2, abs_da FROM {name}_ch WHERE i IS NOT NULL
  UNION ALL
  SELECT {kc(gk, 'b')}b.i, b.j, NULL AS w1, b.w2, abs(b.w2) AS abs_da FROM
    (SELECT {kc(gk)}i, j, w AS w2 FROM {name}_h WHERE {snapshot} = {s2}) b
    ANTI JOIN (SELECT {kc(gk)}i, j FROM {name}_h WHERE {snapshot} = {s1}) a
    ON {on('a', 'b', gk, 'a.i = b.i AND a.j = b.j')})
WHERE abs_da <> 0 AND {cond}"""),
        (name + "_pairs", f"""SELECT {kc(gk)}{s1} AS {snapshot}, i, j FROM {name}_chg WHERE w1 IS NOT NULL
UNION ALL SELECT {kc(gk)}{s2} AS {snapshot}, i, j FROM {name}_chg WHERE w2 IS NOT NULL"""),
        (name + "_E", f"SELECT * FROM {E} WHERE {snapshot} IN ({s1}, {s2})"),
    ]
    solve, z = solve_ctes(name + "_E", keys, mode, name + "_s", scope, p, seed)
    ctes += solve
    ctes += distance_ctes(name + "_pairs", z, keys, name + "_dist")
    ctes += [
        (name + "_de", f"""SELECT {kc(gk, 'c')}c.i, c.j, c.abs_da,
  coalesce(d1.d, 0.0) AS d1, coalesce(d2.d, 0.0) AS d2,
  c.abs_da * abs(coalesce(d1.d, 0.0) - coalesce(d2.d, 0.0)) AS delta_e
FROM {name}_chg c
LEFT JOIN (SELECT * FROM {name}_dist WHERE {snapshot} = {s1}) d1 ON {on('c', 'd1', gk, 'd1.i = c.i AND d1.j = c.j')}
LEFT JOIN (SELECT * FROM {name}_dist WHERE {snapshot} = {s2}) d2 ON {on('c', 'd2', gk, 'd2.i = c.i AND d2.j = c.j')}"""),
        (name + "_run", f"""SELECT *, sum(delta_e) OVER (PARTITION BY {kl(gk) if gk else '1'}
  ORDER BY delta_e, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_sum FROM {name}_de"""),
        (name, f"""SELECT *, (running_sum > {threshold} OR NOT bool_or(running_sum > {threshold})
  OVER (PARTITION BY {kl(gk) if gk else '1'})) AS anomalous FROM {name}_run"""),
        (name + "_nodes", f"""SELECT DISTINCT {kc(gk)}node FROM (
  SELECT {kc(gk)}i AS node FROM {name} WHERE anomalous
  UNION ALL SELECT {kc(gk)}j AS node FROM {name} WHERE anomalous)"""),
    ]
    return ctes


def flag_select(name: str, keys=()) -> str:
    return (f"SELECT {kc(keys)}i, j, {rnd('abs_da', 'abs_da')}, {rnd('d1', 'd1')}, "
            f"{rnd('d2', 'd2')}, {rnd('delta_e', 'delta_e')}, "
            f"{rnd('running_sum', 'running_sum')}, anomalous FROM {name}")


# ------------------------------------------------------------------ per query

def _trade(final: str, extra=(), years=None) -> str:
    return with_sql(trade_ctes(years) + list(extra), final)


def _pair(final: str, extra=()) -> str:
    """Over the two years that are compared."""
    return _trade(final, extra, Q.YEARS)


def sql_queries() -> dict[str, str]:
    S1, S2, T = Q.S1, Q.S2, Q.TILE
    K = ["snapshot"]
    out: dict[str, str] = {}
    out["trade_edges"] = _trade(f"SELECT snapshot, src, dst, {rnd('w', 'w')} FROM edges")
    out["degree"] = _trade(f"SELECT snapshot, src AS node, {rnd('sum(w)', 'deg')} FROM edges GROUP BY 1, 2")
    out["inv_degree"] = _trade(
        f"""SELECT snapshot, node, {rnd('deg', 'deg')},
  {rnd('CASE WHEN deg <> 0 THEN pow(deg, -0.5) ELSE 0.0 END', 'inv')}
FROM (SELECT snapshot, src AS node, sum(w) AS deg FROM edges GROUP BY 1, 2)""")
    out["graph_profile"] = _trade(
        f"""SELECT snapshot, count(*) AS n_entries, count(DISTINCT src) AS n_nodes,
  min(least(src, dst)) AS min_node, max(greatest(src, dst)) AS max_node,
  {rnd('sum(w)', 'total_w')}, {rnd('min(w)', 'min_w')}, {rnd('max(w)', 'max_w')}
FROM edges GROUP BY snapshot""")
    out["half_edges_cross_block"] = _trade(
        f"SELECT snapshot, src AS i, dst AS j, {rnd('w', 'w')} FROM edges "
        f"WHERE src // {T} > dst // {T} AND w <> 0")
    out["tile_edges"] = _trade(
        f"""SELECT snapshot, CAST(src // {T} AS BIGINT) AS bi, CAST(dst // {T} AS BIGINT) AS bj,
  CAST(src % {T} AS INTEGER) AS r, CAST(dst % {T} AS INTEGER) AS c, {rnd('w', 'w')} FROM edges""")
    out["tiles_roundtrip"] = _trade(f"""SELECT snapshot, CAST(src // {T} AS BIGINT) AS bi,
  CAST(dst // {T} AS BIGINT) AS bj, CAST({T} AS INTEGER) AS n_rows, CAST({T * T} AS INTEGER) AS n_cells,
  CAST(count(*) AS INTEGER) AS n_entries, {rnd('sum(w)', 'total')},
  {rnd(f'sum(CASE WHEN src % {T} = 0 AND dst % {T} = 1 THEN w ELSE 0.0 END)', 'second')}
FROM edges GROUP BY ALL""")
    out["whole_tile"] = out["trade_edges"]
    out["stored_edge_list"] = _trade("SELECT snapshot, src, dst FROM edges")
    out["stored_tiles"] = _trade(f"""SELECT snapshot, CAST(src // {T} AS BIGINT) AS bi,
  CAST(dst // {T} AS BIGINT) AS bj, src, dst,
  {rnd(f'CASE WHEN src // {T} = dst // {T} THEN 2 * w ELSE w END', 'w')}
FROM edges WHERE src // {T} >= dst // {T}""")
    out["edge_order"] = _trade("""SELECT snapshot, src AS i, dst AS j,
  row_number() OVER (PARTITION BY snapshot ORDER BY dst, src) - 1 AS place FROM edges WHERE src > dst""")
    out["matvec"] = _trade(
        f"""SELECT e.snapshot, e.src AS node, {rnd('sum(e.w * x.x)', 'x')}
FROM edges e JOIN (SELECT snapshot, src AS node,
  CASE WHEN sum(w) <> 0 THEN pow(sum(w), -0.5) ELSE 0.0 END AS x FROM edges GROUP BY 1, 2) x
ON e.snapshot = x.snapshot AND e.dst = x.node GROUP BY 1, 2""")
    out["matmul"] = _trade(
        f"""SELECT snapshot, src, dst, {rnd('w', 'w')} FROM (
SELECT a.snapshot, a.src, b.dst, sum(a.w * b.w) AS w FROM edges a JOIN edges b
ON a.snapshot = b.snapshot AND a.dst = b.src GROUP BY 1, 2, 3) WHERE w <> 0""")
    out["mat_subtract"] = _pair(
        f"""SELECT src, dst, {rnd('w', 'w')} FROM (
SELECT src, dst, sum(w) AS w FROM (
  SELECT src, dst, w FROM edges WHERE snapshot = {S1}
  UNION ALL SELECT src, dst, -w FROM edges WHERE snapshot = {S2}) GROUP BY 1, 2) WHERE w <> 0""")
    out["laplacian"] = _trade(
        f"""SELECT snapshot, src, dst, {rnd('w', 'w')} FROM (
SELECT snapshot, src, dst, sum(w) AS w FROM (
  SELECT snapshot, src, src AS dst, sum(w) AS w FROM edges GROUP BY 1, 2, 3
  UNION ALL SELECT snapshot, src, dst, -w FROM edges) GROUP BY 1, 2, 3) WHERE w <> 0""")
    def mm(a, b):
        return f"""SELECT x.snapshot, x.src, y.dst, sum(x.w * y.w) AS w FROM {a} x JOIN {b} y
  ON x.snapshot = y.snapshot AND x.dst = y.src GROUP BY 1, 2, 3 HAVING sum(x.w * y.w) <> 0"""

    def add(a, b):
        return f"""SELECT snapshot, src, dst, sum(w) AS w FROM (SELECT snapshot, src, dst, w FROM {a}
  UNION ALL SELECT snapshot, src, dst, w FROM {b}) GROUP BY 1, 2, 3 HAVING sum(w) <> 0"""
    chain = [
        ("cdeg", """SELECT snapshot, src AS node, sum(w) AS deg,
  CASE WHEN sum(w) > 0 THEN pow(sum(w), -0.5) ELSE 0.0 END AS isq FROM edges GROUP BY 1, 2"""),
        ("cS", """SELECT e.snapshot, e.src, e.dst, a.isq * e.w * b.isq AS w FROM edges e
  JOIN cdeg a ON e.snapshot = a.snapshot AND e.src = a.node
  JOIN cdeg b ON e.snapshot = b.snapshot AND e.dst = b.node"""),
        ("cI", "SELECT snapshot, node AS src, node AS dst, 1.0 AS w FROM cdeg"),
        ("cC0", "SELECT snapshot, node AS src, node AS dst, isq AS w FROM cdeg WHERE isq <> 0"),
        ("cSI", add("cS", "cI")),
        ("cC1", mm("cSI", "cC0")),
        ("cS2", mm("cS", "cS")),
        ("cS2I", add("cS2", "cI")),
        ("cC2", mm("cS2I", "cC1")),
    ]
    out["chain_product"] = _trade(f"SELECT snapshot, src, dst, {rnd('w', 'w')} FROM cC2", chain)
    # incidence projection (sketch), walk series (exact), pair distances
    ic = [half_cte("edges", K)] + incidence_sketch_ctes("edges", "half", K, "b")
    out["incidence_project"] = _trade(
        f"SELECT snapshot, CAST(slot AS BIGINT) AS slot, node, {rnd('x', 'x')} FROM b", ic)
    sc, z = solve_ctes("edges", K, "exact", "sv")
    out["walk_series"] = _trade(
        f"SELECT snapshot, CAST(slot AS BIGINT) AS slot, node, {rnd('x', 'x')} FROM {z}", sc)
    for mode in ("exact", "sketch"):
        sc, z = solve_ctes("edges", K, mode, "sv")
        dc = distance_ctes("sv_half", z, K, "dist")
        out[f"pair_distance_{mode}"] = _trade(
            f"""SELECT h.snapshot, h.i, h.j, {rnd('coalesce(d.d, 0.0)', 'd')}
FROM sv_half h LEFT JOIN dist d ON h.snapshot = d.snapshot AND h.i = d.i AND h.j = d.j""",
            sc + dc)
    # detection
    dt = detect_ctes("edges", S1, S2, [], "sketch", "det")
    out["delta_e"] = _pair(
        f"SELECT i, j, {rnd('abs_da', 'abs_da')}, {rnd('d1', 'd1')}, {rnd('d2', 'd2')}, "
        f"{rnd('delta_e', 'delta_e')} FROM det_de", dt)
    out["detect_trade"] = _pair(flag_select("det"), detect_ctes("edges", S1, S2, [], "exact", "det"))
    out["stored_result"] = _pair(f"""SELECT i, j, {rnd('delta_e', 'delta_e')}, anomalous,
  i IN (SELECT node FROM det_nodes) AS i_found, j IN (SELECT node FROM det_nodes) AS j_found FROM det""", dt)
    out["anomaly_cut"] = _pair(flag_select("det") + " WHERE anomalous", dt)
    out["banded_cut"] = _pair(f"SELECT i, j, {rnd('delta_e', 'delta_e')}, anomalous FROM det", dt)
    out["anomalous_nodes"] = _pair("SELECT CAST(node AS BIGINT) AS node FROM det_nodes", dt)
    out["detect_trade_cross_block"] = _pair(
        flag_select("det"), detect_ctes("edges", S1, S2, [], "sketch", "det", "cross_block", T))
    out["detect_trade_sketch"] = _pair(flag_select("det"), dt)
    out["detect_trade_empty_cut"] = _pair(
        "SELECT CAST(node AS BIGINT) AS node FROM det_nodes",
        detect_ctes("edges", S1, S2, [], "sketch", "det", threshold=10.0))
    # grids
    out["month_index"] = """SELECT CAST(CASE WHEN y BETWEEN 1982 AND 2002 AND m BETWEEN 0 AND 12
  THEN (y - 1982) * 12 + m - 1 END AS INTEGER) AS month_idx, count(*) AS n_orders
FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders) GROUP BY 1"""
    out["time_slice"] = with_sql([cube_cte()],
                                 f"SELECT row, col, {rnd('value', 'value')} FROM cube WHERE slice = {Q.WEEKS[1]}")
    out["missing_to_zero"] = with_sql(clean_grid_ctes(),
                                      f"SELECT slice, row, col, {rnd('value', 'value')} FROM clean")
    out["downsample"] = with_sql(clean_grid_ctes() + tiles_ctes("clean", ["slice"]),
                                 f"SELECT slice, node, row, col, {rnd('value', 'value')} FROM tiles")
    at = activity_tiles_ctes()
    apts = ("apts", "SELECT snapshot, node, [CAST(value AS DOUBLE)] AS x FROM atiles")
    ag = rbf_ctes("apts", K, SIG, "agraph")
    out["rbf_graph_grid"] = with_sql(at + [apts] + ag,
                                     f"SELECT snapshot, src, dst, {rnd('w', 'w')} FROM agraph")
    out["detect_activity"] = with_sql(
        activity_tiles_ctes(Q.WEEKS) + [apts] + ag + detect_ctes("agraph", Q.WEEKS[0], Q.WEEKS[1], [], "sketch", "det"),
        flag_select("det"))
    emb = ("pts", "SELECT CAST(vec_id AS BIGINT) AS node, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")
    out["rbf_graph_vec"] = with_sql([emb] + rbf_ctes("pts", [], SIG, "g"),
                                    f"SELECT src, dst, {rnd('w', 'w')} FROM g")
    out["rbf_graph_pruned"] = with_sql([emb] + rbf_ctes("pts", [], SIG, "g", math.exp(-2.0)),
                                       f"SELECT src, dst, {rnd('w', 'w')} FROM g")
    top = [emb,
           ("nrm", """SELECT node, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS norm,
  row_number() OVER (ORDER BY sqrt(list_sum(list_transform(x, lambda v: v * v))) DESC, node) - 1 AS pos
FROM pts"""),
           ("top", f"""SELECT node, norm, pos FROM nrm
WHERE pos < (SELECT floor(count(*) * {Q.perturb.ANOMALY_FRACTION} + 1e-9) FROM pts)""")]
    out["top_fraction"] = with_sql(top, f"SELECT node, {rnd('norm', 'norm')}, CAST(pos AS BIGINT) AS pos FROM top")
    sd = repr(math.sqrt(Q.perturb.NOISE_VAR))

    def normal(tag):
        def u(s):
            return (f"(CAST(('0x' || substr(md5(concat_ws('|', 0, p.node, '{tag}', '{s}')), 1, 13)) AS BIGINT)"
                    f" / {float(16 ** 13)!r})")
        return f"(sqrt(-2.0 * ln(1.0 - {u('a')})) * cos({2 * math.pi!r} * {u('b')}))"
    pert = top + [("sh", f"""SELECT p.node, p.x, t.node IS NOT NULL AS anomalous,
  {sd} * {normal('noise')} + CASE WHEN t.node IS NOT NULL
      THEN {Q.perturb.ANOMALY_MEAN!r} + {sd} * {normal('anomaly')} ELSE 0.0 END AS shift
FROM pts p LEFT JOIN top t ON p.node = t.node""")]
    out["perturb"] = with_sql(pert, f"""SELECT node, {rnd('shift', 'shift')}, anomalous,
  {rnd('sqrt(list_sum(list_transform(x, lambda v: (v + shift) * (v + shift))))', 'norm')} FROM sh""")
    pp = pert + [("pboth", """SELECT 1 AS snapshot, node, x FROM pts
UNION ALL SELECT 2 AS snapshot, node, list_transform(x, lambda v: v + shift) AS x FROM sh""")]
    pp += rbf_ctes("pboth", K, SIG, "pg") + detect_ctes("pg", 1, 2, [], "sketch", "pdet")
    out["detect_perturbed"] = with_sql(pp, """SELECT CAST(coalesce(t.node, f.node) AS BIGINT) AS node,
  t.node IS NOT NULL AS planted, f.node IS NOT NULL AS found
FROM top t FULL OUTER JOIN pdet_nodes f ON t.node = f.node""")
    # evaluation: the detection under two seeds
    tp = [c for seed, name in enumerate(("tru", "pre"))
          for c in detect_ctes("edges", S1, S2, [], "sketch", name, threshold=Q.EVAL_THRESHOLD, seed=seed)]
    diff = ("diff", """SELECT coalesce(t.i, p.i) AS i, coalesce(t.j, p.j) AS j,
  coalesce(t.delta_e, 0.0) - coalesce(p.delta_e, 0.0) AS diff
FROM tru t FULL OUTER JOIN pre p ON t.i = p.i AND t.j = p.j""")
    out["edge_diff"] = _pair(f"SELECT i, j, {rnd('diff', 'diff')} FROM diff", tp + [diff])
    out["squared_loss"] = _pair(f"SELECT {rnd('sum(diff * diff)', 'loss')} FROM diff", tp + [diff])
    out["same_nodes"] = _pair("""SELECT count(t.node) AS n_truth, count(p.node) AS n_pred,
  CAST(sum(CASE WHEN t.node IS NULL OR p.node IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch,
  sum(CASE WHEN t.node IS NULL OR p.node IS NULL THEN 1 ELSE 0 END) = 0 AS same
FROM tru_nodes t FULL OUTER JOIN pre_nodes p ON t.node = p.node""", tp)
    ranks = [("rk_p", """SELECT node, row_number() OVER (ORDER BY score DESC, node) - 1 AS pos FROM
  (SELECT node, max(delta_e) AS score FROM (SELECT i AS node, delta_e FROM pre UNION ALL
   SELECT j AS node, delta_e FROM pre) GROUP BY node)"""),
             ("rk_t", """SELECT node, row_number() OVER (ORDER BY score DESC, node) - 1 AS pos FROM
  (SELECT node, max(delta_e) AS score FROM (SELECT i AS node, delta_e FROM tru UNION ALL
   SELECT j AS node, delta_e FROM tru) GROUP BY node)"""),
             ("nn", "SELECT CAST(count(DISTINCT src) AS DOUBLE) AS n FROM edges")]
    out["rank_agreement"] = _pair(
        f"""SELECT {rnd('1.0 - 6.0 * sum(pow(p.pos - coalesce(t.pos, nn.n), 2)) / (max(nn.n) * (max(nn.n) * max(nn.n) - 1.0))', 'rho')}
FROM rk_p p LEFT JOIN rk_t t ON p.node = t.node, nn""", tp + ranks)
    # sigma sweep over nation trade profiles
    sig_list = sorted(set(float(s) for s in Q.SWEEP) | {Q.SIGMA})
    sig_vals = ", ".join(f"({s!r})" for s in sig_list)
    sw = nation_points_ctes() + [
        ("sigmas", f"SELECT * FROM (VALUES {sig_vals}) t(sigma)"),
        ("spts", "SELECT s.sigma, p.snapshot, p.node, p.x FROM points p, sigmas s"),
    ] + rbf_ctes("spts", ["sigma", "snapshot"], "a.sigma", "sg") \
      + detect_ctes("sg", S1, S2, ["sigma"], "sketch", "sw", threshold=Q.SWEEP_THRESHOLD) + [
        ("tr", f"SELECT * FROM sw WHERE sigma = {Q.SIGMA!r}"),
        ("trn", f"SELECT * FROM sw_nodes WHERE sigma = {Q.SIGMA!r}"),
        ("loss", """SELECT s.sigma, sum(diff * diff) AS loss FROM sigmas s JOIN (
  SELECT coalesce(t.sigma, p.sigma) AS sigma,
         coalesce(t.delta_e, 0.0) - coalesce(p.delta_e, 0.0) AS diff
  FROM (SELECT s.sigma, tr.i, tr.j, tr.delta_e FROM tr, sigmas s) t
  FULL OUTER JOIN sw p ON t.sigma = p.sigma AND t.i = p.i AND t.j = p.j) d
ON s.sigma = d.sigma GROUP BY s.sigma"""),
        ("mm", """SELECT coalesce(t.sigma, p.sigma) AS sigma, count(p.node) AS n_pred,
  sum(CASE WHEN t.node IS NULL OR p.node IS NULL THEN 1 ELSE 0 END) AS n_mismatch
FROM (SELECT s.sigma, trn.node FROM trn, sigmas s) t
FULL OUTER JOIN sw_nodes p ON t.sigma = p.sigma AND t.node = p.node GROUP BY 1"""),
        ("summary", """SELECT s.sigma, coalesce(l.loss, 0.0) AS loss,
  coalesce(m.n_mismatch, 0) = 0 AS same, CAST(coalesce(m.n_pred, 0) AS BIGINT) AS n_nodes
FROM sigmas s LEFT JOIN loss l ON s.sigma = l.sigma LEFT JOIN mm m ON s.sigma = m.sigma"""),
        ("rates", f"""SELECT * FROM (VALUES {', '.join(f'({i}, CAST({lr!r} AS DOUBLE))' for i, lr in
                                                  enumerate(Q.LEARNING_RATES))}) t(run_id, learning_rate)"""),
        ("trace", f"""SELECT run_id, iter, sigma, loss, learning_rate FROM rates,
  (SELECT CAST(row_number() OVER (ORDER BY sigma) - 1 AS INTEGER) AS iter, sigma, loss
   FROM summary WHERE sigma <> {Q.SIGMA!r})"""),
    ]
    out["sigma_sweep"] = with_sql(
        sw, f"SELECT {rnd('sigma', 'sigma')}, {rnd('loss', 'loss')}, same, n_nodes FROM summary")
    out["evaluate_sigma"] = with_sql(sw, f"""SELECT {rnd('sigma', 'sigma')}, {rnd('loss', 'loss')}, same, n_nodes,
  {rnd('CASE WHEN same THEN 0.0 ELSE loss END', 'score')} FROM summary WHERE sigma = {Q.SWEEP[2]!r}""")
    out["stored_trace"] = with_sql(
        sw, f"SELECT run_id, iter, {rnd('sigma', 'sigma')}, {rnd('loss', 'loss')}, "
            f"{rnd('learning_rate', 'learning_rate')} FROM trace")
    out["secant_step"] = with_sql(sw, f"""SELECT run_id, iter, {rnd('sigma', 'sigma')}, {rnd('loss', 'loss')},
  {rnd('CASE WHEN ps IS NULL THEN sigma + 0.4 ELSE sigma - learning_rate * (loss - pl) / (sigma - ps) END', 'next_sigma')}
FROM (SELECT *, lag(sigma) OVER (PARTITION BY run_id ORDER BY iter) AS ps,
             lag(loss) OVER (PARTITION BY run_id ORDER BY iter) AS pl FROM trace)""")
    out["trace_summary"] = with_sql(sw, f"""SELECT {rnd('learning_rate', 'learning_rate')}, count(*) AS n_iter,
  {rnd('first(sigma ORDER BY iter)', 'first_sigma')}, {rnd('first(sigma ORDER BY iter DESC)', 'last_sigma')},
  {rnd('first(loss ORDER BY iter)', 'first_loss')}, {rnd('first(loss ORDER BY iter DESC)', 'last_loss')},
  {rnd('min(loss)', 'min_loss')}, CAST(first(iter ORDER BY loss, iter) AS INTEGER) AS argmin_iter
FROM trace GROUP BY learning_rate""")
    out["calibrate_sigma"] = calibrate_sql()
    return out


def calibrate_sql() -> str:
    """The secant search as a recursive query: a row of the working table is a run with
    the sigma it judges next; a round judges the open runs, all in one."""
    S1, S2, snapshot = Q.S1, Q.S2, "snapshot"
    runs = ", ".join(f"({i}, {lr!r}, {s!r})" for i, (lr, s) in enumerate(
        itertools.product(Q.LEARNING_RATES, Q.STARTS)))
    truth = [("tpoints", "SELECT snapshot, node, x FROM points")]
    truth += rbf_ctes("tpoints", [snapshot], SIG, "tedges")
    truth += detect_ctes("tedges", S1, S2, [], "sketch", "td", threshold=Q.SWEEP_THRESHOLD)
    rnds = [("cur", f"""SELECT run_id, lr, iter + 1 AS iter, next_sigma AS sigma, sigma AS prev_sigma, loss AS prev_loss
FROM cal WHERE iter + 1 < {Q.ITERATIONS} AND next_sigma IS NOT NULL AND next_sigma <> 0
  AND (iter < 0 OR ((iter = 0 OR NOT same) AND next_sigma <> sigma))"""),
            ("rpoints", "SELECT c.run_id, p.snapshot, p.node, p.x, c.sigma FROM points p, cur c")]
    rnds += rbf_ctes("rpoints", ["run_id", snapshot], "a.sigma", "redges")
    rnds += detect_ctes("redges", S1, S2, ["run_id"], "sketch", "rd", threshold=Q.SWEEP_THRESHOLD)
    rnds += [
        ("lossp", """SELECT run_id, i, j, sum(t) AS diff FROM (
  SELECT c.run_id, t.i, t.j, t.delta_e AS t FROM td t, cur c
  UNION ALL SELECT run_id, i, j, -delta_e AS t FROM rd) GROUP BY ALL"""),
        ("lossr", "SELECT run_id, sum(diff * diff) AS loss FROM lossp GROUP BY run_id"),
        ("nodesr", """SELECT run_id, node, sum(s) AS s FROM (
  SELECT c.run_id, t.node, 1 AS s FROM td_nodes t, cur c
  UNION ALL SELECT run_id, node, -1 AS s FROM rd_nodes) GROUP BY ALL"""),
        ("mism", "SELECT run_id, count(*) AS n FROM nodesr WHERE s <> 0 GROUP BY run_id"),
        ("judged", """SELECT c.*, coalesce(l.loss, 0.0) AS loss, coalesce(m.n, 0) = 0 AS same
FROM cur c LEFT JOIN lossr l ON l.run_id = c.run_id LEFT JOIN mism m ON m.run_id = c.run_id"""),
    ]
    step = with_sql(rnds, """SELECT run_id, lr, iter, sigma, loss, same,
  CASE WHEN iter = 0 THEN sigma + 0.4 WHEN sigma = prev_sigma THEN NULL
       ELSE sigma - lr * ((loss - prev_loss) / (sigma - prev_sigma)) END AS next_sigma FROM judged""")
    cal = ("cal", f"""SELECT CAST(run_id AS INTEGER) AS run_id, CAST(lr AS DOUBLE) AS lr, -1 AS iter,
  CAST(NULL AS DOUBLE) AS sigma, CAST(NULL AS DOUBLE) AS loss, FALSE AS same, CAST(s AS DOUBLE) AS next_sigma
FROM (VALUES {runs}) AS v(run_id, lr, s)
UNION ALL SELECT * FROM ({step})""")
    body = with_sql(nation_points_ctes() + truth + [cal], f"""SELECT run_id, CAST(iter AS INTEGER) AS iter, {rnd('sigma', 'sigma')},
  {rnd('loss', 'loss')}, same, {rnd('lr', 'learning_rate')} FROM cal WHERE iter >= 0""")
    return body.replace("WITH ", "WITH RECURSIVE ", 1)
