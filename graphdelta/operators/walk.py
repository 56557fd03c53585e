"""Many right-hand sides through the truncated random-walk series at once.

The chain-preconditioned Richardson solve of the original collapses to

    y = sum_{j=0}^{K-1} P^j (b / deg),      P = D^-1 A,
    K = 2^(max(d,1)-1) * max(q-1, 0),       q = -ceil(ln tol)

(see ``series_length``).  K is part of the semantics -- the series is *not*
iterated to convergence.

Vector layout ("wide"): ``(keys..., chunk INT, node BIGINT, x0 .. x{W-1})``.
Slot ``t`` of a right-hand side lives in ``chunk = t // W``, column ``t % W``.
One walk step is then a single join + one partially aggregated ``groupBy`` for
*all* slots, instead of one job per slot; W stays below Spark's codegen field
limit, and more slots simply mean more chunk rows.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..session import ensure_checkpoint_dir
from .linalg import degree, row_normalize
from .ordered import dense_index

MAX_WIDTH = 8                       # columns per chunk row (measured: 8 < 16 < 64 s/step)
BROADCAST_LIMIT = 64 * 1024 * 1024  # bytes; a vector above this is shuffled, not broadcast
CHECKPOINT_EVERY = 4                # walk steps between lineage cuts
ROWS_PER_TASK = 2_000_000           # joined rows per task in a broadcast-path step


def xcols(width: int) -> list[str]:
    return [f"x{u}" for u in range(width)]


def each_x(template: str, width: int) -> list[F.Column]:
    """``template`` for every value column, as SQL text with ``{x}`` for the column and
    ``{u}`` for its number: one call to the JVM a column.  Built from ``Column``
    operations, the wide expressions of a walk on a small graph took longer to
    write down than to run."""
    return [F.expr(template.format(x=f"x{u}", u=u)).alias(f"x{u}") for u in range(width)]


def chunking(n_slots: int, max_width: int = MAX_WIDTH) -> tuple[int, int]:
    """(number of chunks, width) that spreads ``n_slots`` evenly over chunks."""
    if n_slots <= 0:
        return 0, 1
    nch = math.ceil(n_slots / max_width)
    return nch, math.ceil(n_slots / nch)


def vector_width(vec: DataFrame) -> int:
    return sum(1 for c in vec.columns if c.startswith("x") and c[1:].isdigit())


def _sum_by_node(rows: DataFrame, keys, width: int) -> DataFrame:
    return rows.groupBy(*keys, "chunk", "node").agg(*each_x("sum({x})", width))


def _endpoints(signed: DataFrame, ks: list[str], width: int) -> DataFrame:
    """+values at i, -values at j, in one pass over ``signed`` (an explode of two
    structs rather than a union, which would compute the signs twice)."""
    cols = xcols(width)
    plus = ", ".join(["i AS node"] + [f"{c} AS {c}" for c in cols])
    minus = ", ".join(["j AS node"] + [f"-{c} AS {c}" for c in cols])
    ends = F.expr(f"explode(array(struct({plus}), struct({minus})))")
    return (signed.select(*ks, "chunk", ends.alias("_e"))
                  .select(*ks, "chunk", "_e.node", *[f"_e.{c}" for c in cols]))


def incidence_sketch(half: DataFrame, k: int, keys=("snapshot",), seed: int = 0,
                     weight_power: float = 1.0, max_width: int = MAX_WIDTH,
                     sign_hash: str = "md5", independent: bool = False) -> DataFrame:
    """B^T W Q for a k-column random +-1/sqrt(k) matrix Q (G1 + B12).

    Half edge (i, j, w) adds ``+w^p s/sqrt(k)`` at i and the negation at j, with
    the sign of slot t in hex digit t % 32 of md5("seed|i|j|t div 32") (below 8: +1),
    a draw that DuckDB reproduces: one digest serves 32 slots, once per edge.
    ``sign_hash="xxhash64"`` draws s from Spark's xxhash64 instead: about 19x
    cheaper per draw, for production runs that need no SQL oracle.
    ``independent=True`` puts the graph keys into the hash, so each snapshot
    draws its own signs (the original's single RNG stream did); by default the
    snapshots share signs, which lowers the noise in d1 - d2.
    """
    ks = list(keys)
    nch, width = chunking(k, max_width)
    scale = 1.0 / math.sqrt(k)
    wv = F.pow(F.col("w"), F.lit(float(weight_power))) if weight_power != 1.0 else F.col("w")
    graph = [F.col(c).cast("string") for c in ks] if independent else []
    edge = F.concat_ws("|", F.lit(str(seed)), *graph, F.col("i").cast("string"),
                       F.col("j").cast("string"), F.lit(""))
    digits = F.concat(F.lit(""), *[F.md5(F.concat(edge, F.lit(str(b))))
                                   for b in range(-(-k // 32) if sign_hash == "md5" else 0)])
    e = (half.select(*ks, "i", "j", wv.alias("wv"), digits.alias("_digits"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(nch - 1))))
             # a chunk's digits are cut out once: a place in a text is found by counting to it
             .withColumn("_mine", F.expr(f"substring(_digits, chunk * {width} + 1, {width})")))
    slot = f"(chunk * {width} + {{u}})"
    if sign_hash == "md5":
        positive = "substring(_mine, {u} + 1, 1) < '8'"
    elif sign_hash == "xxhash64":
        names = "".join(f"`{c}`, " for c in ks) if independent else ""
        positive = f"xxhash64({int(seed)}, {names}i, j, {slot}) >= 0"
    else:
        raise ValueError(f"unknown sign_hash {sign_hash!r}")
    vals = each_x(f"CASE WHEN {slot} < {k} THEN wv * CASE WHEN {positive} THEN 1.0D ELSE -1.0D END"
                  f" * {scale!r}D ELSE 0.0D END", width)
    signed = e.select(*ks, "chunk", "i", "j", *vals)
    return _sum_by_node(_endpoints(signed, ks, width), ks, width)


def incidence_exact(half: DataFrame, keys=("snapshot",), weight_power: float = 1.0,
                    max_width: int = MAX_WIDTH, n_slots: int | None = None) -> DataFrame:
    """B^T W with one slot per half edge: the sketch's expectation (no randomness).

    Slots are numbered densely per graph by ``dense_index`` (two-level, no global
    window).  ``n_slots`` = the largest number of half edges of one graph.
    """
    ks = list(keys)
    wv = F.pow(F.col("w"), F.lit(float(weight_power))) if weight_power != 1.0 else F.col("w")
    idx = dense_index(half.select(*ks, "i", "j", wv.alias("wv")), ["j", "i"], ks, "slot")
    if n_slots is None:
        n_slots = idx.groupBy(*ks).count().agg(F.max("count")).first()[0] or 0
    nch, width = chunking(int(n_slots), max_width)
    if nch == 0:
        width = 1
    e = idx.select(*ks, "i", "j", "wv",
                   floor_div("slot", width).cast("int").alias("chunk"),
                   F.pmod(F.col("slot"), F.lit(width)).cast("int").alias("col"))
    signed = e.select(*ks, "chunk", "i", "j",
                      *each_x("CASE WHEN col = {u} THEN wv ELSE 0.0D END", width))
    return _sum_by_node(_endpoints(signed, ks, width), ks, width)


def _fits(rows: int, width: int, limit: int) -> bool:
    return rows * (width + 4) * 8 <= limit


def _salted_edges(P: DataFrame, ks: list[str], n_parts: int, min_bucket: int,
                  bucket_rows: int | None = None):
    """Shuffle-path layout of P: hash partitioned on (keys, dst, salt), persisted.

    A destination with more in-edges than one bucket's share (a hub) is split
    into ``S = ceil(count / bucket)`` salts by hash of the source; its vector
    rows are replicated S times at join time.  ``hot`` has at most
    ``#edges / bucket`` rows, so broadcasting it is bounded by construction.
    """
    if bucket_rows:
        bucket = int(bucket_rows)
    else:
        m = P.count()
        bucket = max(int(math.ceil(m / max(n_parts, 1))), int(min_bucket))
    hot = (P.groupBy(*ks, "dst").count().filter(F.col("count") > F.lit(bucket))
            .select(*ks, "dst", F.ceil(F.col("count") / F.lit(bucket)).cast("int").alias("S")))
    hot = hot.checkpoint(eager=True)
    salted = (P.join(F.broadcast(hot), ks + ["dst"], "left")
               .withColumn("salt", F.pmod(F.xxhash64("src"),
                                          F.coalesce(F.col("S"), F.lit(1))).cast("int"))
               .drop("S")
               .repartition(n_parts, *ks, "dst", "salt")
               .persist(StorageLevel.MEMORY_AND_DISK))
    return salted, hot


def _sizes(c: DataFrame, ks: list[str], width: int) -> tuple[int, int, int, int]:
    """Of a dense vector, in one job: its rows; its chunks, added over the graphs; the
    rows and the cells that a dense matrix over the same nodes has."""
    blocks = F.countDistinct(F.when(F.col("chunk") == 0, floor_div("node", width)))
    graphs = (c.groupBy(*ks).agg(F.count("*").alias("rows"), (F.max("chunk") + 1).alias("nch"),
                                 blocks.alias("blocks"))
              .withColumn("n", F.col("rows") / F.col("nch")))
    got = graphs.agg(F.sum("rows"), F.sum("nch"), F.sum(F.col("n") * F.col("blocks")),
                     F.sum(F.col("n") * F.col("n"))).first()
    return tuple(int(v or 0) for v in got)


def _doubling_pays(K: int, m: int, n_rows: int, power_rows: int, cells: int, width: int,
                   limit: int) -> bool:
    """Whether the powers of P cost less than the steps they spare: they take no more
    room than the vector, both fit the broadcast, and the products of all doublings
    (dense at worst) are no more than the edges of all steps."""
    applied = K.bit_length() + bin(K).count("1") - 2
    return (power_rows <= n_rows and _fits(n_rows + power_rows, width, limit)
            and 2 * applied * cells <= K * m)


def _doubled(P: DataFrame, c: DataFrame, K: int, ks: list[str], width: int,
             n_parts: int) -> DataFrame:
    """The series by doubling: ``S_2m = S_m + P^m S_m`` and ``P^2m = P^m P^m``, with
    ``S_m+1 = c + P S_m`` and ``P^m+1 = P P^m`` where the binary form of K has a one.

    The power travels beside the sums as further columns of the same wide table
    (``power`` rows: chunk and column are those of the destination), so each of the
    some 2 log2 K applications is one join and one sum.
    """
    cols = xcols(width)
    power = (P.groupBy(*ks, floor_div("dst", width).alias("chunk"), F.col("src").alias("node"))
             .agg(*each_x(f"sum(CASE WHEN pmod(dst, {width}) = {{u}} THEN p ELSE 0.0D END)", width)))
    layout = [*ks, "power", "chunk", "node", *cols]
    base = (c.withColumn("chunk", F.col("chunk").cast("bigint")).withColumn("power", F.lit(False))
            .select(*layout).unionByName(power.withColumn("power", F.lit(True)).select(*layout)))
    base = base.checkpoint(eager=True)

    def cells(table: DataFrame) -> DataFrame:
        long = table.filter("power").select(
            *ks, F.col("node").alias("src"), "chunk", F.posexplode(F.array(*cols)).alias("u", "p"))
        out = long.filter(F.col("p") != 0).select(
            *ks, "src", (F.col("chunk") * F.lit(width) + F.col("u")).alias("dst"), "p")
        return out.repartition(n_parts, *ks, "src", "dst") if n_parts > 1 else out

    def apply(matrix: DataFrame, table: DataFrame, plus: DataFrame, last: bool) -> DataFrame:
        if last:
            table = table.filter(~F.col("power"))
        moved = cells(matrix).join(F.broadcast(table.withColumnRenamed("node", "dst")), ks + ["dst"])
        moved = moved.select(*ks, "power", "chunk", F.col("src").alias("node"),
                             *each_x("p * {x}", width))
        return (moved.unionByName(plus.filter(~F.col("power")))
                .groupBy(*ks, "power", "chunk", "node").agg(*each_x("sum({x})", width))
                .checkpoint(eager=True))

    state, bits = base, bin(K)[3:]
    for n, bit in enumerate(bits):
        end = n == len(bits) - 1
        state = apply(state, state, state, end and bit == "0")
        if bit == "1":
            state = apply(base, state, base, end)
    return state.filter(~F.col("power")).select(
        *ks, F.col("chunk").cast("int").alias("chunk"), "node", *cols)


def walk_series(edges: DataFrame, b: DataFrame, K: int, keys=("snapshot",),
                broadcast_limit: int = BROADCAST_LIMIT,
                checkpoint_every: int = CHECKPOINT_EVERY,
                min_bucket: int = 100_000, bucket_rows: int | None = None) -> DataFrame:
    """z = sum_{j<K} P^j (b/deg) for every slot of ``b``.

    Returns ``(keys..., chunk, node, x...)``, dense over the nodes of positive
    degree and the chunks present in ``b`` for that graph; K = 0 gives zeros.

    Plan per step: ``P JOIN y ON dst = node`` -> ``p * x`` per edge, UNION the
    constant term ``c``, ``groupBy(keys, chunk, node).sum``.

    * Vector under ``broadcast_limit`` (rows x width, counted, not guessed):
      it is broadcast, so the edge table is never shuffled and a hub's edges
      stay spread over all tasks; partial aggregation collapses them before the
      step's only shuffle.
    * Larger vector: P is laid out once, hash partitioned on (keys, dst, salt)
      with hub destinations salted (see ``_salted_edges``); each step shuffles
      only the vector (hub rows replicated per salt) and the partial sums.
    * A dense graph with no more nodes than slots (counted, see ``_doubling_pays``)
      is walked by doubling instead of step by step; the terms are the same.

    Lineage is cut with a reliable ``checkpoint()`` every ``checkpoint_every``
    steps (into ``spark.checkpoint.dir``), so a lost executor recomputes at most
    that many steps.
    """
    ks = list(keys)
    if not ks:
        raise ValueError("walk_series needs at least one graph key column")
    width = vector_width(b)
    cols = xcols(width)
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)

    deg = degree(edges, ks)
    nodes = deg.select(*ks, "node",
                       F.when(F.col("deg") != 0, F.lit(1.0) / F.col("deg"))
                        .otherwise(F.lit(0.0)).alias("inv"))
    # every node of positive degree with every chunk of its graph: the chunks are
    # numbered from 0, so their count per graph, one row each, says them all
    chunks = b.groupBy(*ks).agg((F.max("chunk") + 1).alias("_n"))
    dense = (nodes.join(chunks, ks)
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n"))
    c = (dense.join(b, ks + ["chunk", "node"], "left")
              .select(*ks, "chunk", "node",
                      *each_x("coalesce({x}, 0.0D) * inv", width)))
    c = c.checkpoint(eager=True)
    if K <= 0:
        return c.select(*ks, "chunk", "node", *each_x("0.0D", width))

    n_rows, n_chunks, power_rows, cells = _sizes(c, ks, width)
    bc = _fits(n_rows, width, broadcast_limit)
    P = row_normalize(edges, ks)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bc:
        # Spread P evenly over a partition count sized by the step's work
        # (|P| x chunks joined rows, far more than P's bytes suggest, so AQE's
        # size-based coalescing would leave it to a couple of tasks), capped by
        # the configured shuffle partitions.  Hashing (src, dst), not src, keeps
        # a hub's edges spread too.
        m = edges.count()
        work_parts = max(1, math.ceil(m * max(n_chunks, 1) / ROWS_PER_TASK))
        if _doubling_pays(K, m, n_rows, power_rows, cells, width, broadcast_limit):
            return _doubled(P, c, K, ks, width, min(n_parts, work_parts))
        P = (P.repartition(min(n_parts, work_parts), *ks, "src", "dst")
              .persist(StorageLevel.MEMORY_AND_DISK))
        hot = None
    else:
        P, hot = _salted_edges(P, ks, n_parts, min_bucket, bucket_rows)
    y = c
    for step in range(1, K):
        yv = y.withColumnRenamed("node", "dst")
        if bc:
            joined = P.join(F.broadcast(yv), ks + ["dst"])
        else:
            yv = (yv.join(F.broadcast(hot), ks + ["dst"], "left")
                    .withColumn("salt", F.explode(F.sequence(
                        F.lit(0), F.coalesce(F.col("S"), F.lit(1)) - 1)))
                    .drop("S"))
            joined = P.join(yv, ks + ["dst", "salt"])
        moved = joined.select(*ks, "chunk", F.col("src").alias("node"),
                              *each_x("p * {x}", width))
        y = _sum_by_node(moved.unionByName(c), ks, width)
        if step % checkpoint_every == 0 and step != K - 1:
            y = y.checkpoint(eager=True)
    y = y.checkpoint(eager=True)
    P.unpersist()
    return y
