"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned to integers, ``floor(scale * x)``, and packed into blocks in
vertical layout: a block holds one array for each dimension.  A block of queries meets
a block of candidates dimension block by dimension block, the heaviest dimensions
first.  After each, what the rest can still add is at most the product of the two
remaining lengths (Cauchy and Schwarz); a candidate whose partial score plus that stays
below the query's present k-th score is out, and the arrays are compacted: whole
candidates and queries while many pairs live, single pairs once few do.

The first bound of a query is its k-th score in a small sample of the candidates, which
only makes the search shorter: any sample gives the same result.  Within a task the
bounds rise from block to block.

Shuffles: distinct queries, packed candidates (once, so that the work is dealt evenly
however the input is), and at most ``k + 1`` rows for each query and task.  Queries are
broadcast in passes of some ``PASS_BYTES``, twice that at most, which is checked.

Defined results: a vector that is null or holds null or non-finite components takes no
part.  Shorter vectors count as filled up with zeros.  A row with a null id is a
candidate, behind all others of its score, and never a query.  Repeated rows are
candidates of their own, and each repeated query gives its own list.  Equal scores are
ordered by id.  A score beyond 64 bits is given as the last long of its side.  An empty
table gives no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdelta.llm.common import materialise, partitions_for

# Rows and components of a block, one row at least.
CAND_ROWS, CAND_CELLS = 4096, 1 << 22
QUERY_ROWS, QUERY_CELLS = 512, 1 << 19
DIMS = 16  # dimensions added at a time
SPARSE = 0.1  # share of living pairs below which they are kept one by one
SAMPLE_ROWS = 4096
PASS_BYTES = 16 << 20
PAIRS_PER_TASK = 500_000_000

PACKED = "block long, n int, d int, kind string, ids binary, nulls binary, copies binary, cells binary"
FOUND = "block long, slot int, query_id long, copies long, own long, vec_id long, score long"
_LAST = np.iinfo(np.int64)


def _kind(cells: np.ndarray) -> str:
    """The smallest type that holds whole numbers of this size."""
    top = float(np.abs(cells).max()) if cells.size else 0.0
    return next((t for t, most in (("int8", 127), ("int16", 32_767), ("int32", 2**31 - 1))
                 if top <= most), "float64")


def _matrix(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their scaled vectors as a matrix filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    use = np.asarray(column.is_valid())
    at = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.cast(pa.float64())
    x = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    use &= bad[at[1:]] == bad[at[:-1]]
    rows = np.flatnonzero(use)
    size = np.diff(at)
    if len(rows) == len(use) and len(use) and (size == size[0]).all():
        return rows, x[at[0]:at[-1]].reshape(len(rows), int(size[0]))
    size = np.where(use, size, 0)
    out = np.zeros((len(rows), int(size.max()) if len(rows) else 0))
    for k, r in enumerate(rows):
        out[k, :size[r]] = x[at[r]:at[r + 1]]
    return rows, out


def _packer(rows_per_block: int, most_cells: int, scale: float):
    """Packs rows ``(vec_id, vec, copies)`` into blocks in vertical layout; a block holds
    one row at least."""

    def block(number: int, ids: list, copies: list, cells: np.ndarray) -> pa.RecordBatch:
        kind = _kind(cells)
        null = np.array([i is None for i in ids], dtype=np.uint8)
        number = (TaskContext.get().partitionId() << 32) + number
        values = [number, len(ids), cells.shape[1], kind,
                  np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(),
                  null.tobytes(), np.array(copies, dtype=np.int64).tobytes(),
                  np.ascontiguousarray(cells.T).astype(kind).tobytes()]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                          names=["block", "n", "d", "kind", "ids", "nulls", "copies", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, parts, number = [], [], [], 0
        held, width = 0, 0

        def flush():
            cells = np.zeros((held, width))
            lo = 0
            for p in parts:
                cells[lo:lo + len(p), :p.shape[1]] = p
                lo += len(p)
            return block(number, ids, copies, cells)

        for b in batches:
            rows, m = _matrix(b.column("vec"), scale)
            b_ids, b_copies = b.column("vec_id").to_pylist(), b.column("copies").to_pylist()
            lo = 0
            while lo < len(rows):
                width = max(width, m.shape[1])
                room = max(1, min(rows_per_block, most_cells // max(width, 1))) - held
                if room <= 0:
                    yield flush()
                    ids, copies, parts, held, width, number = [], [], [], 0, 0, number + 1
                    continue
                take = rows[lo:lo + room]
                parts.append(m[lo:lo + room])
                ids += [b_ids[r] for r in take]
                copies += [b_copies[r] for r in take]
                held += len(take)
                lo += len(take)
        if held:
            yield flush()

    return run


def _cells(row: dict, prefix: str = "") -> np.ndarray:
    return np.frombuffer(row[prefix + "cells"], dtype=row[prefix + "kind"]).reshape(
        row[prefix + "d"], row[prefix + "n"])


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of numbers too large for doubles."""
    q, c = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object) for m in (q, c))
    return np.clip(q.T @ c, int(_LAST.min), int(_LAST.max)).astype(np.int64)


def _squares(q: np.ndarray) -> np.ndarray:
    """Each vector's score with itself."""
    squares = (q.astype(np.float64) ** 2).sum(axis=0)
    if squares.max(initial=0) < 2**53:
        return squares.astype(np.int64)
    return np.array([min(sum(int(x) ** 2 for x in v), int(_LAST.max)) for v in q.T.tolist()], dtype=np.int64)


def search_block(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``(query, candidate, score)`` of a query block with a candidate block, both
    ``(dimension, row)``, whose score reaches the query's bound; no such pair is missing."""
    d = max(len(q), len(c))
    q, c = (np.vstack([m, np.zeros((d - len(m), m.shape[1]), m.dtype)]) if len(m) < d else m for m in (q, c))
    most = d * (float(np.abs(q).max(initial=0)) or 1.0) * (float(np.abs(c).max(initial=0)) or 1.0)
    if most >= 2**53:
        score = _exact(q, c)
        qi, ci = np.nonzero(score >= bound[:, None])
        return qi, ci, score[qi, ci]
    real = np.float32 if most < 2**24 else np.float64  # whole numbers, added exactly
    heavy = np.argsort(-(q.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    q, c = q[heavy].astype(real), c[heavy].astype(real)
    floor = (bound.astype(np.float64) - 4).astype(real)  # the sums below are rounded
    steps = range(0, d, DIMS)

    def rests(m):  # what is left of the length after each step, rounded up
        left = np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
        return [(np.sqrt(left[lo + DIMS]) * (1 + 1e-6)).astype(real) if lo + DIMS < d
                else np.zeros(m.shape[1], dtype=real) for lo in steps]

    q_rest, c_rest = rests(q), rests(c)
    rows, cols = np.arange(q.shape[1]), np.arange(c.shape[1])
    part = np.zeros((len(rows), len(cols)), dtype=real)
    pairs = None
    for step, lo in enumerate(steps):
        hi = lo + DIMS
        if pairs is None:
            part += q[lo:hi, rows].T @ c[lo:hi, cols]
            live = part + q_rest[step][rows, None] * c_rest[step][cols] >= floor[rows, None]
            n_live = np.count_nonzero(live)
            if hi >= d or n_live < SPARSE * live.size:
                a, b = np.nonzero(live)
                pairs, score = (rows[a], cols[b]), part[a, b]
            else:
                r, k = live.any(axis=1), live.any(axis=0)
                if r.sum() * k.sum() < 0.7 * live.size:
                    part, rows, cols = part[np.ix_(r, k)], rows[r], cols[k]
        else:
            a, b = pairs
            score = score + (q[lo:hi, a] * c[lo:hi, b]).sum(axis=0, dtype=real)
            live = score + q_rest[step][a] * c_rest[step][b] >= floor[a]
            pairs, score = (a[live], b[live]), score[live]
    if pairs is None:  # vectors without components
        a, b = np.nonzero(np.broadcast_to(floor[:, None] <= 0, part.shape))
        pairs, score = (a, b), np.zeros(len(a))
    return *pairs, score.astype(np.int64)


class Best:
    """The best ``k`` candidates of each query of a block so far."""

    def __init__(self, n: int, k: int, bound: np.ndarray | None):
        self.k = k
        self.bound = np.full(n, _LAST.min) if bound is None else bound.copy()
        self.q = np.zeros(0, dtype=np.int64)
        self.score, self.ids = self.q.copy(), self.q.copy()
        self.null = np.zeros(0, dtype=np.uint8)

    def add(self, q, score, ids, null) -> None:
        q, score = np.r_[self.q, q], np.r_[self.score, score]
        ids, null = np.r_[self.ids, ids], np.r_[self.null, null]
        # ~score turns the order round without overflow
        order = np.lexsort((ids, null, ~score, q))
        q = q[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, dtype=bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = order[rank < self.k]
        self.q, self.score, self.ids, self.null = (
            np.r_[x] for x in (q[rank < self.k], score[keep], ids[keep], null[keep]))
        last = rank[rank < self.k] == self.k - 1
        self.bound[self.q[last]] = np.maximum(self.bound[self.q[last]], self.score[last])


def _searcher(k: int):
    """Searches rows of a candidate block beside a query block (prefix ``q_``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        about: dict[int, tuple] = {}
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                number, q, c = row["q_block"], _cells(row, "q_"), _cells(row)
                if number not in found:
                    found[number] = Best(row["q_n"], k, np.frombuffer(row["q_bound"], dtype=np.int64)
                                         if row["q_bound"] else None)
                    about[number] = (np.frombuffer(row["q_ids"], dtype=np.int64),
                                     np.frombuffer(row["q_copies"], dtype=np.int64), _squares(q))
                best = found[number]
                qi, ci, score = search_block(q, c, best.bound)
                best.add(qi, score, np.frombuffer(row["ids"], dtype=np.int64)[ci],
                         np.frombuffer(row["nulls"], dtype=np.uint8)[ci])
        for number, best in found.items():
            ids, copies, own = about[number]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(best.q), number)), pa.array(best.q.astype(np.int32)),
                 pa.array(ids[best.q]), pa.array(copies[best.q]), pa.array(own[best.q]),
                 pa.array(best.ids, mask=best.null.astype(bool)), pa.array(best.score)],
                names=["block", "slot", "query_id", "copies", "own", "vec_id", "score"])

    return run


def _bounder(k: int):
    """Gives each query block its bounds: k-th scores in the sample beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                best = Best(row["q_n"], k, None)
                qi, ci, score = search_block(_cells(row, "q_"), _cells(row), best.bound)
                best.add(qi, score, np.zeros(len(qi), dtype=np.int64), np.zeros(len(qi), dtype=np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]]), pa.array([best.bound.tobytes()], pa.binary())],
                    names=["block", "bound"])

    return run


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of the highest integer inner
    product with each row that ``is_query`` names, itself left out."""
    spark = table.sparkSession
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vec_col].alias("vec"),
                        F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec").isNotNull())
    one = F.lit(1).cast("long").alias("copies")
    candidates = rows.select("vec_id", "vec", one)
    # equal rows ask once; a query's own row is one candidate of its id and score
    queries = (rows.filter(F.col("asks") & F.col("vec_id").isNotNull())
                   .groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies")))
    n = candidates.count()
    n_queries, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("vec") + 24), F.lit(0))).first()
    packed = materialise(queries.coalesce(max(1, n_queries // QUERY_ROWS))
                                .mapInArrow(_packer(QUERY_ROWS, QUERY_CELLS, scale), PACKED))
    passes = 1 + 2 * size // PASS_BYTES
    while True:
        dealt = packed.withColumn("pass", F.pmod(F.xxhash64("block"), F.lit(passes)).cast("int"))
        largest = dealt.groupBy("pass").agg(F.sum(F.length("cells")).alias("b"), F.count("*").alias("c")).agg(
            F.max(F.when(F.col("c") > 1, F.col("b")))).first()[0] or 0
        if largest <= 2 * PASS_BYTES:
            break
        passes *= 2

    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = candidates.sample(share, seed=1).limit(2 * SAMPLE_ROWS).coalesce(1).mapInArrow(
        _packer(2 * SAMPLE_ROWS, CAND_CELLS, scale), PACKED).filter("block % 4294967296 = 0").withColumn("all", F.lit(0))
    names = ("block", "n", "d", "kind", "ids", "copies", "cells")
    asking = dealt.select("pass", *[F.col(c).alias(f"q_{c}") for c in names])
    bounds = materialise(
        asking.repartition(partitions_for(table, 0, 1)).withColumn("all", F.lit(0))
              .join(F.broadcast(sample.select("all", "n", "d", "kind", "cells")), "all")
              .mapInArrow(_bounder(k + 1), "block long, bound binary"))
    asking = materialise(asking.join(
        bounds.select(F.col("block").alias("q_block"), F.col("bound").alias("q_bound")), "q_block", "left"))

    blocks = materialise(candidates.mapInArrow(_packer(CAND_ROWS, CAND_CELLS, scale), PACKED))
    parts = partitions_for(table, n * n_queries // passes, PAIRS_PER_TASK)
    found = None
    for p in range(passes):
        hits = (blocks.select("n", "d", "kind", "ids", "nulls", "cells", F.lit(p).alias("pass"))
                      .repartition(parts)
                      .join(F.broadcast(asking.filter(F.col("pass") == p)), "pass")
                      .mapInArrow(_searcher(k + 1), FOUND))
        found = hits if found is None else found.unionByName(hits)

    query = Window.partitionBy("block", "slot")
    order = query.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    mine = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    ranked = (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
                   .withColumn("at", F.min(F.when(mine, F.col("rank"))).over(query))
                   .filter(F.col("at").isNull() | (F.col("rank") != F.col("at")))
                   .withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("at"), 1).otherwise(0))
                   .filter(F.col("rank") <= k))
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return (ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", repeat)
                  .drop("col"))
