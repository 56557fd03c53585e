"""Detection on dense graphs, held as tiles (A4, G1, G3, G4 of a graph with an edge for
most of its pairs, as Gaussian graphs of wide kernels are).

Walked as a table of edges, such a graph costs edges x chunks joined rows a step.  Here
its nodes are numbered in order of id and cut into blocks of ``TILE_NODES``; a row is a
tile ``(p, q)``, p >= q, with the weights of both snapshots as arrays of doubles, so the
work of a step is a matrix product for every tile and all that moves is the vector, a
row for each block.  Signs, terms, distances and scores are those of ``walk`` and
``distance``; only the order in which doubles are added differs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import floor_div, series_length, sketch_width
from ..session import ensure_checkpoint_dir, release
from .ordered import dense_index

TILE_NODES = 512                     # nodes of a block: a tile has two arrays of 2 MB
GROUP = 3                            # a task holds the tiles of so many blocks by so many, at most
RELEASE_EVERY = 3                    # steps after which shuffle files of finished ones may go
DENSE = 0.1                          # share of all pairs from which a graph is held as tiles
MAX_NODES = 100_000                  # nodes up to which their numbers are broadcast
VECTOR_LIMIT = 256 * 1024 * 1024     # bytes of a vector, which every task sums up and which is broadcast
STRIP_CELLS = 1 << 14                # cells of a tile that are worked on at a time
SEED_DIGITS = 10                     # a text of a longer seed may not fit one block of md5


# ---------------------------------------------------------------- arrays of a tile

def _rows(batches):
    for b in batches:
        cols = {name: b.column(n) for n, name in enumerate(b.schema.names)}
        for r in range(b.num_rows):
            yield {c: a[r] for c, a in cols.items()}


def _array(cell, *shape):
    import numpy as np
    return np.frombuffer(cell.as_buffer()).reshape(shape)


def _block_rows(totals: dict):
    import pyarrow as pa
    for blk, x in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([blk], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["blk", "data"])


def _sum_blocks(rows: DataFrame) -> DataFrame:
    """Arrays ``(blk, data)`` added up for every block."""
    def add(table):
        import numpy as np
        import pyarrow as pa
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("data"))
        return pa.table({"blk": table.column("blk").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})
    return rows.groupBy("blk").applyInArrow(add, "blk int, data binary")


def _with_ends(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every tile with the columns of its two blocks, by broadcast: tiles never move."""
    for end in ("p", "q"):
        named = [F.col(c).alias(end if c == "blk" else f"{c}_{end}") for c in blocks.columns]
        tiles = tiles.join(F.broadcast(blocks.select(*named)), end)
    return tiles


# ---------------------------------------------------------------- building

def _fill(size: int, n_blocks: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        tiles, counts, cells = {}, {}, size * size
        for b in batches:
            tile, cell, w = (b.column(n) for n in range(3))
            if tile.null_count:
                raise ValueError("the table of nodes lacks an end of an edge")
            tile, cell, w = tile.to_numpy(), cell.to_numpy(), w.to_numpy(zero_copy_only=False)
            order = np.argsort(tile, kind="stable")
            cut = np.flatnonzero(np.diff(tile[order])) + 1
            for part in np.split(order, cut):
                if len(part):
                    t = int(tile[part[0]])
                    both = tiles.setdefault(t, np.zeros(2 * cells))
                    both[cell[part]] = w[part]
                    counts[t] = counts.get(t, 0) + len(part)
        for t, both in tiles.items():
            n = int(np.count_nonzero(both))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t // n_blocks], pa.int32()), pa.array([t % n_blocks], pa.int32()),
                 pa.array([counts[t]], pa.int64()), pa.array([counts[t] - n], pa.int64()),
                 pa.array([both.tobytes()], pa.binary())], names=["p", "q", "n", "repeated", "w"])
    return run


def _tiles(edges: DataFrame, numbered: DataFrame, n_blocks: int, s1, s2, snapshot: str,
           size: int) -> DataFrame:
    """``(p, q, n, repeated, w)``: the weights of both snapshots, how many edges there are
    and how many of them are not cells of their own (one pair twice, a weight of 0)."""
    at = [F.broadcast(numbered.withColumnsRenamed({"node": end, "k": f"k_{end}"})) for end in ("src", "dst")]
    half = edges.filter(F.col(snapshot).isin(s1, s2) & (F.col("src") > F.col("dst"))).select(
        (F.col(snapshot) == F.lit(s2)).cast("int").alias("second"), "src", "dst", "w")
    half = half.join(at[0], "src", "left").join(at[1], "dst", "left")
    p, q = floor_div("k_src", size), floor_div("k_dst", size)
    cell = (F.col("second") * F.lit(size * size) + (F.col("k_src") - p * size) * size
            + F.col("k_dst") - q * size)
    cells = half.select((p * F.lit(n_blocks) + q).cast("int").alias("tile"), cell.cast("int").alias("cell"),
                        F.col("w").cast("double").alias("w"))
    # Neighbouring tiles share their blocks, so a task that has all of a square of tiles sums
    # up few blocks; the squares are dealt out one by one, as are tiles where there are few.
    side = max(1, min(GROUP, n_blocks // 8))
    squares = -(-n_blocks // side)
    # a null tile, of an end without a number, goes anywhere and is refused there
    tile = F.coalesce("tile", F.lit(0))
    row, col = floor_div(floor_div(tile, n_blocks), side), floor_div(F.pmod(tile, F.lit(n_blocks)), side)
    square = floor_div(row * (row + 1), 2) + col
    return cells.repartitionById(squares * (squares + 1) // 2, square.cast("int")).mapInArrow(
        _fill(size, n_blocks), "p int, q int, n bigint, repeated bigint, w binary")


def _degrees(size: int):
    """Of every block and snapshot: the degrees, then the numbers of edges."""
    def run(batches):
        import numpy as np
        totals = {}
        for r in _rows(batches):
            w = _array(r["w"], 2, size, size)
            for blk, axis in ((r["p"].as_py(), 2), (r["q"].as_py(), 1)):
                t = totals.setdefault(blk, np.zeros((2, 2, size)))
                t[0] += w.sum(axis=axis)
                t[1] += np.count_nonzero(w, axis=axis)
        yield from _block_rows(totals)
    return run


def _inverse(size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            got = [_array(x, 2, 2, size) for x in b.column(1)]
            inv = [np.divide(1.0, deg, out=np.zeros_like(deg), where=deg != 0) for deg, _ in got]
            live = np.array([np.count_nonzero(n, axis=1) for _, n in got]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x.tobytes() for x in inv], pa.binary()),
                 pa.array(live[:, 0]), pa.array(live[:, 1])], names=["blk", "inv", "live1", "live2"])
    return run


# ---------------------------------------------------------------- signs

_SHIFTS = [s for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in r * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: list, shape) -> list:
    """The four 32-bit words of md5 of one block for a whole array of messages at once;
    a word of the messages is a number or an array that fits ``shape``."""
    import numpy as np
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for n in range(64):
        if n < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = n
        elif n < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * n + 1) % 16
        elif n < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * n + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * n % 16
        f += a
        if isinstance(words[at], int):
            f += np.uint32((words[at] + _SINES[n]) & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(_SINES[n])
        np.left_shift(f, np.uint32(_SHIFTS[n]), out=t)
        f >>= np.uint32(32 - _SHIFTS[n])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


def _put(words: dict, at: int, chars) -> None:
    """The bytes ``chars (n, length)`` of n texts at place ``at`` of their words."""
    import numpy as np
    for x in range(chars.shape[1]):
        bits = chars[:, x].astype(np.uint32) << np.uint32(8 * ((at + x) % 4))
        words[(at + x) // 4] = words.get((at + x) // 4, 0) | bits


def _by_length(ids):
    """``(places, bytes with a bar behind)`` of the ids with equally many characters."""
    import numpy as np
    texts = [f"{i}|".encode() for i in ids.tolist()]
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        yield where, np.frombuffer(b"".join(texts[i] for i in where), np.uint8).reshape(len(where), n)


def _project(ids_i, ids_j, w, k: int, seed: int):
    """What the half edges ``w (snapshots, i, j)`` add at i and take away at j in the k
    columns of ``walk.incidence_sketch``, without its factor 1 / sqrt(k)."""
    import numpy as np
    bi, bj = np.zeros((len(w), len(ids_i), k)), np.zeros((len(w), len(ids_j), k))
    head = f"{seed}|".encode()
    for rows, chars_i in _by_length(ids_i):
        for cols, chars_j in _by_length(ids_j):
            wi, wj = {}, {}
            _put(wi, 0, np.broadcast_to(np.frombuffer(head, np.uint8), (len(rows), len(head))))
            _put(wi, len(head), chars_i)
            _put(wj, len(head) + chars_i.shape[1], chars_j)
            start = len(head) + chars_i.shape[1] + chars_j.shape[1]
            step = max(1, STRIP_CELLS // len(cols))
            for lo in range(0, len(rows), step):
                at = rows[lo:lo + step]
                x = np.ascontiguousarray(w[:, at][:, :, cols])
                if not x.any():
                    continue
                shape = x.shape[1:]
                total_i, total_j = x.sum(axis=2), x.sum(axis=1)
                add_i, add_j = np.empty((len(w), shape[0], k)), np.empty((len(w), shape[1], k))
                one_i, one_j = np.ones(shape[0]), np.ones(shape[1])
                part = np.empty_like(x)
                for digest in range(-(-k // 32)):
                    tail = f"{digest}".encode()
                    last = {}
                    _put(last, start, np.frombuffer(tail + b"\x80", np.uint8)[None, :])
                    words = [int(last[n][0]) if n in last else 0 for n in range(16)]
                    words[14] |= 8 * (start + len(tail))
                    for n in set(wi) | set(wj):
                        both = np.uint32(words[n])
                        if n in wi:
                            both = both | wi[n][lo:lo + step, None]
                        if n in wj:
                            both = both | wj[n][None, :]
                        words[n] = both
                    state = _md5(words, shape)
                    for slot in range(32 * digest, min(k, 32 * digest + 32)):
                        # hex digit u of a word: its bytes are the low ones first, each of two digits;
                        # a digit of 8 and more is a minus
                        u = slot % 8
                        bit = np.uint32(8 * (u // 2) + (7 if u % 2 == 0 else 3))
                        minus = ((state[slot % 32 // 8] >> bit) & np.uint32(1)).astype(float)
                        np.multiply(x, minus, out=part)
                        add_i[:, :, slot] = total_i - 2 * (part @ one_j)
                        add_j[:, :, slot] = total_j - 2 * (one_i @ part)
                bi[:, at] += add_i
                bj[:, cols] += add_j
    return bi, bj


def _sketch(size: int, k: int, seed: int, power: float):
    def run(batches):
        import numpy as np
        totals, scale = {}, 1.0 / math.sqrt(k)
        for r in _rows(batches):
            ids = [r[c].values.to_numpy() for c in ("ids_p", "ids_q")]
            w = _array(r["w"], 2, size, size)[:, :len(ids[0]), :len(ids[1])]
            if power != 1.0:
                w = np.power(w, power, out=np.zeros_like(w), where=w != 0)
            bi, bj = _project(*ids, w, k, seed)
            for blk, x in ((r["p"].as_py(), bi * scale), (r["q"].as_py(), bj * -scale)):
                totals.setdefault(blk, np.zeros((2, size, k)))[:, :x.shape[1]] += x
        yield from _block_rows(totals)
    return run


# ---------------------------------------------------------------- walk and scores

def _scaled(size: int, k: int):
    """``(blk, inv, data)`` -> data times inv."""
    def run(batches):
        import numpy as np
        for r in _rows(batches):
            c = _array(r["data"], 2, size, k) * _array(r["inv"], 2, size)[:, :, None]
            yield from _block_rows({r["blk"].as_py(): np.ascontiguousarray(c)})
    return run


def _step(size: int, k: int):
    """Each tile's share of P y."""
    def run(batches):
        import numpy as np
        totals = {}
        for r in _rows(batches):
            w = _array(r["w"], 2, size, size)
            for here, there, a in (("p", "q", w), ("q", "p", w.transpose(0, 2, 1))):
                moved = a @ _array(r[f"data_{there}"], 2, size, k)
                moved *= _array(r[f"inv_{here}"], 2, size)[:, :, None]
                blk = r[here].as_py()
                if blk in totals:
                    totals[blk] += moved
                else:
                    totals[blk] = moved
        yield from _block_rows(totals)
    return run


def _scores(size: int, k: int):
    """Changed pairs ``(i, j, abs_da, d1, d2)``; a distance is 0 where the pair is no edge."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        step = max(1, STRIP_CELLS // size)
        for r in _rows(batches):
            w = _array(r["w"], 2, size, size)
            ids = [r[c].values.to_numpy() for c in ("ids_p", "ids_q")]
            # a row for each slot
            zi, zj = (np.ascontiguousarray(_array(r[c], 2, size, k).transpose(0, 2, 1)) for c in ("data_p", "data_q"))
            for lo in range(0, len(ids[0]), step):
                strip = w[:, lo:lo + step]
                change = np.abs(strip[0] - strip[1])
                a, b = np.nonzero(change)
                if not len(a):
                    continue
                d = []
                for s in (0, 1):
                    total = np.zeros(change.shape)
                    diff = np.empty(change.shape)
                    for u in range(k):
                        np.subtract(zi[s, u, lo:lo + step, None], zj[s, u], out=diff)
                        diff *= diff
                        total += diff
                    d.append(np.where(strip[s] != 0, total, 0.0)[a, b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[0][lo + a], ids[1][b], change[a, b], *d)],
                    names=["i", "j", "abs_da", "d1", "d2"])
    return run


def scored_pairs(edges: DataFrame, nodes: DataFrame, s1, s2, eps: float, tol: float, d: int,
                 weight_power: float = 1.0, seed: int = 0, n_nodes: int | None = None,
                 snapshot: str = "snapshot", size: int = TILE_NODES) -> DataFrame | None:
    """The changed pairs ``(i, j, abs_da, d1, d2, delta_e)`` of two dense snapshots, or None
    where the edges are not for tiles: under ``DENSE`` of all pairs, a pair twice, no edge,
    too many nodes, no terms.  ``nodes (node)`` holds every end of an edge; more do no harm.

    ``edges`` are read once.  Only the numbers of nodes and edges reach the driver; the
    vector, which is broadcast, is bounded by ``VECTOR_LIMIT``."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    numbered = dense_index(nodes.select(F.col("node").cast("bigint").alias("node")).dropna().distinct(),
                           ["node"], [], "k").checkpoint(eager=True)
    n = numbered.count()
    n_blocks = math.ceil(n / size)
    K = series_length(tol, d)
    most = 2 * n * sketch_width(n_nodes or n, eps) * 8
    if n < 2 or n > MAX_NODES or most > VECTOR_LIMIT or K <= 0 or len(str(int(seed))) > SEED_DIGITS:
        return None
    tiles = _tiles(edges, numbered, n_blocks, s1, s2, snapshot, size).checkpoint(eager=True)
    release(spark)
    m, repeated = tiles.agg(F.sum("n"), F.sum("repeated")).first()
    if not m or repeated or m < DENSE * n * (n - 1):
        return None

    ids = numbered.groupBy(floor_div("k", size).cast("int").alias("blk")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("ids"))
    tiles = tiles.select("p", "q", "w")
    degrees = _sum_blocks(tiles.mapInArrow(_degrees(size), "blk int, data binary"))
    blocks = (degrees.mapInArrow(_inverse(size), "blk int, inv binary, live1 bigint, live2 bigint")
              .join(ids, "blk").checkpoint(eager=True))
    if n_nodes is None:
        n_nodes = max(blocks.agg(F.sum("live1"), F.sum("live2")).first())
    k = sketch_width(int(n_nodes), eps)
    blocks = blocks.select("blk", "ids", "inv")
    vector = "blk int, data binary"
    b = _sum_blocks(_with_ends(tiles, blocks.select("blk", "ids"))
                    .mapInArrow(_sketch(size, k, int(seed), weight_power), vector))
    c = b.join(blocks, "blk").select("blk", "inv", "data").mapInArrow(_scaled(size, k), vector)
    c = c.checkpoint(eager=True)
    y = c
    for step in range(1, K):
        moved = _with_ends(tiles, y.join(blocks.select("blk", "inv"), "blk")).mapInArrow(_step(size, k), vector)
        y = _sum_blocks(moved.unionByName(c)).checkpoint(eager=True)
        if step % RELEASE_EVERY == 0 or step == K - 1:
            release(spark)
    pairs = _with_ends(tiles, y.join(blocks.select("blk", "ids"), "blk")).mapInArrow(
        _scores(size, k), "i bigint, j bigint, abs_da double, d1 double, d2 double")
    return pairs.withColumn("delta_e", F.col("abs_da") * F.abs(F.col("d1") - F.col("d2")))
