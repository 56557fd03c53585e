"""Graph snapshots on storage.

Storage form is COO Parquet ``(snapshot, src, dst, w)``, partitioned by
snapshot (a snapshot read is partition-pruned).  Dense square tiles
``(bi, bj, values ARRAY<ARRAY<DOUBLE>>)`` -- the original's unit of storage --
are read and written too; a tile is bounded by the tile size, never by the
graph size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_div

TILE_SPLITS = 8  # tasks that may write the edges of one tile
EDGE_SCHEMA = "snapshot INT, src BIGINT, dst BIGINT, w DOUBLE"


def read_tiles(tiles: DataFrame, keys=("snapshot",)) -> DataFrame:
    """Dense tiles -> COO edges, zeros dropped.

    ``src = bi * p + r``, ``dst = bj * p + c`` with p the tile's row count.
    """
    ks = list(keys)
    rows = tiles.select(*ks, "bi", "bj", F.size("values").alias("p"),
                        F.posexplode("values").alias("r", "row"))
    cells = rows.select(*ks, "bi", "bj", "p", "r", F.posexplode("row").alias("c", "w"))
    return (cells.filter(F.col("w") != 0)
                 .select(*ks,
                         (F.col("bi").cast("bigint") * F.col("p") + F.col("r")).alias("src"),
                         (F.col("bj").cast("bigint") * F.col("p") + F.col("c")).alias("dst"),
                         F.col("w").cast("double").alias("w")))


def to_tiles(edges: DataFrame, block_size: int, keys=("snapshot",)) -> DataFrame:
    """COO -> dense ``block_size`` x ``block_size`` tiles.

    Only tiles holding a non-zero are emitted (an absent tile is all zero, which
    COO cannot tell apart anyway); rows missing inside a tile are zero-filled,
    and a node range that is not a multiple of the tile size simply ends in a
    zero-padded last tile.  Two bounded aggregations: a row of a tile, then the
    rows of a tile.
    """
    ks = list(keys)
    p = int(block_size)
    t = edges.select(*ks,
                     floor_div("src", p).alias("bi"),
                     floor_div("dst", p).alias("bj"),
                     F.pmod(F.col("src"), F.lit(p)).cast("int").alias("r"),
                     F.pmod(F.col("dst"), F.lit(p)).cast("int").alias("c"), "w")
    rows = (t.groupBy(*ks, "bi", "bj", "r")
             .agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("m"))
             .select(*ks, "bi", "bj", "r",
                     F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                                 lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0))).alias("row")))
    zero = F.array_repeat(F.lit(0.0), p)
    return (rows.groupBy(*ks, "bi", "bj")
                .agg(F.map_from_entries(F.collect_list(F.struct("r", "row"))).alias("m"))
                .select(*ks, "bi", "bj",
                        F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                                    lambda r: F.coalesce(F.element_at("m", r), zero)).alias("values")))


def write_snapshot(edges: DataFrame, path: str, block_size: int | None = None,
                   mode: str = "overwrite") -> None:
    """Write edges as COO Parquet partitioned by snapshot (A4).  With
    ``block_size`` the rows also carry their tile ids ``bi, bj``."""
    out = edges
    if block_size:
        p = int(block_size)
        out = out.withColumn("bi", floor_div("src", p)) \
                 .withColumn("bj", floor_div("dst", p))
    out.write.mode(mode).partitionBy("snapshot").parquet(path)


def read_snapshot(spark: SparkSession, path: str, snapshots=None) -> DataFrame:
    """COO snapshots back; a snapshot filter prunes partitions (A1, A2)."""
    df = spark.read.parquet(path)
    if snapshots is not None:
        df = df.filter(F.col("snapshot").isin(list(snapshots)))
    return df.select("snapshot", "src", "dst", "w")


TILE_KEYS = ["snapshot", "bi", "bj"]


def write_tiles(edges: DataFrame, path: str, block_size: int) -> None:
    """Edges as COO Parquet partitioned by ``(snapshot, bi, bj)`` (A4, A8): a tile is a
    folder of its own, so reading one leaves the others unopened.  Written again to the
    same path, the tiles in ``edges`` are replaced whole and the others stay (dynamic
    overwrite).  A tile with many edges is written by several tasks, split by hash of
    the source."""
    p = int(block_size)
    parts = F.pmod(F.xxhash64("src"), F.lit(TILE_SPLITS))
    (edges.select("snapshot", floor_div("src", p).alias("bi"), floor_div("dst", p).alias("bj"),
                  "src", "dst", "w")
     .repartition(*TILE_KEYS, parts)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*TILE_KEYS).parquet(path))


def read_tiles_of(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The edges of the tiles that ``manifest (snapshot, bi, bj)`` lists (A1); repeated
    entries count once, those without a tile give nothing.

    The manifest is a table, joined on the partition columns: with a filter of its own it
    prunes the tiles at run time (dynamic partition pruning), so unlisted tiles are not
    read.  Nothing is listed on the driver but the folders that Spark lists itself."""
    wanted = manifest.select(*[F.col(c).cast("bigint").alias("_" + c) for c in TILE_KEYS]).distinct()
    tiles = spark.read.schema("src BIGINT, dst BIGINT, w DOUBLE, snapshot BIGINT, bi BIGINT, "
                              "bj BIGINT").parquet(path)
    match = [F.col(c) == F.col("_" + c) for c in TILE_KEYS]
    return tiles.join(wanted, match, "left_semi").select(
        F.col("snapshot").cast("int").alias("snapshot"), "bi", "bj", "src", "dst", "w")


def edge_pairs(edges: DataFrame, keys=("snapshot",)) -> DataFrame:
    """The edge list without weights (A2)."""
    return edges.select(*list(keys), "src", "dst")


def write_result(flagged: DataFrame, nodes: DataFrame, path: str,
                 ground_truth: bool = False) -> str:
    """Write the full scored list and the node set (A3).  The truth and a normal
    run go to different sub-folders; either overwrites its previous result."""
    base = path.rstrip("/") + ("/truth" if ground_truth else "/result")
    flagged.write.mode("overwrite").parquet(base + "/delta_e")
    nodes.write.mode("overwrite").parquet(base + "/nodes")
    return base


def write_node_locations(tiles: DataFrame, path: str) -> None:
    """Node -> (row, col) of the tile's top-left cell (A5)."""
    tiles.select("node", "row", "col").write.mode("overwrite").parquet(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """Calibration trace as Parquet."""
    trace.write.mode("overwrite").parquet(path)


def write_cube(cube: DataFrame, path: str, slice_col: str = "slice") -> None:
    """A ``(row, col, slice, value)`` cube partitioned by time slice, so one slice
    is read by partition pruning (A6)."""
    cube.write.mode("overwrite").partitionBy(slice_col).parquet(path)


def read_slice(spark: SparkSession, path: str, index: int, slice_col: str = "slice") -> DataFrame:
    """One slice of a stored cube: the filter on the partition column becomes a
    ``PartitionFilters`` entry of the scan."""
    return (spark.read.parquet(path).filter(F.col(slice_col) == F.lit(int(index)))
                 .select("row", "col", "value"))


def edge_order(df: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Presentation order of an edge list: by j, then i."""
    return df.orderBy(F.col(j), F.col(i))
