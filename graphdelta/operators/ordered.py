"""Global order without a single-partition window.

A ``Window.orderBy(...)`` with no ``partitionBy`` pulls every row into one task.
Both helpers here work in two levels instead:

1. ``repartitionByRange`` on ``keys + order`` (+ unique tie-breakers) -- sampled
   boundaries, so even a value shared by a third of all rows is spread over many
   partitions because the tie-breakers keep splitting it;
2. a window per (keys, partition id) for the local rank, a pass over the sorted
   partition for the local running sum;
3. per-partition totals (at most ``#keys x #partitions`` rows, a bounded table)
   prefix-summed and joined back as the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def _parts(df: DataFrame, n_partitions: int | None) -> int:
    if n_partitions:
        return int(n_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, keys, order, n_partitions):
    ks = list(keys or [])
    n = _parts(df, n_partitions)
    r = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in ks + list(order)])
    return ks, r.withColumn("_pid", F.spark_partition_id())


def _local_sums(n_keys: int, at: int):
    """For ``mapInArrow`` on sorted rows that start with ``n_keys`` keys: every row with
    the sum of column ``at`` from its key's first row in the partition on, added one by
    one; nulls add nothing, and the sum is null up to the first number."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        key, total, seen = None, 0.0, False
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for n in range(n_keys):
                k = b.column(n)
                same = pc.equal(k[1:], k[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                null = k.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | (null[1:] & null[:-1]))
            first = tuple(b.column(n)[0].as_py() for n in range(n_keys))
            new[0] = first != key
            key = tuple(b.column(n)[-1].as_py() for n in range(n_keys))
            known = b.column(at).is_valid().to_numpy(zero_copy_only=False)
            value = pc.fill_null(b.column(at), 0.0).to_numpy(zero_copy_only=False)
            sums, valid = np.empty(len(value)), np.empty(len(value), bool)
            for lo, hi in zip(c := [*{0: 0, **dict.fromkeys(np.flatnonzero(new).tolist())}], [*c[1:], len(value)]):
                if new[lo]:
                    total, seen = 0.0, False
                run_ = np.cumsum(np.concatenate(([total], value[lo:hi])))[1:]
                sums[lo:hi] = run_
                valid[lo:hi] = seen | np.logical_or.accumulate(known[lo:hi])
                total, seen = float(run_[-1]), bool(valid[hi - 1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(sums, mask=~valid)], names=[*b.schema.names, "_local"])

    return run


def running_sum(df: DataFrame, value: str, order, keys=(), name: str = "running_sum",
                n_partitions: int | None = None) -> DataFrame:
    """Cumulative sum of ``value`` in ``order`` within ``keys``.

    ``order`` must make rows unique within ``keys`` (add the id columns as
    tie-breakers); the result is then deterministic.  ``df`` is read twice, to find the
    ranges and to deal the rows out, which is the only time they are shuffled; they are
    sorted and added up where they land and stored once.  ``value`` comes back as a double.
    """
    ks, r = _ranged(df, keys, order, n_partitions)
    rows = r.select(*ks, F.col(value).cast("double").alias(value),
                    *[c for c in r.columns if c not in (*ks, value)])
    rows = rows.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ks + list(order)])
    summed = T.StructType([*rows.schema.fields, T.StructField("_local", T.DoubleType())])
    local = stored(rows.mapInArrow(_local_sums(len(ks), len(ks)), summed))
    totals = local.groupBy(*ks, "_pid").agg(F.sum(value).alias("_tot"))
    # Bounded table: one row per (key, partition); a window over it is cheap.
    tw = (Window.partitionBy(*ks).orderBy("_pid")
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*ks, "_pid",
                            F.coalesce(F.sum("_tot").over(tw), F.lit(0.0)).alias("_off"))
    out = local.join(F.broadcast(offsets), ks + ["_pid"])
    return (out.withColumn(name, F.col("_off") + F.col("_local"))
               .select(*df.columns, name))


def dense_index(df: DataFrame, order, keys=(), name: str = "idx",
                n_partitions: int | None = None) -> DataFrame:
    """0-based contiguous index of each row in ``order`` within ``keys``."""
    ks, r = _ranged(df, keys, order, n_partitions)
    r = r.checkpoint(eager=True)
    local = r.withColumn("_local", F.row_number().over(
        Window.partitionBy(*ks, "_pid").orderBy(*order)))
    counts = r.groupBy(*ks, "_pid").agg(F.count("*").alias("_cnt"))
    tw = (Window.partitionBy(*ks).orderBy("_pid")
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*ks, "_pid",
                            F.coalesce(F.sum("_cnt").over(tw), F.lit(0)).alias("_off"))
    out = local.join(F.broadcast(offsets), ks + ["_pid"])
    return (out.withColumn(name, (F.col("_off") + F.col("_local") - 1).cast("bigint"))
               .drop("_pid", "_local", "_off"))
