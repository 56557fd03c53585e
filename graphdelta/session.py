"""Session helpers: a local session for tests / bench and the checkpoint directory.

Library code never builds its own session; it takes the caller's.  Lineage in the
iterative operators is cut with ``DataFrame.checkpoint()`` into the directory the
cluster names in ``spark.checkpoint.dir``; only when that is unset (local tests)
do we pick a scratch folder ourselves.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session we build gets.  AQE re-plans joins and coalesces
# partitions at runtime; skew-join splitting covers hot join keys.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "graphdelta", extra: dict | None = None) -> SparkSession:
    """A local session (tests, bench).  On a cluster the caller's session is used."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory; return it.

    Uses the context's directory if one is set, else ``spark.checkpoint.dir``
    from the session conf (the shared folder on a cluster).  Only if both are
    unset -- a local test session -- a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a shared "
                "checkpoint folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="run-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's
    JVM has collected the plans that made them, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """The table, written once into the checkpoint folder as Parquet, which takes less
    room than a checkpoint's rows, and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
