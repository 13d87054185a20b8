"""Session construction for tests, the bench and local runs.

On a cluster the session comes from the platform; the library never reconfigures it except
for the checkpoint directory, and only when the cluster left ``spark.checkpoint.dir`` unset.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "shopscope", memory: str = "16g",
                  scratch: str | None = None) -> SparkSession:
    """A local session with AQE and skew-join handling on and the UI off."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cores)
    conf["spark.driver.memory"] = memory
    if scratch:
        conf["spark.local.dir"] = scratch
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, fallback=scratch)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a local one only when unset.

    ``fallback`` is meant for tests and single-machine runs. Returns the directory in use,
    or None when neither is available (callers then skip checkpointing).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return shared
    if fallback is not None:
        if not sc.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a local folder isn't shared")
        path = os.path.join(fallback, "checkpoints")
        sc.setCheckpointDir(path)
        return path
    return None


def scratch_dir(prefix: str = "shopscope-") -> str:
    """A fresh scratch folder (one per run, never reused)."""
    return tempfile.mkdtemp(prefix=prefix, dir="/tmp")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``.

    Only a local master without that setting gets a scratch folder of its own."""
    root = ensure_checkpoint_dir(spark)
    if root is None:
        root = ensure_checkpoint_dir(spark, fallback=scratch_dir())
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def stored(df, tag: str):
    """``df`` as a Parquet table in the shared folder, for several passes over what took joins to make.

    The table goes when the block ends, so what leaves it must not read from it any more (see ``small``)."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df):
    """A result of a few rows, computed now and held by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def materialize(df, eager: bool = True):
    """Cut a DataFrame's lineage so that later jobs (and a lost executor) start from it.

    With a checkpoint directory (the cluster's shared ``spark.checkpoint.dir``) the data is
    written there with ``checkpoint()``; without one it is persisted to memory and disk and
    computed once. Never a machine-local checkpoint.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    if ensure_checkpoint_dir(spark) is not None:
        return df.checkpoint(eager=eager)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        out.count()
    return out
