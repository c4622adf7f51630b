"""Session settings and the shared folder used to pin intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Runtime SQL settings the operators count on. The skew-join rule is forced
# because several joins feed a grouping on the same key: without the force
# Spark keeps that key in one task to save a shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams on disk, not in the heap; job state with timers needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the operators count on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    That is the checkpoint folder, else a folder below the warehouse.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir", None)
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` below the shared folder, removed when the session's JVM ends."""
    root = f"{shared_folder(spark)}/ziplore-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}"


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the copy.

    Used where a result is read more than once and is either costly to build
    or depends on how rows fell into partitions. The copy survives the loss of
    executors, which a cached or locally checkpointed frame does not, and later
    steps read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
