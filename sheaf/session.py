"""Session helpers: a local session for tests/bench, and checkpoint-dir discovery."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings this library relies on for result equality with the oracle
# (UTC session time) and for scale (AQE re-planning, skew-join splitting).
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go when their DataFrame does
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sheaf",
                  extra: dict | None = None) -> SparkSession:
    """A local-mode session with the UI off (tests, bench, smoke runs)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("SHEAF_DRIVER_MEMORY", "16g"))
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master may leave it unset (tests, bench); it then gets a folder of its own.  Elsewhere a folder of
    one machine would lose the parts that other executors write, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sheaf-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_scopes: list[list[str]] = []  # paths pinned inside of each open `pinned_scope`


def pinned_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back.

    Like a checkpoint it is one execution and safe from lost executors; besides, Catalyst knows its true size and so
    picks a broadcast join by its own threshold.  The table goes at the end of the innermost :func:`pinned_scope`; outside
    of any it stays until the cluster clears the folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pinned/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def pinned_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables pinned inside of this block at its end, in whatever file system they are.

    Frames built inside must have been written or collected by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
