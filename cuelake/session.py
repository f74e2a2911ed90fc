"""Session defaults, input spreading and lineage cuts."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on; anything the cluster already sets wins at submit time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cuelake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only on a local master where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if root is None and current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if current is None:
        spark.sparkContext.setCheckpointDir(root)
    return root or current


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, *counts: Column) -> tuple[DataFrame, Row]:
    """``cut``, with counts over the rows (their number as ``n`` if none is given) taken by the job that writes them."""
    seen = Observation()
    held = cut(df.observe(seen, *(counts or [F.count(F.lit(1)).alias("n")])))
    return held, Row(**seen.get)


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores.

    A table of real size has many splits per core and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def ship() -> None:
    """Make this package travel inside the functions sent to Python workers.

    Workers then need no copy of it; a job that ships it with ``--py-files`` may skip this.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
