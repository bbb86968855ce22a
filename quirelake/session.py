"""Session defaults and durable cuts of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quirelake")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there.

    The folder named by spark.checkpoint.dir is used where it is set; only where no folder is known (tests, a laptop)
    is one of our own set. Executors may be lost afterwards: the files are in the shared folder, not on an executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirelake-checkpoint-"))
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """Tasks that run at once; a floor for the number of partitions of a CPU-heavy stage."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys for a CPU-heavy stage: an explicit number of partitions, which is not coalesced.

    The number is that of spark.sql.shuffle.partitions, which is set to the data's size, and at least two per slot.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * slots(spark))
    return df.repartition(n, *keys)


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """df as it is where its scan has a partition or more per slot, so that large inputs are not shuffled; else spread by the keys.

    For plans without a shuffle of their own: the number of partitions is read from the plan, nothing runs.
    """
    try:
        enough = df._jdf.toJavaRDD().getNumPartitions() >= slots(df.sparkSession)
    except Exception:  # no access to the plan
        enough = False
    return df if enough else spread(df, *keys)
