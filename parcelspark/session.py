"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size checks: a join side is broadcast only when its
# measured size is under the threshold, and skewed partitions are split at run time.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",  # layers are bucketed by cell; joins have further keys
    "spark.sql.codegen.cache.maxEntries": "2000",  # one job has more stages than the default of 100
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "parcelspark", cores: str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {**CONF, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **conf}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; only on one machine (a ``local`` master) is a
    temporary folder chosen where that is unset. Anywhere else that would be a folder per executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a stage's narrow result as a table in the shared folder and go on from there.

    Used where several later joins read the same stage: it is computed once, later plans stay
    small and know its true size, and lost executors re-read files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
