"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lavra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder. Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local one takes its place only in a local session; on a cluster a missing folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not folder:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lavra-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder or jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder (executors may be lost)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 50_000) -> DataFrame:
    """Join a side that is expected to be small.

    At most max_rows + 1 rows of it are fetched. If it has no more than max_rows, the join is a
    broadcast of exactly those rows; beyond that bound it is an ordinary shuffled join, whose skew
    adaptive execution splits.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df.join(small, on, how)
    local = df.sparkSession.createDataFrame(rows, small.schema)
    return df.join(F.broadcast(local), on, how)
