"""Structured Streaming forms. Each takes a streaming DataFrame and gives one; run() drains it into a folder."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import key
from lavra.session import checkpoint_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{folder}/{name[0]}*{name[1:]}")


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process all that is there, with state and output in the shared folder, and read the output."""
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        # a changing result: each batch replaces the rows written before

        def save(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        q = writer.foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def windowed_counts(df: DataFrame, at: str, by: list[str], size: str = "5 minutes", late: str = "1 day") -> DataFrame:
    """Counts per tumbling window with a watermark; complete output."""
    t = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return t.groupBy(F.window(at, size), *by).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("inicio"), *by, "n")


def latest(df: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """The last value per key: heartbeats."""
    return df.groupBy(*key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def deduplicated(df: DataFrame, key: str, at: str, late: str = "3 days") -> DataFrame:
    """Each key once, within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def paired(df: DataFrame, pair: str, role: str, at: str, wait: str = "1 hour") -> DataFrame:
    """Prompts joined with replies of the same pair within the wait: a stream-stream join with state bounded by the watermark."""
    p = df.where(F.col(role) == "p").select(F.col(pair).alias("par"), F.col(at).alias("pergunta_em")).withWatermark("pergunta_em", "1 day")
    r = df.where(F.col(role) == "r").select(F.col(pair).alias("par_r"), F.col(at).alias("resposta_em")).withWatermark("resposta_em", "1 day")
    return p.join(r, (F.col("par") == F.col("par_r")) & (F.col("resposta_em") >= F.col("pergunta_em")) & (F.col("resposta_em") <= F.col("pergunta_em") + F.expr(f"interval {wait}"))).drop("par_r")


def since_last(df: DataFrame, hours: int = 8) -> DataFrame:
    """id, usuario_id, ferramenta_id: the events that are emitted if one is suppressed within the hours after the last emitted one of its user and tool.

    df: id, usuario_id, ferramenta_id, quando, in order of `quando` from batch to batch. The state of a key is one
    instant. Repeated ids of a batch count once; references are compared as keys; null ones are left out.
    """
    gap = hours * 3_600_000_000
    src = df.select("id", key(F.col("usuario_id")).alias("usuario_id"), key(F.col("ferramenta_id")).alias("ferramenta_id"), F.unix_micros("quando").alias("us")).where("usuario_id is not null and ferramenta_id is not null and us is not null")

    def emit(k, batches, state):
        last = state.get[0] if state.exists else None
        new = pd.concat(list(batches)).drop_duplicates().sort_values(["us", "id"], kind="stable")
        keep = []
        new = new.reset_index(drop=True)
        for us in new["us"]:
            ok = last is None or us - last >= gap
            keep.append(ok)
            last = us if ok else last
        state.update((last,))
        out = new.loc[keep, ["id"]]
        yield out.assign(usuario_id=k[0], ferramenta_id=k[1])

    return src.groupBy("usuario_id", "ferramenta_id").applyInPandasWithState(emit, "id string, usuario_id string, ferramenta_id string", "last bigint", "append", "NoTimeout")
