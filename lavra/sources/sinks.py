"""Sinks: tables, nested documents, SQL scripts, self-contained pages, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.functions.scalars import sql_literal
from lavra.session import checkpoint


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table as a whole; with a partition column only pruned folders are read later."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The old table and the new rows, the latest row per key (ties: the greatest values).

    It is written beside the old table, which is then swapped for it by two renames; a run that ends
    between them leaves the old table under `<path>.velho`. Errors of reading rise, they never count as "no table".
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    here, old, staged = Path(path), Path(f"{path}.velho"), Path(f"{path}.novo")
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)
    rows = spark.read.parquet(path).unionByName(new, allowMissingColumns=True) if fs.exists(here) else new
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, *rest)).alias("x")).select(*key, "x.*")
    out.write.mode("overwrite").parquet(f"{path}.novo")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(staged, here)
    fs.delete(old, True)
    return spark.read.parquet(path)


def with_ids(df: DataFrame, order: list[str], prefix: str = "CAP-", width: int = 6) -> DataFrame:
    """Adds id: consecutive numbers in the given order, by two steps (counts per range partition, then positions), so no task holds all rows."""
    # the partitions are used twice and must be the same ones
    part = checkpoint(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order)
    part = part.withColumn("_i", F.row_number().over(w))
    before = part.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_b", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return part.join(before, "_p").withColumn("id", F.format_string(f"{prefix}%0{width}d", F.col("_b") + F.col("_i"))).drop("_p", "_i", "_b")


def documents(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """<key>, json: each parent row with its child rows as nested arrays. Child tables are grouped by the key before the join."""
    out = parent
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        out = out.join(child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns])).alias("json"))


def insert_script(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row, as text."""
    values = F.concat_ws(", ", *[sql_literal(F.col(c)) for c in df.columns])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(") ON CONFLICT DO NOTHING;")).alias("comando"))


def page(template: str, payload: dict, mark: str = "/*DADOS*/") -> str:
    """A self-contained page: the payload is put in place of the mark, with closing tags escaped."""
    return template.replace(mark, json.dumps(payload, ensure_ascii=False).replace("</", "<\\/"))


def snapshot(df: DataFrame, path: str) -> int:
    """Write a copy and check that it holds as many rows."""
    df.write.mode("overwrite").parquet(path)
    n, m = df.count(), df.sparkSession.read.parquet(path).count()
    if n != m:
        raise ValueError(f"snapshot has {m} rows of {n}")
    return m
