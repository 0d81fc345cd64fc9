from pyspark.sql import functions as F

from lavra.streaming import streams


def test_pairs_equal_the_batch_join(spark, tmp_path):
    rows = [("a", "p", 0), ("a", "r", 30), ("b", "p", 10), ("b", "r", 10_000), ("c", "r", 5), ("d", "p", 50), ("d", "r", 60), ("d", "r", 70)]
    df = spark.createDataFrame(rows, "par string, papel string, s int").withColumn("em", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    path = str(tmp_path / "t.parquet")
    df.repartition(3).write.parquet(path)
    got = streams.run(streams.paired(streams.source(spark, path), "par", "papel", "em"))
    seconds = lambda c: F.unix_seconds(c) - 1_700_000_000
    assert sorted(tuple(r) for r in got.select("par", seconds(F.col("pergunta_em")), seconds(F.col("resposta_em"))).collect()) == [("a", 0, 30), ("d", 50, 60), ("d", 50, 70)]


def test_last_value_per_key(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, "x"), ("m", 3, "y"), ("n", 2, None), ("m", 2, "z")], "k string, at int, v string")
    path = str(tmp_path / "h.parquet")
    df.write.parquet(path)
    got = streams.run(streams.latest(streams.source(spark, path), ["k"], "at", "v"), "complete")
    assert sorted((r["k"], r["v"], r["at"]) for r in got.collect()) == [("m", "y", 3), ("n", None, 2)]


def test_deduplication_within_the_watermark(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("b", 7)], "id string, s int").select("id", F.timestamp_seconds("s").alias("em"))
    path = str(tmp_path / "d.parquet")
    df.write.parquet(path)
    got = streams.run(streams.deduplicated(streams.source(spark, path), "id", "em"))
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"]
