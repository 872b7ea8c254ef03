from pyspark.sql import functions as F

from tessera.streaming import ledger


def test_repeats_within_the_watermark_come_once(spark, tmp_path):
    rows = [("p", "a", 1, "2024-01-01 00:00:00"), ("p", "a", 1, "2024-01-01 00:10:00"), ("p", "b", -1, "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "project string, step string, status int, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ledger.once(ledger.entries(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " ")), ["project", "step"], "at")
    ledger.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") % 2).alias("k"), F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ledger.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "at", "10 minutes", ["k"])
    ledger.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and out.agg(F.max("n")).first()[0] == 5
