from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.sources import views
from tidemark.streaming.sampling import sample_stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    ticks = views.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    end = ticks.limit(1).select("instrument", F.lit("2031-01-01").cast("timestamp").alias("ts"), "close", "volume")
    ticks.repartition(3).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "*"))
    query = sample_stream(stream, 30).writeStream.outputMode("append").format("memory").queryName("sampled").start()
    try:
        query.processAllAvailable()
        end.coalesce(1).write.parquet(str(tmp_path / "b"))
        query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    batch = B.sample(views.ticks(spark, sf_dir), 30).select("instrument", "bar", "price")
    found = spark.table("sampled").where(F.col("bar") < 1_900_000_000)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.collect()}
