from pyspark.sql import functions as F

from tallyweave.functions.sizing import Grid
from tallyweave.operators import exact, linear
from tallyweave.streaming import sketches

SCHEMA = "key string, weight long, time timestamp"


def feed(spark, tmp_path):
    rows = [(f"k{i % 7}", 1 + i % 3, f"2024-01-01 00:{i % 50:02d}:00") for i in range(300)]
    for n in range(3):
        part = spark.createDataFrame(rows[n::3], "key string, weight long, time string").withColumn("time", F.to_timestamp("time"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), stream


def drain(spark, df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
        return spark.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def test_streamed_cells_equal_batch(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    grid = Grid(3, 16)
    found = drain(spark, sketches.streaming_count_min(stream, grid), "complete", "cells", tmp_path)
    assert sorted(map(tuple, found)) == sorted(map(tuple, linear.count_min(exact.frequencies(batch), grid).collect()))


def test_streamed_misra_gries_bounds(spark, tmp_path):
    batch, stream = feed(spark, tmp_path)
    found = drain(spark, sketches.streaming_misra_gries(stream, 4, 2), "update", "mg", tmp_path)
    true = {r["key"]: r["total"] for r in exact.frequencies(batch).collect()}
    assert found and all(0 < r["estimate"] <= true[r["key"]] for r in found)


def test_windowed_frequencies(spark, tmp_path):
    _, stream = feed(spark, tmp_path)
    found = drain(spark, sketches.windowed_frequencies(stream, "time", "10 minutes", "5 minutes"), "append", "w", tmp_path)
    assert found and all((r["end"] - r["start"]).seconds == 600 for r in found)
