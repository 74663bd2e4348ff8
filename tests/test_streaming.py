"""A stream that has ended gives what the batch plan gives, up to the windows that the watermark has not closed."""

from __future__ import annotations

from pitchlake.streaming.windows import stream_windows

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    query = stream_windows(stream, 14400, 7200).writeStream.outputMode("complete").format("memory").queryName("windows_out").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(120)
    found = sorted(map(repr, spark.table("windows_out").collect()))
    assert found == sorted(map(repr, stream_windows(batch, 14400, 7200).collect())) and found
