from tabulon.streaming.aggregates import windowed

ARGS = ("ts", "1 day", "10 days", ["event_type"], {"n": ("COUNT", "value"), "total": ("SUM", "value")}, {"value": ">=10"})


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/event[s].parquet")
    run = windowed(stream, *ARGS).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 6))
    want = sorted(map(key, windowed(batch, *ARGS).collect()))
    assert want and sorted(map(key, spark.table("windowed").collect())) == want
