from kindred.streaming import events as E


def test_estimates_of_a_stream_have_a_name_of_their_own(spark):
    at = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{at}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(at)
    assert E.windowed(events).columns == ["window_start", "event_type", "n", "total", "users"]
    assert E.windowed(stream).columns == ["window_start", "event_type", "n", "total", "approx_users"]
