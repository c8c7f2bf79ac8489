from pyspark.sql import functions as F

from folio.streaming import limits


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("t"), "event_type")


def test_limit_as_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = limits.sliding_log(_events(spark, sf_dir), "user_id", "event_id", "us", 86_400_000_000, 2)
    src = str(tmp_path / "in")
    _events(spark, sf_dir).select("user_id", "event_id", "us").write.parquet(src)
    stream = spark.readStream.schema("user_id long, event_id long, us long").parquet(src)
    out = limits.sliding_log_stream(stream, "user_id", "event_id", "us", 86_400_000_000, 2)
    q = out.writeStream.format("memory").queryName("folio_limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("folio_limits").collect())) == sorted(map(tuple, batch.collect()))


def test_window_is_open_on_the_left():
    ok, log, _ = limits.admit([0], 10, 10, 1)
    assert ok and log == [10]
    ok, log, wait = limits.admit([1], 10, 10, 1)
    assert not ok and log == [1] and wait == 1


def test_breaker(spark):
    rows = [(1, 0, 0, True), (1, 1, 1, True), (1, 2, 2, False), (1, 3, 100, False), (1, 4, 101, False), (1, 5, 102, True)]
    df = spark.createDataFrame(rows, "k long, i long, us long, failed boolean")
    got = [(r["i"], r["state"], r["allowed"]) for r in limits.breaker(df, "k", "i", "us", "failed", failures=2, wait_us=50, successes=2).orderBy("i").collect()]
    assert got == [(0, "closed", True), (1, "open", True), (2, "open", False), (3, "half_open", True), (4, "closed", True), (5, "closed", True)]


def test_session_stream(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    _events(spark, sf_dir).select("user_id", "t").write.parquet(src)
    stream = spark.readStream.schema("user_id long, t timestamp").parquet(src)
    q = limits.live_sessions_stream(stream, "user_id", "t").writeStream.format("memory").queryName("folio_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("folio_sessions").count() > 0


def test_rates_stream(spark, sf_dir, tmp_path):
    src = str(tmp_path / "in")
    _events(spark, sf_dir).select("event_type", "t").write.parquet(src)
    stream = spark.readStream.schema("event_type string, t timestamp").parquet(src)
    q = limits.windowed_counts_stream(stream, "t", "event_type").writeStream.format("memory").queryName("folio_rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("folio_rates").columns == ["window", "event_type", "increase"]
