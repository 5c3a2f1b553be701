"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["c_mktsegment", "n", "total"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_windows(spark, tmp_path, data):
    from pyspark.sql import functions as F

    from bagwright.streaming import windows

    src = str(tmp_path / "in")
    spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    static = spark.read.parquet(src)
    stream = spark.readStream.schema(static.schema).parquet(src)
    made = windows.tumbling(stream, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")], late="1 day")
    windows.append(made, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in windows.tumbling(static, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert windows.sessions(static, "ts", "5 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")]).agg(F.sum("n")).collect()[0][0] == static.count()
