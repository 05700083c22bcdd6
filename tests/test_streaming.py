from genoframe.streaming.summaries import first_within, windowed_counts


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 05:00:00", "b", 2.0)], "t string, k string, v double")
    rows.selectExpr("to_timestamp(t) AS t", "k", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("t timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream(), "t", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n, r.total) for r in spark.table("counts").collect()) == [("a", 2, 4.0), ("b", 1, 2.0)]
    q = first_within(stream(), "t", ["k"]).writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]
