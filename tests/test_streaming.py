from weftgraph.streaming import mentions


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{k}:00") for k in range(4)] + [("b", "2024-01-01 00:01:00"), (None, "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "entity string, t string").selectExpr("entity", "cast(t as timestamp) as ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = mentions.windowed_mentions(stream, "entity", "ts").writeStream.outputMode("update").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.entity, r.n) for r in spark.table("counted").collect()} == {("a", 4)}
    q = mentions.first_seen(stream, "entity", "ts").writeStream.outputMode("append").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.entity for r in spark.table("seen").collect()} == {"a", "b"} and spark.table("seen").count() == 2
