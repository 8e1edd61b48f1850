from postloom.streaming.recency import sliding_counts


def test_stream_counts_as_the_table_does(spark, tmp_path):
    data = spark.sql("select 'a' section, 'h1' hash, timestamp'2024-01-01 10:00:00' created_at union all select 'a','h1', timestamp'2024-01-01 10:00:00' union all select null,'h2', timestamp'2024-01-03 10:00:00' union all select 'a','h3', timestamp'2024-03-01 00:00:00'")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = sliding_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select window.start s, section, n from counts").collect()
    assert {(r["section"], r["n"]) for r in got} == {("a", 1), ("", 1)} and len(got) == 14
    assert sliding_counts(data).count() == 21
