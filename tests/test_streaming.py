from pyspark.sql import functions as F

from pagewright.streaming import ingest


def test_files_as_they_arrive(spark, tmp_path):
    from pagewright.plans.partition import raw
    from pagewright.sources.filetype import detect

    land = tmp_path / "in"
    land.mkdir()
    for k, t in enumerate(("It was here and they were running.", "It was there.", "It was here and they were running.")):
        (land / f"{k}.txt").write_text(t)
    once = ingest.once_each(ingest.files(spark, str(land)).withColumn("text", F.decode("content", "UTF-8")))
    ingest.drain(once.select("doc_id", "element_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    parsed = raw(detect(ingest.files(spark, str(land))))
    ingest.drain(parsed.select("doc_id", "ord", "text"), str(tmp_path / "out2"), str(tmp_path / "cp2")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3


def test_windows(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    e.write.parquet(str(tmp_path / "ev"))
    w = ingest.windowed_counts(ingest.rows(spark, str(tmp_path / "ev"), schema), "ts", "1 hour", None, "1 hour", "event_type")
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.event_type, r.window.start): r.n for r in spark.table("w").collect()}
    want = {(r.event_type, r.w.start): r.n for r in e.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got == want
    s = ingest.sessions(ingest.rows(spark, str(tmp_path / "ev"), schema), "user_id")
    q = s.writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("s").count() > 0
