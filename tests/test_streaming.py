"""Streams against the same thing in one batch."""

import datetime

from pyspark.sql import functions as F

from veinstone.streaming import incremental


def test_new_files_become_fragments(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    for k, text in enumerate(["One text here.", "Two texts here."]):
        (folder / f"{k}.txt").write_text(text)
        incremental.stream_fragments(incremental.file_stream(spark, str(folder)), out, mark).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["One text here.", "Two texts here."]


def events(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, start + datetime.timedelta(hours=k), "view" if k % 2 else "click", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))


def test_windows(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    query = incremental.windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(incremental.windowed_usage(batch).collect())


def test_cumulative(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    query = incremental.cumulative_usage(stream).writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    expected = batch.groupBy("user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    assert sorted(spark.table("totals").collect()) == sorted(expected.collect())
