from pyspark.sql import functions as F

from foliograph.sources.packages import build
from foliograph.streaming import ingest


def test_packages_arrive_and_are_appended(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.zip").write_bytes(build([[{"text": "one"}]]))
    stream = ingest.packages(spark, str(inbox)).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.text")
    ingest.append(stream, out, str(tmp_path / "state")).awaitTermination()
    (inbox / "b.zip").write_bytes(build([[{"text": "two"}]]))
    stream = ingest.packages(spark, str(inbox)).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.text")
    ingest.append(stream, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_windows_match_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = ingest.activity(source, "ts", "event_type", "value").writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r.start, r.event_type): r.n for r in spark.table("activity").collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert found == {(r.w.start, r.event_type): r["count"] for r in batch.collect()}
