from pyspark.sql import functions as F

from chainframe.plans.queries import event_counts
from chainframe.sources.store import table
from chainframe.streaming import transitions

SF = "/root/testdata/sf0.001"


def test_stream_counts_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events").select("event_id", "ts", "user_id", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = transitions.transitions(transitions.read(spark, str(tmp_path / "in"), events))
    job = stream.writeStream.format("memory").queryName("moved").outputMode("append").start()
    job.processAllAvailable()
    job.stop()
    found = spark.table("moved").groupBy("i", "j").agg(F.count("*").cast("double").alias("w"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, event_counts(spark, SF).collect()))


def test_idle_users_are_forgotten(spark, tmp_path):
    row = lambda n, day, user: spark.createDataFrame([(n, f"2024-{day} 00:00:00", user, "view")], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    like = row(0, "01-01", 1)
    like.write.parquet(str(tmp_path / "in"))
    stream = transitions.transitions(transitions.read(spark, str(tmp_path / "in"), like), "1 hour", idle_hours=24)
    job = stream.writeStream.format("memory").queryName("kept").outputMode("append").start()
    try:
        for n, (day, user) in enumerate([("01-01", 2), ("01-02", 1), ("03-01", 3), ("03-02", 3), ("03-03", 1)], 1):
            job.processAllAvailable()
            row(n, day, user).write.mode("append").parquet(str(tmp_path / "in"))
        job.processAllAvailable()
    finally:
        job.stop()
    # user 1 moves within a day, but not from January to March
    assert sorted((r["user_id"], str(r["ts"])[:10]) for r in spark.table("kept").collect()) == [(1, "2024-01-02"), (3, "2024-03-02")]
