from pyspark.sql import functions as F

from arborline.common import table
from arborline.operators import changes
from arborline.streaming import edits


def test_stream_agrees_with_batch(spark, data, tmp_path):
    ops = table(spark, data, "ops").filter("session_id is not null")
    known = table(spark, data, "label_map").select("session_id", "baseline_fingerprint").distinct()
    mine = ops.join(known, ["session_id", "baseline_fingerprint"], "left_semi").select("session_id", "event", "operation_id", "target_operation_id", "sequence", "type")
    source = str(tmp_path / "log")
    mine.repartition(3).write.parquet(source)
    held = []
    stream = spark.readStream.schema(mine.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = edits.follow(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: held.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    updates = spark.createDataFrame(held, "batch long, " + edits.OUT)
    got = {tuple(r) for r in edits.latest(updates).collect()}
    want = {tuple(r) for r in changes.in_force(table(spark, data, "ops"), table(spark, data, "label_map")).select("session_id", "operation_id", "t", "type").collect()}
    assert got == want


def test_windows_in_stream_and_batch(spark, data, tmp_path):
    e = table(spark, data, "events").select("ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "events")
    e.orderBy("ts").coalesce(1).write.parquet(source)
    q = edits.windows(spark.readStream.schema(e.schema).parquet(source)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(180)
    norm = lambda df: {(r["from_ts"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect()}
    assert norm(spark.table("w")) == norm(edits.windows(e))
