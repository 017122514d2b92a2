from pyspark.sql import functions as F

from lumenframe.streaming import tracker


def _events(spark):
    rows = [(i, i, "ab"[i % 2], float(1 + (i * 7) % 11) if i != 20 else 1e9) for i in range(60)]
    return spark.createDataFrame(rows, "event_id long, seq long, kind string, value double")


def test_stream_equals_batch(spark, tmp_path):
    rows = _events(spark)
    for k in range(3):
        rows.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.stream_ewma(stream, "kind", ["seq"], "value").writeStream.outputMode("update").format("memory").queryName("ewma").start()
    q.processAllAvailable()
    q.stop()
    last = {r["kind"]: (r["e"], r["n"]) for r in spark.sql("SELECT kind, max_by(ewma, n) AS e, max(n) AS n FROM ewma GROUP BY kind").collect()}
    batch = {r["kind"]: (r["ewma"], r["n"]) for r in tracker.ewma(rows, "kind", ["seq"], "value").collect()}
    assert last == batch
    assert batch["a"][1] == 29  # the outlier does not count


def test_saved_stream(spark, tmp_path):
    rows = _events(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = tracker.save_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 1, lambda df, k: seen.append(k))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60 and seen == [0]


def test_rings_and_choices(spark):
    ring = tracker.ring(_events(spark), "kind", ["seq"], 8)
    assert ring.count() == 16 and ring.select("kind", "slot").distinct().count() == 16
    saved = spark.createDataFrame([("r", 3, 1.0, 1), ("r", 5, 0.5, 2), ("q", None, 1.0, 3), ("q", 9, 0.5, 4)], "run string, epoch int, mtime double, id long")
    assert {r["run"]: r["id"] for r in tracker.resume_choice(saved, "run").collect()} == {"r": 2, "q": 3}


def test_tracker_rows(spark):
    t = tracker.Tracker()
    t.on_batch_rmse(1.0)
    t.on_progress(1, 2, 3)
    t.on_epoch_end(1, 0.5)
    assert [r["op"] for r in t.frame(spark).orderBy("seq").collect()] == ["rmse_batch", "progress", "epoch_end"]
    n = tracker.NullTracker()
    n.on_batch_rmse(1.0)
    assert n.rows == []
