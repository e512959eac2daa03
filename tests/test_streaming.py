"""Streams give what batches give."""

import json

from pyspark.sql import functions as F

from loomspan.streaming import events as ev

SF = "/root/testdata/sf0.001"


def _stream_dir(spark, tmp_path, n=3):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1).withColumn("ts", F.col("ts").cast("timestamp")).repartition(n).write.parquet(src)
    return src


def test_tumbling_stream_equals_batch(spark, tmp_path):
    src = _stream_dir(spark, tmp_path)
    ev.drain(ev.tumbling(ev.parquet(spark, src), late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {(r["start"], r["event_type"], r["n"]) for r in ev.tumbling(spark.read.parquet(src)).collect()}
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got <= batch  # windows still open when the input ends aren't emitted in append mode
    rest = ev.tumbling(ev.parquet(spark, src)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    rest.awaitTermination()
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()} == batch


def test_tail_and_count_batches(spark, tmp_path):
    d = tmp_path / "log"
    d.mkdir()
    rows = [{"round_num": i, "platform": "twitter", "agent_id": i, "action_type": "LIKE"} for i in range(12)]
    (d / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\n{bad\n" + json.dumps({"event_type": "round_end"}))
    ev.drain(ev.tail(spark, str(d)), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 12
    (d / "b.json").write_text(json.dumps(rows[0]))
    ev.drain(ev.tail(spark, str(d)), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 13  # only the new file
    src = str(tmp_path / "acts")
    spark.range(12).selectExpr("id event_id", "'twitter' platform", "'LIKE' action_type").write.parquet(src)
    ev.drain(ev.count_batches(ev.parquet(spark, src)), str(tmp_path / "b"), str(tmp_path / "bc"))
    got = sorted((r["first_id"], r["last_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "b")).collect())
    assert got[:2] == [(0, 4, 5), (5, 9, 5)]


def test_batches_are_retried(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.range(3).write.parquet(src)
    seen = []

    def send(batch, number):
        seen.append(number)
        if len(seen) == 1:
            raise RuntimeError("once")
        assert batch.count() == 3

    ev.each_batch(ev.parquet(spark, src), send, str(tmp_path / "c"))
    assert seen == [0, 0]


def test_responses_in_time(spark):
    c = spark.sql("select 1 command_id, timestamp'2024-01-01 00:00:00' ts union all select 2, timestamp'2024-01-01 00:00:00'")
    a = spark.sql("select 1 command_id, timestamp'2024-01-01 00:00:30' ts, 'ok' r union all select 2, timestamp'2024-01-01 00:05:00', 'late'")
    assert [r["command_id"] for r in ev.responses(c, a).collect()] == [1]
