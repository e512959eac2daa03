"""Streams of actions: incremental reads, progress state, count batches and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

SCHEMA = "round_num int, ts timestamp, platform string, agent_id long, action_type string, event_type string, args string, _corrupt_record string"


def tail(spark: SparkSession, folder: str, schema: str | StructType = SCHEMA, files: int = 100) -> DataFrame:
    """Action lines of a growing folder; the checkpoint remembers what was read. Lines that don't parse, event lines and those
    without agent are left out."""
    out = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files).json(folder)
    return out.where(F.col("_corrupt_record").isNull() & F.col("event_type").isNull() & F.col("agent_id").isNotNull())


def parquet(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None, key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window and key; the same frame works for batches."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = out.withWatermark("ts", late) if out.isStreaming else out
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = out.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = out.withWatermark("ts", late) if out.isStreaming else out
    out = out.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each id once: within the watermark on a stream, over all rows in a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def count_batches(actions: DataFrame, size: int = 5, key: str = "platform", idle: int | None = None) -> DataFrame:
    """Every `size` actions of a key make a row (key, n, first_id, last_id); with `idle`, what is left after so many milliseconds
    without new ones makes a short one (for streams that run on: a trigger for what is there now would wait for it without end).

    State is at most size - 1 ids a key."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            if held:
                yield pd.DataFrame({key: [name[0]], "n": [len(held)], "first_id": [held[0]], "last_id": [held[-1]]})
            return
        new = sorted(i for pdf in batches for i in pdf["event_id"])
        held = held + new
        full = [held[a : a + size] for a in range(0, len(held) - len(held) % size, size)]
        held = held[len(full) * size :]
        state.update((held,))
        if idle is not None:
            state.setTimeoutDuration(idle)
        if full:
            yield pd.DataFrame({key: name[0], "n": size, "first_id": [b[0] for b in full], "last_id": [b[-1] for b in full]})

    got = actions.where(F.col("action_type") != "DO_NOTHING").select(key, "event_id")
    return got.groupBy(key).applyInPandasWithState(run, f"{key} string, n long, first_id long, last_id long", "ids array<bigint>", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def progress(actions: DataFrame) -> DataFrame:
    """The newest round and count of each platform, kept up to date (update mode)."""
    return actions.groupBy("platform").agg(F.max("round_num").alias("round"), F.count(F.lit(1)).alias("actions"))


def responses(commands: DataFrame, answers: DataFrame, within: str = "60 seconds") -> DataFrame:
    """Commands with their answers by command_id, answered in time: a stream-stream join bounded on both sides by watermarks."""
    c, a = commands, answers.withColumnRenamed("command_id", "_id").withColumnRenamed("ts", "answered_at")
    if c.isStreaming:
        c, a = c.withWatermark("ts", within), a.withWatermark("answered_at", within)
    on = (F.col("command_id") == F.col("_id")) & (F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= F.col("ts") + F.expr(f"interval {within}"))
    return c.join(a, on).drop("_id")


def drain(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into Parquet, exactly once by the checkpoint."""
    frame.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(frame: DataFrame, send, checkpoint: str, tries: int = 3) -> None:
    """Calls send(batch, number) for each micro-batch, a few times if it fails; number makes repeated sends recognisable."""

    def run(batch: DataFrame, number: int) -> None:
        for k in range(tries):
            try:
                return send(batch, number)
            except Exception:
                if k == tries - 1:
                    raise

    frame.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
