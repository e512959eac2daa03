"""Count windows with their own state: full batches as they fill, short ones after a pause, the rest out of the state store at the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "platform string, n long, first_id long, last_id long, full boolean"


class CountWindow(StatefulProcessor):
    """Every `size` ids of a key make a row. State is a list of at most size - 1 ids and, with `idle`, a timer."""

    def __init__(self, size: int, idle: int | None):
        self.size, self.idle = size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "event_id bigint")

    def _row(self, key, batch: list[int]) -> dict:
        return {"platform": key[0], "n": len(batch), "first_id": batch[0], "last_id": batch[-1], "full": len(batch) == self.size}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [i for (i,) in self.ids.get()] if self.ids.exists() else []
        held += sorted(i for pdf in rows for i in pdf["event_id"].tolist())
        cut = len(held) - len(held) % self.size
        rest = held[cut:]
        self.ids.clear()
        if rest:
            self.ids.put([(i,) for i in rest])
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if rest:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if cut:
            yield pd.DataFrame([self._row(key, held[a : a + self.size]) for a in range(0, cut, self.size)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [i for (i,) in self.ids.get()] if self.ids.exists() else []
        self.ids.clear()
        if held:
            yield pd.DataFrame([self._row(key, held)])

    def close(self) -> None:
        pass


def count_windows(actions: DataFrame, size: int = 5, idle: int | None = None) -> DataFrame:
    """(platform, n, first_id, last_id, full) of a stream (platform, event_id, action_type) without idle actions; `idle`: milliseconds
    without a new one after which a short batch is put out. The session needs the state store STORE."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor as _  # noqa: F401  (Spark 4)

    got = actions.where(F.col("action_type") != "DO_NOTHING").select("platform", "event_id")
    return got.groupBy("platform").transformWithStateInPandas(CountWindow(size, idle), OUT, "Append", "None" if idle is None else "ProcessingTime")


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The short batches that a stopped stream of count_windows still holds, read from its checkpoint's state."""
    held = spark.read.format("statestore").option("stateVarName", "ids").load(checkpoint)
    ids = held.select(F.col("key")[held.schema["key"].dataType.names[0]].alias("platform"), F.col("list_element.event_id").alias("event_id"))
    return ids.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).withColumn("full", F.lit(False))


# ---- counters -----------------------------------------------------------------------------------------------------------


def observed(actions: DataFrame, name: str = "actions") -> DataFrame:
    """Actions, with counts of all, skipped and failed ones observed as they pass: no second read."""
    skipped = F.col("action_type") == "DO_NOTHING"
    return actions.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(skipped).alias("skipped"), F.count_if(F.col("platform").isNull()).alias("failed"))


def drain_counted(frame: DataFrame, path: str, checkpoint: str, counters: str, name: str = "actions") -> dict[str, int]:
    """Runs a stream with `observed` in it over what is there now into Parquet, and appends a row of its counts for each micro-batch to the
    table `counters`; returns the totals over all runs."""
    spark = frame.sparkSession
    query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [(str(query.id), int(p["batchId"]), *(int(p["observedMetrics"][name][k]) for k in ("seen", "skipped", "failed"))) for p in query.recentProgress if name in p["observedMetrics"]]
    if rows:
        spark.createDataFrame(rows, "query string, batch long, seen long, skipped long, failed long").coalesce(1).write.mode("append").parquet(counters)
    kept = spark.read.schema("query string, batch long, seen long, skipped long, failed long").parquet(counters)
    # A micro-batch that was run again counts once.
    once = kept.groupBy("query", "batch").agg(*[F.max(c).alias(c) for c in ("seen", "skipped", "failed")])
    return once.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "skipped", "failed")]).first().asDict()
