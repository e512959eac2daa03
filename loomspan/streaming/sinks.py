"""Sinks and queues over files: episodes written once by commit and abort, commands read one file a trigger."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

EPISODE = "platform string, agent_id long, text string"


@dataclass
class Written(WriterCommitMessage):
    draft: str
    rows: int


class EpisodeSink(DataSource):
    """`writeStream.format("episodes")`: batches of rows (platform, agent_id, text) as JSON lines in a folder that driver and executors
    share. Tasks write drafts; a micro-batch's drafts become episodes/<batch>/ in one rename when all tasks are done, and a batch that
    is there already is not written again. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "episodes"

    def schema(self) -> str:
        return EPISODE

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return EpisodeWriter(self.options["path"])


class EpisodeWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = os.path.join(self.path, "drafts")
        os.makedirs(folder, exist_ok=True)
        draft, rows = os.path.join(folder, f"{uuid.uuid4().hex}.jsonl"), 0
        with open(draft, "w", encoding="utf-8") as f:
            for r in iterator:
                f.write(json.dumps(r.asDict(), ensure_ascii=False) + "\n")
                rows += 1
        return Written(draft, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        done, made = os.path.join(self.path, "episodes", str(batchId)), os.path.join(self.path, "drafts", f"batch-{batchId}-{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(done), exist_ok=True)
        if not os.path.exists(done):
            os.makedirs(made)
            for k, m in enumerate(m for m in messages if m):
                os.rename(m.draft, os.path.join(made, f"part-{k:05d}.jsonl"))
            os.rename(made, done)
        else:
            self.abort(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        for m in messages:
            if m and os.path.exists(m.draft):
                os.remove(m.draft)


def write_episodes(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Drains a stream (platform, agent_id, text) into the sink, each row once."""
    frame.sparkSession.dataSource.register(EpisodeSink)
    frame.writeStream.format("episodes").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed batches."""
    return spark.read.schema(EPISODE).json(f"{path}/episodes/*")


# ---- commands -----------------------------------------------------------------------------------------------------------

COMMAND = "command_id string, command_type string, args string, timestamp string"
TYPES = ("interview", "batch_interview", "close_env")


def command_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """(file, modified, command_id, command_type, args, reason) of a folder of JSON files, one command each: `files` of them a trigger, the
    oldest first. reason says what is wrong with a file, null if nothing is; args stay JSON."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files).option("latestFirst", False).option("pathGlobFilter", "*.json").load(folder)
    v = F.try_parse_json("value")
    field = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    reason = F.when(v.isNull(), "not JSON").when(field("command_id").isNull(), "no command_id").when(field("command_type").isNull(), "no command_type").when(~field("command_type").isin(*TYPES), "unknown type")
    args = F.to_json(F.try_variant_get(v, "$.args", "variant"))
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), field("command_id").alias("command_id"), field("command_type").alias("command_type"), args.alias("args"), reason.alias("reason"))


def run_commands(commands: DataFrame, handle: Callable[[DataFrame, int], None], rejected: str, checkpoint: str) -> None:
    """Calls handle(batch, number) with the commands that are right, trigger by trigger; the others go to the folder `rejected` as JSON
    lines with their reason, under the trigger's number, so that a repeated trigger writes them once."""

    def run(batch: DataFrame, number: int) -> None:
        bad = batch.where(F.col("reason").isNotNull())
        if bad.limit(1).count():
            bad.select("file", "modified", "reason").coalesce(1).write.mode("overwrite").json(f"{rejected}/trigger={number}")
        good = batch.where(F.col("reason").isNull()).drop("reason")
        if good.limit(1).count():
            handle(good, number)

    commands.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
