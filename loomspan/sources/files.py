"""Sources and sinks: panels, result files, action logs, simulation documents, vintages and a polling table source."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDE_DATE = "date"


def wide_csv(spark: SparkSession, path: str, assets: list[str], value: str = "px", key: str = "asset") -> DataFrame:
    """A CSV with a date column and one column an asset, as a long panel; missing cells go."""
    schema = ", ".join([f"`{WIDE_DATE}` date", *(f"`{a}` double" for a in assets)])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide.unpivot([WIDE_DATE], assets, key, value).withColumnRenamed(WIDE_DATE, "dt").where(F.col(value).isNotNull())


#: Columns of experiment results; files have either set, told apart by their header.
RESULTS = "experiment string, sharpe double, sortino double, ic double, dir_acc double, ann_return double, ann_vol double, max_dd double, total double, time_s double, description string"


def results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files of differing columns by name, tagged with their file. Descriptions may span lines."""
    frames = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p).withColumn("source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)) for p in paths]
    frames = [f.withColumnRenamed("desc", "description") if "desc" in f.columns else f for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    numbers = [c.split()[0] for c in RESULTS.split(", ") if c.endswith("double")]
    return out.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numbers if c in out.columns})


def top_results(results: DataFrame, n: int = 5, by: str = "sharpe") -> DataFrame:
    return results.orderBy(F.desc(by), "experiment").limit(n)


def best_result(results: DataFrame, least: float = 0.0, by: str = "sharpe") -> DataFrame:
    """The first row, or none when it is below `least`: the test comes after the limit."""
    return top_results(results, 1, by).where(F.col(by) >= least)


ROUND = "struct<round:int,date:string,agent_signals:map<string,array<double>>,ensemble:array<double>,agreement:double,market_state:struct<vix:double,regime:string>>"


def simulation(spark: SparkSession, path: str) -> DataFrame:
    """Rounds of one JSON document: round, dt, agent_signals, ensemble, agreement, market_state."""
    doc = spark.read.schema(f"rounds array<{ROUND}>").option("multiLine", True).json(path)
    out = doc.select(F.explode("rounds").alias("r")).select("r.*")
    return out.select("round", F.to_date("date").alias("dt"), "agent_signals", "ensemble", "agreement", "market_state")


def weights(spark: SparkSession, path: str, rounds: DataFrame) -> DataFrame:
    """(dt, asset, weight): a JSON array of maps, zipped by position with the rounds' dates; the longer side's rest goes."""
    maps = spark.read.schema("w string").text(path, wholetext=True).select(F.from_json("w", "array<map<string,double>>").alias("a"))
    rows = maps.select(F.posexplode("a").alias("i", "m"))
    dated = rounds.select("dt", (F.row_number().over(Window.orderBy("round")) - 1).alias("i"))
    return dated.join(rows, "i").select("dt", F.explode("m").alias("asset", "weight"))


ACTION = "round int, timestamp string, platform string, agent_id long, agent_name string, action_type string, action_args map<string,string>, result string, success boolean, event_type string, _corrupt_record string"


def action_log(spark: SparkSession, paths: str | list[str], platform: str | None = None, agent: int | None = None, round_num: int | None = None) -> DataFrame:
    """JSON lines without blanks, broken lines, events and rows without agent; the platform is the row's, else its folder's."""
    got = spark.read.schema(ACTION).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    got = got.withColumn("platform", F.coalesce("platform", folder))
    out = got.where(F.col("_corrupt_record").isNull() & F.col("event_type").isNull() & F.col("agent_id").isNotNull()).drop("_corrupt_record", "event_type")
    for column, x in (("platform", platform), ("agent_id", agent), ("round", round_num)):
        if x is not None:
            out = out.where(F.col(column) == x)
    return out


def all_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Logs of both platforms, newest first; where there is none, the folder's own log."""
    try:
        out = action_log(spark, [f"{folder}/*/actions.jsonl"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = action_log(spark, [f"{folder}/actions.jsonl"])
    return out.orderBy(F.desc("timestamp"))


def as_known_on(vintages: DataFrame, on: str) -> DataFrame:
    """vintages: series, dt, value, known_from, known_until (null: still). Values as known on a date."""
    d = F.lit(on).cast("date")
    return vintages.where((F.col("known_from") <= d) & (F.col("known_until").isNull() | (d < F.col("known_until"))))


def latest_revision(vintages: DataFrame, keys: list[str], stamp: str = "known_from") -> DataFrame:
    """One row a key: the values with the greatest stamp. Pre-aggregated map-side; no window holds a key's revisions."""
    rest = [c for c in vintages.columns if c not in keys]
    return vintages.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stamp, *[c for c in rest if c != stamp])).alias("r")).select(*keys, "r.*")


def factor_file(spark: SparkSession, path: str, names: list[str], mark: str = "Mkt-RF") -> DataFrame:
    """Rows below the header line that has `mark`: yyyyMMdd dates, percents to shares; other lines go."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("v"))
    cells = {n: F.expr(f"try_cast(trim(v[{i + 1}]) as double)") / 100 for i, n in enumerate(names)}
    out = lines.select(F.to_date(F.try_to_timestamp(F.trim(F.col("v")[0]), F.lit("yyyyMMdd"))).alias("dt"), *[c.alias(n) for n, c in cells.items()])
    return out.where(F.col("dt").isNotNull()).dropna()


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of .txt, .md and .markdown files; bytes that aren't UTF-8 become Latin-1 where the file as a whole doesn't decode."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    got = got.where(F.lower("path").rlike(r"\.(txt|md|markdown)$"))
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return got.select("path", text.alias("text"))


def fresh(path: str, hours: float) -> bool:
    """Whether a local file exists and changed within `hours`."""
    import os

    return os.path.exists(path) and time.time() - os.path.getmtime(path) <= hours * 3600


def load_or_compute(spark: SparkSession, path: str, compute, overwrite: bool = False) -> DataFrame:
    """The table at `path`, computed and written first where it isn't there. Works on any file system that Spark has."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class SeriesSource(DataSource):
    """`spark.read.format("series")`: a JSON file for each series, {"series": ..., "observations": [{"date", "value"}]}; one
    partition a file, read with retries and growing pauses. Options: files (comma-separated), retries, pause."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "dt date, series string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _SeriesReader(self.options)


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.options["files"].split(",")]

    def read(self, partition) -> Iterator[tuple]:
        from datetime import date

        tries, pause = int(self.options.get("retries", 3)), float(self.options.get("pause", 0.5))
        for k in range(tries):
            try:
                with open(partition.value, encoding="utf-8") as f:
                    doc = json.load(f)
                break
            except (OSError, ValueError):
                if k == tries - 1:
                    raise
                time.sleep(pause * 2**k)
        for o in doc["observations"]:
            yield date.fromisoformat(o["date"]), doc["series"], None if o["value"] in (None, ".") else float(o["value"])


# ---- sinks --------------------------------------------------------------------------------------------------------------


def write_panel(panel: DataFrame, path: str, by: str = "asset") -> None:
    """Parquet, one folder a key; rows of a key spread over tasks by month, so a long history isn't one task's."""
    panel.repartition(by, F.trunc("dt", "MM")).write.mode("overwrite").partitionBy(by).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, appended."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def versioned_json(df: DataFrame, folder: str) -> int:
    """The next iteration_NNN and a new latest of a small report; returns the number."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    seen = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    number = 1 + max([int(n.split("_")[1]) for n in seen if n.startswith("iteration_")], default=0)
    for name in (f"iteration_{number:03d}", "latest"):
        df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    return number


def latex(df: DataFrame, caption: str = "", label: str = "", digits: int = 4, rows: int = 200) -> str:
    """A LaTeX table of a small frame; more than `rows` rows is an error, not a cut."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows for a table")
    cell = lambda x: "--" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in got)
    head = " & ".join(map(cell, df.columns))
    return "\n".join([r"\begin{table}[htbp]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", rf"{head} \\", r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"])


def summary_text(metrics: DataFrame, title: str, digits: int = 4, rows: int = 200) -> str:
    """Aligned text of a small frame: a line for each column of each row; more than `rows` rows is an error, not a cut."""
    got = metrics.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows for a summary")
    wide = max((len(c) for c in metrics.columns), default=0)
    cell = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    blocks = ["\n".join(f"{c:<{wide}} : {cell(r[c])}" for c in metrics.columns) for r in got]
    return "\n\n".join([f"{title}\n{'=' * len(title)}", *blocks]) + "\n"


# ---- calls that may fail, queues and catalogues of files ----------------------------------------------------------------


def with_retry(call, tries: int = 3, delay: float = 1.0, sleep=None):
    """call() up to `tries` times; before the k-th repeat it waits delay * 2 ** (k - 1). The last error is raised."""
    import time

    for k in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if k == tries:
                raise
            (sleep or time.sleep)(delay * 2 ** (k - 1))


def commands(spark: SparkSession, folder: str, schema: str = "command_id string, command_type string, args string") -> DataFrame:
    """Commands of a folder of JSON files, one each, with modified: the oldest first. Files that don't parse are left out."""
    got = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    got = got.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"))
    return got.where(F.col("_corrupt_record").isNull() & F.col("command_id").isNotNull()).drop("_corrupt_record").orderBy("modified", "file")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, model, ticker, kind) of files model_ticker_kind.*, kind being ret or fwd; contents are not read."""
    name = r"([^/_]+)_([^/_]+)_(ret|fwd)\.[^/]*$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    part = lambda i: F.regexp_extract("path", name, i)
    return files.where(F.col("path").rlike(name)).select("path", part(1).alias("model"), part(2).alias("ticker"), part(3).alias("kind"))
