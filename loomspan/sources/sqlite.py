"""`spark.read.format("sqlite_rows")`: a table of an SQLite file that driver and executors can open, read in ranges of rowids.

Options: path, table, partitions (8), after (only rows whose rowid is above), pushdown. The first column is _rowid. With pushdown, which
sqlite_rows sets where the session has spark.sql.python.filterPushdown.enabled, comparisons with constants, IN and null tests on single
columns go into the file's SQL; ranges
are cut between the least and the greatest rowid, so gaps make some of them short and no row is read twice. The file is opened read-only."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def kind_of(declared: str) -> str:
    """The type of a declared column, by SQLite's rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "double"
    return "binary" if "BLOB" in d else "string"


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        with opened(self.options["path"]) as c:
            columns = c.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(["_rowid bigint", *(f"`{name}` {kind_of(declared)}" for _, name, declared, *_ in columns)])

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.count = options["path"], options["table"], int(options.get("partitions", 8))
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema]
        self.where: list[tuple[str, list]] = [("rowid > ?", [int(options["after"])])] if "after" in options else []

    def _rows(self, select: str, more: str = "", values: tuple = ()) -> sqlite3.Cursor:
        parts = [w for w, _ in self.where] + ([more] if more else [])
        where = f" where {' and '.join(parts)}" if parts else ""
        return opened(self.path).execute(f"select {select} from {quoted(self.table)}{where}", [*(x for _, v in self.where for x in v), *values])

    def partitions(self) -> list[InputPartition]:
        low, high = self._rows("min(rowid), max(rowid)").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.count))
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        as_kind = {"bigint": int, "double": float, "string": str, "binary": bytes}
        convert = [as_kind[k] for _, k in self.fields]
        columns = ", ".join("rowid" if n == "_rowid" else quoted(n) for n, _ in self.fields)
        for row in self._rows(columns, "rowid >= ? and rowid < ?", (partition.low, partition.high)):
            yield tuple(None if v is None else f(v) for f, v in zip(convert, row, strict=True))


class PushingReader(SqliteReader):
    """The reader where the session pushes filters into Python sources: Spark refuses it elsewhere."""

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            named = "rowid" if column == "_rowid" else quoted(column or "")
            if column and type(f) in OPERATORS:
                self.where.append((f"{named} {OPERATORS[type(f)]} ?", [f.value]))
            elif column and isinstance(f, In):
                self.where.append((f"{named} in ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column and isinstance(f, IsNotNull | IsNull):
                self.where.append((f"{named} is {'not ' * isinstance(f, IsNotNull)}null", []))
            else:
                yield f


def sqlite_rows(spark: SparkSession, path: str, table: str, after: int | None = None, partitions: int = 8) -> DataFrame:
    """Rows of a table, with _rowid; `after`: only those added since."""
    spark.dataSource.register(SqliteSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("sqlite_rows").option("pushdown", pushed).option("path", path).option("table", table).option("partitions", partitions)
    return (reader if after is None else reader.option("after", after)).load()


def actions_after(spark: SparkSession, path: str, after: int = 0, quiet: tuple[str, ...] = ("refresh", "sign_up")) -> tuple[DataFrame, int]:
    """Trace rows added after a rowid, without the quiet actions, and the rowid to go on from (which counts quiet rows too)."""
    rows = sqlite_rows(spark, path, "trace", after)
    last = rows.agg(F.max("_rowid")).first()[0]
    return rows.where(~F.col("action").isin(*quiet)), after if last is None else last


def interviews(spark: SparkSession, path: str, agent: int | None = None) -> DataFrame:
    """Interview rows of a trace, the newest first, with prompt and response out of their JSON."""
    rows = sqlite_rows(spark, path, "trace").where(F.col("action") == "interview")
    rows = rows if agent is None else rows.where(F.col("user_id") == agent)
    info = F.col("info")
    return rows.select("_rowid", F.col("user_id").alias("agent_id"), F.get_json_object(info, "$.prompt").alias("prompt"), F.get_json_object(info, "$.response").alias("response"), F.col("created_at").alias("timestamp")).orderBy(F.desc("_rowid"))
