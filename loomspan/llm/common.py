"""What the corpus operators share: shared-folder tables, worker paths and text expressions."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a kept table may be broadcast, as `small` measures them.
BROADCAST_BYTES = 16_000_000
#: Bytes of a broadcast row beside its values: the hash table's entry and the row's header.
ROW_BYTES = 48
#: Rows to an Arrow batch: a worker and the JVM each hold one or two batches of texts.
BATCH_ROWS = 1_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: `[\x20\x09-\x0D]`
BLANKS = " \t\n\x0b\x0c\r"
#: Java form of the separators around `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text already lower-cased.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same, for bytes.translate: separators become blanks, A-Z become a-z, the rest stays.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset is accepted in local mode only, where a temporary folder serves."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='loomspan-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder, now or when the JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if at_exit else fs.delete(p, True)


class Tables:
    """Intermediate tables in the shared folder. They cut lineage and survive lost executors.

    `keep` writes and rereads one; `drop` deletes one that nothing reads any more; the rest go when the JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        remove(self.spark, path, at_exit=True)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.loomspan_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "loomspan_path", None):
            remove(self.spark, path)


def with_workers(spark: SparkSession) -> None:
    """Lets Python workers import this library when only the driver's sys.path names it, gives them batches of few rows (unless the
    session sets a size of its own), and has them return freed memory to the system, as they are reused from stage to stage."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for name, value in {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "64000000", "MALLOC_MMAP_THRESHOLD_": "32000000", "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1"}.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def bytes_of(df: DataFrame) -> int:
    """What a table takes when it is broadcast: fixed widths by type, strings and binaries as measured."""
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if odd := [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]:
        raise ValueError(f"no bound on the size of {odd}")
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(ROW_BYTES + 8 * len(df.columns)))
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` marked for broadcast when it takes at most `most` bytes (BROADCAST_BYTES), else marked for a join by shuffle. Reads it: pass
    a kept table."""
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if most is None else most) else df.hint("merge")


def make_way(df: DataFrame, *names: str) -> DataFrame:
    """`df` with its columns of these names, which an operator adds or uses inside, renamed: _0 (or the next free number) is put behind."""
    taken, wanted = {c.lower() for c in df.columns}, {n.lower() for n in names}
    for c in [c for c in df.columns if c.lower() in wanted]:
        k = 0
        while f"{c}_{k}".lower() in taken:
            k += 1
        df = df.withColumnRenamed(c, f"{c}_{k}")
        taken.add(f"{c}_{k}".lower())
    return df


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a bounded number of rows from a literal: made on the JVM alone."""
    text = json.dumps([dict(zip((f.strip().split(" ")[0] for f in schema.split(",")), r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("r.*")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
