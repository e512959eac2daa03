"""Fitted models as versioned artefacts: a folder a version, a table of what is known of each, and a pointer to the latest.

    folder/name/v000001/model     what Spark ML's writer writes
    folder/name/v000001/about     one JSON row: name, version, created, metrics, parameters
    folder/name/latest            the version's number, moved into place when all is written

Paths are of any file system that Spark has."""

from __future__ import annotations

import json
import time
import uuid
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ABOUT = "name string, version long, created timestamp, metrics map<string,double>, parameters map<string,string>"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Complete versions, in order: those with a row about them."""
    fs, root, path = _fs(spark, f"{folder}/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[1:]) for n in found if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{folder}/{name}/{n}/about/_SUCCESS")))


def save_model(spark: SparkSession, model: PipelineModel, folder: str, name: str, metrics: dict[str, float] | None = None, parameters: dict[str, str] | None = None) -> int:
    """Writes the next version and then makes it the latest; returns its number. A writer that stops midway leaves the old latest."""
    fs, root, path = _fs(spark, f"{folder}/{name}")
    fs.mkdirs(root)
    number = 1 + max((int(n[1:]) for s in fs.listStatus(root) if (n := s.getPath().getName()).startswith("v") and n[1:].isdigit()), default=0)
    at = f"{folder}/{name}/v{number:06d}"
    model.write().overwrite().save(f"{at}/model")
    about = json.dumps({"name": name, "version": number, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "metrics": metrics or {}, "parameters": parameters or {}})
    spark.range(1).select(F.lit(about).alias("value")).coalesce(1).write.mode("overwrite").text(f"{at}/about")
    set_latest(spark, folder, name, number)
    return number


def set_latest(spark: SparkSession, folder: str, name: str, number: int) -> None:
    """Points to a version, by renaming a file that is written whole."""
    fs, _, path = _fs(spark, f"{folder}/{name}")
    draft, latest = path(f"{folder}/{name}/.latest-{uuid.uuid4().hex}"), path(f"{folder}/{name}/latest")
    out = fs.create(draft, True)
    out.write(str(number).encode())
    out.close()
    if not fs.rename(draft, latest):  # file systems that don't rename onto a file
        fs.delete(latest, False)
        if not fs.rename(draft, latest):
            raise OSError(f"{latest} can't be replaced")


def latest(spark: SparkSession, folder: str, name: str) -> int:
    return int(spark.read.text(f"{folder}/{name}/latest").first()[0])


def load_model(spark: SparkSession, folder: str, name: str, version: int | None = None) -> PipelineModel:
    return _loaded(spark, folder, name, latest(spark, folder, name) if version is None else version)


@lru_cache(maxsize=8)
def _loaded(spark: SparkSession, folder: str, name: str, version: int) -> PipelineModel:
    """The models used last stay loaded: a version never changes."""
    return PipelineModel.load(f"{folder}/{name}/v{version:06d}/model")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of every complete version of every model of a folder."""
    return spark.read.schema(ABOUT).json(f"{folder}/*/v*/about")


def best(catalogue: DataFrame, metric: str, lower_is_better: bool = True) -> DataFrame:
    """Each model's best version by a metric; of equal ones the newest."""
    value = F.col("metrics")[metric]
    order = F.struct(-value if lower_is_better else value, F.col("version"))
    return catalogue.where(value.isNotNull()).groupBy("name").agg(F.max_by("version", order).alias("version"), F.max_by(value, order).alias(metric))
