"""A corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read as the next one's docs. Documents that
score as toxic go; lines found in ten documents or more go from the texts; one document of each group of near copies (five words to
a shingle, a similarity of 0.8 or more) stays; documents that the benchmark contaminates go; the last stage encodes and decodes what
is left. Columns beside doc_id, text and n_chars pass through under any names. Rows without doc_id stay in near dedup.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm import bpe, decontam, linededup, neardup, toxicity
from loomspan.llm.common import Tables, remove, shared_folder, table

OWN = ("doc_id", "text", "n_chars")


def aside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with docs' other columns under names that no operator uses, and all columns of docs in place again."""
    names = [c if c in OWN else f"other {i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*[f"`{c}`" for c in names]).toDF(*docs.columns)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return aside(docs, lambda d: toxicity.score(d, model).where(F.col("_score") < 0.5))


def common_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(d: DataFrame) -> DataFrame:
        out = linededup.drop_common_lines(d)
        return out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else out

    return aside(docs, stage)


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the least id stays. Rows that share an id are one document where their texts are the same (the
    greatest row stays), else each text is one, under a name of its own below all ids."""
    tables = Tables(spark)
    hashed = F.xxhash64("text")
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("lo"), F.max(hashed).alias("hi"))
    seen = tables.keep(ids.where(F.col("n") > 1).select("doc_id", (F.col("lo") != F.col("hi")).alias("mixed")), "seen")

    def only_first(d: DataFrame, name: str) -> DataFrame:
        # Joined by a shuffle at every size: both tables grow with the input.
        copies = tables.keep(neardup.near_duplicates(d, id_col=name).where(~F.col("kept")).select(name), "copies").hint("merge")
        return d.join(copies, name, "left_anti")

    def stage(d: DataFrame) -> DataFrame:
        if not seen.limit(1).count():
            return only_first(d, "doc_id")
        whole = isinstance(d.schema["doc_id"].dataType, T.IntegralType)
        own = -1 - F.shiftright(F.xxhash64("doc_id", "text"), 2).bitwiseAND(2**61 - 1) if whole else F.concat(F.lit(" "), "doc_id", F.hex(hashed))
        named = d.join(seen.hint("merge"), "doc_id", "left").withColumn("name", F.when(F.col("mixed"), own).otherwise(F.col("doc_id").cast("long" if whole else "string")))
        left = only_first(named, "name")
        best = left.where(F.col("mixed").isNotNull()).groupBy("name").agg(F.max(F.struct(*[f"`{c}`" for c in d.columns])).alias("r")).select("r.*")
        return left.where(F.col("mixed").isNull()).select(*[f"`{c}`" for c in d.columns]).unionByName(best)

    return aside(docs, stage)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return aside(docs, lambda d: decontam.judged(decontam.find_contamination(d, benchmark)).where(~F.col("contaminated")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", common_lines_go),
    ("near dedup", near_copies_go),
    ("decontamination", contaminated_documents_go),
    ("tokens", tokens),
]

#: A trained machine decides in the first stage and a tokenizer in the last, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's folder goes when the next one is written; the last one's when the JVM ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if before:
            remove(spark, before)
        before = f"{folder}/{k}"
    remove(spark, folder, at_exit=True)
    return docs
