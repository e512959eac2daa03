"""Text functions: normalisation, statistics, chunking, JSON repair and number formats."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomspan.config import DEFAULT


def normalised(text: Column) -> Column:
    """CRLF and CR become LF, three or more LF two; then lines and the whole are stripped (in this order)."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "\n{3,}", "\n\n")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return docs.withColumns({"chars": F.length(t).cast("long"), "lines": (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long"), "words": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("long")})


#: Where a chunk may end, in order of preference.
SEPARATORS = ["。", "！", "？", ".\n", "!\n", "?\n", "\n\n", ". ", "! ", "? "]


def chunks(text: str | None, size: int = DEFAULT.chunk[0], overlap: int = DEFAULT.chunk[1]) -> Iterator[tuple[int, str]]:
    """(number, chunk). A text of up to `size` characters is one chunk as it is. A chunk of a longer one ends after the last separator of
    the first kind that stands beyond 30 % of its size and is stripped; the next one starts `overlap` characters before that end.
    Blank chunks go."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    if not text or not text.strip():
        return
    if len(text) <= size:
        yield 0, text
        return
    # All places of each separator once, then the last one inside each chunk by bisection.
    places = [(len(mark), [m.start() for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in SEPARATORS if mark in text]
    number, begin = 0, 0
    while True:
        limit = begin + size
        if limit >= len(text):
            limit = len(text)
        else:
            last = ((starts[j - 1], width) for width, starts in places if (j := bisect_right(starts, limit - width)))
            limit = next((start + width for start, width in last if start - begin > size * 0.3), limit)
        if part := text[begin:limit].strip():
            yield number, part
            number += 1
        if limit == len(text):
            return
        begin = max(limit - overlap, begin + 1)


@udtf(returnType="chunk_no int, chunk string")
class Chunks:
    """Table function: chunks of a text."""

    def eval(self, text: str, size: int, overlap: int):
        yield from chunks(text, size, overlap)


def register(spark: SparkSession) -> None:
    """Makes text_chunks(text, size, overlap) known to SQL."""
    spark.udtf.register("text_chunks", Chunks)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = DEFAULT.chunk[0], overlap: int = DEFAULT.chunk[1]) -> DataFrame:
    """(id, chunk_no, chunk): Arrow batches, one output batch for each input batch of rows."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(i, k, part) for i, t in enumerate(b.column(1)) for k, part in chunks(t.as_py(), size, overlap)]
            taken = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "chunk_no", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk_no int, chunk string")


def repaired(text: str | None) -> str | None:
    """Truncated JSON with its open string, brackets and braces closed; null if that doesn't parse either."""
    if text is None:
        return None
    stack, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    body = (text[:-1] if skip else text) + '"' * quoted
    for tail in ("", "null", ": null"):
        try:
            out = body.rstrip().rstrip(",") + tail + "".join(reversed(stack))
            json.loads(out)
            return out
        except ValueError:
            continue
    return None


def repair_json(docs: DataFrame, column: str) -> DataFrame:
    """Rows that parse stay as they are on the JVM; the rest go through `repaired` in Arrow batches."""
    import pandas as pd

    fix = F.pandas_udf(lambda s: pd.Series([repaired(x) for x in s]), "string")
    broken = F.col(column).isNotNull() & F.try_parse_json(column).isNull()
    good, bad = docs.where(~broken), docs.where(broken)
    return good.unionByName(bad.withColumn(column, fix(column)))


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def experiment_config(name: Column) -> dict[str, Column]:
    """Fields that an experiment's name spells out, with defaults: model, maximum weight, cost, aversion."""
    models = ["lgbm", "xgb", "ridge", "lasso", "elastic", "svr", "mlp", "rf", "gb", "ensemble"]
    low, model = F.lower(name), F.lit("lgbm")
    for m in reversed(models):
        model = F.when(low.contains(m), m).otherwise(model)
    number = lambda pattern, otherwise: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")), F.lit("999")).cast("double"), F.lit(float(otherwise)))
    return {"model": model, "max_weight": number(r"maxw(\d+)", 35) / 100, "cost_bps": number(r"tc(\d+)", 10), "aversion": number(r"(?:lambda|ra)(\d+)", 5)}


#: Synonyms and the canonical name.
GENDERS = {"m": "male", "man": "male", "male": "male", "男": "male", "f": "female", "woman": "female", "female": "female", "女": "female"}


def gender(c: Column) -> Column:
    out = F.lit("other")
    for k, v in GENDERS.items():
        out = F.when(F.lower(F.trim(c)) == k, v).otherwise(out)
    return out


def username(name: Column) -> Column:
    """Lower case, blanks as _, letters, digits and _ only, and three digits from a hash of the name."""
    base = F.regexp_replace(F.regexp_replace(F.lower(name), " ", "_"), "[^a-z0-9_]", "")
    return F.concat(base, F.lit("_"), (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 900 + 100).cast("string"))


def documents_joined(docs: DataFrame, by: str, name: str = "doc_id", text: str = "text") -> DataFrame:
    """One text a group: `=== doc i: name ===` before each document, blank lines between. A group is one output text."""
    from pyspark.sql import Window

    numbered = docs.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(name)))
    part = F.concat(F.lit("=== doc "), F.col("_i").cast("string"), F.lit(": "), F.col(name).cast("string"), F.lit(" ===\n"), F.col(text))
    return numbered.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("joined"))
