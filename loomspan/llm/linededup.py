"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position.

Rows that share a doc_id are one document when documents are counted, and each keeps its own row. A row without doc_id is a
document known by its text. Null or empty text is one empty line, which is never dropped. Extra columns stay; those named as
an added one (_n_lines, _n_dropped) or one used inside (they begin with __) are renamed with _0 behind. Nothing is capped: hot lines
are counted map-side, and only hashes of lines seen on enough rows travel further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Tables, ascii_lower, make_way, small, text_of

MIN_DOCS = 10
MIN_CHARS = 1


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hash(key):
    """128 bits of a line's key: its xxhash64 and that of the key behind a fixed mark."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("#"), key).alias("b"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with text_col rebuilt without its common lines, plus _n_lines and _n_dropped. A line is known by 128 bits of its key."""
    docs = make_way(docs, "_n_lines", "_n_dropped", "__id", "__by_text", "__key", "__gone", "__left")
    tables = Tables(docs.sparkSession)
    by_text = F.when(F.col(id_col).isNull(), F.xxhash64(text_of(text_col)))
    who, line = ["__id", "__by_text"], ["a", "b"]
    long_enough = lambda k: F.length(k) >= min_chars
    keys = F.array_distinct(F.filter(F.transform(F.split(text_of(text_col), "\n"), _key), long_enough))
    lines = docs.select(F.col(id_col).alias("__id"), by_text.alias("__by_text"), F.explode(keys).alias("__key")).select(*who, _hash("__key").alias("h")).select(*who, "h.*")
    # Enough rows is necessary for enough documents; the rare survivors are then counted by distinct document.
    often = tables.keep(lines.groupBy(*line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(*line), "often")
    hits = tables.keep(lines.join(small(often), line, "left_semi").distinct(), "hits")
    common = tables.keep(hits.groupBy(*line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(*line), "common")
    dropped = hits.join(small(common), line, "left_semi").groupBy(*who).agg(F.collect_set(F.struct(*line)).alias("__gone"))
    # Joined by a shuffle at every size: which documents have common lines grows with the input.
    dropped = tables.keep(dropped.toDF("__id2", "__by_text2", "__gone"), "dropped").hint("merge")
    for done in (often, hits, common):
        tables.drop(done)
    split = F.split(text_of(text_col), "\n")

    def kept(text):
        k = _key(text)
        return ~(long_enough(k) & F.array_contains(F.col("__gone"), _hash(k)))

    same = F.col(id_col).eqNullSafe(F.col("__id2")) & F.col("__by_text").eqNullSafe(F.col("__by_text2"))
    out = docs.withColumn("__by_text", by_text).join(dropped, same, "left").drop("__id2", "__by_text2", "__by_text")
    out = out.withColumn("__left", F.when(F.col("__gone").isNull(), split).otherwise(F.filter(split, kept)))
    out = out.withColumn("_n_lines", F.size(split).cast("long")).withColumn("_n_dropped", F.col("_n_lines") - F.size("__left"))
    return out.withColumn(text_col, F.array_join("__left", "\n")).drop("__left", "__gone")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The contract's digest: doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_common_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with l as (
  select doc_id, rid, whole, unnest(lines) line, generate_subscripts(lines, 1) pos
  from (select doc_id, row_number() over () rid, md5(coalesce(text, '')) whole, string_split(coalesce(text, ''), chr(10)) lines from documents)
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l
), c as (select key from k where length(key) >= 1 group by key having count(distinct coalesce(cast(doc_id as varchar), 'text ' || whole)) >= 10)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from (select k.*, c.key is not null gone from k left join c using (key)) group by doc_id, rid
"""
