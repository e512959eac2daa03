"""Ranked lexical search: every document against a set of queries, by integer impacts.

Documents stay where they are: a task's documents are a shard. Its postings (for the terms that some query has; no other term can
score) are compressed rows, a term's documents and impacts side by side, each impact computed once. Queries go term at a time: a
term's impacts are added into a dense array of scores. The k best are selected with argpartition; of the documents that tie with the
k-th those of the least ids are taken. Shards' lists are merged in Spark, first in parts dealt by hash of the id, then whole.

Two passes over the documents are made for each block of queries (QUERY_BYTES of text): document frequencies and lengths, then
scores. What a task holds is a block's vocabulary and one shard's postings (at most SHARD_HITS), however long the corpus.

Null and empty texts have no terms: such documents are not counted in N and score nothing, such queries return no rows. Each row of the
documents ranks by itself, rows of one id too; a null id comes after all others among ties. Repeated queries each get their rows. No
documents or no queries give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, text_of, with_workers
from .decontam import words_of

K = 50
#: Fixed values of the score: length normalisation, in hundredths, and the scale of an impact.
LEVEL, SLOPE, SCALE, TF, SATURATION = 100, 50, 1_000_000_000, 1000, 20
#: UTF-8 bytes of query text to a block.
QUERY_BYTES = 16_000_000
#: Postings and documents of a shard; a task with more has several shards.
SHARD_HITS, SHARD_DOCS = 16_000_000, 500_000
#: Parts in which shards' lists are merged before an item's meet.
PARTS = 16


class Vocabulary:
    """Terms of a block of queries by number, and each query's different terms."""

    def __init__(self, texts: list[str]):
        self.terms: dict[bytes, int] = {}
        self.queries = [sorted({self.terms.setdefault(w, len(self.terms)) for w in words_of(t)}) for t in texts]

    def hits(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """A document's length, its terms that queries have, and their occurrences."""
        words = words_of(text)
        ids = np.fromiter((i for i in map(self.terms.get, words) if i is not None), np.int64)
        return len(words), *np.unique(ids, return_counts=True)


def weight(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)


class Shard:
    """Postings by term of documents, which are numbered in the order that decides ties."""

    def __init__(self, docs: int, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n: int, total: int):
        order = np.argsort(term, kind="stable")
        self.docs, self.doc = docs, doc[order]
        term, tf = term[order], tf[order]
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        norm = LEVEL - SLOPE + (SLOPE * lengths * n) // total
        self.impact = weights[term] * ((SCALE * tf) // (TF * tf + SATURATION * norm[self.doc]))

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents above 0, and no others."""
        score = np.zeros(self.docs, np.int64)
        for t in terms:
            a, b = self.starts[t], self.starts[t + 1]
            score[self.doc[a:b]] += self.impact[a:b]
        found = np.flatnonzero(score)
        if len(found) > k:
            got = score[found]
            least = got[np.argpartition(got, len(got) - k)[len(got) - k]]
            above, ties = found[got > least], found[got == least]
            found = np.concatenate((above, ties[: k - len(above)]))
        return found, score[found]


def _blocks(queries: DataFrame, item_col: str, text_col: str) -> list[list]:
    """The queries by blocks of bounded bytes: rows of id, text and how often both are there."""
    q = queries.select(F.col(item_col).alias("i"), text_of(text_col).alias("t")).where(F.length("t") > 0).groupBy("i", "t").agg(F.count(F.lit(1)).alias("c"))
    size = q.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size <= QUERY_BYTES:
        return [q.collect()] if size else []
    tables = Tables(queries.sparkSession)
    kept = tables.keep(q.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * math.ceil(size / QUERY_BYTES)))), "queries")
    sizes = {r["b"]: r["s"] for r in kept.groupBy("b").agg(F.sum(F.octet_length("t")).alias("s")).collect()}
    packs, room = [], 0
    for b, s in sorted(sizes.items()):
        if not packs or room + s > QUERY_BYTES:
            packs, room = [*packs, []], 0
        packs[-1].append(b)
        room += s
    return [kept.where(F.col("b").isin(p)).collect() for p in packs]


def statistics(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the vocabulary, over all documents."""
    v, size = vocabulary, len(vocabulary.terms)

    def run(batches):
        counts, n, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            for x in b.column(0):
                length, terms, _ = v.hits(x.as_py())
                counts[terms] += 1
                n, total = n + (length > 0), total + length
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen]), pa.array([n, total, *counts[seen]])], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    frequency = np.zeros(size, np.int64)
    for t, n in found.items():
        if t >= 0:
            frequency[t] = n
    return found.get(-2, 0), found.get(-1, 0), frequency


def _shard_lists(docs: DataFrame, vocabulary: Vocabulary, stats: tuple[int, int, np.ndarray], k: int, id_col: str, text_col: str) -> DataFrame:
    """(query, doc_id, score): the k best of each shard for each query, by number."""
    v, (n, total, frequency) = vocabulary, stats
    weights = weight(n, frequency)

    def lists(ids: list[pa.Array], lengths: list[int], terms: list[np.ndarray], tfs: list[np.ndarray]) -> pa.RecordBatch:
        ids = pa.concat_arrays(ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc = np.repeat(number, [len(t) for t in terms])
        shard = Shard(len(order), np.array(lengths, np.int64)[order], doc, np.concatenate(terms), np.concatenate(tfs), weights, n, total)
        got = [shard.best(q, k) for q in v.queries]
        which = np.repeat(np.arange(len(got)), [len(d) for d, _ in got])
        docs, scores = (np.concatenate([x[i] for x in got]) if got else np.empty(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), ids.take(pa.array(order[docs])), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    def run(batches):
        ids, lengths, terms, tfs, size = [], [], [], [], 0
        for b in batches:
            ids.append(b.column(0))
            for x in b.column(1):
                length, t, tf = v.hits(x.as_py())
                lengths.append(length)
                terms.append(t)
                tfs.append(tf)
                size += len(t)
            if size >= SHARD_HITS or len(lengths) >= SHARD_DOCS:
                yield lists(ids, lengths, terms, tfs)
                ids, lengths, terms, tfs, size = [], [], [], [], 0
        if lengths:
            yield lists(ids, lengths, terms, tfs)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"query long, doc_id {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    with_workers(spark)
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    kind, item = docs.schema[id_col].dataType.simpleString(), queries.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long")
    for rows in _blocks(queries, item_col, query_col):
        v = Vocabulary([r["t"] for r in rows])
        stats = statistics(docs, v, text_col)
        if not stats[0] or not v.terms:
            continue
        found = _shard_lists(docs, v, stats, k, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
        parts = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*best))).where(F.col("r") <= k)
        top = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r["i"], r["c"]) for n, r in enumerate(rows)], f"query long, item_id {item}, c int")
        named = top.join(F.broadcast(names), "query").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("c"))))
        out = out.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return out


def ranked_search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's result."""
    return search(docs, benchmark)


SQL = r"""
with d as (
  select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w
  from documents
), q as (
  select row_number() over () qid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) w
  from benchmark
), s as (select count(*) big_n, sum(len(w))::bigint big_l from d where len(w) > 0),
m as (select rid, doc_id, 100 - 50 + (50 * len(w) * big_n) // big_l m from d, s where len(w) > 0),
p as (select rid, t, count(*) tf from (select rid, unnest(w) t from d) group by rid, t),
f as (select t, count(*) df from p group by t),
i as (
  select rid, t, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * m)) impact
  from p join f using (t) join m using (rid), s
), r as (
  select qid, item_id, rid, doc_id, sum(impact)::bigint score
  from (select qid, item_id, unnest(w) t from q) join i using (t) join m using (rid) group by qid, item_id, rid, doc_id having sum(impact) > 0
), k as (select *, row_number() over (partition by qid order by score desc, doc_id nulls last) as rank from r)
select item_id, rank::integer as rank, doc_id, score from k where rank <= 50
"""
