"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of a task, about SHARD_WORDS words (a longer document is one by itself). Its words become
symbols: those that no benchmark item has can be in no window and collapse into separators, as do document borders. Separators
differ from one another, so suffixes are told apart within a run of benchmark words. All windows are searched backwards at once
through wavelet-tree ranks; occurrences are located by walking to sampled suffix positions; their spans merge.

Null and empty texts have no words; items without words have no windows. Repeated rows each get their row, repeated items each
count, an empty benchmark contaminates nothing and an empty documents table gives an empty result. Columns named as an added one are renamed
with _0 behind. Documents never move, so
no key or passage gathers anywhere. The benchmark is handled in blocks of bounded size, so what a task holds doesn't grow.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, Tables, make_way, text_of, with_workers

WINDOW = 13
SHARD_WORDS = 400_000
#: Every so many positions of a run has its suffix position stored.
SAMPLE = 8
#: UTF-8 bytes of benchmark text to a block.
BLOCK_BYTES = 16_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


class FMIndex:
    """symbols: ints from 0; each 0 is a separator of its own. The last must be 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        apart = symbols == 0
        self.separators = int(apart.sum())
        suffixes = self._sorted(symbols, apart)
        bwt = symbols[suffixes - 1]
        counts = np.bincount(symbols, minlength=2)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.n, self.bwt = n, bwt
        # Wavelet matrix: for each bit from the highest, ranks of 1 and the number of 0.
        self.levels, seq = [], bwt
        for bit in reversed(range(max(1, int(symbols.max()).bit_length()))):
            ones = (seq >> bit) & 1
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.levels.append((bit, ranks, n - int(ranks[-1])))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))
        # A walk never leaves its run: the position after each separator is sampled.
        near = np.arange(n) - np.maximum.accumulate(np.where(apart, np.arange(n), -1)) - 1
        kept = apart | (near % sample == 0)
        marked = kept[suffixes]
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.marked, self.samples = marked, suffixes[marked]

    @staticmethod
    def _sorted(symbols: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Suffix positions in order, by doubling over the suffixes that are still tied."""
        n, z = len(symbols), int(apart.sum())
        key = symbols.astype(np.int64) + z
        key[apart] = np.arange(z)
        tied, rank, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(tied):
            order = np.argsort(key, kind="stable")
            tied, key = tied[order], key[order]
            base = rank[tied]
            at = np.arange(len(tied))
            fresh = np.append(True, key[1:] != key[:-1])
            group = np.append(True, base[1:] != base[:-1])
            start = np.maximum.accumulate(np.where(fresh, at, 0))
            rank[tied] = base + start - np.maximum.accumulate(np.where(group, at, 0))
            alone = fresh & np.append(fresh[1:], True)
            tied = tied[~alone]
            depth = depth * 2 or 1
            key = rank[tied] * (n + 1) + rank[np.minimum(tied + depth, n - 1)] + 1
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        start = np.zeros(len(at), np.int64)
        for bit, ones, zeros in self.levels:
            up = ((symbol >> bit) & 1).astype(bool)
            a, b = ones[at], ones[start]
            at = np.where(up, zeros + a, at - a)
            start = np.where(up, zeros + b, start - b)
        return at - start

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, end row) of those that occur. windows: symbols, aligned right in the rows of an array."""
        live, width = np.arange(len(windows)), windows.shape[1]
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        done = []
        for step in range(width):
            c = windows[live, width - 1 - step].astype(np.int64)
            fits = c < len(self.first)
            live, lo, hi, c = live[fits], lo[fits], hi[fits], c[fits]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            there = lo < hi
            live, lo, hi = live[there], lo[there], hi[there]
            ended = sizes[live] == step + 1
            done.append((live[ended], lo[ended], hi[ended]))
            live, lo, hi = live[~ended], lo[~ended], hi[~ended]
            if not len(live):
                break
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            found = self.marked[rows]
            out[live[found]] = self.samples[self.marks[rows[found]]] + steps
            live, rows = live[~found], rows[~found]
            c = self.bwt[rows].astype(np.int64)
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


class Benchmark:
    """A block of items: its vocabulary, distinct windows, and the items of each window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple, list[int]] = {}
        self.items = ["" if i is None else str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for j in range(max(1, len(ids) - window + 1) if ids else 0):
                of = seen.setdefault(tuple(ids[j : j + window]), [])
                if not of or of[-1] != k:
                    of.append(k)
        self.sizes = np.array([len(w) for w in seen], np.int64)
        self.windows = np.zeros((len(seen), window), np.int32)
        for r, w in enumerate(seen):
            self.windows[r, window - len(w) :] = w
        self.of = list(seen.values())

    def scan(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, list[int]]]:
        """For each document of a shard: merged spans of words (start, end), and the items found."""
        sizes = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(sizes)
        starts, total = ends - sizes, int(sizes.sum())
        none = [(np.empty((0, 2), np.int64), [])] * len(docs)
        if not total or not len(self.windows):
            return none
        get = self.vocabulary.get
        words = np.fromiter((get(w, 0) for d in docs for w in d), np.int32, total)
        # Words of no item, and borders of documents, become one separator a run.
        border = np.zeros(total, bool)
        border[starts[sizes > 0]] = True
        known = words > 0
        gap = np.append(True, ~known[:-1]) | border
        lead = known & gap
        at = np.cumsum(known.astype(np.int64) + lead) - 1  # a separator goes before each run
        n = int(at[-1]) + 2
        symbols, place = np.zeros(n, np.int32), np.zeros(n, np.int64)
        symbols[at[known]] = words[known]
        place[at[known]] = np.flatnonzero(known)
        index = FMIndex(symbols)
        window, lo, hi = index.search(self.windows, self.sizes)
        if not len(window):
            return none
        count = hi - lo
        rows = np.repeat(hi - np.cumsum(count), count) + np.arange(int(count.sum()))
        which = np.repeat(window, count)
        begin = place[index.locate(rows)]
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + self.sizes[which], -1)
        hit = np.cumsum(cover[:-1]) > 0
        first = hit & np.append(True, ~hit[:-1] | border[1:])
        last = hit & np.append(~hit[1:] | border[1:], True)
        spans = np.stack((np.flatnonzero(first), np.flatnonzero(last) + 1), 1)
        doc = np.searchsorted(ends, begin, "right")
        pairs = np.unique(doc * len(self.windows) + which)
        out = list(none)
        span_doc = np.searchsorted(ends, spans[:, 0], "right")
        cuts = np.flatnonzero(np.append(True, span_doc[1:] != span_doc[:-1]))
        pair_doc = pairs // len(self.windows)
        for a, b in zip(cuts, np.append(cuts[1:], len(spans)), strict=True):
            d = int(span_doc[a])
            i, j = np.searchsorted(pair_doc, [d, d + 1])
            found = sorted({k for w in pairs[i:j] % len(self.windows) for k in self.of[w]})
            out[d] = (spans[a:b] - starts[d], found)
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_SQL = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _pass(docs: DataFrame, text_col: str, items: list[tuple], window: int, found: bool) -> DataFrame:
    names = docs.columns

    def run(batches):
        block = Benchmark(items, window)
        text, before = names.index(text_col), names.index("_found") if found else None

        def shard(b: pa.RecordBatch, docs: list[list[bytes]], a: int):
            rows = []
            for k, (words, (spans, hits)) in enumerate(zip(docs, block.scan(docs), strict=True)):
                spans, hits = [tuple(s) for s in spans.tolist()], [block.items[i] for i in hits]
                if found:
                    old = b.column(before)[a + k].as_py()
                    spans, hits = _merged(spans + [(s["start"], s["end"]) for s in old["spans"]]), hits + old["items"]
                rows.append({"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in spans], "items": hits})
            part = b.slice(a, len(docs))
            kept = [c for i, c in enumerate(part.columns) if i != before]
            return pa.RecordBatch.from_arrays([*kept, pa.array(rows, _FOUND)], names=[*(x for x in names if x != "_found"), "_found"])

        for b in batches:
            docs, size, a = [], 0, 0
            for k, x in enumerate(b.column(text)):
                docs.append(words_of(x.as_py()))
                size += len(docs[-1])
                if size >= SHARD_WORDS or k == b.num_rows - 1:
                    yield shard(b, docs, a)
                    docs, size, a = [], 0, k + 1

    fields = [f for f in docs.schema if f.name != "_found"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`_found` {_FOUND_SQL}"])
    return docs.mapInArrow(run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, *, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """`docs` with _found: n_words, merged spans of hit words (start, end), and item_ids with an occurring window.

    One pass over docs for each block of the benchmark; between passes the table is written and read again."""
    docs = make_way(docs, "_found")
    spark = docs.sparkSession
    with_workers(spark)
    bench = benchmark.select(F.col(item_col).alias("i"), text_of().alias("t")).where(F.length("t") > 0)
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tables, out, old = Tables(spark), docs, None
    blocks = _blocks(bench, size, tables)
    for k, block in enumerate(blocks):
        out = _pass(out, text_col, [tuple(r) for r in block.collect()], window, k > 0)
        if k < len(blocks) - 1:
            out = tables.keep(out, f"block{k}")
            if old is not None:
                tables.drop(old)
            old = out
    return out


def _blocks(bench: DataFrame, size: int, tables: Tables) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_BYTES: rows are dealt to bins by their place in a written table, so that equal items part,
    and bins are packed by their measured bytes. Only an item that is longer than that makes a larger part."""
    if size <= BLOCK_BYTES:
        return [bench]
    bins = 8 * math.ceil(size / BLOCK_BYTES)
    kept = tables.keep(bench.withColumn("b", F.pmod(F.xxhash64("i", "t", F.monotonically_increasing_id()), F.lit(bins))), "benchmark")
    sizes = kept.groupBy("b").agg(F.sum(F.octet_length("t")).alias("s")).orderBy("b").collect()
    packs, room = [], 0
    for r in sizes:
        if not packs or room + r["s"] > BLOCK_BYTES:
            packs, room = [*packs, []], 0
        packs[-1].append(r["b"])
        room += r["s"]
    return [kept.where(F.col("b").isin(p)).select("i", "t") for p in packs]


def judged(found: DataFrame) -> DataFrame:
    """Adds n_words, n_hit, n_items and contaminated, by the contract's rule, to find_contamination's rows."""
    found = make_way(found, "n_words", "n_hit", "n_items", "contaminated")
    hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.withColumns({"n_words": F.col("_found.n_words"), "n_hit": hit, "n_items": F.size("_found.items").cast("long")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest."""
    out = judged(find_contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", "_found"))
    digest = F.sha2(F.array_join(F.array_sort("_found.items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def sha_of_items(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SQL = r"""
with d as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select row_number() over () br, cast(item_id as varchar) item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
win as (select br, item, least(len(w), 13) m, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') t from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) p from b where len(w) > 0)),
m as (select distinct m from win),
hits as (
  select rid, p, d2.m, br, item from (
    select rid, m, p, array_to_string(w[p:p + m - 1], ' ') t from (select rid, w, m.m, unnest(range(1, len(w) - m.m + 2)) p from d, m where len(w) >= m.m)) d2
  join win on win.m = d2.m and win.t = d2.t),
cover as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + m)) q from (select distinct rid, p, m from hits)) group by rid),
its as (select rid, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct rid, br, item from hits) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cover using (rid) left join its using (rid)
"""
