"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

A document's set is its distinct shingles of five words. Documents of equal sets form a class, and one of each class goes on.
The k least hashes of a set are its sketch. Two sets of a Jaccard index of t or more share nearly t * k of the k least hashes
of their union, so at least SHARE(t) * k of each sketch's values but for a chance below 1e-8; each document is therefore
listed under all but SHARE * k - 1 of its values, its rarest, and a pair to link meets in a list. That keeps values of common
passages out of the lists without losing a pair.

In short lists all pairs are candidates. In a long one, each round compares one centre with all others; members already linked
in one component need no more, and centres are done. Members of lists that are still long and divided are listed anew, by sketches
of RELIST values: those are whole sets but for very long documents, so a document is listed under hardly more values than a
linked pair may differ in, and members that only share a passage leave. The rounds start again there. What is divided even then
is compared in blocks, from which only pairs that can pass come out. Candidates pass an estimate from the union's sketch, then the
exact index of the full sets. Components come from min-label propagation with pointer jumps.

A shingle is known by a 64-bit hash, so n_shingles and the index are exact but for collisions (one in 10**9 for a document of 10**5
shingles). Null or empty texts have empty sets and link with nothing. Rows that share a doc_id are one document that belongs to
the classes of all its texts; it gets the least component of those, one row, and the size of its largest set. Rows without doc_id
keep to themselves: component_id is null, kept is true. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, small, with_workers

WORDS = 5
SKETCH = 48
#: Taken off the threshold for the share of sketch values that a linked pair surely has: five deviations or more.
SLACK = 0.38
SHORT_LIST = 8
ROUNDS = 2
#: Hashes of a document to its second lists.
RELIST = 1024
#: Documents to a block of a list that stays divided.
BLOCK = 512
#: Words whose hash a task remembers, and bytes of hashes to a batch of sets.
MEMORY = 100_000
BATCH = 4_000_000


class Words(dict):
    """Hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        x = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = x
        return x


def shingles(text: str | None, width: int = WORDS, known: Words | None = None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as signed 64-bit integers."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and the blanks of ASCII only
    if not words:
        return np.empty(0, np.int64)
    known = Words() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        x = np.full(n, np.uint64(min(len(h), width)))
        for k in range(min(width, len(h))):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unique(x.view(np.int64))


def _hashed(docs: DataFrame, id_col: str, text_col: str, width: int, k: int | None) -> DataFrame:
    """(id, n, digest, s): size of a row's set, 128-bit hash of it (null if empty), its k least hashes or all. One set is held at a
    time, and what goes out in one batch is bounded by bytes or by one row."""
    with_workers(docs.sparkSession)

    def run(batches):
        known = Words()

        def packed(ids, out):
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x[2]) for x in out]))).astype(np.int32))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[2] for x in out]), pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, *columns], names=["id", "n", "digest", "s"])

        for b in batches:
            out, first, size = [], 0, 0
            for i, text in enumerate(b.column(1)):
                s = shingles(text.as_py(), width, known)
                out.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None, s if k is None else s[:k].copy()))
                size += out[-1][2].nbytes
                if size >= BATCH or i == b.num_rows - 1:
                    yield packed(b.column(0).slice(first, i + 1 - first), out)
                    out, first, size = [], i + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n long, digest string, s array<bigint>")


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """(id, n, digest, sketch): the k least hashes of each row's set."""
    return _hashed(docs, id_col, text_col, width, k).withColumnRenamed("s", "sketch")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, digest, s): the whole set of each row."""
    return _hashed(docs, id_col, text_col, width, None).drop("n")


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(id, c): the least id reachable over edges (a, b), for every id in one. Labels fall to the least among neighbours and
    then to that one's label, so long chains take few rounds. Hot ends are pre-aggregated; nothing is collected."""
    both = tables.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = tables.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("c")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = lower.join(labels.select(F.col("id").alias("c"), F.col("c").alias("far")), "c").select("id", F.least("c", "far").alias("c"), "old")
        new = tables.keep(jump, f"{name}-{step}")
        changed = new.where(F.col("c") != F.col("old")).limit(1).count()
        tables.drop(labels)
        labels = new
        if not changed:
            tables.drop(both)
            return labels


def _blocks(t: Fraction, keep: int):
    """All pairs of two blocks of a list that can pass and aren't in one component yet, each in the first list that both are in.

    v: the `keep` least hashes of a set, cut to 32 bits (which can only raise the overlap). Where both sets are whole in v, the
    index is known, and one pair for each document and component of the other block is enough; else the overlap must reach the
    threshold less six deviations of the estimate."""
    num, den = t.numerator, t.denominator
    slack = 6 * float(t * (1 - t) / keep) ** 0.5

    def run(pdf):
        import pandas as pd

        i, j, h = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["h"].iloc[0])
        sides = [pdf[pdf["block"] == i].sort_values("id"), pdf[pdf["block"] == j].sort_values("id")]
        held = [[np.asarray(v, np.int64) for v in x["v"]] for x in sides]
        sizes = [np.array([len(v) for v in x], np.int64) for x in held]
        flat = np.concatenate([v for x in held for v in x])
        _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        at, ok = column[at], count[at] > 1
        cut = int(sizes[0].sum())
        rows = [np.repeat(np.arange(len(x)), x) for x in sizes]
        common = np.zeros((len(held[0]), len(held[1])), np.float32)
        for a in range(0, int((count > 1).sum()), 4096):
            part = []
            for r, c, o, x in ((rows[0], at[:cut], ok[:cut], held[0]), (rows[1], at[cut:], ok[cut:], held[1])):
                m = np.zeros((len(x), 4096), np.float32)
                here = o & (c >= a) & (c < a + 4096)
                m[r[here], c[here] - a] = 1
                part.append(m)
            common += part[0] @ part[1].T
        n = [x["n"].to_numpy(np.int64) for x in sides]
        low, high, total = np.minimum.outer(*n), np.maximum.outer(*n), np.add.outer(*n)
        whole = high <= keep
        sure = whole & (common * (num + den) >= num * total - 1e-3)
        maybe = ~whole & (low * den >= high * num) & (common >= (float(t) - slack) * np.minimum(low, keep))
        apart = sides[0]["c"].to_numpy()[:, None] != sides[1]["c"].to_numpy()[None, :]
        x = [x["x"].to_numpy(bool) for x in sides]
        apart &= (x[0][:, None] & (n[0][:, None] <= n[1])) | (x[1][None, :] & (n[1] <= n[0][:, None]))
        lists = [[np.asarray(v, np.int64) for v in x["pre"]] for x in sides]
        ids = [x["id"].to_numpy() for x in sides]
        comp = sides[1]["c"].to_numpy()
        out, linked = [], set()
        for a, b in zip(*np.nonzero((sure | maybe) & apart), strict=True):
            if sure[a, b]:
                if (a, comp[b]) in linked:
                    continue
                linked.add((a, comp[b]))
            elif int(np.intersect1d(lists[0][a], lists[1][b]).min()) != h:
                continue
            out.append((min(ids[0][a], ids[1][b]), max(ids[0][a], ids[1][b])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: str = "0.8", *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """A row for each doc_id: id_col, n_shingles, component_id, kept. threshold: a decimal or fraction, compared exactly."""
    t, tables = Fraction(threshold), Tables(docs.sparkSession)
    rows = tables.keep(sketches(docs, id_col, text_col, width, SKETCH), "sketches")
    classes = tables.keep(rows.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("r")).select("digest", "r.*"), "classes")
    # A document with several texts can stand for several classes, so classes are known by digest; ids are their names.
    edges = _Links(classes, docs, tables, t, id_col, text_col, width).edges()
    labels = components(edges, tables, "all").select("id", "c")
    member = rows.where(F.col("id").isNotNull() & F.col("digest").isNotNull()).select("id", "digest").join(classes.select("digest", F.col("id").alias("rep")), "digest")
    member = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("c", "rep")).alias("c"))
    sizes = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("n").alias("n"))
    out = sizes.join(member, "id", "left").select("id", "n", F.coalesce("c", "id").alias("c"))
    out = out.unionByName(rows.where(F.col("id").isNull()).select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def prefixes(sets: DataFrame, keys: list[str], needed: Column, first: Column | None = None) -> DataFrame:
    """(keys, h, x): the rarest values of each row's `sketch` (m of them), all but needed - 1. Rows that share `needed` values or more
    share one of these, as all order their values alike. Values that no other row has come first and are in no list.

    x: whether the value is also among all but first - 1; the smaller one of a pair shares at least `first` values."""
    listed = sets.select(*keys, F.size("sketch").alias("m"), F.explode("sketch").alias("h"))
    often = listed.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    own = listed.join(often, "h").groupBy(*keys, "m").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))
    rest = lambda least: (F.size("own") - least + 1).cast("int")
    x = F.lit(True) if first is None else F.col("p") < rest(first)
    own = own.where(rest(needed) > 0).select(*keys, "m", "own", F.posexplode(F.slice("own", 1, rest(needed))).alias("p", "o"))
    return own.select(*keys, F.col("o.h").alias("h"), x.alias("x"))


class _Links:
    """Edges (a, b) between class representatives that hold the components together."""

    def __init__(self, classes: DataFrame, docs: DataFrame, tables: Tables, t: Fraction, id_col: str, text_col: str, width: int):
        self.classes, self.docs, self.tables, self.t = classes, docs, tables, t
        self.id_col, self.text_col, self.width = id_col, text_col, width
        self.share = max(Fraction(1, SKETCH), t - Fraction(str(SLACK)))
        self.found: DataFrame | None = None
        self.turn = 0

    def near(self, x: Column, y: Column) -> Column:
        """Sizes alone bound the index: |A and B| / |A or B| is at most the smaller over the larger."""
        return F.least(x, y) * self.t.denominator >= F.greatest(x, y) * self.t.numerator

    def able(self, a: Column, b: Column) -> Column:
        """Whether two entries (id, n, c, x) of a list can be a pair to link that this list has to find."""
        met = (a["x"] & (a["n"] <= b["n"])) | (b["x"] & (b["n"] <= a["n"]))
        return (a["c"] != b["c"]) & self.near(a["n"], b["n"]) & met

    def edges(self) -> DataFrame:
        needed = F.ceil(F.col("m") * float(self.share) - 1e-9)
        lists = self.tables.keep(prefixes(self.classes, ["id", "n"], needed).select("h", "id", "n", F.col("id").alias("c"), "x"), "lists")
        left = self._rounds(lists)
        self.tables.drop(lists)
        if left is not None:
            again = self.tables.keep(self._listed_again(left), "lists-again")
            self.tables.drop(left)
            left = self._rounds(again)
            if left is not None:
                self._check(self._in_blocks(left, again))
                self.tables.drop(left)
            self.tables.drop(again)
            self.tables.drop(self.held)
        return self.found

    def _check(self, pairs: DataFrame) -> None:
        self.turn += 1
        new = _verified(pairs.distinct(), self.classes, self.docs, self.tables, self.t, self.share, self.id_col, self.text_col, self.width, str(self.turn))
        self.found = new if self.found is None else self.found.union(new)

    def _rounds(self, lists: DataFrame) -> DataFrame | None:
        """Checks what lists (h, id, n, c, x) bring together, c being a component. Returns the kept rows (h, id, n, c, x, size) of the
        lists that stay long and divided, or None."""
        tables = self.tables
        stats = [F.count(F.lit(1)).alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("x").alias("any")]
        open_ = (F.col("size") > 1) & (F.col("c0") != F.col("c1")) & F.col("any")
        sizes = tables.keep(lists.groupBy("h").agg(*stats).where(open_).select("h", "size"), "sizes")
        short = lists.join(sizes.where(F.col("size") <= SHORT_LIST).select("h"), "h").groupBy("h").agg(F.collect_list(F.struct("id", "n", "c", "x")).alias("g"))
        partners = lambda x: F.filter("g", lambda y: (x["id"] < y["id"]) & self.able(x, y))
        pair = F.flatten(F.transform("g", lambda x: F.transform(partners(x), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
        pairs = short.select(F.explode(pair).alias("p")).select("p.a", "p.b")
        long = tables.keep(lists.join(sizes.where(F.col("size") > SHORT_LIST).select("h"), "h").select("h", "id", "n", "c", "x"), "long")
        # A document in many long lists stands in the middle of a large group: it makes the better centre.
        state = tables.keep(long.join(long.groupBy("id").agg(F.count(F.lit(1)).alias("deg")), "id"), f"state-{self.turn}")
        tables.drop(long)
        entry = F.struct("id", "n", "c", "x")
        order = F.struct((~F.col("x")).alias("late"), (-F.col("deg")).alias("d"), F.xxhash64("id").alias("r"), entry.alias("e"))
        for k in range(ROUNDS + 1):
            heads = state.groupBy("h").agg(*stats, F.min(order).alias("o"))
            heads = tables.keep(heads.where(open_).select("h", "size", F.col("o.e").alias("head")), f"heads-{self.turn}")
            more = heads.limit(1).count() > 0
            divided = state.join(heads, "h")
            if k == ROUNDS:
                if not k:
                    self._check(pairs)
                left = tables.keep(divided.select("h", "id", "n", "c", "x", "size"), f"left-{self.turn}") if more else None
                break
            star = divided.where(self.able(entry, F.col("head")))
            star = star.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"))
            if not k:
                self._check(pairs.union(star))
            elif more:
                self._check(star)
            if not more:
                left = None
                break
            labels = components(self.found, tables, f"c{self.turn}")
            rest = divided.where(F.col("id") != F.col("head.id")).select("h", "id", "n", "c", "x", "deg")
            rest = rest.join(labels.select("id", F.col("c").alias("now")), "id", "left")
            new = tables.keep(rest.select("h", "id", "n", F.coalesce("now", "c").alias("c"), "x", "deg"), f"state-{self.turn}")
            for done in (state, heads, labels):
                tables.drop(done)
            state = new
        for done in (state, heads, sizes):
            tables.drop(done)
        return left

    def _listed_again(self, left: DataFrame) -> DataFrame:
        """Lists (h, id, n, c, x) of the members of divided lists, by RELIST hashes. A pair to link that isn't in one component yet has
        both ends among them. Whole sets share t of the larger one, which is 2 t / (1 + t) of the smaller one at least; sketches of
        k hashes share six deviations less than t of them."""
        t, ids = float(self.t), self.tables.keep(left.groupBy("id").agg(F.min("c").alias("c")), "ids-again")
        slack = F.ceil(F.col("m") * max(t - 6 * (t * (1 - t) / RELIST) ** 0.5, 1 / RELIST) - 1e-9)
        whole = F.col("n") <= F.floor(F.lit(RELIST * t))
        share = lambda x: F.when(whole, F.ceil(F.col("n") * x.numerator / F.lit(x.denominator) - 1e-9)).otherwise(slack)
        self.held = self.tables.keep(self._again(ids.select("id")), "sets-again")
        lists = prefixes(self.held, ["id", "digest", "n"], share(self.t), share(2 * self.t / (1 + self.t)))
        return lists.join(ids, "id").select("h", "id", "n", "c", "x")

    def _again(self, ids: DataFrame) -> DataFrame:
        """Sketches of RELIST values, for the classes that these ids stand for."""
        texts = self.docs.select(self.id_col, self.text_col).join(small(ids.withColumnRenamed("id", self.id_col)), self.id_col, "left_semi")
        held = sketches(texts, self.id_col, self.text_col, self.width, RELIST).dropDuplicates(["id", "digest"])
        return held.join(self.classes.select("id", "digest"), ["id", "digest"], "left_semi")

    def _in_blocks(self, left: DataFrame, lists: DataFrame) -> DataFrame:
        """Candidate pairs of lists that are long and divided still: blocks of a list's members, all against all in one group each."""
        tables = self.tables
        ids = tables.keep(left.select("id").distinct(), "rest-ids")
        held = self.held.join(small(ids), "id", "left_semi").select("id", "n", F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("v"))
        own = lists.join(small(ids), "id", "left_semi").groupBy("id").agg(F.collect_set("h").alias("pre"))
        held = tables.keep(held.join(own, "id"), "rest-sets")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = left.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
        dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
        dealt = dealt.join(held, ["id", "n"]).select("h", "id", "n", "c", "x", "v", "pre", "block", "i", "j")
        kind = lists.schema["id"].dataType.simpleString()
        # Groups take work beyond their bytes, so their number sets the tasks and not the size of what is shuffled.
        groups = left.select("h", "size").distinct().agg(F.sum(F.ceil(F.col("size") / BLOCK) * (F.ceil(F.col("size") / BLOCK) + 1) / 2)).first()[0]
        tasks = int(min(max(groups // 4, 1), 10_000))
        return dealt.repartition(tasks, "h", "i", "j").groupBy("h", "i", "j").applyInPandas(_blocks(self.t, RELIST), f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, tables: Tables, t: Fraction, share: Fraction, id_col: str, text_col: str, width: int, turn: str) -> DataFrame:
    pairs = tables.keep(pairs, f"pairs-{turn}")
    used = tables.keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), f"used-{turn}")
    of = classes.join(small(used), "id", "left_semi")
    side = lambda x: of.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("digest").alias(f"d{x}"))
    size = lambda s: F.size(F.col(s))
    low: Column = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, F.greatest(F.least(F.lit(SKETCH), F.greatest(size("sa"), size("sb"))), F.lit(1)))
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), low))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(both >= F.size(low) * float(share) - 1e-6)
    likely = tables.keep(likely.select("a", "b", "da", "db"), f"likely-{turn}")
    ids = tables.keep(likely.select(F.col("da").alias("digest"), F.col("a").alias("id")).union(likely.select("db", "b")).distinct(), f"ids-{turn}")
    texts = docs.select(id_col, text_col).join(small(ids.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi")
    sets = full_sets(texts, id_col, text_col, width).dropDuplicates(["id", "digest"])
    sets = tables.keep(sets.join(small(ids), ["id", "digest"], "left_semi"), f"sets-{turn}")
    x = likely.join(sets.select(F.col("id").alias("a"), F.col("digest").alias("da"), F.col("s").alias("sa")), ["a", "da"])
    x = x.join(sets.select(F.col("id").alias("b"), F.col("digest").alias("db"), F.col("s").alias("sb")), ["b", "db"])
    x = x.withColumn("i", F.size(F.array_intersect("sa", "sb")).cast("long")).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    out = tables.keep(x.where(F.col("i") * t.denominator >= F.col("u") * t.numerator).select("a", "b"), f"edges-{turn}")
    for done in (sets, ids, likely, pairs, used):
        tables.drop(done)
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's rows: linked at 100 * intersection >= 85 * union."""
    return near_duplicates(docs, "0.85")
