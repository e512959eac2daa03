"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine.

The kernel of two tokens compares the subsequences of three letters that they share, each weighted by LAMBDA to the power of the
stretch it spans and normalised, so letters put in or left out cost a little and not everything. Marks inside a token count as no
letters, look-alikes (4 for a) as the letters they stand for. The kernel of two texts is the sum, over pairs of their different
tokens, of powers of that (POWERS: a low one that still sees altered words, a high one that tells words of one stem apart),
divided by the square root of both numbers of tokens. Sums, powers and such scalings of kernels are kernels.

Landmarks are tokens of training documents that labels tell apart, chosen one by one so that those of a rare language come before
more of a frequent one. A text's values for the landmarks map through the inverse square root of the landmarks' own kernel matrix,
and a support vector machine is trained on a bounded sample of labelled texts and on copies of the toxic ones whose landmarks
have a letter put in. Margins become probabilities by a sigmoid that is fitted out of fold.

Settings are chosen by `tune`, which sees the training rows alone: each fifth of them is scored by a model of the other four.

Null and empty texts have zero values and get the score that gives. Labels that are null don't train; several labels of a
document count as toxic when one is, and of several texts of one id the greatest trains. Without labels of both classes every score is the share of toxic ones (0 for none). Texts
and tokens of any length are scored whole. Repeated rows get equal scores. `score` adds _score; a column of that name
becomes _score_0.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, make_way, with_workers

#: Labelled rows that train the machine at most: those with the least hash of their id.
TRAIN_ROWS = 8_000
LANDMARKS = 128
#: What is left of a toxic document's weight each time that a landmark it holds is chosen.
DECAY = 0.5
LAMBDA = 0.95
POWERS = (3, 10)
COST = 1000.0
#: Letters up to which a token's subsequences are listed one by one; longer ones are summed letter by letter.
SHORT = 16
#: Tokens whose value a task remembers, and the longest of them.
MEMORY, MEMORY_WIDTH = 150_000, 40
_ORDER, _BITS = 3, 6
#: Figures and signs that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Marks that stand for no letter, and ! which ends sentences: they go from around a token.
_MARKS = "!" + "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LOOKS_LIKE)
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")


@dataclass(frozen=True)
class Settings:
    """What `tune` chooses: see the constants of these names."""

    landmarks: int = LANDMARKS
    decay: float = DECAY
    lam: float = LAMBDA
    powers: tuple[int, ...] = POWERS
    cost: float = COST


@lru_cache(maxsize=4096)
def _letter(c: str) -> int:
    """1 to 26: a letter without its accents; 27 to 63: other letters, by a remainder; 0: no letter."""
    c = LOOKS_LIKE.get(c, c)
    base = unicodedata.normalize("NFD", c)[0]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(base) % 37 if base.isalpha() else 0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The letter of each code point of the basic plane; asked one by one beyond it."""
    return np.array([_letter.__wrapped__(chr(c)) for c in range(0x10000)], np.uint8)


def tokens_of(text: str | None) -> set[str]:
    """Blank-separated tokens in lower case, and runs of single characters drawn together."""
    if not text:
        return set()
    text = text.lower()
    whole = {t.strip(_MARKS) for t in {*text.split()}}
    whole.update("".join(m.split()).strip(_MARKS) for m in _SPACED.findall(text))
    return whole


def form(token: str) -> str:
    """A token's letters as the kernel sees them: a to z, other letters as they are."""
    return "".join(chr(96 + k) if k < 27 else c for c in token if (k := _letter(c)))


def altered(token: str, key: object) -> str:
    """A token with a letter put in between two others, by a hash of key and token."""
    h = zlib.crc32(f"{key}|{token}".encode())
    at = 1 + h % max(1, len(token) - 1)
    return token[:at] + chr(97 + (h >> 16) % 26) + token[at:]


@lru_cache(maxsize=2 * SHORT)
def _places(n: int, lam: float = LAMBDA) -> tuple[np.ndarray, np.ndarray]:
    c = np.array(list(combinations(range(n), _ORDER)), np.int64).reshape(-1, _ORDER)
    return c, lam ** (c[:, -1] - c[:, 0] + 1.0)


def _features(letters: np.ndarray, lam: float = LAMBDA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the different subsequences of tokens of one length up to SHORT, each row of unit norm."""
    places, weight = _places(letters.shape[1], lam)
    x = letters.astype(np.int64)
    codes = (x[:, places[:, 0]] << 2 * _BITS) | (x[:, places[:, 1]] << _BITS) | x[:, places[:, 2]]
    order = np.argsort(codes, 1)
    codes = np.take_along_axis(codes, order, 1)
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    fresh, codes = fresh.ravel(), codes.ravel()
    at = np.flatnonzero(fresh)
    total = np.add.reduceat(weight[order].ravel(), at) if len(at) else np.empty(0)
    row = at // max(1, len(weight))
    norm = np.sqrt(np.bincount(row, total**2, len(x)))
    return row, codes[at], total / norm[row]


def _long_features(letters: np.ndarray, lam: float = LAMBDA) -> tuple[np.ndarray, np.ndarray]:
    """(code, weight) of one token of any length, of unit norm, in time that grows with the length."""
    there, letters = np.unique(letters, return_inverse=True)
    k = len(there)
    one, two, three = np.zeros(k), np.zeros((k, k)), np.zeros((k, k * k))
    flat = two.reshape(-1)
    for x in letters.tolist():
        three[x] += flat
        two[:, x] += one
        two *= lam
        one[x] += 1
        one *= lam
    total = three.T.reshape(-1)  # from (third, first and second) to the code's order
    held = np.flatnonzero(total)
    there = there.astype(np.int64)
    codes = (there[held // (k * k)] << 2 * _BITS) | (there[held // k % k] << _BITS) | there[held % k]
    return codes, total[held] / math.sqrt(float((total**2).sum()))


class Kernel:
    """Normalised gap-weighted kernel of tokens against landmarks, exact for tokens of any length."""

    def __init__(self, landmarks: list[str], lam: float = LAMBDA):
        self.m, self.lam = len(landmarks), lam
        parts = [self._one(s) for s in landmarks]
        code = np.concatenate([c for c, _ in parts] or [np.empty(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.start = np.searchsorted(code[order], np.arange((1 << _ORDER * _BITS) + 1))
        self.mark = np.repeat(np.arange(self.m), [len(c) for c, _ in parts])[order] if parts else np.empty(0, np.int64)
        self.weight = np.concatenate([w for _, w in parts] or [np.empty(0)])[order]

    @staticmethod
    def _lettered(token: str) -> np.ndarray:
        return np.array([k for c in token if (k := _letter(c))], np.uint8)

    def _one(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        x = self._lettered(token)
        if len(x) < _ORDER:
            return np.empty(0, np.int64), np.empty(0)
        return _features(x[None], self.lam)[1:] if len(x) <= SHORT else _long_features(x, self.lam)

    def _against(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        count = self.start[code + 1] - self.start[code]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[code] - ends + count, count)
        place = np.repeat(row * self.m, count) + self.mark[at]
        return np.bincount(place, np.repeat(weight, count) * self.weight[at], rows * self.m).reshape(rows, self.m)

    def values(self, tokens: list[str]) -> np.ndarray:
        """A row for each token: its kernel values, 0 to 1; all 0 for a token of fewer than three letters."""
        out = np.zeros((len(tokens), self.m), np.float32)
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        flat = _letters()[np.minimum(points, 0xFFFF)]
        for k in np.flatnonzero(points > 0xFFFF):
            flat[k] = _letter(chr(points[k]))
        token = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        there = flat > 0
        flat, token = flat[there], token[there]
        size = np.bincount(token, minlength=len(tokens))
        start = np.cumsum(size) - size
        for n in np.unique(size[(size >= _ORDER) & (size <= SHORT)]).tolist():
            for who in np.array_split(who := np.flatnonzero(size == n), -(-len(who) // 512)):
                out[who] = self._against(*_features(flat[start[who, None] + np.arange(n)], self.lam), len(who))
        for k in np.flatnonzero(size > SHORT).tolist():
            code, weight = _long_features(flat[start[k] : start[k] + size[k]], self.lam)
            out[k] = self._against(np.zeros(len(code), np.int64), code, weight, 1)[0]
        return out


def powers(values: np.ndarray, to: Sequence[int] = POWERS) -> np.ndarray:
    """Columns of token kernels to columns of each power of them."""
    x = np.asarray(values)
    out, done, last = [], np.ones_like(x), 0
    for p in to:  # in rising order, by products: the general power is slow
        base, left = x, p - last
        while left:
            if left & 1:
                done = done * base
            base, left = base * base, left >> 1
        out.append(done)
        last = p
    return np.hstack(out)


def text_row(kernel: Kernel, tokens: set[str], to: Sequence[int] = POWERS) -> np.ndarray:
    """A text's kernel values for the landmarks, one for each power and landmark."""
    return powers(kernel.values(sorted(tokens)).astype(float), to).sum(0) / math.sqrt(max(1, len(tokens)))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = 50) -> np.ndarray:
    """Weights (the last for a constant 1) of a linear machine with squared hinge loss, by Newton steps; y is -1 or 1."""
    x = np.hstack((x, np.ones((len(x), 1))))
    share = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * cost / len(y)
    ridge = np.eye(x.shape[1]) / 100
    loss = lambda w: 0.5 * w @ ridge @ w + (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        left = 1 - y * (x @ w)
        on = left > 0
        grad = ridge @ w - 2 * x[on].T @ (share[on] * y[on] * left[on])
        hess = ridge + 2 * (x[on].T * share[on]) @ x[on]
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w) - 1e-4 * size * (grad @ move):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) is the probability of y = 1, with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z, ab = np.stack((margin, np.ones_like(margin)), 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        move = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + 1e-9 * np.eye(2), z.T @ (p - t))
        move *= min(1, 2 / max(1e-12, np.abs(move).max()))
        ab = ab - move
        if np.abs(move).max() < 1e-10:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """Landmarks, and weights that take a text's kernel values to a margin; the score is a sigmoid of it."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, constant: float, a: float, b: float, settings: Settings = Settings()):  # noqa: B008
        self.landmarks, self.weights, self.constant, self.a, self.b, self.settings = tuple(landmarks), weights, constant, a, b, settings

    def scorer(self):
        """A function of a list of texts. A margin is linear in the kernel values, so a token adds one number to its texts' margins;
        the numbers of the last tokens are remembered as long as the function lives."""
        kernel, known, weights = Kernel(list(self.landmarks), self.settings.lam), {}, np.asarray(self.weights, np.float32)

        def scores(texts: list[str | None]) -> np.ndarray:
            margin = np.zeros(len(texts))
            sets = [tokens_of(t) for t in texts] if self.landmarks else []
            new = list(set().union(*sets).difference(known))
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(set().union(*sets))
            for a in range(0, len(new), 4096):
                part = new[a : a + 4096]
                known.update(zip(part, (powers(kernel.values(part), self.settings.powers) @ weights).tolist(), strict=True))
            for k, s in enumerate(sets):
                margin[k] = math.fsum(map(known.__getitem__, s)) / math.sqrt(max(1, len(s)))
            for t in new:
                if len(t) > MEMORY_WIDTH:
                    del known[t]
            return 1 / (1 + np.exp(-np.clip(self.a * (margin + self.constant) + self.b, -500, 500)))

        return scores

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.scorer()(texts)


def held_out(doc_id: Column) -> Column:
    """A fifth of ids; their labels never train. A null id has no remainder and is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def covering(tokens: list[str], odds: np.ndarray, token: np.ndarray, doc: np.ndarray, most: int, decay: float = DECAY) -> list[str]:
    """At most `most` of `tokens`, each the one with the greatest odds * weight of the documents that hold it. token and doc are
    pairs of numbers: who holds what. Documents weigh 1 at first and `decay` times as much after each choice they hold."""
    weight, free, out = np.ones(int(doc.max(initial=-1)) + 1), np.ones(len(tokens), bool), []
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    for _ in range(min(most, len(tokens))):
        gain = np.bincount(token, weight[doc], len(tokens)) * odds
        best = int(np.argmax(np.where(free, gain, -np.inf)))
        free[best] = False
        out.append(tokens[best])
        weight[doc[token == best]] *= decay
    return out


def machine(x: np.ndarray, y: np.ndarray, own: np.ndarray, fold: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float, float, float]:
    """(weights for kernel values, constant, a, b). own: the landmarks' kernel matrix, a block for each power; fold: which fifth a
    row is in, so that the sigmoid is fitted to margins of machines that have not seen the row."""
    m = own.shape[0]
    to = np.zeros((own.shape[1], own.shape[1]))
    for k in range(own.shape[1] // m):
        block = own[:, k * m : (k + 1) * m]
        power, turn = np.linalg.eigh((block + block.T) / 2)
        to[k * m : (k + 1) * m, k * m : (k + 1) * m] = turn * np.where(power > 1e-3, 1 / np.sqrt(np.maximum(power, 1e-3)), 0) @ turn.T
    z = x @ to
    w = support_vectors(z, y, cost)
    margin = z @ w[:-1] + w[-1]
    for f in range(5):
        rest = fold != f
        if (~rest).any() and len(set(y[rest])) == 2:
            v = support_vectors(z[rest], y[rest], cost)
            margin[~rest] = z[~rest] @ v[:-1] + v[-1]
    a, b = sigmoid_fit(margin, y)
    return to @ w[:-1], float(w[-1]), a, b


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int | None = None, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Trains on at most train_rows labelled documents that aren't held out. What reaches the driver is as bounded: which toxic
    documents hold which candidate tokens, landmarks, and a row of kernel values for each text and altered copy."""
    spark = docs.sparkSession
    with_workers(spark)
    tables = Tables(spark)
    settings = settings if landmarks is None else replace(settings, landmarks=landmarks)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    texts = tables.keep(texts.select("toxic", "text", F.xxhash64("doc_id").alias("doc")).repartition(16, "doc"), "train")

    def found(batches):
        for b in batches:
            for toxic, text, doc in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = sorted({s for t in tokens_of(text.as_py()) if len(s := form(t)) >= _ORDER})
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32()), pa.array([doc] * len(own), pa.int64())], names=["token", "toxic", "doc"])

    counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    up, down = counts.get(1, 0), counts.get(0, 0)
    if not up or not down:
        return Model([], np.zeros(0), 0.0, 0.0, 50.0 if up else -50.0)
    seen = texts.mapInArrow(found, "token string, toxic int, doc long").groupBy("token")
    seen = seen.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"), F.collect_list(F.when(F.col("toxic") == 1, F.col("doc"))).alias("docs"))
    odds = F.log((F.col("p") + 0.5) / (up + 1) / ((F.col("q") + 0.5) / (down + 1)))
    able = seen.where((F.col("p") >= 2) & (odds >= 1.5)).select("token", odds.alias("odds"), "docs").orderBy("token").toArrow()
    holds = able["docs"].combine_chunks()
    token = np.repeat(np.arange(len(able)), pc.list_value_length(holds).to_numpy(zero_copy_only=False))
    doc = np.unique(pc.list_flatten(holds).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    names = covering(able["token"].to_pylist(), able["odds"].to_numpy(), token, doc, settings.landmarks, settings.decay)
    if not names:
        share = up / (up + down)
        return Model([], np.zeros(0), 0.0, 0.0, math.log(share / (1 - share)))
    chosen = frozenset(names)

    def valued(batches):
        kernel = Kernel(names, settings.lam)
        for b in batches:
            out = []
            for toxic, text, doc in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = tokens_of(text.as_py())
                out.append((toxic, doc, text_row(kernel, own, settings.powers)))
                if toxic and (hit := {t for t in own if form(t) in chosen}):
                    out.append((toxic, doc, text_row(kernel, (own - hit) | {altered(form(t), doc) for t in hit}, settings.powers)))
            flat = pa.array(np.concatenate([x[2] for x in out]) if out else np.empty(0))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.FixedSizeListArray.from_arrays(flat, len(settings.powers) * len(names)).cast(pa.list_(pa.float64()))], names=["toxic", "doc", "x"])

    rows = texts.mapInArrow(valued, "toxic int, doc long, x array<double>").orderBy("doc", "x").toArrow()
    tables.drop(texts)
    x = pc.list_flatten(rows["x"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    y, doc = 2.0 * rows["toxic"].to_numpy() - 1, rows["doc"].to_numpy()
    weights, constant, a, b = machine(x, y, powers(Kernel(names, settings.lam).values(names), settings.powers), doc % 5, settings.cost)
    return Model(names, weights, constant, a, b, settings)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with _score."""
    docs = make_way(docs, "_score")
    with_workers(docs.sparkSession)
    names = docs.columns

    def run(batches):
        scores = model.scorer()
        for b in batches:
            text = b.column(names.index(text_col))
            p = np.concatenate([scores(text.slice(a, 256).to_pylist()) for a in range(0, len(text), 256)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*names, "_score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "`_score` double"])
    return docs.mapInArrow(run, schema)


def tune(docs: DataFrame, labels: DataFrame, settings: Sequence[Settings], folds: int = 5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(settings, found, missed, flagged, passed, f1, loss) for each of `settings`: documents that aren't held out, each judged by a model
    that is fitted without its fold of them. Labels of held-out documents are never read. One model a setting and fold is fitted."""
    spark = docs.sparkSession
    tables = Tables(spark)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).withColumn("fold", fold)
    sample = tables.keep(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "sample")
    rows = []
    for s in settings:
        judged = []
        for k in range(folds):
            rest = sample.where(F.col("fold") != k)
            model = fit(rest.select("doc_id", "text"), rest.select("doc_id", "toxic"), train_rows, settings=s)
            judged.append(score(sample.where(F.col("fold") == k), model).select("toxic", "_score"))
        p, toxic = F.greatest(F.least("_score", F.lit(1 - 1e-6)), F.lit(1e-6)), F.col("toxic") == 1
        hit = F.col("_score") >= 0.5
        n = reduce(DataFrame.unionByName, judged).agg(*[F.count_if(c).alias(name) for name, c in (("found", toxic & hit), ("missed", toxic & ~hit), ("flagged", ~toxic & hit), ("passed", ~toxic & ~hit))], F.avg(-F.log(F.when(toxic, p).otherwise(1 - p))).alias("loss")).first()
        rows.append((str(s), n["found"], n["missed"], n["flagged"], n["passed"], 2 * n["found"] / max(1, 2 * n["found"] + n["missed"] + n["flagged"]), n["loss"]))
    return spark.createDataFrame(rows, "settings string, found long, missed long, flagged long, passed long, f1 double, loss double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
