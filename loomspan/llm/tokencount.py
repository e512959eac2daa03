"""Token counts by byte-pair merging with a heap and a linked list, and no identifiers.

A piece starts as its bytes. A heap holds the adjacent pairs that the vocabulary merges; the one of lowest rank (the leftmost of
equals) is popped again and again, its two symbols become one in a linked list of places, and the new neighbours' pairs are pushed.
A pair that has changed since it was pushed is skipped. The count is the initial symbols less the merges. Pieces that were counted
are remembered.

Null text is empty: no tokens. Texts of any length are counted whole. Special strings inside a text are one token each, as the file
has it. Repeated rows give equal rows and an empty table an empty one; extra columns stay in count_tokens, which adds _n_bytes and
_n_tokens (columns of these names are renamed with _0 behind). Rows are handled one by one, so no key gathers anywhere.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .bpe import MEMORY, byte_symbols, vocabulary_path
from .common import make_way, with_workers

LIMIT = 1024
#: White space as the tokenizer's regular expressions know it.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A blank and what is not blank, or a run of blanks: no token crosses the borders of these.
_CHUNK = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Fixed value: the splitting pattern of byte-level pre-tokenizers.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: Beyond these letters, Unicode's tables differ between libraries, so the tokenizers library's own classes are asked.
_FAR = re.compile("[^\\x00-\u024f]")
#: Characters of a chunk or piece up to which it is remembered.
_SHORT = 64


class Merges:
    """A tokenizers file of byte-level BPE without a normalizer: how pairs rank, and which strings are one token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if odd or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"byte-level BPE without normalizer or leading space is built, not {odd or split}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip, stand alone or are normalised are not built")
        stand = byte_symbols()
        if missing := [s for s in stand if s not in model["vocab"]]:
            raise ValueError(f"{len(missing)} bytes are no token")
        #: Symbols are texts of a character a byte. Ranks by both symbols, and those of single bytes by the pair.
        self.byte = str.maketrans({s: chr(b) for b, s in enumerate(stand)})
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[left.translate(self.byte), right.translate(self.byte)] = r
        self.first = {a + b: r for (a, b), r in self.rank.items() if len(a) == len(b) == 1}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.far_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def forget(self) -> None:
        """Empties what a task remembers: workers outlive it."""
        self.known.clear()
        self.pieces.clear()

    def merged(self, piece: str) -> int:
        """Tokens of a piece, given as a character a byte. A symbol is known by where it begins; the next one begins where it ends."""
        n, first, rank = len(piece), self.first.get, self.rank.get
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := first(piece[i : i + 2])) is not None]
        heapify(heap)
        end, before, left = list(range(1, n + 1)), list(range(-1, n)), n
        while heap:
            _, i, j, k = heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            left -= 1
            whole = piece[i:k]
            if i and (r := rank((piece[(b := before[i]) : i], whole))) is not None:
                heappush(heap, (r, b, i, k))
            if k < n:
                before[k] = i
                if (r := rank((whole, piece[k : end[k]]))) is not None:
                    heappush(heap, (r, i, k, end[k]))
        return left

    def piece(self, text: str) -> int:
        return self.merged(text if text.isascii() else text.encode().decode("latin-1"))

    def chunk(self, text: str) -> int:
        if _FAR.search(text):
            return sum(self.merged(p.translate(self.byte)) for p, _ in self.far_split.pre_tokenize_str(text))
        body = text[1:] if text[0] == " " else text
        if body.isalpha():
            return self.piece(text)
        known, total = self.pieces, 0
        # A word and one closing mark is the usual case; the pattern finds the same two pieces.
        for p in (text[:-1], text[-1]) if text[-1] in ".,;:!?" and body[:-1].isalpha() else _PIECE.findall(text):
            if (c := known.get(p)) is None:
                c = self.piece(p)
                if len(p) <= _SHORT:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[p] = c
            total += c
        return total

    def plain(self, text: str) -> int:
        chunks, known = _CHUNK.findall(text), self.known
        try:
            return sum(map(known.__getitem__, chunks))
        except KeyError:
            pass
        total = 0
        for x in chunks:
            if (c := known.get(x)) is None:
                c = self.chunk(x)
                if len(x) <= _SHORT:
                    if len(known) >= 2 * MEMORY:
                        known.clear()
                    known[x] = c
            total += c
        return total

    def count(self, text: str) -> int:
        if self.special and (found := self.special.findall(text)):
            return len(found) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with _n_bytes (UTF-8) and _n_tokens of the whole text."""
    docs = make_way(docs, "_n_bytes", "_n_tokens")
    with_workers(docs.sparkSession)
    names = docs.columns

    def run(batches):
        m = merges(path)
        for b in batches:
            texts = b.column(names.index(text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.count(x.as_py() or "") for x in texts], pa.int64())], names=[*names, "_n_tokens"])
        m.forget()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "`_n_tokens` bigint"])
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.mapInArrow(run, schema).withColumn("_n_bytes", size)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The contract's digest: doc_id, n_bytes, n_tokens, over_limit."""
    sized = make_way(docs.select("doc_id", "text"), "n_bytes").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = count_tokens(sized, path or vocabulary_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > limit).alias("over_limit"))
