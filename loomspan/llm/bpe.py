"""BPE by backtracking: longest token matches from an Aho-Corasick pass, checked against a pair-compatibility table.

A sequence of tokens is what merging by rank would give exactly if every neighbouring pair is: then no merge across their
border could have come before the merges that made them. The encoder takes the longest match at each place, and on an
incompatible pair a shorter prefix, marking places that lead nowhere, so each is left at most once. Decoding copies byte
ranges from one table of all token texts by offset.

Null text is empty: no tokens. Texts of any length are encoded whole. Repeated rows give equal rows and an empty table an
empty one; extra columns stay in encode_documents, which adds _ids (a column of that name becomes _ids_0). Ids are
of any type. Rows are handled one by one, so no key or copy group gathers anywhere.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import make_way, with_workers

#: Entries of a task's memory of encoded chunks and of words and pairs; each is emptied when full, and all at the task's end.
MEMORY = 200_000
#: Added to the code point of a word's last symbol, so that symbols stay single characters.
_LAST = 0xF0000
#: White space as the tokenizer's regular expressions know it; str.split() also cuts at U+001C to U+001F.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")
#: Beyond these letters, Unicode's tables differ between libraries, so the tokenizers library's own classes and cases are asked.
_FAR = regex.compile("[^\\x00-\u024f]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else the next code point from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Tokenizer:
    """A tokenizers file: NFC, blanks, lower case; a splitting pattern; byte-level BPE with an end-of-word suffix, no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.far_split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.far_case = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        if odd := [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")]:
            raise ValueError(f"added tokens {odd} strip, stand alone or are normalised, which is not built")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = special
        texts = {i: t for t, i in (vocab | special).items()}
        symbols: dict[int, str] = {}
        for t, i in vocab.items():
            if len(t) == 1:
                symbols[i] = t
            elif len(t) == 1 + len(suffix) and t.endswith(suffix):
                symbols[i] = chr(ord(t[0]) + _LAST)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, i = vocab[left], vocab[right], vocab[left + right]
            self.halves[i], self.merged[a, b] = (a, b), i
            symbols[i] = symbols[a] + symbols[b]
        if (made := [*self.merged.values()]) != sorted(made):
            raise ValueError("ids of merged tokens must rise with the rank of their merges")
        self.length = {i: len(s) for i, s in symbols.items()}
        by_symbols = {s: i for i, s in symbols.items()}
        self.shorter = {i: next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), -1) for i, s in symbols.items()}
        self.matches = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.matches.add_word(s, (i, len(s) - 1))
        self.matches.make_automaton()
        stand = byte_symbols()
        self.table = {b: stand[b] for b in range(256)}
        #: A token that merging gives as it stands is its own encoding; all of them are, which the tests verify.
        self.whole = {s: [i] for s, i in by_symbols.items()}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        pieces = [(" " + texts.get(i, "")).encode() for i in range(max(texts) + 1)]
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def forget(self) -> None:
        """Empties what a task remembers: workers outlive it."""
        for memory in (self.known, self.words, self.pairs):
            memory.clear()

    def compatible(self, a: int, b: int) -> bool:
        """Whether rank-ordered merging leaves the border between neighbours a and b alone. Ids of merged tokens rise with rank."""
        merged, halves = self.merged.get, self.halves.get
        left, right, before, out = a, b, 1 << 40, True
        while True:
            if merged((left, right), before) < before:
                out = False
                break
            # Undo the later merge; of equal ones the left one came first, so the right one is undone first.
            if left > right:
                if (parts := halves(left)) is None:
                    break
                before, left = left, parts[1]
            else:
                if (parts := halves(right)) is None:
                    break
                before, right = right + 1, parts[0]
        if len(self.pairs) > 2 * MEMORY:
            self.pairs.clear()
        self.pairs[a, b] = out
        return out

    def word(self, raw: bytes) -> list[int]:
        s = raw.decode("latin-1").translate(self.table)
        s = s[:-1] + chr(ord(s[-1]) + _LAST)
        if (whole := self.whole.get(s)) is not None:
            return whole
        n, length, pairs = len(s), self.length, self.pairs.get
        longest = [-1] * n
        for end, (i, back) in self.matches.iter(s):
            longest[end - back] = i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        last = -1
        while True:
            end = at + length[token]
            if not dead[end]:
                ok = last < 0 or pairs((last, token))
                if ok or (ok is None and self.compatible(last, token)):
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                gone = out.pop()
                at -= length[gone]
                last = out[-1] if out else -1
                token = self.shorter[gone]

    def chunk(self, text: str) -> bytes:
        pieces = [p for p, _ in self.far_split.pre_tokenize_str(text)] if _FAR.search(text) else self.pattern.findall(text)
        out, words = [], self.words
        for p in pieces:
            if (x := words.get(p)) is None:
                x = array("I", self.word(p.encode())).tobytes()
                if len(words) >= MEMORY // 2:
                    words.clear()
                if len(p) <= 64:
                    words[p] = x
            out.append(x)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif _FAR.search(text):
            text = self.far_case.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        chunks = _SPACE.split(text) if _ODD.search(text) else text.split()
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        out = []
        for c in chunks:
            if (x := known.get(c)) is None:
                x = self.chunk(c)
                if len(known) >= MEMORY:
                    known.clear()
                if len(c) <= 64:
                    known[c] = x
            out.append(x)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.special and self.special.search(text):
            raw = b"".join(np.uint32(self.special_ids[p]).tobytes() if p in self.special_ids else self.plain(p) for p in self.special.split(text))
        else:
            raw = self.plain(text)
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' texts, a blank between: what the library gives where the file names no decoder."""
        if not len(ids):
            return b""
        size = self.sizes[ids]
        step = np.ones(int(size.sum()), np.int64)
        start = self.offsets[ids]
        step[0] = start[0]
        step[np.cumsum(size)[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
        return self.bytes[np.cumsum(step)].tobytes()[1:]


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with _ids (array of int) of the whole text."""
    docs = make_way(docs, "_ids")
    with_workers(docs.sparkSession)
    names = docs.columns

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            ids = [t.encode(x.as_py() or "").astype(np.int32) for x in b.column(names.index(text_col))]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*names, "_ids"])
        t.forget()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "`_ids` array<int>"])
    return docs.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    with_workers(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            rows = []
            for x in b.column(1):
                ids = t.encode(x.as_py() or "")
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        t.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
