"""Fill-in-middle: a text is cut at two of its units and put out as prefix, suffix, middle or suffix, prefix, middle.

Units are found by big-integer bit-parallelism over the UTF-8 bytes: bytes.translate and one int() make a mask with a bit a byte for
each class, shifted boolean operations mark where units begin, bit_count gives their number, and recursive halving selects the bit of
a rank. Each step is linear in the text at 64 positions a machine word, so a text of any length is cut whole.

Null text is empty, and an empty text is plain: no units, itself as the output. A text that holds a tag is plain too, as it couldn't
be rebuilt. A null id draws as an empty one. Rows of equal id and text give equal rows; an empty table gives an empty one; extra
columns stay, those named as an added one renamed with _0 behind. Rows are handled one by one, so no key gathers anywhere.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import make_way, text_of, with_workers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts that may be cut, how many are; of 100 that are, how many put the suffix first.
RATE, SPM_RATE = 100, 50
#: The digits that int(..., 2) reads.
_ZERO, _ONE = b"01"
ADDED = {"_form": "string", "_n": "bigint", "_prefix_chars": "bigint", "_middle_chars": "bigint", "_fim": "string"}


def byte_class(members) -> bytes:
    """The table for `mask`: which bytes are in a class."""
    inside = set(members)
    return bytes(_ONE if b in inside else _ZERO for b in range(256))


NEWLINES = byte_class(b"\n")
BLANKS = byte_class(b" \t\n\x0b\x0c\r")
#: Bytes that begin a code point.
LEADS = byte_class(b for b in range(256) if not 0x80 <= b < 0xC0)


def mask(raw: bytes, table: bytes) -> int:
    """Bit i: whether byte i of raw is in the class."""
    return int(raw[::-1].translate(table), 2) if raw else 0


def unit_starts(raw: bytes, unit: str) -> int:
    """A bit for each byte that begins a unit: a line with its line feed, a word with the blanks behind it, or a code point."""
    every = (1 << len(raw)) - 1
    if unit == "line":
        return (mask(raw, NEWLINES) << 1 | 1) & every
    if unit == "word":
        blank = mask(raw, BLANKS)
        return (blank << 1 & ~blank | 1) & every
    if unit == "char":
        return mask(raw, LEADS)
    raise ValueError(f"unit is line, word or char, not {unit}")


def select(bits: int, width: int, rank: int) -> int:
    """The position of the set bit that has `rank` set bits below it, among `width` positions."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, at, rank = bits >> half, width - half, at + half, rank - below
    return at


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 from the id."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(raw: bytes, key: str, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """form, number of units, code points of prefix and middle (None if plain), output."""
    starts = unit_starts(raw, unit)
    n = starts.bit_count()
    h1, h2, h3, h4 = draws(key, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not raw or p in raw or s in raw or m in raw or h3 % 100 >= rate:
        return "plain", n, None, None, raw
    place = lambda k: select(starts, len(raw), k) if k < n else len(raw)
    a, b = (place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    lead = mask(raw[:b], LEADS)
    before = (lead & ((1 << a) - 1)).bit_count()
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    spm = h4 % 100 < spm_rate
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return "spm" if spm else "psm", n, before, lead.bit_count() - before, out


def fill_in_middle(docs: DataFrame, *, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with _form (plain, psm or spm), _n (units), _prefix_chars, _middle_chars (code points, null if plain) and _fim, the text
    as it is trained on."""
    docs = make_way(docs, *ADDED, "__key")
    with_workers(docs.sparkSession)
    names = docs.columns
    fed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("string"), F.lit("")))

    def run(batches):
        for b in batches:
            keys, texts = b.column(len(names)), b.column(names.index(text_col))
            rows = [cut((t.as_py() or "").encode(), k.as_py(), unit, seed, rate, spm_rate) for k, t in zip(keys, texts, strict=True)]
            forms, counts, before, within, out = zip(*rows, strict=True) if rows else [()] * 5
            made = [pa.array(forms, pa.string()), *(pa.array(x, pa.int64()) for x in (counts, before, within)), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *made], names=[*names, *ADDED])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {t}" for n, t in ADDED.items())])
    return fed.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        begin, a, b = len(first), F.locate(second, output), F.locate(MIDDLE, output)
        size = len(second)
        return F.substr(output, F.lit(begin + 1), a - begin - 1), F.substr(output, a + size, b - a - size), F.substr(output, b + len(MIDDLE))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def fim_digest(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    out = fill_in_middle(docs.select("doc_id", text_of().alias("text"))).select("doc_id", "_n", "_form", "_prefix_chars", "_middle_chars", "_fim")
    whole = restored(F.col("_fim"), F.col("_form"))
    return out.select(
        "doc_id",
        F.col("_n").alias("n"),
        F.col("_form").alias("form"),
        F.col("_prefix_chars").alias("prefix_chars"),
        F.col("_middle_chars").alias("middle_chars"),
        F.sha2("_fim", 256).alias("output_sha256"),
        F.sha2(whole, 256).alias("restored_sha256"),
    )


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h
  from documents
), c as (
  select *, len(u) n,
    ('0x' || h[1:8])::bigint % (len(u) + 1) c1, ('0x' || h[9:16])::bigint % (len(u) + 1) c2,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 100 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 50 then 'spm' else 'psm' end form
  from d
), p as (
  select *, array_to_string(u[1:least(c1, c2)], '') pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') mid,
    array_to_string(u[greatest(c1, c2) + 1:], '') suf
  from c
)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(pre) end::bigint prefix_chars, case when form <> 'plain' then length(mid) end::bigint middle_chars,
  sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid else t end) output_sha256,
  sha256(t) restored_sha256
from p
"""
