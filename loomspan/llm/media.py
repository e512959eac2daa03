"""Media columns over ISO containers: nested boxes are walked and sample tables decoded; payloads stay undecoded bytes.

A container is ftyp, moov (one track: mdhd, stsd, stts, stsc, stsz, stco or co64, stss) and mdat. Reading takes codec,
timescale, duration and keyframe byte ranges from the tables alone; the payload is read back through the chunk offsets.
Null and empty texts store one padded unit. Each row is handled on its own, of any length; offsets go to 64 bits when needed.
Repeated rows give equal rows, an empty table gives an empty one, and only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Tables, with_workers

#: Bytes of a sample: 192 8-bit values at 24 kHz. Samples to a chunk, and from one keyframe to the next.
UNIT, RATE, CHUNK, KEY = 192, 24_000, 50, 25
#: Bytes of containers to a batch that a worker hands back.
BATCH = 4_000_000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    head = struct.pack(">I4s", size, kind) if size < 2**32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *body))


def _full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *body)


def pack(payload: bytes) -> bytes:
    """A container around a payload whose length is a positive multiple of UNIT."""
    n = len(payload) // UNIT
    if n < 1 or n * UNIT != len(payload):
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    chunks, last = divmod(n, CHUNK)
    wide = len(payload) > 2**31
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, last)] if last else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, n + 1, KEY, dtype=">u4").tobytes()
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    total = n * UNIT
    starts = np.arange(0, len(payload), CHUNK * UNIT, dtype=np.int64)

    def moov(base: int) -> bytes:
        places = (starts + base).astype(">u8" if wide else ">u4").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", first, per, 1) for first, per in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), places),
            _full(b"stss", struct.pack(">I", len(keys) // 4), keys),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        # Version 1 of the headers has 64-bit durations.
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, total, 0x55C4, 0), flags=1 << 24)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"text\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, total), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=(1 << 24) | 7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, total, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), flags=1 << 24)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = 8 if 8 + len(payload) < 2**32 else 16
    base = len(ftyp) + len(moov(0)) + head  # offsets have a fixed width, so the size of moov is known before them
    return b"".join((ftyp, moov(base), _box(b"mdat", payload)))


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, end) of every box, nested ones after their parent. Bodies are not read."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box header is cut off")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}, beyond its parent")
        yield kind, at + head, at + size
        if kind in _NESTED:
            yield from boxes(data, at + head, at + size)
        at += size


def inspect(data: bytes) -> dict:
    """codec, timescale, duration, samples, places and sizes of chunks, and byte ranges of keyframes, of the first track."""
    at: dict[bytes, int] = {}
    for kind, start, _ in boxes(data):
        at.setdefault(kind, start)
    if missing := {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - at.keys():
        raise ValueError(f"no {sorted(missing)} box")
    codec = data[at[b"stsd"] + 12 : at[b"stsd"] + 16].decode("latin-1")
    if data[at[b"mdhd"]] == 1:
        timescale, duration = struct.unpack_from(">IQ", data, at[b"mdhd"] + 20)
    else:
        timescale, duration = struct.unpack_from(">II", data, at[b"mdhd"] + 12)
    table = lambda kind, width, skip=8, n=None: np.frombuffer(data, f">u{width}", n, at[kind] + skip).astype(np.int64)
    size, n = struct.unpack_from(">II", data, at[b"stsz"] + 4)
    sizes = np.full(n, size, np.int64) if size else table(b"stsz", 4, 12, n)
    (entries,) = struct.unpack_from(">I", data, at[b"stts"] + 4)
    stts = table(b"stts", 4, 8, 2 * entries).reshape(-1, 2)
    places, width = (b"co64", 8) if b"co64" in at else (b"stco", 4)
    (count,) = struct.unpack_from(">I", data, at[places] + 4)
    starts = table(places, width, 8, count)
    (entries,) = struct.unpack_from(">I", data, at[b"stsc"] + 4)
    stsc = table(b"stsc", 4, 8, 3 * entries).reshape(-1, 3)
    per = np.repeat(stsc[:, 1], np.diff(np.append(stsc[:, 0], count + 1)))
    chunk = np.repeat(np.arange(count), per)
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else sizes
    first = np.concatenate(([0], np.cumsum(per)[:-1])) if count else per
    offsets = starts[chunk] + before - before[first][chunk]
    if b"stss" in at:
        (entries,) = struct.unpack_from(">I", data, at[b"stss"] + 4)
        keys = table(b"stss", 4, 8, entries) - 1
    else:
        keys = np.arange(n)
    ends = np.append(keys[1:], n)  # the samples of a group of frames stand together as far as their chunks do
    return {"codec": codec, "timescale": timescale, "duration": duration, "samples": n, "decode_time": int((stts[:, 0] * stts[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "key_start": offsets[keys], "key_bytes": np.add.reduceat(sizes, keys) if len(keys) else sizes[:0], "key_ends": ends}


def payload(data: bytes, info: dict) -> bytes:
    """The samples in order, read through the tables; neighbours in the file are read at once."""
    start, size = info["offsets"], info["sizes"]
    cut = np.flatnonzero(np.append(True, start[1:] != start[:-1] + size[:-1]))
    ends = np.append(cut[1:], len(start)) - 1
    return b"".join(data[a:b] for a, b in zip(start[cut].tolist(), (start[ends] + size[ends]).tolist(), strict=True))


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT if raw else UNIT)


KEYFRAMES = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))


def _columns(names: list[str], kinds: list[pa.DataType], key: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names=names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each document's container. Batches go out by a bound of bytes or one row at a time."""
    with_workers(docs.sparkSession)
    names, kinds = [id_col, "n_bytes", "media"], [pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            rows, first, size = [], 0, 0
            for i, text in enumerate(b.column(1)):
                n, raw = padded(text.as_py())
                rows.append((n, pack(raw)))
                size += len(rows[-1][1])
                if size >= BATCH or i == b.num_rows - 1:
                    yield _columns(names, kinds, b.column(0).slice(first, i + 1 - first), rows)
                    rows, first, size = [], i + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _described(media: DataFrame, columns: list[str], fields: str, kinds: list[pa.DataType], row) -> DataFrame:
    """`columns` of media, which must begin with one to pass on and end with the container, read by `row(*other columns, container)`."""
    with_workers(media.sparkSession)
    names = [columns[0], *(f.split(" ", 1)[0] for f in fields.split(", "))]

    def run(batches):
        for b in batches:
            rows = [row(*(b.column(k)[i].as_py() for k in range(1, b.num_columns))) for i in range(b.num_rows)]
            yield _columns(names, kinds, b.column(0), rows)

    kind = media.schema[columns[0]].dataType.simpleString()
    return media.select(*columns).mapInArrow(run, f"`{columns[0]}` {kind}, {fields}")


def described(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, codec, timescale, duration, samples, keyframes) from the containers' tables; payloads are not decoded."""

    def row(data: bytes) -> tuple:
        x = inspect(data)
        keys = [{"start": a, "bytes": c} for a, c in zip(x["key_start"].tolist(), x["key_bytes"].tolist(), strict=True)]
        return x["codec"], x["timescale"], x["duration"], x["samples"], keys

    fields = "codec string, timescale long, duration long, samples long, keyframes array<struct<start:bigint,bytes:bigint>>"
    return _described(media, [id_col, media_col], fields, [pa.string(), pa.int64(), pa.int64(), pa.int64(), KEYFRAMES], row)


def digest(n: int, media: bytes) -> tuple:
    x = inspect(media)
    back = payload(media, x)
    seconds = x["duration"] / x["timescale"]
    feature = f"{x['codec'].strip()} {x['timescale']} {seconds:.3f}s samples={x['samples']} keys={len(x['key_start'])} first={x['key_start'][0]}+{x['key_bytes'][0]} last={x['key_start'][-1]}+{x['key_bytes'][-1]}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_columns(docs: DataFrame) -> DataFrame:
    """The contract's digest, of containers that are written to a table in the shared folder and read from it."""
    stored = Tables(docs.sparkSession).keep(store(docs), "media")
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _described(stored, ["doc_id", "n_bytes", "media"], fields, kinds, digest)
