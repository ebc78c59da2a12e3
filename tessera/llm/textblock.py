"""Helpers that look at many texts at once inside a task.

A task sees Arrow batches; each batch is cut into blocks of whole texts, and a
block is one byte array with offsets.  Tokenising and hashing then run on the
array, not on Python strings.  Memory follows the block, not the partition; a
text longer than a block makes a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18
LONG_WORD = 255

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_tables: dict[str, np.ndarray] = {}


def byte_class(chars: bytes) -> np.ndarray:
    """Truth table over byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Words of the contracts: anything but space and U+0009 to U+000D.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words of digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM_OR_BEYOND = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2**64."""
    if (table := _tables.get(kind)) is None or len(table) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        table = np.full(max(n, 1 << 16), step, dtype=np.uint64)
        table[0] = 1
        table = _tables[kind] = np.multiply.accumulate(table)
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of value times power; ``span_hash`` reads any span off them.

    These hashes only bring together what may be equal: some texts collide by design of the sum.
    Whatever decides a result compares the texts, or digests of them (``strong``), besides.
    """
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers("up", len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    down = _powers("down", len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def strong(parts: list[bytes]) -> np.ndarray:
    """A digest of 128 bits for each part, as two rows of 64-bit integers; equal digests count as equal parts."""
    raw = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2).T


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[buf]


def word_bounds(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each text."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = table[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    begins, stops = inside & ~before, before & ~inside
    edge = off[1:-1]
    both = edge[inside[edge] & before[edge]]  # a word at the end of one text and one at the start of the next
    begins[both] = stops[both] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, off)


def word_values(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; of those longer than LONG_WORD, where such sums can be made to collide, part of a digest."""
    values = span_hash(prefix_hash(byte_values(buf)), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        values[i] = strong([buf[starts[i] : ends[i]].tobytes()])[0, 0].view(np.uint64)
    return values


def word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of words within a block: equal exactly where the bytes are."""
    _, first, ids = np.unique(word_values(buf, starts, ends), return_index=True, return_inverse=True)
    length = ends - starts
    twin = first[ids]
    same = length == length[twin]
    if same.all():
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        same = buf[np.repeat(starts, length) + inside] == buf[np.repeat(starts[twin], length) + inside]
    if same.all():
        return ids
    raw, known = buf.tobytes(), {}  # two words with one hash
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Numbers of windows of ``width`` neighbours: equal exactly where all their ids are."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    done, span = ids, 1
    while span * 2 <= width:
        done = pair(done[:-span], done[span:]) if len(done) > span else done[:0]
        span *= 2
    rest = width - span  # the last windows overlap
    if rest and len(done) > rest:
        done = pair(done[:-rest], done[rest:])
    return done if not rest or len(ids) >= width else done[:0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; nulls must be gone."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def map_blocks(
    df: DataFrame,
    make: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict | None],
    added: str,
    keep: list[str] | None = None,
    text: str = "text",
    seen: list[str] | None = None,
) -> DataFrame:
    """Append columns that ``make(bytes, offsets, rows)`` finds for each block of texts.

    ``keep`` names the columns passed through (all by default), ``seen`` those that only ``make`` gets, after them.  The text itself
    goes to Python as the hidden column ``__text``, nulls as the empty text.
    """
    keep, seen = df.columns if keep is None else keep, seen or []
    source = df.select(*[F.col(f"`{c}`") for c in [*keep, *seen]], whole_text(text).alias("__text"))
    kept_schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    names = [part.strip().split(" ")[0] for part in _top_level(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi, buf, off in blocks(texts):
                rows = batch.slice(lo, hi - lo)
                got = make(buf, off, rows)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: len(keep)], *[x if isinstance(x, pa.Array) else pa.array(x) for x in got.values()]],
                    names=[*keep, *names],
                )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema], added])
    return source.mapInArrow(run, schema)


def emit_blocks(
    df: DataFrame,
    make: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict],
    schema: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """Rows of any number that ``make`` finds for each block of texts."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], whole_text(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in blocks(batch.column(batch.num_columns - 1)):
                got = make(buf, off, batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in got.values()], names=list(got))

    return source.mapInArrow(run, schema)


def _top_level(schema: str) -> list[str]:
    parts, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column: the first counts[0] values, the next counts[1], and so on."""
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values if isinstance(values, pa.Array) else pa.array(values))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """True where some [lo, hi) covers a place in 0 to n-1."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0
