"""Where fixed-length windows of text repeat: the candidate search of both exact dedups.

Every window of ``width`` tokens (bytes or words) is assigned the smallest of its
k-grams, the leftmost if several are.  Neighbouring windows with the same one form a run.  Equal
windows have equal k-grams at equal places, so windows can only be equal within one k-gram's
group of runs.  A run is named by a digest of all it covers; runs with equal digests
agree window by window.

One pass counts (k-gram, digest), summed within each block of texts before anything is
shuffled, so a passage in a third of all texts is one row a block.  Groups of one
run are done with.  What is left is known to later passes through a bit table
of bounded size, which only saves work: an exact join follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut
from tessera.llm.textblock import NOT_SPACE, byte_values, emit_blocks, mix, prefix_hash, signed, span_hash, whole_text, word_bounds, word_values

_PLACE_BITS = 23
#: Tokens handled at once; longer texts go in pieces that overlap by a window.
PIECE = 1 << 21
#: Bits of the table, at most.
MAX_TABLE_BITS = 1 << 27


@dataclass
class Runs:
    """Runs of a block: k-gram hash, digest, text, first window in the text, windows, place of the k-gram after it."""

    gram: np.ndarray
    digest: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    anchor: np.ndarray


def _piece_runs(values: np.ndarray, off: np.ndarray, width: int, k: int) -> Runs:
    n = len(values)
    w = width - k + 1
    if n < width:
        return Runs(*[np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)])
    prefix = prefix_hash(values)
    at = np.arange(n - k + 1)
    grams = span_hash(prefix, at, at + k)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (grams & ~low) | at.astype(np.uint64)
    span = 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if w > span:
        best = np.minimum(best[: len(best) - (w - span)], best[w - span :])
    place = (best & low).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)]
    start = np.arange(len(place))
    valid = np.flatnonzero(start + width <= off[doc + 1])
    if not len(valid):
        return Runs(*[np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)])
    p = place[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    lo, p = valid[first], p[first]
    digest = mix(span_hash(prefix, lo, lo + count - 1 + width) + mix((p - lo).astype(np.uint64)) * np.uint64(3))
    return Runs(grams[p], digest, doc[lo], lo - off[doc[lo]], count, p - lo)


def find_runs(values: np.ndarray, off: np.ndarray, width: int, k: int) -> Runs:
    """Runs of all windows of a block; off are the texts' bounds in values."""
    if len(values) <= PIECE:
        return _piece_runs(values, off, width, k)
    parts = []  # one long text: its windows by their starts
    for d in range(len(off) - 1):
        for lo in range(int(off[d]), max(int(off[d]) + 1, int(off[d + 1]) - width + 1), PIECE):
            hi = min(int(off[d + 1]), lo + PIECE + width - 1)
            part = _piece_runs(values[lo:hi], np.array([0, hi - lo]), width, k)
            part.doc = part.doc + d
            part.lo = part.lo + lo - int(off[d])
            parts.append(part)
    return Runs(*[np.concatenate([getattr(x, f) for x in parts]) for f in ("gram", "digest", "doc", "lo", "n", "anchor")])


def tokens(buf: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Token values and the texts' bounds among them; unit is 'byte' or 'word'."""
    if unit == "byte":
        return byte_values(buf), off
    starts, ends, at = word_bounds(buf, off, NOT_SPACE)
    return word_values(buf, starts, ends), at


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and __th, a hash of the text: together they name a document, also where ids repeat."""
    return docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("__th"))


def repeated_runs(docs: DataFrame, unit: str, width: int, k: int) -> DataFrame:
    """(gram, kinds): k-grams of more than one run; kinds is the number of digests that their runs have."""

    def count(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        runs = find_runs(*tokens(buf, off, unit), width, k)
        digest, first, counts = np.unique(runs.digest, return_index=True, return_counts=True)
        return {"gram": signed(runs.gram[first]), "digest": signed(digest), "n": counts.astype(np.int64)}

    counted = emit_blocks(docs, count, "gram bigint, digest bigint, n bigint", [])
    # dealt by gram alone, so that both sums below need no further exchange
    runs = counted.repartition("gram").groupBy("gram", "digest").agg(F.sum("n").alias("cnt"))
    per_gram = runs.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("cnt").alias("total"))
    return cut(per_gram.where("total > 1").select("gram", "kinds"))


PROBES = 4
_SALT, _STEP = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x9E3779B97F4A7C15)


class BitTable:
    """May a value be in the set?  Never wrong about those that are; about one in 400 others passes."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.shift, self.words = np.uint64(64 - bits), words

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], dtype=np.uint64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=bool)
        left, h = np.arange(len(values)), values ^ _SALT
        for _ in range(PROBES):
            h = mix(h + _STEP)
            at = h >> self.shift
            hit = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            left, h = left[hit], h[hit]
        out[left] = True
        return out


def bit_table(df: DataFrame, col: str, n: int) -> BitTable:
    """A table of about 16 bits a value, at most MAX_TABLE_BITS; tasks set its bits, the driver gets its words."""
    bits = int(min(MAX_TABLE_BITS, max(1 << 12, 16 * n)) - 1).bit_length()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, probes = batch.column(0).to_numpy().view(np.uint64) ^ _SALT, []
            for _ in range(PROBES):
                h = mix(h + _STEP)
                probes.append(h >> np.uint64(64 - bits))
            at = np.concatenate(probes)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

    words = np.zeros(1 << max(0, bits - 6), dtype=np.uint64)
    for part in df.select(col).mapInArrow(places, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        words[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    return BitTable(bits, words)
