"""SimHash near-duplicates, found by pigeonring filtering.

Two fingerprints that differ in at most t of their bits, cut into m segments on a
ring, must have a chain of neighbouring segments, starting somewhere, in which
the first l segments differ in at most l*t/m bits together, for every l up to m.
With 16 segments of 4 bits and t = 3, the first five segments of that chain are equal
(5*3/16 < 1), and the first ten differ in one bit at most (10*3/16 < 2), so one half of the
sixth to tenth segment is equal too: thirty bits at one of sixteen starts, the key of an equi-join.
The rest of the chain's budgets prunes partners before the full Hamming check.

Only distinct fingerprints are compared, so copies cost one row.  Fingerprints
are dealt by key; within a key neighbours in sorted order are compared at growing
distance, and only a spanning forest of the links found leaves the task, not all
pairs.  A key with more than MAX_KEY fingerprints is dealt on by its other 34 bits: cut into six parts,
three of them must be equal, whichever they are.  No part of it can then hold more than 2**17 fingerprints, as only
17 bits are left to differ, and the links are the same.

Cases: a null or empty text has fingerprint zero, and such documents link like
any other; very long texts are hashed whole; bits set in just half of the hashes (ties) are 0; repeated rows and equal fingerprints are one component; a null doc_id never
names a component unless all its members are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.repeats import keyed
from tessera.llm.shared import BROADCAST_ROWS, aside, back, cut
from tessera.llm.textblock import map_blocks, signed, whole_text

MAX_BITS = 3
SHINGLE = 3
SEGMENTS = 16
MAX_KEY = 20_000

_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Majority of the bits of the shingles' hashes; zero for no words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = max(1, len(words) - shingle + 1)
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[starts[i] : starts[i + span] - 1], seed) for i in range(n)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    every = np.arange(0, n, 255)
    for k in range(8):  # eight counters of eight bits in each lane sum
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, every)
        counts[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > n)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """docs with __fp, the fingerprint as a signed 64-bit integer."""

    def make(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        raw = buf.tobytes()
        return {"fp": signed(np.array([fingerprint(raw[a:b], shingle) for a, b in zip(off[:-1], off[1:], strict=True)], dtype=np.uint64))}

    return map_blocks(docs, make, "__fp bigint", keep)


def _rotate(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _last(budget: int, segments: int, max_bits: int) -> int:
    """How many segments of a chain may differ in at most ``budget`` bits."""
    return next(n for n in range(segments, 0, -1) if n * max_bits // segments <= budget)


def ring_keys(fps: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, start, ring, key, rest): the ring from each start, what must be equal there, and the bits that are not in the key.

    ``start`` is twice the segment where the chain begins, and one more for the second half.
    """
    width = 64 // segments
    equal, near = _last(0, segments, max_bits) * width, _last(1, segments, max_bits) * width
    half = (near - equal) // 2
    starts = F.array(*[F.struct(F.lit(s).alias("start"), _rotate(F.col("fp"), s * width).alias("ring")) for s in range(segments)])
    ring = fps.select("fp", F.explode(starts).alias("x")).select("fp", "x.start", "x.ring")
    bits = lambda a, b: F.shiftrightunsigned("ring", 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1))
    of = lambda i, a, rest: F.struct(F.lit(i).alias("half"), (F.shiftleft(bits(0, equal), half) + bits(a, a + half)).alias("key"), rest.alias("rest"))
    first = of(0, equal, bits(equal + half, 64))
    second = of(1, equal + half, F.shiftleft(bits(equal, equal + half), 64 - equal - 2 * half) + bits(equal + 2 * half, 64))
    return ring.select("fp", "start", "ring", F.explode(F.array(first, second)).alias("x")).select("fp", (2 * F.col("start") + F.col("x.half")).alias("start"), "ring", "x.key", "x.rest")


def dealt_on(keys: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS) -> DataFrame:
    """The same rows under longer keys: of 2*max_bits parts of the rest, each choice of max_bits that may be equal."""
    width = 64 // segments
    equal, near = _last(0, segments, max_bits) * width, _last(1, segments, max_bits) * width
    n, parts = 64 - equal - (near - equal) // 2, 2 * max_bits
    edges = [n * i // parts for i in range(parts + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(parts), max_bits)]
    choices = F.array(*[F.struct(F.lit(i).alias("i"), F.col("rest").bitwiseAND(F.lit(m).cast("bigint")).alias("equal")) for i, m in enumerate(masks)])
    more = keys.select("fp", "start", "ring", "key", F.explode(choices).alias("x"))
    return more.select("fp", (F.col("start") * len(masks) + F.col("x.i")).alias("start"), "ring", F.xxhash64("key", "x.equal").alias("key"))  # two keys with one hash only mean more pairs to check


def _forest(ring: np.ndarray, group: np.ndarray, segments: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is near within each group (rows sorted by group)."""
    n = len(ring)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    width, found_a, found_b = 64 // segments, [], []
    left = np.arange(n)
    for step in range(1, n):
        left = left[left + step < n]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        a = left[parent[left] != parent[left + step]]
        b = a + step
        diff = ring[a] ^ ring[b]
        chain = np.ones(len(a), dtype=bool)
        for length in range(1, segments + 1):  # budgets of the chain's prefixes; the last is the full check
            if (length * max_bits) // segments != ((length + 1) * max_bits) // segments or length == segments:
                chain[chain] = np.bitwise_count(diff[chain] >> np.uint64(64 - width * length)) <= (length * max_bits) // segments
        a, b = a[chain], b[chain]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                found_a.append(x)
                found_b.append(y)
        if len(a):
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return np.array(found_a, dtype=np.int64), np.array(found_b, dtype=np.int64)


def _near_in_keys(keys: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """(a, b): links within each (start, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            fp, start, ring, key = (t.column(c).to_numpy() for c in ("fp", "start", "ring", "key"))
            change = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (start[1:] != start[:-1]))])
            a, b = _forest(ring.view(np.uint64), change, segments, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        for batch in batches:  # sorted by (start, key): hold back the last key, as it may go on
            key, start = batch.column(3).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((key != key[-1]) | (start != start[-1])) if len(key) else []
            if not len(key):
                continue
            if len(last):
                split = int(last[-1]) + 1
                yield flush([*held, batch.slice(0, split)])
                held = [batch.slice(split)]
            else:
                held.append(batch)
        if held:
            yield flush(held)

    return keys.select("fp", "start", "ring", "key").repartition("start", "key").sortWithinPartitions("start", "key").mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, segments: int = SEGMENTS, max_bits: int = MAX_BITS, max_key: int = MAX_KEY) -> DataFrame:
    """(a, b) between distinct fingerprints: enough links to span all within max_bits of each other."""
    keys = ring_keys(fps, segments, max_bits)
    hot = cut(keys.groupBy("start", "key").count().where(F.col("count") > max_key).select("start", "key"))
    if hot.isEmpty():
        return _near_in_keys(keys, segments, max_bits)
    usual = keys.join(hot, ["start", "key"], "left_anti")
    crowded = keys.join(hot, ["start", "key"], "left_semi").select("fp", "start", "ring", "key", "rest")
    return _near_in_keys(usual, segments, max_bits).unionByName(_near_in_keys(dealt_on(crowded, segments, max_bits), segments, max_bits))


def grouped(docs: DataFrame, keep: tuple[str, ...], **options) -> DataFrame:
    """The columns ``keep`` with __fp and __root, equal for the rows that links reach; __first is the root's smallest doc_id."""
    marked = cut(fingerprints(docs, keep=list(keep)))
    fps = cut(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("first")))
    groups = connected_components(links(fps.select("fp"), **options))  # (node, root), linked fingerprints only
    roots = fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("__root"))
    named = roots.groupBy("__root").agg(F.min("first").alias("__first"))
    named = roots.select("fp", "__root").join(named, "__root")
    return marked.join(named, marked["__fp"] == named["fp"]).select(*keep, "__fp", "__root", "__first")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id reachable over links."""
    out = grouped(docs.select("doc_id", "text"), ("doc_id",), **options)
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__first").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (nulls last), then the smallest text hash.

    A row is its doc_id and text; of rows equal in both one stays, and a text whose doc_id stands on another one too is judged by itself.
    """
    rows = keyed(docs).select("doc_id", "text", "__th")
    found = cut(grouped(rows, ("doc_id", "__th"), **options).groupBy("__root", "doc_id", "__th").agg(F.count("*").alias("n")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "__th")
    best = found.groupBy("__root").agg(F.min(F.struct(first.alias("first"), "n")).alias("best"))
    gone = found.join(best, "__root").where((F.struct(F.col("doc_id").isNull(), "doc_id", "__th") != F.col("best.first")) | (F.col("n") > 1))
    gone = cut(gone.select(F.col("doc_id").alias("__gone_id"), F.col("__th").alias("__gone_th"), (F.struct(F.col("doc_id").isNull(), "doc_id", "__th") == F.col("best.first")).alias("__repeated")))
    hidden = aside(docs, "doc_id", "text").withColumn("__th", F.xxhash64(whole_text()))
    same = F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.col("__th") == F.col("__gone_th"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    out = back(hidden.join(few(gone), same, "left_anti"), docs)
    repeated = gone.where("__repeated")
    if not repeated.isEmpty():
        out = out.unionAll(back(hidden.join(few(repeated), same, "left_semi").dropDuplicates(["doc_id", "__th"]), docs))
    return out
