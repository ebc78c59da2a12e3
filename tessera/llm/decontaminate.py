"""Benchmark decontamination by winnowing.

The hashes of all runs of K words of a text are sampled: every window of WIDTH words, which
holds WIDTH-K+1 such runs, keeps its smallest (the rightmost, if several are).  Equal windows keep the same
hash, so every shared span of WIDTH words or more has a kept hash on both sides.  Kept hashes
of documents are joined with those of the benchmark.

A hit is extended window by window: the neighbouring windows that kept the same hash travel with it, each named by 128
bits of its words, and join the item's windows of that name; those found lie side by side and make up the
whole shared span.  A window with the same words at many places of a text travels once, so texts that repeat
themselves cost no more than others.  An item of fewer than WIDTH words is one window, kept whole.

Both joins are Spark's: neither side passes through the driver.  A bit table of bounded size (``repeats.BitTable``)
of the benchmark's hashes only saves document rows that would find no partner.

Cases: null and empty texts have no words and no hits; very long texts are read whole; null or empty items have no
windows; an item with a null id counts for n_hit and n_items, and has no name in
the list of ids; items with equal ids are one item; repeated documents get equal answers;
empty tables give no hits, or an empty result.  Further columns pass through; one named like a
result (n_words, hit_spans, items, n_items) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import bit_table
from tessera.llm.shared import cut
from tessera.llm.textblock import ALNUM_OR_BEYOND, LOWER, emit_blocks, lists, prefix_hash, signed, span_hash, strong, whole_text, word_bounds, word_values

WINDOW_WORDS = 10
K = 5
RESULTS = ("n_words", "hit_spans", "items", "n_items")
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def kept_windows(values: np.ndarray, bounds: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``width`` words inside one text, and the k-gram hash that each keeps; bounds separate texts."""
    n, w = len(values) - width + 1, width - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(len(values) - k + 1)
    grams = span_hash(prefix_hash(values), at, at + k)
    best = grams[:n].copy()
    for step in range(1, w):
        np.minimum(best, grams[step : n + step], out=best)
    start = np.arange(n)
    inside = start + width <= bounds[np.searchsorted(bounds, start, side="right")]
    return start[inside], best[inside]


def _windows(buf: np.ndarray, off: np.ndarray, width: int, k: int, whole: np.ndarray | list[int], wanted) -> tuple[np.ndarray, ...]:
    """(text, start in it, words, hash, digests) of a block's windows whose kept hash is ``wanted``.

    ``whole`` are the lengths below ``width`` that are windows too, as spans of a document; a negative one
    stands for texts of just that length.
    """
    low = LOWER[buf]
    starts, ends, at = word_bounds(low, off, ALNUM_OR_BEYOND)
    values = word_values(low, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    begin, prints = kept_windows(values, at[1:], k, width)
    keep = np.flatnonzero(wanted(prints))
    found = [(begin[keep], np.full(len(keep), width), prints[keep])]
    prefix = prefix_hash(values)
    for size in whole:
        n = abs(size)
        s = np.arange(max(0, len(values) - n + 1)) if size > 0 else at[:-1][np.diff(at) == n]
        s = s[s + n <= at[doc[s] + 1]]
        h = span_hash(prefix, s, s + n)
        s, h = s[wanted(h)], h[wanted(h)]
        found.append((s, np.full(len(s), n), h))
    begin, size, prints = (np.concatenate(x) for x in zip(*found, strict=True))
    raw = low.tobytes()
    first, last = starts[begin], ends[begin + size - 1] if len(begin) else ends[:0]
    text = [b" ".join(_split(raw[a:b])) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return doc[begin], begin - at[doc[begin]], size, prints, strong(text)


_GAPS = bytes(32 if not ALNUM_OR_BEYOND[i] else i for i in range(256))


def _split(raw: bytes) -> list[bytes]:
    return raw.translate(_GAPS).split()


def item_windows(benchmark: DataFrame, width: int = WINDOW_WORDS, k: int = K) -> DataFrame:
    """(h, w, w2, size, id): every window of every item, once, under the hash that it keeps."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), "text")

    def make(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        item, _, size, h, name = _windows(buf, off, width, k, [-n for n in range(1, width)], lambda x: np.ones(len(x), dtype=bool))
        return {"h": signed(h), "w": name[0], "w2": name[1], "size": size.astype(np.int32), "id": rows.column(0).take(pa.array(item))}

    return emit_blocks(bench, make, "h bigint, w bigint, w2 bigint, size int, id string", ["id"]).distinct()


def document_windows(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS, k: int = K) -> DataFrame:
    """(doc_id, th, h, w, w2, size, at): windows of documents that may be items' windows, each once a text with all its places."""
    prints = items.select("h").distinct()
    table = docs.sparkSession.sparkContext.broadcast(bit_table(prints, "h", prints.count()))
    sizes = [r["size"] for r in items.where(F.col("size") < width).select("size").distinct().collect()]  # at most width - 1

    def make(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        doc, at, size, h, name = _windows(buf, off, width, k, sizes, table.value.has)
        order = np.lexsort((at, name[1], name[0], doc))
        key = np.stack([doc[order], name[0][order], name[1][order]])
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        one = order[first]
        ids, hashes_of = (rows.column(i).take(pa.array(doc[one])) for i in range(2))
        return {"doc_id": ids, "th": hashes_of, "h": signed(h[one]), "w": name[0][one], "w2": name[1][one], "size": size[one].astype(np.int32), "at": lists(at[order].astype(np.int32), np.diff(np.append(first, len(order))))}

    return emit_blocks(docs, make, "doc_id bigint, th bigint, h bigint, w bigint, w2 bigint, size int, at array<int>", ["doc_id", "__th"])


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each text's window places to spans; a linear pass over sorted places."""
    for batch in batches:
        out = []
        for at, size in zip(batch.column(2), batch.column(3), strict=True):
            a, n = at.values.to_numpy(zero_copy_only=False), size.values.to_numpy(zero_copy_only=False)
            order = np.argsort(a, kind="stable")
            a, b = a[order], (a + n)[order]
            reach = np.maximum.accumulate(b)
            new = np.ones(len(a), dtype=bool)
            new[1:] = a[1:] > reach[:-1]
            first = np.flatnonzero(new)
            out.append([{"a": int(x), "b": int(y)} for x, y in zip(a[first], reach[np.append(first[1:] - 1, len(a) - 1)], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["doc_id", "th", "hit_spans"])


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, k: int = K) -> DataFrame:
    """(doc_id, th, hit_spans, items, n_items) of the documents (doc_id, text, __th) that share a window with an item."""
    items = cut(item_windows(benchmark, width, k))
    own = cut(document_windows(docs, items, width, k))
    name = ["h", "w", "w2", "size"]
    shared = own.join(items.select(*name).distinct(), name, "left_semi").select("doc_id", "th", F.explode("at").alias("at"), "size")
    places = shared.groupBy("doc_id", "th").agg(F.collect_list("at").alias("at"), F.collect_list("size").alias("size"))
    spans = places.mapInArrow(_join_spans, "doc_id bigint, th bigint, hit_spans array<struct<a:int,b:int>>")
    named = own.select("doc_id", "th", *name).join(items, name).groupBy("doc_id", "th", "id").agg(F.lit(1).alias("one"))
    named = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("id")).alias("items"), F.count("*").alias("n_items"), F.count_if(F.col("id").isNull()).alias("nameless"))
    named = named.select("doc_id", "th", F.when(F.col("nameless") > 0, F.array_append("items", F.lit(None).cast("string"))).otherwise(F.col("items")).alias("items"), "n_items")
    here = {c: f"__{c}" for c in ("doc_id", "th")}
    both = spans.join(named.withColumnsRenamed(here), F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th") == F.col("__th")))
    return both.select("doc_id", "th", "hit_spans", "items", "n_items")


def word_count(text: Column) -> Column:
    """Words of digits, letters and what is beyond ASCII; case doesn't matter to their number."""
    return F.regexp_count(text, F.lit(_WORD)).cast("bigint")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, k: int = K) -> DataFrame:
    """docs with n_words, hit_spans (of words), items (ids as strings), n_items."""
    th = F.xxhash64(whole_text())
    found = cut(hits(docs.select("doc_id", "text", th.alias("__th")), benchmark, width, k))
    found = found.select(F.col("doc_id").alias("__hit_id"), F.col("th").alias("__hit_th"), *[F.col(c).alias(f"__{c}") for c in RESULTS[1:]])
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    rows = docs.select(*keep, word_count(whole_text()).alias("n_words"), th.alias("__th"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (F.col("__th") == F.col("__hit_th")), "left")
    none = lambda t: F.array().cast(t)
    return out.select(
        *keep, "n_words", F.coalesce("__hit_spans", none("array<struct<a:int,b:int>>")).alias("hit_spans"), F.coalesce("__items", none("array<string>")).alias("items"), F.coalesce("__n_items", F.lit(0).cast("bigint")).alias("n_items")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["b"] - x["a"])
    named = F.array_join(F.array_sort(F.filter("items", lambda x: x.isNotNull())), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(named, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

