"""Removal of byte strings that occur elsewhere, by suffix arrays of what may repeat.

A string of WIDTH bytes repeats if it starts at two places of the corpus.  The
candidate search (``repeats``) deals windows into groups by one k-gram that equal
windows share.  In a group with one digest every window repeats, or none does.  In a
group with several, the distinct runs are written one after another, the shared k-gram as a
single letter and a letter of its own after each run, and sorted by suffix: a window
repeats if and only if its suffix agrees with a neighbour's over the window's length.
Runs are first trimmed to what any other run of the group reaches on either side.

Groups of more than MAX_RUNS distinct runs aren't given to one task: their windows
are named, counted and joined instead, which says the same of each window.  Runs and windows
are the same only if 128-bit digests of their bytes are; the suffix arrays compare the bytes.  The weaker hashes
of the candidate search only form groups.

Cases: null and empty texts have 0 bytes and nothing to remove; texts shorter than
a window keep all; very long texts are searched in overlapping pieces; repeated rows (equal doc_id and text) are two
occurrences and lose the same bytes; of equal strings none is first, so ties don't arise; an empty table gives an
empty result; other columns don't matter.  Bytes of a character may be cut apart: strings are of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.repeats import bit_table, find_runs, keyed, repeated_runs, tokens
from tessera.llm.shared import cut
from tessera.llm.suffix_array import suffix_array
from tessera.llm.textblock import covered, emit_blocks, map_blocks, prefix_hash, signed, span_hash, strong

WIDTH = 400
K = 300
MAX_RUNS = 1_000
#: Letters sorted together, and letters dealt to one task.
BATCH_LETTERS = 150_000
TASK_LETTERS = 400_000


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _reach(parts: list[bytes]) -> list[int]:
    """For each part the longest start that any other part has too."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    reach = [0] * len(parts)
    for a, b in zip(order, order[1:], strict=False):
        n = _shared(parts[a], parts[b])
        reach[a], reach[b] = max(reach[a], n), max(reach[b], n)
    return reach


def repeated_windows(groups: list[list[tuple[bytes, int]]], w: int) -> list[list[np.ndarray]]:
    """Starts (in each run) of windows that another place of the same group has too.

    A run is (its bytes without the shared k-gram, where that stands); a window is
    w letters, the k-gram counting as one.
    """
    out = [[np.zeros(0, dtype=np.int64) for _ in runs] for runs in groups]
    pieces, owner, begin, letter = [], [], [], 256 + len(groups)
    for g, runs in enumerate(groups):
        left, right = _reach([ctx[:a][::-1] for ctx, a in runs]), _reach([ctx[a:] for ctx, a in runs])
        for r, (ctx, a) in enumerate(runs):
            lo, hi = a - left[r], a + right[r]
            if hi - lo + 1 < w:
                continue
            text = np.frombuffer(ctx[lo:hi], dtype=np.uint8).astype(np.int64)
            pieces += [text[: a - lo], np.array([256 + g]), text[a - lo :], np.array([letter])]
            owner.append((g, r, lo, hi - lo + 1))
            begin.append(0 if not begin else begin[-1] + owner[-2][3] + 1)
            letter += 1
    if not pieces:
        return out
    text = np.concatenate(pieces)
    starts, lengths = np.array(begin), np.array([x[3] for x in owner])
    sa = suffix_array(text)
    run = np.searchsorted(starts, sa, side="right") - 1
    inside = sa - starts[run]
    whole = inside + w <= lengths[run]
    sa, run, inside = sa[whole], run[whole], inside[whole]
    prefix = prefix_hash(text.astype(np.uint64) + np.uint64(1))
    h = span_hash(prefix, sa, sa + w)
    alike = np.flatnonzero(h[1:] == h[:-1])
    span = np.arange(w)
    for lo in range(0, len(alike), 20_000):  # letter by letter, where the hashes agree
        x = alike[lo : lo + 20_000]
        alike[lo : lo + 20_000] = np.where((text[sa[x][:, None] + span] == text[sa[x + 1][:, None] + span]).all(axis=1), x, -1)
    alike = alike[alike >= 0]
    found = np.unique(np.concatenate([alike, alike + 1]))
    by_run = run[found]
    order = np.argsort(by_run, kind="stable")
    cuts = np.flatnonzero(np.diff(by_run[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        g, r, lo, _ = owner[by_run[part[0]]]
        out[g][r] = np.sort(inside[found[part]]) + lo
    return out


def _stretches(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.concatenate([gap, [len(starts) - 1]])] + width).tolist(), strict=True))


def _candidates(docs: DataFrame, runs: DataFrame, width: int, k: int) -> DataFrame:
    """(gram, doc_id, th, lo, n, anchor, d, d2, ctx): runs that may repeat, with 128 bits of their bytes; ctx where others share the k-gram only."""
    many = docs.sparkSession.sparkContext.broadcast(bit_table(runs, "gram", runs.count()))
    mixed_runs = runs.where("kinds > 1")
    mixed = docs.sparkSession.sparkContext.broadcast(bit_table(mixed_runs, "gram", mixed_runs.count()))

    def find(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch, many=many, mixed=mixed) -> dict:
        found = find_runs(*tokens(buf, off, "byte"), width, k)
        keep = np.flatnonzero(many.value.has(found.gram))
        gram, doc, lo, n, anchor = (getattr(found, f)[keep] for f in ("gram", "doc", "lo", "n", "anchor"))
        ctx: list[bytes | None] = [None] * len(keep)
        raw = buf.tobytes()
        begin = off[doc] + lo
        name = strong([b"%d:" % p + raw[a:b] for p, a, b in zip(anchor.tolist(), begin.tolist(), (begin + n - 1 + width).tolist(), strict=True)])
        _, first = np.unique(name, axis=1, return_index=True) if len(keep) else (None, np.zeros(0, dtype=np.int64))  # once a block is enough
        for i in first[mixed.value.has(gram[first])].tolist():
            a = int(begin[i])
            p = a + int(anchor[i])
            ctx[i] = raw[a:p] + raw[p + k : a + int(n[i]) - 1 + width]
        ids, hashes_of = (rows.column(i).take(pa.array(doc)) for i in range(2))  # not the texts
        return {
            "gram": signed(gram),
            "doc_id": ids,
            "th": hashes_of,
            "lo": lo.astype(np.int64),
            "n": n.astype(np.int64),
            "anchor": anchor.astype(np.int32),
            "d": name[0],
            "d2": name[1],
            "ctx": pa.array(ctx, pa.binary()),
        }

    return emit_blocks(docs, find, "gram bigint, doc_id bigint, th bigint, lo bigint, n bigint, anchor int, d bigint, d2 bigint, ctx binary", ["doc_id", "__th"])


def _sorted_groups(mixed: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, th, a, b) of repeated stretches, of the runs that occur once, from the suffix arrays of their groups."""
    w = width - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[dict]] = []
        letters = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows([[(x["ctx"], x["anchor"]) for x in g] for g in held], w)
            out = [
                (x["doc_id"], x["th"], x["lo"] + a, x["lo"] + b)
                for g, starts in zip(held, found, strict=True)
                for x, s in zip(g, starts, strict=True)
                if x["cnt"] == 1
                for a, b in _stretches(s, width)
            ]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["doc_id", "th", "a", "b"])

        for batch in batches:
            for x in batch.to_pylist():
                if not held or held[-1][0]["gram"] != x["gram"]:
                    if letters > BATCH_LETTERS:
                        yield flush()
                        held, letters = [], 0
                    held.append([])
                held[-1].append(x)
                letters += len(x["ctx"])
        if held:
            yield flush()

    letters = mixed.agg(F.sum(F.octet_length("ctx"))).first()[0] or 0
    return mixed.repartition(max(1, -(-letters // TASK_LETTERS)), "gram").sortWithinPartitions("gram", "d", "d2").mapInArrow(run, "doc_id bigint, th bigint, a bigint, b bigint")


def _counted_windows(mixed: DataFrame, width: int, k: int) -> DataFrame:
    """The same for groups too large for a task: windows named by 128 bits of their bytes, counted and joined."""
    w = width - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                at = np.arange(x["n"])
                name = strong([b"%d:" % (x["anchor"] - i) + x["ctx"][i : i + w - 1] for i in range(x["n"])])  # where the k-gram stands, and what is around it
                same = lambda v: pa.array([v] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([same(x["gram"]), *map(pa.array, name), same(x["cnt"]), same(x["doc_id"]), same(x["th"]), pa.array(at + x["lo"])], names=["gram", "h", "h2", "cnt", "doc_id", "th", "a"])

    windows = mixed.mapInArrow(run, "gram bigint, h bigint, h2 bigint, cnt bigint, doc_id bigint, th bigint, a bigint")
    twice = windows.groupBy("gram", "h", "h2").agg(F.sum("cnt").alias("total")).where("total > 1")
    return windows.where("cnt = 1").join(twice, ["gram", "h", "h2"], "left_semi").select("doc_id", "th", "a", (F.col("a") + width).alias("b"))


def repeated_stretches(docs: DataFrame, width: int = WIDTH, k: int = K, max_runs: int = MAX_RUNS) -> DataFrame:
    """(doc_id, th, spans): byte spans of each document that a repeated string covers, in any order."""
    places = cut(_candidates(docs, repeated_runs(docs, "byte", width, k), width, k))
    run = ["gram", "d", "d2"]
    names = places.groupBy(*run).agg(F.count("*").alias("cnt"))
    names = cut(names.withColumn("kinds", F.count("*").over(Window.partitionBy("gram"))).where("cnt > 1 or kinds > 1"))
    same = places.join(names.where("cnt > 1").select(*run), run).select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + width).alias("b"))
    opened = places.where("ctx is not null").groupBy(*run).agg(F.first(F.struct("doc_id", "th", "lo", "n", "anchor", "ctx")).alias("x"))
    mixed = cut(opened.join(names.where("kinds > 1"), run).select(*run, "cnt", "kinds", "x.*"))
    found = same.unionByName(_sorted_groups(mixed.where(F.col("kinds") <= max_runs), width, k))
    if not mixed.where(F.col("kinds") > max_runs).isEmpty():
        found = found.unionByName(_counted_windows(mixed.where(F.col("kinds") > max_runs), width, k))
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = K, max_runs: int = MAX_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    rows = keyed(docs)
    spans = repeated_stretches(rows, width, k, max_runs).withColumnsRenamed({"doc_id": "__id", "th": "__sth"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__sth")), "left").select("doc_id", "text", "spans")

    def clear(buf: np.ndarray, off: np.ndarray, part: pa.RecordBatch) -> dict:
        removed, count, kept = [], [], []
        for i, spans in enumerate(part.column(1)):
            raw = buf[off[i] : off[i + 1]]
            if not spans.is_valid:
                removed.append(0)
                count.append(0)
                kept.append(raw.tobytes())
                continue
            a, b = (spans.values.field(f).to_numpy() for f in ("a", "b"))
            gone = covered(a, b, len(raw))
            removed.append(int(gone.sum()))
            count.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(raw[~gone].tobytes())
        return {
            "n_bytes": np.diff(off).astype(np.int64),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(count, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
            "kept": pa.array(kept, pa.binary()),
        }

    out = map_blocks(joined, clear, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", ["doc_id", "spans"])
    return out.drop("spans")


