"""Removal of word spans that occur earlier, by a compacted de Bruijn graph.

The edges of the graph are the windows of WIDTH words that occur more than once.
The candidate search (``repeats``) finds them in runs: neighbouring windows of one
text that share a k-gram.  A run whose k-gram occurs with one digest only is a path without
branches already.  In the other groups the distinct runs are opened into windows;
windows with one successor and one predecessor are put together again, through joins.  What comes of it are
segments: stretches of windows that always occur together.

The same is done across runs: a segment links to the one that follows it in a text, and where
a link is the only one on both its ends, the two belong to one path.  Each occurrence
of a path is then one row (document, start, length).  The source of a path is its first
occurrence, smallest doc_id and then smallest start.  Words are removed only where they were
verified: runs, windows and segments are named by 128-bit digests of their very words, so the hashes
that the candidate search groups by decide nothing, and an occurrence is held against the coordinates of its source
segment by segment.

Copies cost one row each, never a pair; all groups meet as sums over keys.

Cases: null and empty texts have no words; texts of fewer words than a window keep
all; very long texts are cut into overlapping pieces for the search and rebuilt whole; rows with equal doc_id are at one place in the order, so neither is earlier
than the other at an equal start, and each of them is walked by itself; a null doc_id comes before all others; an empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.repeats import bit_table, find_runs, keyed, repeated_runs, tokens
from tessera.llm.shared import cut, release
from tessera.llm.textblock import NOT_SPACE, covered, emit_blocks, lists, map_blocks, signed, strong, word_bounds

WIDTH = 20
K = 6


def _candidates(docs: DataFrame, runs: DataFrame, width: int, k: int) -> DataFrame:
    """(gram, row, doc_id, th, lo, n, seg, seg2, windows, windows2): runs that may repeat, named by 128 bits of their words.

    ``row`` numbers the rows of docs, so that rows with equal doc_id and text stay apart.  Where the k-gram has several digests, there are
    also 128 bits of each window, once a block.
    """
    many = docs.sparkSession.sparkContext.broadcast(bit_table(runs, "gram", runs.count()))
    mixed_runs = runs.where("kinds > 1")
    mixed = docs.sparkSession.sparkContext.broadcast(bit_table(mixed_runs, "gram", mixed_runs.count()))
    numbers: dict[int, int] = {}  # by task: the next row

    def find(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch, many=many, mixed=mixed, numbers=numbers) -> dict:
        values, at = tokens(buf, off, "word")
        found = find_runs(values, at, width, k)
        keep = np.flatnonzero(many.value.has(found.gram))
        gram, doc, lo, n = (getattr(found, f)[keep] for f in ("gram", "doc", "lo", "n"))
        words = buf.tobytes().split()  # of a block: no word goes on from one text to the next, as texts are parted in tokens()
        if len(words) != len(values):
            words = [w for i in range(len(off) - 1) for w in buf[off[i] : off[i + 1]].tobytes().split()]
        begin = at[doc] + lo
        seg = strong([b" ".join(words[a : a + m]) for a, m in zip(begin.tolist(), (n - 1 + width).tolist(), strict=True)])
        _, first = np.unique(seg, axis=1, return_index=True) if len(keep) else (None, np.zeros(0, dtype=np.int64))
        opened = np.zeros(len(keep), dtype=bool)
        opened[first[mixed.value.has(gram[first])]] = True
        counts = np.where(opened, n, 0)
        starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        each = strong([b" ".join(words[a : a + width]) for a in starts.tolist()])
        ids, hashes_of = (rows.column(i).take(pa.array(doc)) for i in range(2))  # not the texts
        task = TaskContext.get()
        first_row = numbers.setdefault(task.taskAttemptId(), task.partitionId() << 40)
        numbers[task.taskAttemptId()] = first_row + len(off) - 1
        return {
            "gram": signed(gram), "row": first_row + doc, "doc_id": ids, "th": hashes_of, "lo": lo.astype(np.int64), "n": n.astype(np.int64),
            "seg": seg[0], "seg2": seg[1], "windows": lists(each[0], counts), "windows2": lists(each[1], counts),
        }

    return emit_blocks(docs, find, "gram bigint, row bigint, doc_id bigint, th bigint, lo bigint, n bigint, seg bigint, seg2 bigint, windows array<bigint>, windows2 array<bigint>", ["doc_id", "__th"])


def _same(*cols: str) -> Column:
    """All rows of a group agree in these columns (named c0 and c1 for the least and the greatest of c)."""
    out = F.lit(True)
    for c in cols:
        out = out & (F.col(f"{c}0") == F.col(f"{c}1"))
    return out


def _ends(*cols: str) -> list[Column]:
    return [f(c).alias(f"{c}{i}") for c in cols for i, f in enumerate((F.min, F.max))]


def _only(*cols: str) -> list[Column]:
    """Each column's one value in the group, zeros where there are several."""
    return [F.when(_same(*cols), F.col(f"{c}0")).otherwise(0).alias(c) for c in cols]


def _pieces(opened: DataFrame) -> DataFrame:
    """(gram, seg, seg2, pieces) of distinct runs: their stretches of windows that always occur together, repeated ones only.

    ``opened`` has gram, seg, seg2, cnt and the windows, a row for each distinct run.
    """
    run = ["gram", "seg", "seg2"]
    each = opened.select(*run, "cnt", F.posexplode(F.arrays_zip("windows", "windows2")).alias("i", "x"), "windows", "windows2")
    near = lambda c, by: F.coalesce(F.try_element_at(c, F.col("i") + 1 + by), F.lit(0)) if by > 0 else F.when(F.col("i") > 0, F.try_element_at(c, F.greatest(F.col("i"), F.lit(1)))).otherwise(F.lit(0))
    each = each.select(
        *run, "cnt", "i", F.col("x.windows").alias("w"), F.col("x.windows2").alias("w2"),
        near("windows", 1).alias("next"), near("windows2", 1).alias("next2"), near("windows", -1).alias("prev"), near("windows2", -1).alias("prev2"),
    )
    stats = each.groupBy("gram", "w", "w2").agg(F.sum("cnt").alias("total"), *_ends("next", "next2", "prev", "prev2"))
    stats = stats.where("total > 1").select("gram", "w", "w2", *_only("next", "next2"), *_only("prev", "prev2"))
    known = each.select(*run, "i", "w", "w2").join(stats, ["gram", "w", "w2"])
    line = Window.partitionBy(*run).orderBy("i")
    before = lambda c: F.lag(c).over(line)
    glued = (before("i") == F.col("i") - 1) & (before("next") == F.col("w")) & (before("next2") == F.col("w2")) & (F.col("prev") == before("w")) & (F.col("prev2") == before("w2"))
    cuts = known.withColumn("head", F.when(F.coalesce(glued, F.lit(False)), 0).otherwise(1)).withColumn("piece", F.sum("head").over(line))
    first = F.min(F.struct("i", "w", "w2")).alias("f")
    pieces = cuts.groupBy(*run, "piece").agg(first, F.count("*").alias("n"))
    return pieces.groupBy(*run).agg(F.sort_array(F.collect_list(F.struct("f.i", "n", F.col("f.w").alias("seg"), F.col("f.w2").alias("seg2")))).alias("pieces"))


def segments(docs: DataFrame, width: int = WIDTH, k: int = K) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(row, doc_id, at, n, seg, seg2): every occurrence of every repeated segment; (row, doc_id, th), one row of each text; and the written tables that the first reads."""
    runs = repeated_runs(docs, "word", width, k)
    places = cut(_candidates(docs, runs, width, k).join(runs, "gram").withColumn("gram", F.when(F.col("kinds") > 1, F.col("gram"))))  # the k-gram of others is of no more use
    # equal rows have equal places: the least of them speaks for all
    names = cut(places.select("row", "doc_id", "th").distinct().groupBy("doc_id", "th").agg(F.min("row").alias("row")))
    plain = places.where("kinds = 1").select("row", "doc_id", F.col("lo").alias("at"), "n", "seg", "seg2")
    # counted anew under the names of 128 bits: runs that only share a digest are told apart here
    opened = places.where("kinds > 1").groupBy("gram", "seg", "seg2").agg(F.count("*").alias("cnt"), *[F.first(F.when(F.size(c) > 0, F.col(c)), ignorenulls=True).alias(c) for c in ("windows", "windows2")])
    pieces = cut(_pieces(opened.where("windows is not null")))  # written, so that a run with many places can be split in the join
    mixed = places.where("kinds > 1").select("gram", "seg", "seg2", "row", "doc_id", "lo").join(pieces, ["gram", "seg", "seg2"])
    mixed = mixed.select("row", "doc_id", "lo", F.explode("pieces").alias("p")).select("row", "doc_id", (F.col("lo") + F.col("p.i")).alias("at"), F.col("p.n").alias("n"), F.col("p.seg").alias("seg"), F.col("p.seg2").alias("seg2"))
    return plain.unionByName(mixed), names, [places, pieces]


def paths(found: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(row, doc_id, at, n, source, parts): every occurrence of every path without branches.

    ``parts`` are its segments, each with its own first place.  Paths run within a row: rows with equal doc_id and text
    each have their own.  The tables ``spent`` aren't needed once the links are written.
    """
    text = Window.partitionBy("row").orderBy("at")
    follows = F.lead("at").over(text) == F.col("at") + F.col("n")
    preceded = F.lag("at").over(text) + F.lag("n").over(text) == F.col("at")
    beside = lambda how, there, c: F.when(there, how(c).over(text)).otherwise(F.lit(0))
    # neighbours by half of their names: a wrong link only makes a path that later_spans judges segment by segment
    linked = cut(found.withColumns({"next": beside(F.lead, follows, "seg"), "prev": beside(F.lag, preceded, "seg")}))
    release(*spent)
    nodes = linked.groupBy("seg", "seg2").agg(*_ends("next", "prev"), F.min(F.struct("doc_id", "at")).alias("first"))
    nodes = cut(nodes.select("seg", "seg2", "first", *_only("next"), *_only("prev")))
    glued = nodes.where("prev != 0").alias("b").join(nodes.where("next != 0").alias("a"), (F.col("b.prev") == F.col("a.seg")) & (F.col("a.next") == F.col("b.seg")) & (F.col("a.seg") != F.col("b.seg")))
    nodes = nodes.join(glued.select(F.col("b.seg").alias("seg"), F.col("b.seg2").alias("seg2"), F.lit(True).alias("glued")).distinct(), ["seg", "seg2"], "left")
    nodes = cut(nodes.select("seg", "seg2", "first", F.coalesce("glued", F.lit(False)).alias("glued")))  # likewise for a segment with many places
    placed = linked.select("row", "doc_id", "at", "n", "seg", "seg2", (F.col("prev") != 0).alias("joined")).join(nodes, ["seg", "seg2"])
    head = F.when(F.col("glued") & F.col("joined"), 0).otherwise(1)
    numbered = placed.withColumn("path", F.sum(head).over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("row", "path").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "n", "seg", "seg2", "first"))).alias("parts")).select(
        "row", "doc_id", F.col("parts")[0]["at"].alias("at"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"]).alias("n"), F.col("parts")[0]["first"].alias("source"), "parts"
    )


def later_spans(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, th, spans): word spans covered by windows that start earlier too, in any order.

    An occurrence is held against its source segment by segment: each is named by 128 bits of its words, and
    stands at the source's own distance from the path's start, or else is judged against its own first place.
    """
    occurrences, names, spent = segments(docs, width, k)
    found = paths(occurrences, spent)
    at_source = lambda place, source: (source["doc_id"].eqNullSafe(F.col("doc_id"))) & (source["at"] == place)
    whole = F.forall("parts", lambda p: p["first"]["doc_id"].eqNullSafe(F.col("source.doc_id")) & (p["first"]["at"] - F.col("source.at") == p["at"] - F.col("at")))
    later = F.filter("parts", lambda p: ~at_source(p["at"], p["first"]))
    spans = F.when(whole, F.when(~at_source(F.col("at"), F.col("source")), F.array(F.struct(F.col("at").alias("at"), F.col("n").alias("n"))))).otherwise(F.transform(later, lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"))))
    spans = found.select("row", F.explode(spans).alias("x"))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct(F.col("x.at").alias("a"), (F.col("x.at") + F.col("x.n") - 1 + width).alias("b"))).alias("spans"))
    return spans.join(names, "row").select("doc_id", "th", "spans")


def remove_later(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by spaces)."""
    rows = keyed(docs)
    spans = later_spans(rows, width, k).withColumnsRenamed({"doc_id": "__id", "th": "__sth"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__sth")), "left").select("doc_id", "text", "spans")

    def clear(buf: np.ndarray, off: np.ndarray, part: pa.RecordBatch) -> dict:
        _, _, at = word_bounds(buf, off, NOT_SPACE)
        raw = buf.tobytes()
        removed, kept = [], []
        for i, spans in enumerate(part.column(1)):
            words = raw[off[i] : off[i + 1]].split()
            if spans.is_valid:
                gone = covered(*(spans.values.field(f).to_numpy() for f in ("a", "b")), len(words))
                words = [words[j] for j in np.flatnonzero(~gone).tolist()]
            removed.append(int(at[i + 1] - at[i]) - len(words))
            kept.append(b" ".join(words))
        return {"n_words": np.diff(at).astype(np.int64), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    return map_blocks(joined, clear, "n_words bigint, n_removed bigint, kept_sha256 string, kept string", ["doc_id", "spans"]).drop("spans")
