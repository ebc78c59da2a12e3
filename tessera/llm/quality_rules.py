"""Quality rules: heuristics and the divergence of a text from its language.

A document's histogram of character classes, and its histogram of its language's
common words, are compared with the language's own by Jensen-Shannon distance
(base 2, 0 to 1).  Both references come from trusted text: the documents that labels call good and not
toxic, or all documents of a language without such.  The common words of a language are the N_COMMON most frequent ones of
that text, counted over all of it; a reference histogram is the mean over its documents, each weighing the
same, so one long or copied text can't bend it.  Short texts have no stable histogram; they are left
to the base rules.

Repeated words are found exactly: words and windows are numbered by their bytes within a block.

Cases: a null or empty text has no words and fails the base rule; very long texts are counted whole; a null language is
a language like any other; a language with no text long enough isn't judged by distance; words that are equally frequent are taken in the order of their bytes;
repeated rows get equal answers; a document with several labels is trusted if all trust it; an empty table gives an
empty result.  Columns beyond doc_id, text and lang pass through; one named like a result is replaced by it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_ROWS, cut
from tessera.llm.textblock import LOWER, NOT_SPACE, byte_class, emit_blocks, map_blocks, window_ids, word_bounds, word_ids, word_values

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Below these a histogram is too thin to judge.
GUARD_CHARS, GUARD_WORDS = 200, 60
N_COMMON = 40
MAX_CLASS_DISTANCE = 0.20
MAX_WORD_DISTANCE = 0.36
#: Labelled ids that may be broadcast; with more, labels are joined by shuffle.
BROADCAST_IDS = 2_000_000

_CLASSES = np.full(256, 5)
_CLASSES[byte_class(b"abcdefghijklmnopqrstuvwxyz")] = 0
_CLASSES[128:192] = 8  # the rest of a character beyond ASCII: no character of its own
_CLASSES[192:] = 0
_CLASSES[byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASSES[byte_class(b"0123456789")] = 2
_CLASSES[byte_class(b" \t\n\x0b\x0c\r")] = 3
_CLASSES[byte_class(b".,;:!?'\"()-")] = 4
_CLASSES[byte_class(b"#*$%&|<>")] = 6
_CLASSES[:32][_CLASSES[:32] == 5] = 7
N_CLASSES = 8
_SYMBOL = byte_class(b"#*$%&|<>")


def _per_doc(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[off])


def _counts(buf: np.ndarray, off: np.ndarray) -> dict:
    """The base counts of each text of a block."""
    n = len(off) - 1
    starts, ends, words_at = word_bounds(buf, off, NOT_SPACE)
    raw = buf.tobytes()
    dup_lines = np.zeros(n, dtype=np.int64)
    for i in range(n):
        seen: set[bytes] = set()
        for line in raw[off[i] : off[i + 1]].split(b"\n"):
            if line in seen:
                dup_lines[i] += 1
            elif line.strip():
                seen.add(line)
    return {
        "n_words": np.diff(words_at).astype(np.int64),
        "word_chars": _per_doc(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80), off).astype(np.int64),
        "n_symbols": _per_doc(_SYMBOL[buf], off).astype(np.int64),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _repeat_words(word_ids(buf, starts, ends), words_at),
    }


def _repeat_words(ids: np.ndarray, words_at: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text has twice or more."""
    n = len(words_at) - 1
    doc = np.repeat(np.arange(n), np.diff(words_at))
    windows = window_ids(ids, width)
    start = np.arange(len(windows))
    start = start[start + width <= words_at[doc[: len(windows)] + 1]]
    _, key, times = np.unique(windows[start] * n + doc[start], return_inverse=True, return_counts=True)
    twice = start[times[key] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.subtract.at(edge, twice + width, 1)
    return _per_doc(np.cumsum(edge[:-1]) > 0, words_at).astype(np.int64)


def _class_shares(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each character class in each text, and its number of characters."""
    n = len(off) - 1
    at = np.repeat(np.arange(n), np.diff(off)) * (N_CLASSES + 1) + _CLASSES[buf]
    histogram = np.bincount(at, minlength=n * (N_CLASSES + 1)).reshape(n, -1)[:, :N_CLASSES]
    chars = histogram.sum(1)
    return histogram / np.maximum(chars, 1)[:, None], chars


def _word_shares(buf: np.ndarray, off: np.ndarray, rows: list[int], words: list[str]) -> np.ndarray:
    """Share of each of ``words``, and of all others, in the texts with these numbers."""
    n = len(off) - 1
    low = LOWER[buf]
    starts, ends, at = word_bounds(low, off, NOT_SPACE)
    joined = "".join(words).encode()
    stop = np.cumsum([len(w.encode()) for w in words])
    bins = word_values(np.frombuffer(joined, dtype=np.uint8), np.concatenate([[0], stop[:-1]]), stop)
    order = np.argsort(bins)
    values = word_values(low, starts, ends)
    place = np.minimum(np.searchsorted(bins[order], values), len(bins) - 1)
    hit = bins[order][place] == values
    doc = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(doc[hit] * len(bins) + order[place[hit]], minlength=n * len(bins)).reshape(n, -1)[rows]
    total = np.maximum(np.diff(at)[rows], 1)
    shares = counts / total[:, None]
    return np.concatenate([shares, np.maximum(0, 1 - shares.sum(1, keepdims=True))], axis=1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q; both sum to 1."""
    m = (p + q) / 2
    term = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0)
    return np.sqrt(np.maximum(0, ((term(p) + term(np.broadcast_to(q, p.shape))) / 2).sum(1)))


def trusted_text(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(lang, text) of the documents that make the references."""
    every = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text", F.col("lang").isNull().alias("no_lang"))
    if labels is None:
        return every.select("lang", "no_lang", "text")
    good = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.min("quality") == 1, F.lit(False)) & F.coalesce(F.max("toxic") == 0, F.lit(False))).alias("good")).where("good").select("doc_id")
    marked = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    mine = every.join(marked, "doc_id", "left_semi")
    known = mine.select("lang", "no_lang").distinct()
    others = every.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, ["lang", "no_lang"], "left_anti")
    return mine.unionByName(others).select("lang", "no_lang", "text")


def language_references(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(lang, no_lang, words, class_share, word_share): common words and mean histograms of trusted text.

    Each block of texts sends one row for each of its words, and then one row of sums for each of its languages.
    """
    text = trusted_text(docs, labels)

    def count(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        low = LOWER[buf]
        out: dict[str, list] = {"lang": [], "no_lang": [], "word": [], "n": []}
        for (lang, no_lang), mine in _langs(rows).items():
            seen = Counter(w for i in mine for w in low[off[i] : off[i + 1]].tobytes().split())
            out["lang"] += [lang] * len(seen)
            out["no_lang"] += [no_lang] * len(seen)
            out["word"] += seen.keys()
            out["n"] += seen.values()
        return {"lang": pa.array(out["lang"], pa.string()), "no_lang": pa.array(out["no_lang"], pa.bool_()), "word": pa.array(out["word"], pa.binary()), "n": pa.array(out["n"], pa.int64())}

    key = ["lang", "no_lang"]
    counted = emit_blocks(text, count, "lang string, no_lang boolean, word binary, n bigint", key).groupBy(*key, "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "word"))
    words = counted.withColumn("place", place).where(F.col("place") <= N_COMMON).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    words = cut(words.select(*key, F.transform("w", lambda x: x["word"].cast("string")).alias("words")))

    def sums(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        shares, chars = _class_shares(buf, off)
        n_words = np.diff(word_bounds(buf, off, NOT_SPACE)[2])
        judged = (chars >= GUARD_CHARS) & (n_words >= GUARD_WORDS)
        out: dict[str, list] = {"lang": [], "no_lang": [], "classes": [], "words": [], "n": []}
        for (lang, no_lang), mine in _langs(rows).items():
            if mine := [i for i in mine if judged[i]]:
                out["lang"].append(lang)
                out["no_lang"].append(no_lang)
                out["classes"].append(shares[mine].sum(0).tolist())
                out["words"].append(_word_shares(buf, off, mine, rows.column(2)[mine[0]].as_py()).sum(0).tolist())
                out["n"].append(len(mine))
        return {"lang": pa.array(out["lang"], pa.string()), "no_lang": pa.array(out["no_lang"], pa.bool_()), "classes": pa.array(out["classes"], pa.list_(pa.float64())), "words": pa.array(out["words"], pa.list_(pa.float64())), "n": pa.array(out["n"], pa.int64())}

    few = words.count() <= BROADCAST_ROWS
    parts = emit_blocks(text.join(F.broadcast(words) if few else words, key), sums, "lang string, no_lang boolean, classes array<double>, words array<double>, n bigint", [*key, "words"])
    total = parts.groupBy(*key).agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)], *[F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)], F.sum("n").alias("n"))
    shares = total.select(*key, F.array(*[F.col(f"c{i}") / F.col("n") for i in range(N_CLASSES)]).alias("class_share"), F.filter(F.array(*[F.col(f"w{i}") / F.col("n") for i in range(N_COMMON + 1)]), lambda x: x.isNotNull()).alias("word_share"))
    return cut(words.join(shares, key))


def _langs(rows: pa.RecordBatch) -> dict[tuple[str, bool], list[int]]:
    by: dict[tuple[str, bool], list[int]] = {}
    for i, key in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
        by.setdefault(key, []).append(i)
    return by


_ADDED = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double"
_RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs with the counts, both distances (null where not judged), base_failed and kept."""
    refs = language_references(docs, labels)
    few = refs.count() <= BROADCAST_ROWS
    refs = refs.select(F.col("lang").alias("__lang"), F.col("no_lang").alias("__none"), F.col("words").alias("__words"), F.col("class_share").alias("__classes"), F.col("word_share").alias("__shares"))
    keep = [c for c in docs.columns if c not in _RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows = rows.join(F.broadcast(refs) if few else refs, (F.coalesce(F.col("lang"), F.lit("")) == F.col("__lang")) & (F.col("lang").isNull() == F.col("__none")), "left")

    def make(buf: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> dict:
        out = _counts(buf, off)
        shares, chars = _class_shares(buf, off)
        judged = (chars >= GUARD_CHARS) & (out["n_words"] >= GUARD_WORDS)
        by_class, by_word = np.full(len(off) - 1, np.nan), np.full(len(off) - 1, np.nan)
        lang, none, words, classes, word_shares = (batch.column(len(keep) + i) for i in range(5))
        for mine in _langs(pa.RecordBatch.from_arrays([lang, none], names=["l", "n"])).values():
            mine = [i for i in mine if judged[i] and words[i].is_valid]
            if mine:
                by_class[mine] = js_distance(shares[mine], np.array(classes[mine[0]].as_py()))
                by_word[mine] = js_distance(_word_shares(buf, off, mine, words[mine[0]].as_py()), np.array(word_shares[mine[0]].as_py()))
        return {**out, "class_distance": pa.array(by_class, from_pandas=True), "word_distance": pa.array(by_word, from_pandas=True)}

    out = map_blocks(rows, make, _ADDED, keep, seen=["__lang", "__none", "__words", "__classes", "__shares"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
