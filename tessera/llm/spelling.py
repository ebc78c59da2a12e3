"""Spelling variants, found by search schemes over FM-indexes of the delimited vocabulary.

Words one code point apart agree in one half: cut w in two; the other word v then starts with w's first half or
ends with its second one.  So there are two schemes.  The first reads from left to right: it matches the opening
delimiter and the first half exactly, then goes on over the second half with at most one error, then matches the
closing delimiter.  The other is its mirror and reads from right to left.  What stands for all that has been read
is an interval of suffix ranks; a letter more costs two rank queries, for all searches of a shard at once.  The interval
of the closed word has one rank, and its suffix tells the word.

An index that reads from left to right is that of the mirrored words, so one function serves both.  The vocabulary is
dealt to shards by halves: a word is indexed under each start that may be the first half of a word of its length, one more or
one less (and each such end), and it searches the shards of its own two halves only.  A shard holds about SHARD_WORDS
entries; a half with more is parted, its searches too, and each part of it meets each.

Words are counted within tasks before anything is shuffled.  The crc32 of "<doc_id>:<run>" is put together from those of
the document's prefix and of the distinct run (crc32 is linear), so runs are not hashed once an occurrence.

Cases: null and empty texts have no words; a null doc_id is written as nothing; very long texts are read whole, repeated rows
count again; ties of n go to the smaller word; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, release
from tessera.llm.textblock import LOWER, blocks, byte_class, whole_text, word_ids

MIN_LENGTH, MIN_COUNT, DELETE, RATIO = 5, 3, 97, 2
SHARD_WORDS = 1 << 12
#: Words a task counts before it passes them on.
HELD_WORDS = 1 << 18
_ALPHA = byte_class(b"abcdefghijklmnopqrstuvwxyz")
_LATIN = 0xC3  # the lead byte of U+00C0 to U+00FF, and of nothing else
_crc_steps: dict[int, np.ndarray] = {}


def _runs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters in lowered bytes, and the number of runs before each text."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    lead = buf == _LATIN
    inside[:-1] = _ALPHA[buf] | lead
    inside[1:-1] |= lead[:-1]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    begins, stops = inside & ~before, before & ~inside
    edge = off[1:-1]
    both = edge[inside[edge] & before[edge]]
    begins[both] = stops[both] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, off)


def _step(length: int) -> np.ndarray:
    """Tables (4, 256): the part of a crc that each of its bytes leaves after ``length`` bytes more."""
    if length not in _crc_steps:
        zeros = b"\0" * length
        rest = zlib.crc32(zeros, 0)
        bit = [zlib.crc32(zeros, 1 << i) ^ rest for i in range(32)]
        table = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for value in range(256):
                x = 0
                for i in range(8):
                    x ^= bit[8 * byte + i] if value >> i & 1 else 0
                table[byte, value] = x
        _crc_steps[length] = table
    return _crc_steps[length]


def joined_crc(prefix: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of prefix + word from that of each."""
    out = word.copy()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        p = prefix[at]
        if n > 255:  # one at a time: tables are for words
            out[at] ^= np.array([zlib.crc32(b"\0" * n, int(x)) ^ zlib.crc32(b"\0" * n) for x in p], dtype=np.uint32)
            continue
        t = _step(n)
        out[at] ^= t[0, p & 255] ^ t[1, p >> 8 & 255] ^ t[2, p >> 16 & 255] ^ t[3, p >> 24]
    return out


def _block_words(buf: np.ndarray, off: np.ndarray, ids: list) -> Counter:
    """The words of a block after the contract's deletions, with counts."""
    low = LOWER[buf]
    starts, ends, at = _runs(low, off)
    if not len(starts):
        return Counter()
    distinct, first, word = np.unique(word_ids(low, starts, ends), return_index=True, return_inverse=True)
    raw = low.tobytes()
    named = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    own = np.array([zlib.crc32(w) for w in named], dtype=np.uint32)
    head = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], dtype=np.uint32)
    text = np.repeat(np.arange(len(off) - 1), np.diff(at))
    h = joined_crc(head[text], own[word], ends - starts)
    struck = h % DELETE == 0
    counts = np.bincount(word[~struck], minlength=len(distinct)).tolist()
    out = Counter()
    for w, n in zip(named, counts, strict=True):
        if n and len(w) >= MIN_LENGTH and len(s := w.decode()) >= MIN_LENGTH:
            out[s] += n
    for j in np.flatnonzero(struck).tolist():
        s = named[word[j]].decode()
        p = int(h[j]) % len(s)
        if len(s) > MIN_LENGTH:
            out[s[:p] + s[p + 1 :]] += 1
    return out


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, off in blocks(batch.column(1), 1 << 20):
                held.update(_block_words(buf, off, ids[lo:hi]))
                if len(held) > HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    each = docs.select("doc_id", whole_text().alias("text")).mapInArrow(count, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class FMIndex:
    """Ranks of suffixes of $word$word$...$; reads from right to left."""

    def __init__(self, words: list[str]) -> None:
        letters = sorted(set("".join(words)))
        self.code = {c: i + 2 for i, c in enumerate(letters)}  # 0 ends the text, 1 is the delimiter
        self.letters = len(letters)
        lengths = np.array([len(w) + 1 for w in words])
        self.starts = np.cumsum(lengths) - lengths  # of the delimiters before the words
        text = np.array([1, *[x for w in words for x in (*[self.code[c] for c in w], 1)], 0], dtype=np.int64)
        self.n = len(text)
        rank, span = text, 1
        while True:  # prefix doubling: few rounds, as words are short and distinct
            after = np.zeros(self.n, dtype=np.int64)
            after[:-span] = rank[span:] + 1
            key = rank * (self.n + 2) + after
            _, rank = np.unique(key, return_inverse=True)
            if rank.max() == self.n - 1:
                break
            span *= 2
        self.suffix = np.argsort(rank)
        last = text[self.suffix - 1]  # the letter before each suffix; before the text its end
        self.keys = np.sort(last * (self.n + 1) + np.arange(self.n))

    def before(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The rank that a suffix below ``rank`` gets with the letter in front: one bound of the next interval."""
        return np.searchsorted(self.keys, letter * (self.n + 1) + rank)

    def word_of(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.suffix[rank], side="right") - 1


def search(index: FMIndex, asked: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs that agree in the query's last ``exact`` letters and differ by one code point at most before them."""
    length, exact = np.array([len(w) for w in asked], dtype=np.int64), np.array(exact, dtype=np.int64)
    wide = int(length.max(initial=0))
    letters = np.full((len(asked), wide + 1), -1, dtype=np.int64)  # from the end of the query to its start, then the delimiter
    for i, w in enumerate(asked):
        letters[i, : len(w)] = [index.code.get(c, -1) for c in reversed(w)]
        letters[i, len(w)] = 1
    q = np.arange(len(asked))
    lo, hi = index.before(np.ones(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)), index.before(np.ones(len(q), dtype=np.int64), np.full(len(q), index.n))
    pos, err = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=bool)
    found_q, found_w = [], []

    def step(letter: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, err: np.ndarray) -> tuple:
        a, b = index.before(letter, lo), index.before(letter, hi)
        ok = (a < b) & (letter > 0)
        return q[ok], a[ok], b[ok], pos[ok], err[ok]

    while len(q):
        at = letters[q, pos]
        closing = pos == length[q]
        nexts = [step(at, q, lo, hi, pos + 1, err)]
        free = ~err & (pos >= exact[q])
        if free.any():
            f = np.flatnonzero(free)
            every = np.tile(np.arange(2, index.letters + 2), len(f))
            each = np.repeat(f, index.letters)
            nexts.append(step(every, q[each], lo[each], hi[each], pos[each], ~err[each]))  # one letter more
            other = (every != at[each]) & ~closing[each]
            every, each = every[other], each[other]
            nexts.append(step(every, q[each], lo[each], hi[each], pos[each] + 1, ~err[each]))  # another letter
            less = f[~closing[f]]
            nexts.append((q[less], lo[less], hi[less], pos[less] + 1, ~err[less]))  # one letter less
        q, lo, hi, pos, err = (np.concatenate([x[i] for x in nexts]) for i in range(5))
        done = pos > length[q]
        if done.any():
            found_q.append(q[done])
            found_w.append(index.word_of(lo[done]))
            q, lo, hi, pos, err = (x[~done] for x in (q, lo, hi, pos, err))
    if not found_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = np.unique(np.stack([np.concatenate(found_q), np.concatenate(found_w)]), axis=1)
    return both[0], both[1]


def _dealt(words: DataFrame, shard_words: int) -> DataFrame:
    """(shard, i, j, side, word, n, indexed): entries of the indexes and the searches that meet them."""
    size = F.length("word")
    halves = lambda *at: F.array_distinct(F.array(*at))
    begin = lambda n: F.substring("word", F.lit(1), n)
    end = lambda n: F.substring("word", size - n + 1, n)
    floor = lambda x: F.floor(x / 2).cast("int")
    firsts = [begin(floor(size + d)) for d in (-1, 0, 1)]
    lasts = [end((size + d) - floor(size + d)) for d in (-1, 0, 1)]
    entries = words.select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), halves(*firsts).alias("h")), F.struct(F.lit(1).alias("side"), halves(*lasts).alias("h")))).alias("x"))
    entries = cut(entries.select("word", "n", "x.side", F.explode("x.h").alias("half")))
    asks = words.select("word", F.explode(F.array(F.struct(F.lit(0).alias("side"), firsts[1].alias("half")), F.struct(F.lit(1).alias("side"), lasts[1].alias("half")))).alias("x")).select("word", F.lit(None).cast("bigint").alias("n"), "x.side", "x.half")
    total = entries.count()
    shards = max(1, -(-total // shard_words))
    hot = entries.groupBy("side", "half").agg(F.count("*").alias("m")).where(F.col("m") > shard_words).select("side", "half", F.ceil(F.col("m") / shard_words).cast("int").alias("parts"))
    both = entries.withColumn("indexed", F.lit(True)).unionByName(asks.withColumn("indexed", F.lit(False))).join(hot, ["side", "half"], "left")
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("word"), parts).cast("int")
    others = F.sequence(F.lit(0), parts - 1)
    both = both.withColumns({"i": F.when(F.col("indexed"), F.array(mine)).otherwise(others), "j": F.when(F.col("indexed"), others).otherwise(F.array(mine))})
    both = both.withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    return both.select(F.pmod(F.xxhash64("half"), F.lit(shards)).alias("shard"), "i", "j", "side", "word", "n", "half", "indexed")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, n): each ordered pair of words that differ by just one code point, and the count of the second."""

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
        is_entry = table.column("indexed").to_numpy(zero_copy_only=False)
        word = table.column("word").to_pylist()
        count = table.column("n").to_pylist()
        # parted halves share their numbers i, j with others of the shard only at 0, 0; entries under two starts are one
        known = {word[k]: count[k] for k in np.flatnonzero(is_entry).tolist()}
        asked = sorted({word[k] for k in np.flatnonzero(~is_entry).tolist()})
        entries = sorted(known)
        if not entries or not asked:
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        q, w = search(FMIndex([turn(x) for x in entries]), [turn(x) for x in asked], [len(x) // 2 if side == 0 else len(x) - len(x) // 2 for x in asked])
        pairs = [(asked[a], entries[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True) if asked[a] != entries[b]]
        return pa.table({"word": pa.array([a for a, _ in pairs], pa.string()), "near": pa.array([b for _, b in pairs], pa.string()), "n": pa.array([known[b] for _, b in pairs], pa.int64())})

    dealt = _dealt(words, shard_words).drop("half")
    return dealt.groupBy("shard", "side", "i", "j").applyInArrow(meet, "word string, near string, n bigint").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain of forms, by doubling pointers.

    Counts at least double from word to form, so chains are short and the rounds fewer.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(at.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(at)
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, shard_words: int = SHARD_WORDS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = cut(vocabulary(docs, min_count))
    near = near_words(words, shard_words)
    best = cut(near.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "n"), F.struct(-F.col("n"), F.col("near"))).alias("b")))
    held = words.join(best, "word", "left")
    good = F.col("b.n") >= ratio * F.col("n")
    held = cut(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, F.col("b.n")).alias("form_n")))
    last = roots(held.where("form is not null"))
    return held.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
