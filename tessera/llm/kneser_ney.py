"""Quality by perplexity under a modified Kneser-Ney model of trusted text.

The model is of bytes, order ORDER, one for each language.  Each task sums the
n-grams of its documents before they are shuffled; the sums are dealt by n-gram.
Lower orders count the distinct n-grams that extend them to the left.  Three discounts for each
language and order come from counts of counts.  Probabilities are made from the
lowest order up, by joins of the n-grams that occur anywhere in the corpus with
counts, context sums and the probability of their suffixes, all dealt by their keys.

A document's perplexity is the mean of these over all its n-grams; its worst perplexity is that of its
most surprising WORST n-grams in a row, which one toxic word moves however long the text is.  The table of
probabilities goes to the tasks if it has at most BROADCAST_GRAMS rows; beyond
that the documents' own n-grams, with their places, are joined with it instead.

Trusted documents are those that labels call good and not toxic.  One half of
them (by hash of the id) trains; the other half, unseen, gives each language the quantiles
that may be its two limits.  Of all pairs of QUANTILES that pair is taken that
parts the unseen half from the labelled documents that aren't trusted (of the same half of ids) best: share of trusted ones
kept plus share of others dropped.  A language without such others takes QUANTILE for both.

Cases: null and empty texts and those with fewer than MIN_BYTES bytes aren't judged: perplexity null
or weak, kept true; so are documents of languages without trusted text; a null
language is taken as the empty one, and returned so; very long texts are scored whole; ties of the limits are kept; a document with several labels is trusted if all trust it;
repeated rows get equal answers; empty tables give no model, or an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_ROWS, cut
from tessera.llm.textblock import LOWER, blocks, map_blocks, whole_text

ORDER = 5
QUANTILE = 0.99
QUANTILES = (0.9, 0.92, 0.94, 0.96, 0.97, 0.98, 0.99, 0.995)
WORST = 6
MIN_BYTES = 100
#: Labelled ids that may be broadcast; with more, labels are joined by shuffle.
BROADCAST_IDS = 2_000_000
BROADCAST_GRAMS = 4_000_000
#: Distinct n-grams that a task holds before it sends them on.
HELD_GRAMS = 2_000_000


def block_grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a block, packed with the last byte lowest, and the text of each."""
    low = LOWER[buf].astype(np.int64)
    n = len(low) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = np.zeros(n, dtype=np.int64)
    for i in range(order):
        grams = (grams << 8) | low[i : i + n]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    inside = np.arange(n) + order <= off[doc + 1]
    return grams[inside], doc[inside]


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with fold: 0 trusted and training, 1 trusted and held out, 3 labelled, not trusted and held out, 2 all others."""
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("int")
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    labelled = labelled.select("doc_id", F.when(F.expr("q = 1 and t = 0"), half).when(F.expr("q < 1 or t > 0"), half + 2).alias("half"))
    labelled = F.broadcast(labelled) if labels.count() <= BROADCAST_IDS else labelled
    return docs.join(labelled, "doc_id", "left").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("half", F.lit(2)).alias("fold"))


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, c, seen): training count of every n-gram that occurs anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (g, c) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c)], names=["lang", "g", "c"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            train = batch.column(1).to_numpy() == 0
            for lo, hi, buf, off in blocks(batch.column(2)):
                grams, doc = block_grams(buf, off, order)
                for lang in set(langs[lo:hi]):
                    mine = (langs[lo:hi] == lang)[doc]
                    g, c = [], []
                    for side in (True, False):
                        u, n = np.unique(grams[mine & (train[lo:hi][doc] == side)], return_counts=True)
                        g.append(u)
                        c.append(n * side)
                    old = held.get(lang, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
                    keys, back = np.unique(np.concatenate([old[0], *g]), return_inverse=True)
                    held[lang] = (keys, np.bincount(back, weights=np.concatenate([old[1], *c]), minlength=len(keys)).astype(np.int64))
            if sum(len(x[0]) for x in held.values()) > HELD_GRAMS:
                yield from flush()
        yield from flush()

    sent = docs.select("lang", "fold", whole_text().alias("text")).mapInArrow(run, "lang string, g bigint, c bigint")
    return sent.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, logp) for every n-gram of ``counts``: interpolated modified Kneser-Ney."""
    tables = {order: cut(counts.where("c > 0"))}
    every = {order: counts.select("lang", "g")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("bigint"))
        tables[n] = cut(tables[n + 1].select("lang", suffix.alias("g")).groupBy("lang", "g").agg(F.count("*").alias("c")))
        every[n] = cut(every[n + 1].select("lang", suffix.alias("g")).distinct())
    below = None
    for n in range(1, order + 1):
        t = tables[n]
        of = lambda k: F.count_if(F.col("c") == k).cast("double")
        few = t.groupBy("lang").agg(of(1).alias("n1"), of(2).alias("n2"), of(3).alias("n3"), of(4).alias("n4"))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        step = lambda k: F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)), F.lit(0.1)), F.lit(k - 0.05))
        few = few.select("lang", step(1).alias("d1"), step(2).alias("d2"), step(3).alias("d3"))
        context = F.shiftright("g", 8)
        sums = t.groupBy("lang", context.alias("ctx")).agg(F.sum("c").alias("total"), of(1).alias("m1"), of(2).alias("m2"), F.count_if(F.col("c") > 2).cast("double").alias("m3"))
        rows = every[n].withColumn("ctx", context).join(t, ["lang", "g"], "left").join(sums, ["lang", "ctx"], "left").join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "lang")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1).cast("bigint"))).join(below.select("lang", F.col("g").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
            lower = F.col("lower")
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.coalesce((F.col("c") - discount) / F.col("total"), F.lit(0.0))
        rest = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        below = cut(rows.select("lang", "g", F.when(F.col("total").isNull(), lower).otherwise(own + rest * lower).alias("p")))
    return below.select("lang", "g", F.log("p").alias("logp"))


class GramTable:
    """Look-up by hashed place; the few that found their place taken are in a sorted list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        at = self._place(keys)
        self.keys[at] = keys
        own = self.keys[at] == keys
        self.values[at[own]] = values[own]
        order = np.argsort(keys[~own])
        self.rest, self.rest_values = keys[~own][order], values[~own][order].astype(np.float32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        out = self.values[at]
        if len(missed := np.flatnonzero(self.keys[at] != keys)) and len(self.rest):
            j = np.minimum(np.searchsorted(self.rest, keys[missed]), len(self.rest) - 1)
            out[missed] = np.where(self.rest[j] == keys[missed], self.rest_values[j], 0)
        return out


def worst_windows(logp: np.ndarray, doc: np.ndarray, n: int, width: int = WORST) -> np.ndarray:
    """For each of n texts the least sum of ``width`` values in a row; 0 for shorter texts.

    Sums are made term by term, so equal windows have equal sums wherever they stand.
    """
    out = np.zeros(n)
    if (m := len(logp) - width + 1) > 0:
        sums = np.zeros(m)
        for i in range(width):
            sums += logp[i : i + m]
        inside = doc[:m] == doc[width - 1 :]
        sums, own = sums[inside], doc[:m][inside]
        if len(own):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[first]] = np.minimum.reduceat(sums, first)
    return out


def score(docs: DataFrame, table: DataFrame, order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, lang, fold, n_grams, logp (sum over the document's n-grams), worst (least sum of WORST in a row); null without a model."""
    langs = [r.lang for r in table.select("lang").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(langs) <= BROADCAST_ROWS and table.count() <= broadcast_grams:
        number = {x: i for i, x in enumerate(sorted(langs))}
        keys, values = [], []
        for part in table.toArrow().to_batches():
            keys.append(part.column(1).to_numpy() | (np.array([number[x] for x in part.column(0).to_pylist()], dtype=np.int64) << 8 * order))
            values.append(part.column(2).to_numpy())
        known = GramTable(np.concatenate([*keys, np.zeros(0, dtype=np.int64)]), np.concatenate([*values, np.zeros(0)]))
        shared = docs.sparkSession.sparkContext.broadcast((number, known))

        def look(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
            number, known = shared.value
            n = len(off) - 1
            lang = np.array([number.get(x, -1) for x in rows.column(1).to_pylist()], dtype=np.int64)
            grams, doc = block_grams(buf, off, order)
            found = known.get(grams | (np.maximum(lang, 0)[doc] << 8 * order))
            sums = np.bincount(doc, weights=found, minlength=n)
            return {"n_grams": np.bincount(doc, minlength=n).astype(np.int64), "logp": pa.array(sums.astype(float), mask=lang < 0), "worst": pa.array(worst_windows(found, doc, n), mask=lang < 0)}

        return map_blocks(docs, look, "n_grams bigint, logp double, worst double", ["doc_id", "lang", "fold"])

    def own(buf: np.ndarray, off: np.ndarray, rows: pa.RecordBatch) -> dict:
        grams, doc = block_grams(buf, off, order)
        cut_at = np.searchsorted(doc, np.arange(len(off)))
        parts = []
        for a, b in zip(cut_at[:-1], cut_at[1:], strict=True):
            u, n = np.unique(grams[a:b], return_counts=True)
            places = np.split(np.argsort(grams[a:b], kind="stable"), np.cumsum(n)[:-1])
            parts.append([{"g": g, "at": at} for g, at in zip(u.tolist(), places, strict=False)])
        return {"own": pa.array(parts, pa.list_(pa.struct([("g", pa.int64()), ("at", pa.list_(pa.int32()))])))}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_grams, logp, worst = [], [], []
            for found in batch.column(batch.num_columns - 1):
                values = np.concatenate([np.full(len(x["at"]), np.nan if x["logp"] is None else x["logp"], dtype=np.float32) for x in found.as_py()])
                line = np.zeros(len(values), dtype=np.float32)
                line[np.concatenate([np.array(x["at"], dtype=np.int64) for x in found.as_py()])] = values
                known = not np.isnan(line).any()
                n_grams.append(len(line))
                logp.append(float(line.sum(dtype=np.float64)) if known else None)
                worst.append(float(worst_windows(line, np.zeros(len(line), dtype=np.int64), 1)[0]) if known else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_grams, pa.int64()), pa.array(logp, pa.float64()), pa.array(worst, pa.float64())], names=[*batch.schema.names[:-1], "n_grams", "logp", "worst"])

    keyed = docs.withColumn("th", F.xxhash64(whole_text()))
    each = map_blocks(keyed.dropDuplicates(["doc_id", "th", "lang"]), own, "own array<struct<g:bigint,at:array<int>>>", ["doc_id", "th", "lang"])
    each = each.select("doc_id", "th", "lang", F.explode("own").alias("x")).select("doc_id", "th", "lang", "x.g", "x.at")
    lines = each.join(table, ["lang", "g"], "left").groupBy("doc_id", "th", "lang").agg(F.collect_list(F.struct("at", "logp")).alias("found"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema if f.name != "found")
    sums = lines.mapInArrow(whole, f"{kept}, n_grams bigint, logp double, worst double")
    sums = sums.withColumnsRenamed({c: f"__{c}" for c in ("doc_id", "th", "lang")})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("th") == F.col("__th")) & (F.col("lang") == F.col("__lang"))
    return keyed.join(sums, same, "left").select("doc_id", "lang", "fold", F.coalesce("n_grams", F.lit(0).cast("bigint")).alias("n_grams"), "logp", "worst")


def choose_limits(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, max_perplexity, max_worst) from held-out rows (lang, fold, perplexity, worst_perplexity)."""
    qs = [*QUANTILES, quantile]
    at = lambda c: F.percentile_approx(c, qs, F.lit(100_000))
    grid = held.where("fold = 1").groupBy("lang").agg(at("perplexity").alias("means"), at("worst_perplexity").alias("worsts"))
    grid = cut(grid)
    few = lambda df: F.broadcast(df) if grid.count() <= BROADCAST_ROWS else df
    # rows with equal places among the limits are one cell; a limit keeps what lies at or below it
    below = lambda c, limits: F.size(F.filter(F.slice(limits, 1, len(QUANTILES)), lambda x: x < F.col(c)))
    cells = held.join(few(grid), "lang").groupBy("lang", below("perplexity", F.col("means")).alias("i"), below("worst_perplexity", F.col("worsts")).alias("j"))
    cells = cells.agg(F.count_if(F.col("fold") == 1).alias("good"), F.count_if(F.col("fold") == 3).alias("bad"))
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in range(len(QUANTILES)) for j in range(len(QUANTILES))])
    tried = cells.withColumn("pair", F.explode(pairs)).withColumn("keeps", (F.col("i") <= F.col("pair.a")) & (F.col("j") <= F.col("pair.b")))
    counted = lambda c, how: F.sum(F.when(how, F.col(c)).otherwise(0))
    tried = tried.groupBy("lang", "pair").agg(counted("good", F.col("keeps")).alias("kept"), F.sum("good").alias("good"), counted("bad", ~F.col("keeps")).alias("gone"), F.sum("bad").alias("bad"))
    merit = F.round(F.col("kept") / F.col("good") + F.col("gone") / F.col("bad"), 9)
    best = tried.groupBy("lang").agg(F.max(F.when(F.col("bad") > 0, F.struct(merit.alias("merit"), "kept", "pair"))).alias("best"))
    last = F.lit(len(qs))
    pick = lambda limits, c: F.element_at(limits, F.coalesce(F.col(f"best.pair.{c}") + 1, last))
    return grid.join(few(best), "lang", "left").select("lang", pick("means", "a").alias("max_perplexity"), pick("worsts", "b").alias("max_worst_perplexity"))


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, **options) -> DataFrame:
    """doc_id, lang, n_grams, perplexity (of a byte), max_perplexity (of the language), kept, and the same two of the worst window."""
    rows = with_trust(docs.select("doc_id", "text", "lang"), labels)
    table = probabilities(cut(gram_counts(rows, order)), order)
    mean, worst = F.exp(-F.col("logp") / F.col("n_grams")), F.exp(-F.col("worst") / WORST)
    scored = cut(score(rows, table, order, **options).withColumns({"perplexity": F.when(F.col("n_grams") > 0, mean), "worst_perplexity": F.when(F.col("n_grams") >= WORST, worst)}))
    judged = F.col("n_grams") >= MIN_BYTES
    limits = cut(choose_limits(scored.where(judged & F.col("fold").isin(1, 3)), quantile))
    out = scored.join(F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits, "lang", "left")
    far = judged & ((F.col("perplexity") > F.col("max_perplexity")) | (F.col("worst_perplexity") > F.col("max_worst_perplexity")))
    return out.select("doc_id", "lang", "n_grams", "perplexity", "max_perplexity", (~F.coalesce(far, F.lit(False))).alias("kept"), "worst_perplexity", "max_worst_perplexity")
