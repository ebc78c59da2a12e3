"""Mixing sources to target weights, in DataFrame functions alone.

Each source's documents stand on a line, in the order of a hash; a document covers
as many places as it has words.  A source's quota is cut from that line, whole
rounds first and the rest from its start, so the quota is met to the word and no
document is ahead of another of its source by more than one round.  The quota is counted in
blocks of words.  A binary tree over the output shards deals the blocks of all sources: each node gives
its left half a uniform draw without replacement, so the counts of sources that
a shard gets are multivariate hypergeometric, and the sums over shards are exact.
A round of a document stands at round*source_size + its start on the line of its source's quota; where it
crosses an edge of blocks it is split, so every dealt block is filled.  ``mixing_report`` names the shard of a
document's first word and all its pieces; each piece has a hash, and inside a shard the order is by that hash
(``mixed_pieces`` gives each its slot).

A line is never sorted whole: documents fall in buckets by hash, small tables of
bucket sums give each bucket its offset, and running sums stay within buckets.  A source that
holds a third of all rows has as many more buckets.

Cases: a null or empty text has size 0 and takes nothing; a null source is a
source of its own, last; very long texts may be taken in part; sources of size 0 have target 0; repeated rows stand on
the line twice, and ties of the hash are ordered by doc_id and size; an empty table gives an empty result.  Working columns begin
with __ and those returned with mix_, so columns of other names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_ROWS, cut
from tessera.llm.textblock import whole_text

WEIGHTS = (1, 2, 3)
MAX_ROUNDS = 3
ROWS_PER_BUCKET = 4_000
N_SHARDS = 16
BLOCKS_PER_SHARD = 64
#: Buckets of a rank, as a power of two.
RANK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with __size (words) and __hash (place in the order)."""
    return docs.withColumns(
        {
            "__size": F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint"),
            "__hash": F.xxhash64(F.lit(seed), "doc_id", F.crc32(whole_text())),
        }
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(source, __src, source_size, target, __quota): one row for each source.

    Sources are numbered in order without one task seeing all: range partitions are sorted each, and their counts
    give each its first number.  The level that targets stand at rises as long as a source at its limit
    leaves an excess; each round is one sum over all sources.
    """
    per_source = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    dealt = cut(per_source.repartitionByRange(F.col("source").isNull(), "source").withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    firsts = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").isNull(), "source"))
    named = dealt.withColumn("__n", inside).join(F.broadcast(firsts), "__part").withColumn("__src", (F.col("__n") + F.col("__first")).cast("bigint"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("__src") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = cut(named.select("source", "__src", "source_size", weight.cast("bigint").alias("w"), (F.col("source_size") * max_rounds).alias("cap")))
    total, weight_sum = named.agg(F.sum("source_size"), F.sum("w")).first()
    full = (0, 0)  # sums of limits and of weights of the sources at their limits
    while True:
        left, rest = (total or 0) - full[0], (weight_sum or 0) - full[1]
        over = F.col("cap").cast("decimal(38,0)") * rest < F.lit(left).cast("decimal(38,0)") * F.col("w")
        now = tuple(x or 0 for x in named.where(over).agg(F.sum("cap"), F.sum("w")).first()) if rest else full
        if now == full:
            break
        full = now
    target = F.when(over, F.col("cap").cast("double")).otherwise(F.lit(float(left)) * F.col("w") / F.lit(float(rest))) if rest else F.col("cap").cast("double")
    quota = F.least(F.col("cap"), F.floor(F.col("target") + 0.5).cast("bigint"))
    return named.withColumn("target", target).select("source", "__src", "source_size", "target", quota.alias("__quota"))


def ranked(rows: DataFrame, group: str, order: Column, ties: list[str], name: str) -> DataFrame:
    """rows with ``name``, the place (from 1) by ``order``, a 64-bit hash, within ``group``.

    Ranks are found within buckets of the hash; counts of the buckets before give the rest.  ``rows`` is read twice.
    """
    rows = rows.withColumn("__h", order).withColumn("__b", F.shiftrightunsigned("__h", 64 - RANK_BITS))
    line = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(group, "__b").agg(F.count("*").alias("n")).select(group, "__b", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", *ties))
    return rows.withColumn("__in", inside).join(before, [group, "__b"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__h", "__b", "__in", "__before")


def shard_tree(targets: DataFrame, n_shards: int, block: int, seed: int = 1) -> DataFrame:
    """(__src, __block, __shard): every source's blocks of ``block`` words dealt to output shards."""
    blocks = targets.where("__quota > 0").select("__src", F.explode(F.sequence(F.lit(0), F.expr(f"(__quota - 1) div {block}"))).alias("__block"))
    nodes = blocks.withColumns({"lo": F.lit(0), "n": F.lit(n_shards)})
    for level in range((n_shards - 1).bit_length()):
        nodes = cut(nodes)
        left = F.floor(F.col("n") / 2)
        drawn = ranked(nodes, "lo", F.xxhash64(F.lit(seed), F.lit(level), "__src", "__block"), ["__src", "__block"], "drawn")
        quotas = nodes.groupBy("lo").agg(F.floor(F.count("*") * F.floor(F.first("n") / 2) / F.first("n") + 0.5).alias("quota"))  # a row for each node, n_shards at most
        go_left = (F.col("n") == 1) | (F.col("drawn") <= F.col("quota"))
        nodes = drawn.join(F.broadcast(quotas), "lo").select(
            "__src",
            "__block",
            F.when(go_left, F.col("lo")).otherwise(F.col("lo") + left).cast("int").alias("lo"),
            F.when(F.col("n") == 1, F.lit(1)).when(go_left, left).otherwise(F.col("n") - left).cast("int").alias("n"),
        )
    return nodes.select("__src", "__block", F.col("lo").alias("__shard"))


def mix_plan(rows: DataFrame, sizes: DataFrame, n_shards: int = N_SHARDS, seed: int = 1, **options) -> DataFrame:
    """rows (of ``sized``) with mix_size, mix_source_size, mix_target, mix_taken, mix_shard, mix_shards, mix_pieces.

    mix_shard is the shard of the first word, mix_shards has the shard where each round begins, and mix_pieces
    (start on the source's line, words, shard, hash) all words taken.  ``sizes`` has source, __size and __hash of the same rows, cheap to read several times.
    """
    targets = cut(source_targets(sizes, **options))
    n_rows, n_sources, words = sizes.count(), targets.count(), (targets.agg(F.sum("source_size")).first()[0] or 0)
    n_buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    block = max(1, -(-words // (n_shards * BLOCKS_PER_SHARD)))
    targets = targets.withColumnsRenamed({"source": "__source", "source_size": "__source_size", "target": "__target"})
    few = (lambda df: F.broadcast(df)) if n_sources <= BROADCAST_ROWS else (lambda df: df)
    bucket = F.shiftright(F.shiftrightunsigned("__hash", 33) * n_buckets, 31)
    with_source = lambda df: df.withColumn("__bucket", bucket).join(few(targets), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    sums = with_source(sizes).groupBy("__src", "__bucket").agg(F.sum("__size").alias("__words"))
    line = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__src", "__bucket", F.coalesce(F.sum("__words").over(line), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__src", "__bucket").orderBy("__hash", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_source(rows).withColumn("__start", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(offsets, ["__src", "__bucket"])
    start = F.col("__start") + F.col("__offset")
    rounds = F.when(F.col("__source_size") > 0, F.expr("__quota div __source_size")).otherwise(F.lit(0))
    rest = F.col("__quota") - rounds * F.col("__source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), rest - start))
    taken = rounds * F.col("__size") + extra
    # the shards of a source's blocks in their order; all sources together have at most n_shards * BLOCKS_PER_SHARD blocks and one more each
    dealt = shard_tree(targets, n_shards, block, seed).groupBy("__src").agg(F.transform(F.array_sort(F.collect_list(F.struct("__block", "__shard"))), lambda x: x["__shard"]).alias("__shards"))
    placed = placed.withColumns({"mix_taken": taken, "__start": start}).join(few(dealt), "__src", "left")
    n_rounds = F.when(F.col("mix_taken") > 0, rounds + F.when(extra > 0, 1).otherwise(0)).otherwise(0).cast("int")
    placed = placed.withColumn("__from", F.when(n_rounds > 0, F.transform(F.sequence(F.lit(0), n_rounds - 1), lambda r: r * F.col("__source_size") + F.col("__start"))).otherwise(F.array().cast("array<bigint>")))
    until = lambda at: F.least(at + F.col("__size"), F.col("__quota"))
    spans = lambda at: F.sequence(F.floor(at / block), F.floor((until(at) - 1) / block))
    piece = lambda at, b: F.struct(
        F.greatest(at, b * block).alias("start"), (F.least(until(at), (b + 1) * block) - F.greatest(at, b * block)).alias("words"), F.get("__shards", b.cast("int")).alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("piece"), "__src", F.greatest(at, b * block)).alias("hash"),
    )
    pieces = F.flatten(F.transform("__from", lambda at: F.transform(spans(at), lambda b: piece(at, b))))
    shards = F.transform("__from", lambda at: F.get("__shards", F.floor(at / block).cast("int")))
    out = placed.withColumns({"mix_size": F.col("__size"), "mix_source_size": F.col("__source_size"), "mix_target": F.col("__target"), "mix_shard": F.get(shards, F.lit(0)), "mix_shards": shards, "mix_pieces": pieces})
    return out.select(*[f"`{c}`" for c in rows.columns if c not in ("__size", "__hash")], "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_shard", "mix_shards", "mix_pieces")


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shard, pieces."""
    sizes = cut(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "__size", "__hash"))
    out = mix_plan(sizes, sizes, **options)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.col("mix_shard").alias("shard"), F.col("mix_pieces").alias("pieces"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents: each as many times as it is taken, to the nearest whole.

    Columns of docs, then mix_copy and mix_shard.
    """
    rows = sized(docs)
    sizes = cut(rows.select("doc_id", "source", "__size", "__hash"))
    plan = mix_plan(rows, sizes, **options)
    copies = F.when(F.col("mix_size") > 0, F.floor(F.col("mix_taken") / F.col("mix_size") + 0.5)).otherwise(F.lit(0)).cast("int")
    return plan.where(copies > 0).select(*[f"`{c}`" for c in docs.columns], F.posexplode(F.slice("mix_shards", 1, copies)).alias("__copy", "mix_shard")).select(*[f"`{c}`" for c in docs.columns], (F.col("__copy") + 1).alias("mix_copy"), "mix_shard")


def mixed_pieces(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, words, shard, slot): the mix piece by piece, shuffled inside each shard; slots count from 1."""
    each = cut(mixing_report(docs, **options).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.start", "p.words", "p.shard", "p.hash"))
    return ranked(each, "shard", F.col("hash"), ["start", "doc_id"], "slot").select("doc_id", "start", "words", "shard", "slot")
