"""Sharding by sampled splitters, in DataFrame functions alone.

Keys are hashes of texts, so equal texts are neighbours.  A sample of keys,
drawn with chance in proportion to size, gives quantiles; these split the rows
into many more ranges than shards.  A range that turns out overfull is subdivided: first by more
bounds in the order of keys, and a key that alone overfills a range (a group of copies may hold a third of all
rows) is a range of its own, dealt by doc_id to parts.  Smaller groups of equal texts are never parted but by the end of a shard.  Exact sums per range
then place each row on one line of bytes; each shard takes an equal stretch of the
line, a row going where its middle lies.  Shards differ by at most the documents at their two ends.

The law is ``bytes``.  The tables of splitters and range sums are bounded by the
parameters, not by the data; running sums stay within ranges, so no shard is
sorted whole by one task.

Cases: a null or empty text has 16 bytes and checksum 0; a very long text is never cut, so its shard may be larger by it;
ties of the key are ordered by doc_id and size; repeated rows are rows of their own, and those with equal doc_id and text lie
in one part; with fewer rows than shards some shards stay empty; an empty table
gives an empty result.  Working columns begin with __, those returned with
shard_, so columns of other names pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut
from tessera.llm.textblock import whole_text

N_SHARDS = 40
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 50
OVERFULL = 2.0
SUBRANGES = 8
_STEP = 32


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __size and __key."""
    return docs.withColumns({"__size": (F.octet_length(whole_text()) + 16).cast("bigint"), "__key": F.xxhash64(whole_text())})


def splitters(rows: DataFrame, n_ranges: int, total: int, samples: int) -> list[int]:
    """Quantiles of a sample of keys weighted by size; at most n_ranges - 1."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "__key"), 11) / float(1 << 53)
    sample = rows.where(draw * total < F.col("__size") * samples)
    quantiles = F.percentile_approx("__key", [i / n_ranges for i in range(1, n_ranges)], 100 * n_ranges)
    return sorted(set(sample.agg(quantiles).first()[0] or []))


def subdivided(slim: DataFrame, bounds: list[int], full: float) -> tuple[list[int], dict[int, int]]:
    """More bounds inside overfull ranges, in the order of keys, and the keys that alone hold more than ``full`` bytes.

    Such a key becomes a range of its own; both lists are bounded by the number of ranges.
    """
    ranged = slim.withColumn("__range", range_of(F.col("__key"), bounds))
    over = [r[0] for r in ranged.groupBy("__range").agg(F.sum("__size").alias("bytes")).where(F.col("bytes") > OVERFULL * full).select("__range").collect()]
    if not over:
        return bounds, {}
    inside = ranged.where(F.col("__range").isin(over))
    hot = {r["__key"]: r["bytes"] for r in inside.groupBy("__key").agg(F.sum("__size").alias("bytes")).where(F.col("bytes") > full).collect()}
    rest = inside.where(~F.col("__key").isin(list(hot))) if hot else inside
    more = [x for r in rest.groupBy("__range").agg(F.percentile_approx("__key", [i / SUBRANGES for i in range(1, SUBRANGES)], 10_000)).collect() for x in r[1]]
    own = [x for k in hot for x in (k, k + 1) if x < 1 << 63]
    return sorted({*bounds, *more, *own}), hot


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at or below the key: among every 32nd, then among the 32 there."""
    if not bounds:
        return F.lit(0)
    below = lambda among: F.size(F.filter(among, lambda x: x <= key))
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    coarse = below(longs(bounds[_STEP - 1 :: _STEP])) if len(bounds) >= _STEP else F.lit(0)
    return coarse * _STEP + below(F.slice(longs(bounds), coarse * _STEP + 1, F.lit(_STEP)))


def place(rows: DataFrame, slim: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """rows (of ``keyed``) with shard_no and shard_slot; ``slim`` has the same rows' doc_id, __size and __key."""
    total, n_rows = slim.agg(F.sum("__size"), F.count("*")).first()
    if not n_rows:
        return rows.withColumns({"shard_no": F.lit(0), "shard_slot": F.lit(0).cast("bigint")})
    n_ranges = n_shards * RANGES_PER_SHARD
    full = total / n_ranges
    bounds, hot = subdivided(slim, splitters(slim, n_ranges, total, n_ranges * SAMPLES_PER_RANGE), full)
    ranged = lambda df: df.withColumn("__range", range_of(F.col("__key"), bounds))
    n_parts = F.create_map(*[F.lit(x) for k, size in hot.items() for x in (k, math.ceil(size / full))]) if hot else None
    split = lambda df: ranged(df).withColumn("__part", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.coalesce(F.try_element_at(n_parts, F.col("__key")), F.lit(1))).cast("int") if hot else F.lit(0))
    line = Window.orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split(slim).groupBy("__range", "__part").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
    offsets = cut(offsets.select("__range", "__part", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("__rows")))
    inside = Window.partitionBy("__range", "__part").orderBy("__key", "doc_id", "__size")

    def placed(df: DataFrame) -> DataFrame:
        run = split(df).withColumns(
            {
                "__before": F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"),
                "__row": F.row_number().over(inside) - 1,
            }
        ).join(F.broadcast(offsets), ["__range", "__part"])
        middle = 2 * (F.col("__before") + F.col("__bytes")) + F.col("__size")
        shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * total)).cast("int"))
        return run.withColumns({"shard_no": shard, "__at": F.col("__row") + F.col("__rows")})

    firsts = cut(placed(slim).groupBy("shard_no").agg(F.min("__at").alias("__first")))
    out = placed(rows).join(F.broadcast(firsts), "shard_no").withColumn("shard_slot", (F.col("__at") - F.col("__first")).cast("bigint"))
    return out.select(*[f"`{c}`" for c in rows.columns], "shard_no", "shard_slot")


def sharding_report(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    slim = cut(keyed(docs.select("doc_id", "text")).select("doc_id", "__size", "__key", F.crc32(whole_text()).alias("text_crc32")))
    out = place(slim, slim, n_shards)
    return out.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard_no").cast("int").alias("shard"), F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """docs with shard_no and shard_slot."""
    rows = keyed(docs)
    slim = cut(rows.select("doc_id", "__size", "__key"))
    return place(rows, slim, n_shards).drop("__size", "__key")


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """One folder for each shard, rows in the order of their slots."""
    placed = shard(docs, n_shards)
    placed.repartition("shard_no", F.expr("shard_slot div 1000000")).sortWithinPartitions("shard_no", "shard_slot").write.partitionBy("shard_no").parquet(path)
