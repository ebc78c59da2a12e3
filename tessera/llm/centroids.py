"""Lloyd's centroid clustering with the dimensions dealt to shards.

A vector's components become integers, and columns of BLOCK_DIMS of them are one shard's.  Vectors travel in chunks:
one row of the shards' table is (chunk, shard, the chunk's columns as one binary).  In each round a
task adds up, for its shard's columns only, the exact squared distances of the chunk's vectors to its slices of the
centroids; a sum by chunk over the shards makes them whole and takes the nearest centroid.  The answers go
back to the shards, and each shard makes its own slice of the new centroids from the sums of its own columns.

All is integer arithmetic, so neither the order of sums nor the number of tasks changes anything.  The driver holds
the centroids and the shards' sums, k rows of as many components as a vector has, never vectors.  Rounds are written to the
shared folder and the one before is deleted.

Cases: a null vector, one with another number of components, or with a null or non-finite one, is left out, and so is one with a
component beyond +-2**21, where a distance would not fit a long; a null vec_id counts as an empty text in the first draw; rows that
are equal are vectors of their own (of equal hashes the smaller vector is drawn first); with fewer vectors than centroids each starts one; ties go to the
smaller number; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, release

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
BLOCK_DIMS = 16
#: Distances in one row of the partial sums, at most.
CHUNK_CELLS = 1 << 13
LARGEST = 1 << 21


def quantized(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): the vectors that count, in integers."""
    own = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    whole = (F.size("embedding") == dims) & F.forall(own, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))  # NaN is above all numbers
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(own, lambda x: F.floor(x * SCALE).cast("bigint")).alias("v"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors whose ids hash lowest."""
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    best = rows.select(drawn.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in best], dtype=np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Integers in the fewest bytes each that hold them all; a first byte tells how many."""
    top = int(np.abs(values).max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def column_blocks(rows: DataFrame, k: int, dims: int = DIMS, block: int = BLOCK_DIMS) -> DataFrame:
    """(chunk, shard, ids, cols): ids only with shard 0."""
    size = max(1, CHUNK_CELLS // max(k, block))
    kind = rows.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            for lo in range(0, len(values), size):
                part = values[lo : lo + size]
                shards = range(-(-dims // block))
                ids = [batch.column(0)[lo : lo + size].to_pylist(), *[None] * (len(shards) - 1)]
                cols = [_packed(part[:, s * block : (s + 1) * block]) for s in shards]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(shards)), pa.array(list(shards), pa.int32()), pa.array(ids, pa.list_(batch.schema.field(0).type)), pa.array(cols, pa.binary())], names=["chunk", "shard", "ids", "cols"])
                chunk += 1

    return rows.mapInArrow(pack, f"chunk bigint, shard int, ids array<{kind}>, cols binary")


def _widths(dims: int, block: int) -> list[int]:
    return [min(block, dims - lo) for lo in range(0, dims, block)]


def assigned(blocks: DataFrame, centroids: np.ndarray, block: int = BLOCK_DIMS) -> DataFrame:
    """(chunk, best): the nearest centroid of each vector and the distance to it, two packed columns."""
    k, dims = centroids.shape
    slices = [centroids[:, lo : lo + block] for lo in range(0, dims, block)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                mine = slices[shard]
                x = _unpacked(raw, mine.shape[1])
                out.append(_packed(np.stack([((x - c) ** 2).sum(axis=1) for c in mine], axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "part"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                whole = sum(_unpacked(raw, k) for raw in parts)
                best = whole.argmin(axis=1)  # the first of equal ones
                out.append(_packed(np.stack([best, whole[np.arange(len(best)), best]], axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk", "best"])

    parts = blocks.select("chunk", "shard", "cols").mapInArrow(partial, "chunk bigint, part binary")
    return parts.groupBy("chunk").agg(F.collect_list("part").alias("parts")).mapInArrow(nearest, "chunk bigint, best binary")


def moved(blocks: DataFrame, best: DataFrame, centroids: np.ndarray, block: int = BLOCK_DIMS) -> np.ndarray:
    """The centroids after one round: floors of the means; one without vectors stays.  Each shard sums its own columns."""
    k, dims = centroids.shape
    widths = _widths(dims, block)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, raw, near in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, at = _unpacked(raw, widths[shard]), _unpacked(near, 2)[:, 0]
                mine = total.setdefault(shard, np.zeros((k, widths[shard] + 1), dtype=np.int64))
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                mine[at[order][first]] += np.column_stack([np.add.reduceat(x[order], first), np.diff(np.append(first, len(at)))])
        rows = [(s, c, i, int(v)) for s, m in total.items() for c in range(k) if m[c, -1] for i, v in enumerate(m[c])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int32()), (3, pa.int64()))], names=["shard", "c", "i", "v"])

    made = blocks.select("chunk", "shard", "cols").join(best, "chunk").select("shard", "cols", "best").mapInArrow(sums, "shard int, c int, i int, v bigint")
    made = made.groupBy("shard", "c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {(r.shard, r.c, r.i): int(r.v) for r in made.collect()}
    out = centroids.copy()
    for (shard, c, i), v in found.items():
        if i < widths[shard]:
            out[c, shard * block + i] = v // found[shard, c, widths[shard]]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, block: int = BLOCK_DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that counts."""
    rows = quantized(vectors, dims)
    centroids = first_centroids(rows, k)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = cut(column_blocks(rows, len(centroids), dims, block))
    for _ in range(rounds):
        best = cut(assigned(blocks, centroids, block))
        centroids = moved(blocks, best, centroids, block)
        release(best)
    best = cut(assigned(blocks, centroids, block))

    def inertias(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for near in batch.column(0).to_pylist():
                x = _unpacked(near, 2)
                np.add.at(total, x[:, 0], x[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["c", "v"])

    own = {r.c: int(r.v) for r in best.select("best").mapInArrow(inertias, "c bigint, v bigint").groupBy("c").agg(F.sum("v").alias("v")).collect()}
    whole = sum(own.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, near in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = _unpacked(near, 2)
                c = x[:, 0].tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(c, pa.int32()), pa.array(x[:, 1]), pa.array([own[i] for i in c]), pa.array([whole] * len(c), pa.int64()), pa.array([names[i] for i in c])],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.where("shard = 0").select("chunk", "ids").join(best, "chunk").select("ids", "best").mapInArrow(listed, schema)
