"""Centroid clustering with scalar lookup tables.

Components are whole numbers of few different values.  Each round tabulates,
for every dimension, value that occurs in a block of vectors and centroid,
the squared difference; the distances of the block's vectors are then table
entries, gathered and summed, and no difference is worked out for a vector.

Vectors are coded once: a block holds, for each dimension, the values that
occur in it in order and a code for each vector.  A round is one scan of the
blocks; a task gives back a centroid's sums and count, at most centroids x
dimensions rows, which are added up by key before the driver sees them.

Sums are kept in limbs of 30 bits (see ``limbs``), so they are exact for any
finite component.  Squares that could leave 64 bits are worked out with
Python's whole numbers.

Defined results: a vector that is null, of another length or holds a null or
non-finite component is left out; rows that repeat a vec_id are vectors of
their own, a null vec_id hashes as the empty text, and equal hashes are put
in order by the components; fewer vectors than centroids give fewer
centroids; an empty table gives an empty result; a distance or inertia beyond
a long is null; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, resting, written

DIMENSIONS, CENTROIDS, ROUNDS = 64, 16, 3
SCALE = 64
#: Vectors of a block.
BLOCK = 1024
#: Values up to this size have squared distances within 64 bits at up to 256 dimensions.
NARROW = 1 << 26
LIMB = 30
LARGEST = (1 << 63) - 1


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as int64 or, where that is too narrow, as Python's whole numbers."""
    if not len(flat) or np.abs(flat).max() * SCALE < NARROW:
        return np.floor(flat * SCALE).astype(np.int64)
    # A double of 2^53 or more is a whole number already.
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in flat.tolist()], object)


def tables(values: list[np.ndarray], centroids: np.ndarray) -> list[np.ndarray]:
    """Squared difference of each value (row) and centroid (column), for each dimension."""
    return [(v[:, None] - centroids[None, :, d]) ** 2 for d, v in enumerate(values)]


def nearest(codes: np.ndarray, squares: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and distance of each coded vector; of equal distances the first centroid's."""
    total = squares[0][codes[:, 0]]
    for d in range(1, codes.shape[1]):
        total = total + squares[d][codes[:, d]]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def limbs(value: int) -> list[int]:
    """value as digits of base 2^LIMB, lowest first, the last one with the sign; sums of digits stay within 64 bits."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def coded(vectors: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Rows of up to BLOCK vectors: ids, values and sizes (those of each
    dimension, as text if wide), codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                flat = np.asarray(pc.list_flatten(part.column("vector")))
                rows = whole(flat).reshape(-1, dimensions)
                found = [np.unique(rows[:, d], return_inverse=True) for d in range(dimensions)]
                codes = np.stack([codes for _, codes in found], axis=1).astype("<u2")
                values = np.concatenate([v for v, _ in found])
                kinds = [None, ",".join(map(str, values.tolist()))] if values.dtype == object else [values.astype("<i8").tobytes(), None]
                columns = [[part.column("vec_id").to_pylist()], [kinds[0]], [kinds[1]], [[len(v) for v, _ in found]], [codes.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, BLOCK_TYPES)], BLOCK_NAMES)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(resting(run), "ids array<long>, narrow binary, wide string, sizes array<int>, codes binary")


BLOCK_NAMES = ["ids", "narrow", "wide", "sizes", "codes"]
BLOCK_TYPES = (pa.list_(pa.int64()), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, list[np.ndarray], np.ndarray]]:
    for batch in batches:
        for ids, narrow, wide, sizes, codes in zip(*(batch.column(c) for c in BLOCK_NAMES)):
            sizes = sizes.as_py()
            if narrow.is_valid:
                flat = np.frombuffer(narrow.as_py(), "<i8")
            else:
                flat = np.array([int(x) for x in wide.as_py().split(",")], object)
            yield ids, np.split(flat, np.cumsum(sizes)[:-1]), np.frombuffer(codes.as_py(), "<u2").reshape(-1, len(sizes))


def _as_array(centroids: list[list[int]], values: list[np.ndarray]) -> np.ndarray:
    """Centroids in the kind of whole numbers that they and the values ask for."""
    narrow = values[0].dtype != object and max(abs(x) for c in centroids for x in c) <= NARROW
    return np.array(centroids, np.int64 if narrow else object)


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's vectors' mean, rounded down; one without vectors stays."""
    dimensions = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * dimensions for _ in centroids]
        counts = [0] * len(centroids)
        for _, values, codes in _blocks(batches):
            best, _ = nearest(codes, tables(values, _as_array(centroids, values)))
            for c in np.unique(best).tolist():
                own = codes[best == c]
                counts[c] += len(own)
                for d, v in enumerate(values):
                    sums[c][d] += int((np.bincount(own[:, d], minlength=len(v)).astype(v.dtype) * v).sum())
        rows = [(c, d, k, x) for c, row in enumerate(sums) if counts[c] for d, total in enumerate(row) for k, x in enumerate(limbs(total))]
        rows += [(c, -1, 0, n) for c, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((),) * 4)], ["c", "d", "k", "x"])

    out = [list(c) for c in centroids]
    totals: dict[tuple[int, int], int] = {}
    for c, d, k, x in blocks.mapInArrow(run, "c long, d long, k long, x long").groupBy("c", "d", "k").agg(F.sum("x")).collect():
        totals[c, d] = totals.get((c, d), 0) + (x << LIMB * k)
    for (c, d), total in totals.items():
        if d >= 0:
            out[c][d] = total // totals[c, -1]
    return out


def _assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, codes in _blocks(batches):
            best, distance = nearest(codes, tables(values, _as_array(centroids, values)))
            fits = [x if x <= LARGEST else None for x in distance.tolist()]
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(best, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def _inertia(column: str) -> F.Column:
    """The sum of distances, null where one is or where it leaves a long."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count(F.lit(1))) & (total <= LARGEST), total.cast("long"))


def first_centroids(vectors: DataFrame, column: str, count: int) -> list[list[int]]:
    """Components of the vectors whose ids have the least hashes."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), F.col(column).cast("array<double>").alias("v")).orderBy("h", "v").limit(count).collect()
    return [[int(x) for x in whole(np.array(r.v, np.float64)).tolist()] for r in rows]


def cluster(
    embeddings: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, centroids: int = CENTROIDS, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector."""
    spark = embeddings.sparkSession
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = embeddings.filter(F.coalesce((F.size(x) == dimensions) & finite, F.lit(False)))
    now = first_centroids(kept, column, centroids)
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = written(coded(kept, column, dimensions), "blocks")
    for _ in range(rounds):
        now = _moved(blocks, now)
    found = written(_assigned(blocks, now), "assigned")
    drop_scratch(blocks)
    # At most a row for each centroid.
    sums = found.groupBy("cluster").agg(_inertia("distance").alias("cluster_inertia")).collect()
    total = found.agg(_inertia("distance").alias("inertia")).first().inertia
    named = [(r.cluster, r.cluster_inertia, total, hashlib.sha256(",".join(map(str, now[r.cluster])).encode()).hexdigest()) for r in sums]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
