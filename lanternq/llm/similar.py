"""Links of the SimHash operator between texts of a stated similarity.

Two texts are linked if their sets of shingles share ``alike`` of all their
elements or more.  ``BANDS`` keys of ``BAND_ROWS`` least hashes each give the
candidate buckets: two sets alike to 0.8 have no key in common in 1 of 10^9
cases.  Of buckets with the same rows one is
kept.  In a bucket, wide fingerprints are compared bit-sliced
(``simhash.linked_sets``); what is connected by them meets once more with its
whole sets, each text once, and these decide exactly.  Both steps search
outward from one row at a time over those not reached yet and give spanning
edges, never pairs.

No task holds a group of more than ``HELD_BYTES``.  A larger one is dealt into
blocks, and each block is searched together with the first one, which ties a
group of near copies to one part at once.  Rows outside that part (strays)
then meet all blocks, some of them at a time; pairs inside the part need no
look any more, so no link is lost.

Defined results: words are as in ``simhash``; a text of fewer words than a
shingle has is one shingle; texts without words are alike; null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, partitions, resting, written
from .simhash import ALIKE, WIDE_RADIUS, WIDE_SHINGLE, WIDE_WORDS, components, linked_sets, wide_fingerprint

BANDS, BAND_ROWS = 20, 2
#: Bytes of the rows of a group that are searched together, about; and what a row takes besides its item.
HELD_BYTES, ROW_BYTES = 8 << 20, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The set of shingle hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    shingle = min(shingle, len(words))
    count = len(words) - shingle + 1
    rolled = np.full(count, shingle, np.uint64)
    for j in range(shingle):
        rolled = rolled * _ODD + hashes[j : j + count]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(rolled ^ (rolled >> np.uint64(29)))


_TIMES = np.random.default_rng(11).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1)
_PLUS = np.random.default_rng(12).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band: least values of the set under as many hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(own), 4096):
        least = np.minimum(least, (own[low : low + 4096, None] * _TIMES + _PLUS).min(axis=0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = (keys ^ least[k::BAND_ROWS]) * _ODD
        keys ^= keys >> np.uint64(31)
    return keys


def _parts(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[list[tuple[int, int]]]:
    """Spanning edges (from, to) of each connected part of two or more;
    near(i, others) says which of the others i is linked to."""
    left, out = np.arange(count), []
    while len(left) > 1:
        todo, left, edges = [int(left[0])], left[1:], []
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            if hit.any():
                new = left[hit].tolist()
                edges += [(i, j) for j in new]
                todo += new
                left = left[~hit]
        if edges:
            out.append(edges)
    return out


def alike_edges(sets: list[np.ndarray], alike: tuple[int, int] = ALIKE) -> list[tuple[int, int]]:
    """Spanning edges (indexes) of the sets that are alike; only those whose
    wide fingerprints lie within the radius are compared."""
    sizes = np.array([len(s) for s in sets])
    fps = np.array([wide_fingerprint(s) for s in sets]).reshape(-1, WIDE_WORDS)

    # Elements by number, set after set: what a set shares with all others is one pass over them.
    known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marked = np.zeros(len(known), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        n = sizes[i]
        hit = np.zeros(len(others), bool)
        fits = (sizes[others] * alike[1] >= n * alike[0]) & (n * alike[1] >= sizes[others] * alike[0])
        fits &= np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1, dtype=np.int64) <= WIDE_RADIUS
        if not fits.any():
            return hit
        own = numbers[starts[i] : starts[i] + n]
        marked[own] = True
        k = others[fits]
        if len(k) * 8 < len(sets):
            both = np.array([np.count_nonzero(marked[numbers[starts[j] : starts[j] + sizes[j]]]) for j in k.tolist()])
        else:
            both = np.add.reduceat(marked[numbers], starts, dtype=np.int64)[k]
        marked[own] = False
        hit[fits] = both * alike[1] >= (n + sizes[k] - both) * alike[0]
        return hit

    return [e for edges in _parts(len(sets), near) for e in edges]


# -- stages ---------------------------------------------------------------


def _keyed(docs: DataFrame, shingle: int) -> DataFrame:
    """row, its wide fingerprint and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), shingle)
                fps.append(wide_fingerprint(own).tobytes())
                keys.append(band_keys(own).view(np.int64))
            columns = [batch.column("row"), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "fp", "keys"])

    return docs.select("row", "text").mapInArrow(resting(run), "row long, fp binary, keys array<long>")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "row")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return (list(group) for _, group in groupby(rows, key=lambda r: r[0]))


def _near(rows: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of what lies within the radius in each bucket."""

    def edges_of(bucket: np.ndarray, row: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        bounds = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        a, b = [], []
        for low, high in zip(bounds, bounds[1:]):
            for part in linked_sets(fps[low:high], WIDE_RADIUS):
                part = np.sort(row[low:high][part])
                a.append(np.full(len(part) - 1, part[0]))
                b.append(part[1:])
        together = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.RecordBatch.from_arrays([together(a), together(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WIDE_WORDS), np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
            held = tuple(np.concatenate(x) for x in zip(held, (np.asarray(batch.column("bucket")), np.asarray(batch.column("row")), fps)))
            # The last bucket may go on in the next batch.
            end = int(np.searchsorted(held[0], held[0][-1]))
            if end:
                yield edges_of(*(x[:end] for x in held))
                held = tuple(x[end:] for x in held)
        yield edges_of(*held)

    return _dealt(rows).select("bucket", "row", "fp").mapInArrow(resting(run), "a long, b long").distinct()


def _edges(rows: DataFrame, alike: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            edges = alike_edges([np.frombuffer(r[2], np.uint64) for r in group], alike)
            if edges:
                a, b = zip(*((group[i][1], group[j][1]) for i, j in edges))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(rows).select("bucket", "row", "own").mapInArrow(resting(run), "a long, b long").distinct()


def _sets(held: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(t.as_py(), shingle).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("row"), own], ["bucket", "row", "own"])

    return held.select("bucket", "row", "text").mapInArrow(resting(run), "bucket long, row long, own binary")


def _in_blocks(rows: DataFrame, item: str, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What edges_of gives for rows (bucket, row and item), with buckets of over
    HELD_BYTES searched in blocks; the edges span the same parts."""
    size = F.length(item) + ROW_BYTES
    sizes = rows.groupBy("bucket").agg(F.sum(size).alias("size")).filter(F.col("size") > HELD_BYTES)
    sizes = written(sizes.select("bucket", _blocks("size").alias("blocks")), "sizes")
    if sizes.isEmpty():
        return written(edges_of(rows), "edges")
    large = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    large = written(large, "large")

    def meeting(df: DataFrame, *of: str) -> DataFrame:
        # Should two groups get one number, they are searched together, which adds no wrong edge.
        return df.select(F.xxhash64("bucket", *of).alias("bucket"), "row", item)

    others = F.when(F.col("block") == 0, F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    with_first = meeting(large.withColumn("other", F.explode(others)), "other")
    found = written(edges_of(rows.join(sizes, "bucket", "left_anti").unionByName(with_first)), "edges")

    labels = components(found).withColumnRenamed("node", "row")
    later = large.filter("block > 0").select("bucket", "row", size.alias("size")).join(labels, "row", "left")
    parts = later.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = parts.filter("label is not null").groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    strays = later.join(main, "bucket", "left").filter("main is null or label is null or label <> main")
    strays = written(strays.select("bucket", "row", "size"), "strays")
    if strays.isEmpty():
        return found
    shares = written(strays.groupBy("bucket").agg(_blocks(F.sum("size")).alias("shares")), "shares")
    dealt = strays.select("bucket", "row").join(shares, "bucket").join(large, ["bucket", "row"])
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("row", F.lit(1)), F.col("shares"))).withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    whole = large.filter("block > 0").join(shares, "bucket").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    more = written(edges_of(meeting(dealt, "share", "block").unionByName(meeting(whole, "share", "block")).distinct()), "edges")
    return found.unionByName(more)


def _blocks(size: F.Column | str) -> F.Column:
    """Blocks of half of HELD_BYTES, two at least: two of them are held together."""
    return F.greatest(F.lit(2), F.ceil((F.col(size) if isinstance(size, str) else size) * 2 / HELD_BYTES)).cast("long")


def links(docs: DataFrame, shingle: int = WIDE_SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """Edges (a, b) between row numbers that span the same components as all
    pairs of alike texts.  docs has stored columns row and text."""
    keyed = written(_keyed(docs, shingle), "keyed")
    keys = keyed.select("row", F.explode("keys").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"x{k}") for k in (0, 1))).filter("n > 1")
    shared = written(shared.groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket"), "shared")
    members = written(keys.join(shared, "bucket", "left_semi"), "members")
    near = _in_blocks(members.join(keyed.select("row", "fp"), "row"), "fp", _near)
    # A row is tied to the first of each of its at most BANDS parts: to the least
    # of these one edge is enough, and the others are tied among themselves.
    stars = near.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("firsts")).withColumn("a", F.col("firsts")[0])
    others = stars.select("a", F.explode(F.slice("firsts", 2, BANDS)).alias("b")).distinct()
    tied = written(stars.select("a", "b").unionByName(others), "tied")
    drop_scratch(keyed, shared, members, near)
    # Written, so that a small table is broadcast and no text is moved.
    groups = written(components(tied).select(F.col("node").alias("row"), F.col("label").alias("bucket")), "groups")
    sets = written(_sets(docs.select("row", "text").join(groups, "row"), shingle), "sets")
    out = _in_blocks(sets, "own", lambda rows: _edges(rows, alike))
    drop_scratch(tied, groups, sets)
    return out
