"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit set where over half of a text's shingle hashes set
it.  Distinct fingerprints are cut into ``PARTS`` bit ranges; two that differ
in at most ``RADIUS`` bits agree on some choice of ``PARTS - RADIUS`` ranges,
so each choice gives one candidate bucket.  Inside a bucket the fingerprints
are held as vertical bit planes: the distances of 64 of them to a query grow
together in carry-save counters (bitwise operations on machine words), and a
block of 64 is abandoned once each of them is beyond the radius.

A bucket gives a spanning tree of its links, not the pairs themselves: the
members of each linked set, in order, are tied to their half-index, so that
no fingerprint gets more than three edges a bucket and depth stays
logarithmic.  A bucket above ``BUCKET_MAX`` members is cut again on the bits
that its key leaves free, which loses no link; this repeats until none is
left above it or no bits are free.

Components come from taking the least label among neighbours and following
labels (pointer jumping), one written table a round.

Defined results: a null or blank text has fingerprint zero and links like any
other; rows that repeat an id and text get the same result; rows without
doc_id take part, and component_id is the least id that is not null (null if
there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, kept_rows, numbered, partitions, written

RADIUS = 3
PARTS = 5
SHINGLE = 3
SEED = 42
BUCKET_MAX = 4096
BITS = 64
#: Of ``keep_one_each``: words of a shingle, and the share of shingles as a
#: fraction, so that it is compared in whole numbers.
WIDE_SHINGLE = 5
ALIKE = (4, 5)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    digest = xxhash.xxh64_intdigest
    firsts, lasts = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(firsts, lasts)], np.uint64, len(firsts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        rows = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


#: Words of a wide fingerprint, and the distance within which it links.
WIDE_WORDS, WIDE_RADIUS = 4, 88


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE_WORDS`` fingerprint words of a set of shingle hashes.

    Each of their 256 bits differs with a probability of at most 0.19 between
    sets alike to 0.8, and of about 0.5 between others: within ``WIDE_RADIUS``
    lie all but some 1 in 10 billion of the former and 3 in 10 million of the latter.
    """
    out = np.empty(WIDE_WORDS, np.uint64)
    for k in range(WIDE_WORDS):
        x = (hashes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out[k] = majority(x ^ (x >> np.uint64(27)))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, number: str | None = None) -> DataFrame:
    """row (the stored column number, else a new number), doc_id and fp (the fingerprint as a
    signed long) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(fps)], ["row", "doc_id", "fp"])

    row = F.col(number) if number else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long")


# -- bit-sliced comparison ------------------------------------------------


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """planes[bit, block]: bit i of the word is that bit of member 64*block+i.
    fps has a row for each member, of one or more words."""
    n, words = fps.shape
    blocks = -(-n // BITS)
    padded = np.zeros((blocks * BITS, words), np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits.reshape(blocks, BITS, BITS * words).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(BITS * words, blocks)


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Where so few blocks hold wide members not reached yet, these are compared one by one.
FEW_BLOCKS = 8


def near(planes: np.ndarray, query: int, valid: np.ndarray, radius: int = RADIUS, bits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that hold members within the radius of query, and their bit sets.

    valid has the bits of the members that are asked for.  bits leaves out
    those on which the whole bucket agrees.
    """
    alive = np.flatnonzero(valid)
    width = radius.bit_length()
    check = 4 if width < 4 else 16
    bits = list(range(len(planes))) if bits is None else bits
    counters = [np.zeros(len(alive), np.uint64) for _ in range(width)]
    beyond = ~valid[alive]
    for step, bit in enumerate(bits):
        row = planes[bit, alive]
        carry = ~row if query >> bit & 1 else row
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        beyond = beyond | carry
        last = step == len(bits) - 1
        if not last and (step < radius or step % check != check - 1):
            continue
        if radius + 1 < 1 << width:  # the counters can hold more than the radius
            beyond = beyond | _above(counters, radius)
        if not last:
            stay = beyond != FULL
            if not stay.all():
                alive, beyond = alive[stay], beyond[stay]
                counters = [c[stay] for c in counters]
                if not len(alive):
                    break
    found = ~beyond
    some = found != 0
    return alive[some], found[some]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], FULL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            above = above | (equal & counters[i])
            equal = equal & ~counters[i]
    return above


def linked_sets(fps: np.ndarray, radius: int = RADIUS) -> list[np.ndarray]:
    """Connected sets (indexes, two or more) of fingerprints within the radius.

    fps has a word, or a row of words, for each.  Searches outward from one
    member at a time over those not reached yet, so each member is a query once.
    """
    if len(fps) < 2:
        return []
    fps = fps.reshape(len(fps), -1)
    if len(fps) < 24:
        return _small_sets(fps, radius)
    agree = int.from_bytes((np.bitwise_and.reduce(fps) | np.bitwise_and.reduce(~fps)).tobytes(), "little")
    bits = [b for b in range(BITS * fps.shape[1]) if not agree >> b & 1]
    planes = bit_planes(fps)
    valid = np.full(planes.shape[1], FULL)
    if len(fps) % BITS:
        valid[-1] = np.uint64((1 << len(fps) % BITS) - 1)
    out = []
    for seed in range(len(fps)):
        if not int(valid[seed >> 6]) >> (seed & 63) & 1:
            continue
        valid[seed >> 6] &= ~np.uint64(1 << (seed & 63))
        reached, todo = [seed], [seed]
        while todo:
            query = fps[todo.pop()]
            alive = np.flatnonzero(valid)
            if not len(alive):
                break  # all are reached
            if fps.shape[1] > 1 and len(alive) <= FEW_BLOCKS:
                lanes = np.unpackbits(valid[alive].view(np.uint8), bitorder="little").reshape(-1, BITS)
                left = (alive[:, None] * BITS + np.arange(BITS))[lanes.astype(bool)]
                new = left[np.bitwise_count(fps[left] ^ query).sum(axis=1, dtype=np.int64) <= radius].tolist()
                for i in new:
                    valid[i >> 6] &= ~np.uint64(1 << (i & 63))
            else:
                blocks, sets = near(planes, int.from_bytes(query.tobytes(), "little"), valid, radius, bits)
                valid[blocks] &= ~sets
                new = [int(b) << 6 | i for b, s in zip(blocks, sets.tolist()) for i in range(BITS) if s >> i & 1]
            reached += new
            todo += new
        if len(reached) > 1:
            out.append(np.sort(np.array(reached)))
    return out


def _small_sets(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2, dtype=np.int64)
    close = distance <= radius
    if close.sum() == len(fps):
        return []
    label = np.arange(len(fps))
    while True:
        least = np.where(close, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            break
        label = least
    return [m for m in (np.flatnonzero(label == x) for x in np.unique(label)) if len(m) > 1]


# -- candidate buckets ----------------------------------------------------


def part_masks(bits: list[int], parts: int, radius: int) -> list[int]:
    """Masks of the bit choices on which fingerprints within the radius agree."""
    ranges = [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(np.array(bits), parts)]
    return [sum(choice) for choice in combinations(ranges, parts - radius)]


def bucketed(fps: DataFrame, parts: int = PARTS, radius: int = RADIUS) -> DataFrame:
    """Rows (mask, key, fp): a row for each choice of bit ranges."""
    masks = part_masks(list(range(BITS)), parts, radius)
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    return fps.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("mask")).select("mask", (F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def _split_again(big: DataFrame, parts: int, radius: int) -> DataFrame:
    """Cuts buckets anew on the bits outside their mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, fp = (np.asarray(batch.column(c)) for c in ("mask", "fp"))
            for old in np.unique(mask).tolist():
                if old not in finer:
                    free = [b for b in range(BITS) if not (old & 0xFFFFFFFFFFFFFFFF) >> b & 1]
                    masks = part_masks(free, min(parts, len(free)), radius) if len(free) > radius else [(1 << BITS) - 1]
                    finer[old] = np.array(masks, np.uint64).view(np.int64) | old
                members = fp[mask == old]
                new = finer[old]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(new, len(members))), pa.array((members[:, None] & new[None, :]).ravel()), pa.array(np.repeat(members, len(new)))],
                    ["mask", "key", "fp"],
                )

    return big.select("mask", "fp").mapInArrow(run, "mask long, key long, fp long")


def _tree_edges(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges of a shallow spanning tree for each linked set of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def flush(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            edges_a, edges_b = [], []
            bounds = np.concatenate(([0], cut, [len(fp)]))
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                members = np.unique(fp[bounds[i] : bounds[i + 1]])
                for group in linked_sets(members.view(np.uint64), radius):
                    chosen = members[group]
                    edges_a.append(chosen[1:])
                    edges_b.append(chosen[np.arange(1, len(chosen)) >> 1])
            join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([join(edges_a), join(edges_b)], ["a", "b"])

        for batch in batches:
            columns = [np.asarray(batch.column(c)) for c in ("mask", "key", "fp")]
            mask, key, fp = carried = [np.concatenate(x) for x in zip(carried, columns)]
            if not len(fp):
                continue
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield flush(*(x[:end] for x in carried))
                carried = [x[end:] for x in carried]
        if len(carried[0]):
            yield flush(*carried)

    dealt = buckets.repartition(partitions(buckets.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, parts: int = PARTS, radius: int = RADIUS, bucket_max: int = BUCKET_MAX) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span the same
    components as all pairs within the radius."""
    rows = written(bucketed(fps, parts, radius), "buckets")
    edges = []
    while True:
        big = rows.groupBy("mask", "key").count().filter(F.col("count") > bucket_max).filter(F.col("mask") != -1).select("mask", "key")
        big = written(big, "large_buckets")
        if big.isEmpty():
            edges.append(written(_tree_edges(rows, radius).distinct(), "links"))
            break
        edges.append(written(_tree_edges(rows.join(big, ["mask", "key"], "left_anti"), radius).distinct(), "links"))
        rows = written(_split_again(rows.join(big, ["mask", "key"], "left_semi"), parts, radius).distinct(), "buckets")
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node reachable) for each node that has an edge."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        # A neighbour's label ...
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        hooked = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        hooked = written(hooked, "hooked")
        # ... and the label of the label.
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = written(hooked.join(jump, "label").select("node", "old", F.least("label", "jump").alias("label")), "labels")
        drop_scratch(labels, hooked)
        if new.filter("label <> old").isEmpty():
            drop_scratch(both)
            return new.select("node", "label")
        labels = new


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, number: str | None = None) -> DataFrame:
    """row, doc_id, fp, label, component_id for each row of docs.

    label is the component's least fingerprint, component_id its least doc_id.
    """
    fps = written(fingerprints(docs, shingle, number), "fingerprints")
    known = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    labels = components(links(known, radius=radius))
    tied = known.join(labels, known.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    tied = written(tied, "tied")
    least = tied.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = written(tied.join(least, "label").select("fp", "label", "component_id"), "components")
    return fps.join(named, "fp").select("row", "doc_id", "fp", "label", "component_id")


def hexadecimal(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one_each(docs: DataFrame, shingle: int = WIDE_SHINGLE, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """One row of docs for each component of texts that share at least ``alike``
    (as a fraction) of their shingles: the first by doc_id (rows without one
    come last), then by place in the scan.

    Wide fingerprints find the candidates and whole sets decide; see ``similar``.
    """
    from . import similar

    stored, number = numbered(docs)
    rows = stored.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = written(components(similar.links(rows, shingle, alike)), "components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    tied = rows.select("row", "doc_id").join(labels.withColumnRenamed("node", "row"), "row")
    gone = tied.join(tied.groupBy("label").agg(F.min(order).alias("first")), "label").filter("row <> first.row").select("row")
    return kept_rows(stored, number, written(gone, "gone"), "left_anti")
