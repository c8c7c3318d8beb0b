"""Suffix-array dedup: longest previous factors of byte strings.

A byte goes if some ``WINDOW`` bytes over it also start in a document with a
smaller doc_id.

In suffix order, the nearest entries on either side that belong to a smaller
document (the previous and the next smaller value) bound what a suffix has in
common with anything earlier: the longer of its common prefixes with these two
is its longest previous factor.  A window is a repeat if that factor is at
least as long as the window.

No order of all suffixes is built in one place.  Every window has an anchor,
the least hash among its runs of ``ANCHOR`` bytes.  Equal windows have equal
anchors, so the stretches of windows that share an anchor (its passages) are
ordered together and away from others.  The steps:

1. A task hashes the anchors of some megabytes of texts and sends short keys,
   packed, to the buckets they fall into; what its own texts share it tells at
   once and sends on one time only, so that a bucket holds no more entries of
   a key than there are such tasks' parts.  Keys in texts of different content
   come back to these texts.
2. Texts meet their keys, and the passages of these keys are cut out.  Of equal
   passages only the first document's is kept with its bytes.
3. Shards (the different passages of a key) are ordered some of them together,
   as a match between two shards is a match all the same.  A shard of more than
   ``SHARD_BYTES`` is cut anew by longer anchors, in the end by whole windows,
   and what is found in a part is carried back.
4. Texts meet their repeated windows and are cut.

Texts that are equal as wholes are settled by their first document and only
that one takes part.  A text is known by its doc_id and a 64-bit hash.

Defined results: a null text counts as empty; texts shorter than the window
lose nothing; rows with the same doc_id do not remove each other's bytes; rows
without doc_id come after all others; repeated rows get the same result; an
empty table gives an empty result; further columns are left alone.  Long texts
are looked at in pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, partitions, resting, slices, text_of, written

WINDOW = 50
ANCHOR = 20
NO_ID = (1 << 63) - 1
#: Bytes of texts whose anchors are sent on together, and of texts hashed at once.
SCAN_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Bytes of texts whose keys a bucket takes.
BUCKET_BYTES = 32 << 20
#: Bits of a key besides its bucket.
KEY_BYTES = 5
#: Windows of a passage, bytes of a shard, bytes that are ordered together.
MOST_WINDOWS, SHARD_BYTES, ORDERED_BYTES = 4096, 1 << 20, 1 << 20
#: Passages whose bytes a task remembers to have given.
GIVEN = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


# -- longest previous factors ---------------------------------------------


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; data has seven bytes more at its end."""
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their next depth bytes (equal ones as given),
    and the common prefix of each with the one before it, at most depth.

    data has ``depth + 7`` bytes more after the last start."""
    eights = _eights(data)
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    common = np.full(len(starts), depth, np.int64)
    common[:1] = 0
    tied = np.arange(len(starts))
    for at in range(0, depth, 8):
        key = eights[starts[order[tied]] + at].astype(np.uint64)
        if depth - at < 8:
            key &= ~np.uint64((1 << 8 * (8 - depth + at)) - 1)
        again = np.lexsort((key, group[tied])) if at else np.argsort(key, kind="stable")
        order[tied], key = order[tied][again], key[again]
        own = group[tied]
        differ = np.flatnonzero((key[1:] != key[:-1]) & (own[1:] == own[:-1]))
        unlike = key[differ + 1] ^ key[differ]
        bytes_alike = np.zeros(len(differ), np.int64)
        for k in range(1, 8):
            bytes_alike += unlike < np.uint64(1) << np.uint64(64 - 8 * k)
        common[tied[differ + 1]] = at + bytes_alike
        edge = np.concatenate(([True], common[1:] < depth)) if at + 8 >= depth else np.concatenate(([True], common[1:] < at + 8))
        group = np.cumsum(edge)
        alone = edge & np.concatenate((edge[1:], [True]))
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
    return starts[order], common


def previous_smaller(values: np.ndarray, common: np.ndarray, floor: int) -> np.ndarray:
    """Common prefix with the nearest earlier entry of a smaller value, 0 if
    there is none or if it is shorter than floor.

    Each entry looks at the one before it and, while that is not smaller, at
    the one that that one looks at; all entries move at once."""
    n = len(values)
    look, least = np.arange(-1, n - 1), common.copy()
    moving = np.flatnonzero((look >= 0) & (least >= floor))
    while len(moving):
        at = look[moving]
        moving = moving[(at >= 0) & (least[moving] >= floor)]
        moving = moving[values[look[moving]] >= values[moving]]
        at = look[moving]
        shorter, further = np.minimum(least[moving], least[at]), look[at]
        least[moving], look[moving] = shorter, further
    found = (look >= 0) & (least >= floor)
    found[found] = values[look[found]] < values[found]
    return np.where(found, least, 0)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, documents: np.ndarray, depth: int, floor: int = 1) -> np.ndarray:
    """For each start, the longest prefix (at most depth bytes; 0 if shorter than
    floor) that also starts in a smaller document."""
    number = np.empty(int(starts.max(initial=-1)) + 1, np.int64)
    number[starts] = np.arange(len(starts))
    ordered, common = suffix_order(data, starts, depth)
    which = number[ordered]
    values = documents[which]
    before = previous_smaller(values, common, floor)
    after = previous_smaller(values[::-1], np.concatenate((common[:1], common[:0:-1])), floor)[::-1]
    out = np.empty(len(starts), np.int64)
    out[which] = np.maximum(before, after)
    return out


def repeated_windows(passages: list[tuple[int, bytes]], window: int = WINDOW) -> list[np.ndarray]:
    """For each passage (document, bytes) the starts of its windows that a smaller document has."""
    sizes = np.array([len(p) - window + 1 for _, p in passages])
    data = np.frombuffer(b"".join([p for _, p in passages]) + bytes(window + 7), np.uint8)
    offsets = np.cumsum(np.concatenate(([0], sizes[:-1] + window - 1)))
    firsts = np.cumsum(np.concatenate(([0], sizes)))
    within = np.arange(firsts[-1]) - np.repeat(firsts[:-1], sizes)
    documents = np.repeat(np.array([d for d, _ in passages], np.int64), sizes)
    longest = longest_previous_factors(data, np.repeat(offsets, sizes) + within, documents, window, window)
    return [within[a:b][longest[a:b] >= window] for a, b in zip(firsts.tolist(), firsts[1:].tolist())]


# -- anchors --------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the length (at least 8) bytes from each place."""
    eights = _eights(data).astype(np.uint64)
    n = len(data) - length + 1
    out = eights[:n]
    for at in [*range(8, length - 8, 8), *([length - 8] if length > 8 else [])]:
        out = _mixed(out * _ODD) + eights[at : at + n]
    return _mixed(out * _ODD)


def anchored_runs(texts: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """key, text, first window and number of windows of each run that shares an
    anchor, at most MOST_WINDOWS long.  Texts have at least window bytes."""
    found, held, size = [], [], 0
    for i, text in enumerate(texts):
        for low in range(0, len(text) - window + 1, PIECE_BYTES):
            held.append((i, low, text[low : low + PIECE_BYTES + window - 1]))
            size += len(held[-1][2])
            if size >= PIECE_BYTES:
                found.append(_runs_of_pieces(held, window, anchor))
                held, size = [], 0
    if held:
        found.append(_runs_of_pieces(held, window, anchor))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs_of_pieces(pieces: list[tuple[int, int, bytes]], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    owner, low, parts = zip(*pieces)
    least = gram_hashes(np.frombuffer(b"".join(parts), np.uint8), anchor)
    span, width = window - anchor + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - span + width], least[span - width :])
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(len(least), bool)
    inside[(ends[:-1, None] - np.arange(1, window)).ravel()] = False
    change = least[1:] != least[:-1]
    first = np.flatnonzero(inside & np.concatenate(([True], change | ~inside[:-1])))
    stop = np.flatnonzero(inside & np.concatenate((change | ~inside[1:], [True]))) + 1
    times = -(-(stop - first) // MOST_WINDOWS)
    if (times > 1).any():
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, stop = np.repeat(first, times) + nth * MOST_WINDOWS, np.repeat(stop, times)
        stop = np.minimum(stop, first + MOST_WINDOWS)
    piece = np.searchsorted(ends, first, side="right")
    starts = ends - np.array([len(p) for p in parts])
    return least[first], np.array(owner)[piece], first - starts[piece] + np.array(low)[piece], stop - first


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and KEY_BYTES bytes of each key, as one number: bucket + buckets * rest."""
    n = np.uint64(buckets)
    return keys % n + n * (keys // n & np.uint64((1 << 8 * KEY_BYTES) - 1))


# -- stages ---------------------------------------------------------------


def _arrow(types: str, *columns: object) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in types.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, ARROW[k]) for c, k in zip(columns, kinds)], list(names))


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
RANGES = "array<struct<at:int,n:int>>"
ARROW[RANGES] = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
SPANS = "array<struct<start:long,end:long>>"
ARROW[SPANS] = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SENT = "bucket int, owns array<long>, docs binary, keys binary"
TOLD = "own long, keys array<long>"
PASSAGE = "own long, document long, key long, digest long, first int, count int, passage binary"
PART = "parent_key long, parent long, owner long, at int, count int, key long, digest long, passage binary"
SEEN = "key long, digest long, owner long, seen " + RANGES


def _sent(texts: DataFrame, buckets: int, window: int, anchor: int) -> DataFrame:
    """Packed keys for each bucket; below zero, keys that a task knows to be shared."""

    def rows(owns: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, doc, _, _ = anchored_runs(texts, window, anchor)
        key = short_keys(key, buckets)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc = key[fresh], doc[fresh]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        several = np.diff(np.append(np.flatnonzero(first), len(key))) > 1
        known = several[np.cumsum(first) - 1]
        own = np.array(owns)

        def packed(bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, size: int) -> pa.RecordBatch:
            order = np.lexsort((doc, bucket))
            bucket, key, doc = bucket[order], key[order], doc[order]
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
            out = []
            for a, b in zip(edges, edges[1:]):
                docs, index = np.unique(doc[a:b], return_inverse=True)
                out.append((int(bucket[a]), own[docs].tolist(), index.astype("<u4").tobytes(), key[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()))
            return _arrow(SENT, *zip(*out))

        n = np.uint64(buckets)
        once = key[first]
        yield packed((once % n).astype(np.int64), once // n, doc[first], KEY_BYTES)
        if known.any():
            # Dealt by text, as a key's entries need not meet any more.
            yield packed(-1 - own[doc[known]] % buckets, key[known], doc[known], 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        size = 0
        for batch in batches:
            for own, text in zip(batch.column("own").to_pylist(), batch.column("text")):
                if own in held:
                    continue
                held[own] = text.as_py().encode()
                size += len(held[own])
                if size >= SCAN_BYTES:
                    yield from rows(list(held), list(held.values()))
                    held, size = {}, 0
        if held:
            yield from rows(list(held), list(held.values()))

    return texts.select("own", "text").mapInArrow(resting(run), SENT)


def _told(sent: DataFrame, buckets: int) -> DataFrame:
    """own and keys that texts of another content have too; a text may get several rows."""

    def by_text(own: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(own, kind="stable")
        own, key = own[order], key[order].astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([len(own) > 0], own[1:] != own[:-1], [len(own) > 0])))
        return _arrow(TOLD, own[edges[:-1]], pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(key)))

    def unpacked(row: tuple, size: int) -> tuple[np.ndarray, np.ndarray]:
        _, owns, docs, keys = row
        raw = np.frombuffer(keys, np.uint8).reshape(-1, size)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :size] = raw
        return np.array(owns, np.int64)[np.frombuffer(docs, "<u4")], wide.view("<u8").ravel().astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            if bucket < 0:
                for row in group:
                    yield by_text(*unpacked(row, 8))
                continue
            own, key = (np.concatenate(x) for x in zip(*(unpacked(row, KEY_BYTES) for row in group)))
            order = np.argsort(key, kind="stable")
            own, key = own[order], key[order]
            edge = np.concatenate(([True], key[1:] != key[:-1]))
            first = np.flatnonzero(edge)
            shared = (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first))[np.cumsum(edge) - 1]
            if shared.any():
                yield by_text(own[shared], key[shared] * np.uint64(buckets) + np.uint64(bucket))

    dealt = sent.repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(resting(run), TOLD)


def _of_text(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return _mixed(key + _mixed((doc.astype(np.uint64) + np.uint64(1)) * _ODD))


def _digest(passage: bytes) -> int:
    return xxhash.xxh3_64_intdigest(passage) - (1 << 63)


def _passages(held: DataFrame, buckets: int, window: int, anchor: int) -> DataFrame:
    """The passages of each text's shared keys; a task gives the bytes of equal
    ones once, and now and then again (null else)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                if len(given) > GIVEN:
                    given.clear()
                texts = [t.as_py().encode() for t in part.column("text")]
                key, doc, first, count = anchored_runs(texts, window, anchor)
                key = short_keys(key, buckets)
                told = [np.concatenate([np.asarray(k.values) for k in keys]).astype(np.uint64) for keys in part.column("keys")]
                own = np.repeat(np.arange(len(told)), [len(k) for k in told])
                # A key of another text may be taken for this one's, which costs a passage and changes nothing.
                stay = np.isin(_of_text(key, doc), _of_text(np.concatenate(told), own))
                key, doc, first, count = key[stay].astype(np.int64), doc[stay], first[stay], count[stay]
                digests, fresh = [], []
                for k, i, a, z in zip(key.tolist(), doc.tolist(), first.tolist(), (first + count + window - 1).tolist()):
                    passage = texts[i][a:z]
                    digests.append(digest := _digest(passage))
                    fresh.append(None if (k, digest) in given else passage)
                    given.add((k, digest))
                same = (part.column(c).take(pa.array(doc)) for c in ("own", "document"))
                yield _arrow(PASSAGE, *same, key, digests, first.astype(np.int32), count.astype(np.int32), fresh)

    return held.select("own", "document", "text", "keys").mapInArrow(resting(run), PASSAGE)


def _distinct(passages: DataFrame) -> DataFrame:
    """The different passages, each with its first document as owner."""
    return passages.groupBy("key", "digest").agg(F.min("document").alias("owner"), F.first("passage", ignorenulls=True).alias("passage"))


def _seen(distinct: DataFrame, window: int) -> DataFrame:
    """Windows of each different passage that documents before its owner have."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([(owner, passage) for _, _, owner, passage in rows], window)
        out = [(key, digest, owner, _ranges(w)) for (key, digest, owner, _), w in zip(rows, found) if len(w)]
        return _arrow(SEEN, *(zip(*out) if out else ((),) * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "owner", "passage"))))
        held, size = [], 0
        for _, shard in groupby(rows, key=lambda r: r[0]):
            shard = list(shard)  # of at most SHARD_BYTES
            if len(shard) == 1:
                continue  # one document's own passage
            held += shard
            size += sum(len(r[3]) for r in shard)
            if size >= ORDERED_BYTES:
                yield solved(held)
                held, size = [], 0
        if held:
            yield solved(held)

    dealt = distinct.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.select("key", "digest", "owner", "passage").mapInArrow(resting(run), SEEN)


def _ranges(windows: np.ndarray) -> list[dict[str, int]]:
    """Window starts, in order, as stretches."""
    edge = np.flatnonzero(np.concatenate(([True], np.diff(windows) > 1, [True])))
    return [{"at": int(windows[a]), "n": int(b - a)} for a, b in zip(edge, edge[1:])]


def _parts(distinct: DataFrame, window: int, anchor: int) -> DataFrame:
    """The different passages of large shards, cut by longer anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent_key, parent, owner, passage = (batch.column(c).to_pylist() for c in ("key", "digest", "owner", "passage"))
            key, which, first, count = anchored_runs(passage, window, anchor)
            which, first, count = which.tolist(), first.tolist(), count.tolist()
            parts = [passage[i][a : a + n + window - 1] for i, a, n in zip(which, first, count)]
            yield _arrow(PART, *([x[i] for i in which] for x in (parent_key, parent, owner)), first, count, key.view(np.int64), list(map(_digest, parts)), parts)

    return distinct.select("key", "digest", "owner", "passage").mapInArrow(resting(run), PART)


def _windows() -> F.Column:
    """All windows of a passage if an earlier document owns it, else the owner's repeated ones; from the passage's first."""
    own = F.transform("seen", lambda r: F.struct((r.at + F.col("first")).alias("at"), r.n.alias("n")))
    every = F.array(F.struct(F.col("first").alias("at"), F.col("count").alias("n")))
    return F.when(F.col("document") > F.col("owner"), every).otherwise(F.coalesce(own, F.array().cast(RANGES)))


def _resolved(distinct: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, digest, owner, seen of the different passages that documents before
    their owners share windows with."""
    levels, found = [], []
    while True:
        sizes = distinct.groupBy("key").agg(F.sum(F.length("passage")).alias("size"))
        big = written(sizes.filter((F.col("size") > SHARD_BYTES) & F.lit(anchor < window)).select("key"), "big")
        found.append(written(_seen(distinct.join(big, "key", "left_anti"), window), "seen"))
        if big.isEmpty():
            break
        anchor += -(-3 * (window - anchor) // 4)
        cut = distinct.join(big, "key", "left_semi")
        parts = written(_parts(cut, window, anchor), "parts")
        shared = parts.groupBy("key").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).filter("a <> b").select("key")
        parts = written(parts.join(written(shared, "shared"), "key", "left_semi"), "parts")
        distinct = written(_distinct(parts.withColumnRenamed("owner", "document")), "distinct")
        # Parts carry their own documents, their content's owner comes from the different parts.
        mine = parts.select("parent_key", "parent", F.col("owner").alias("document"), F.col("at").alias("first"), "count", "key", "digest")
        levels.append((mine, distinct.select("key", "digest", "owner")))
    seen = found.pop()
    while levels:
        mine, owners = levels.pop()
        known = owners.join(seen.drop("owner"), ["key", "digest"], "left")
        back = mine.join(known, ["key", "digest"]).select("parent_key", "parent", "document", _windows().alias("at")).filter(F.size("at") > 0)
        back = back.groupBy("parent_key", "parent", "document").agg(F.flatten(F.collect_list("at")).alias("seen"))
        back = back.select(F.col("parent_key").alias("key"), F.col("parent").alias("digest"), F.col("document").alias("owner"), "seen")
        seen = written(found.pop().unionByName(back), "resolved")
    return seen


def _cut(held: DataFrame, window: int) -> DataFrame:
    """What is left of each text without its repeated windows."""
    out = "own long, document long, n_removed long, spans " + SPANS + ", kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, seen in zip(batch.column("text"), batch.column("seen").to_pylist()):
                data, merged = text.as_py().encode(), []
                for a, b in sorted((r["at"], r["at"] + r["n"] + window - 1) for part in seen for r in part):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                removed.append(len(data) - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield _arrow(out, batch.column("own"), batch.column("document"), removed, spans, kept)

    return held.select("own", "document", "text", "seen").mapInArrow(resting(run), out)


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs, and
    spans (start, end of what goes) and kept (the bytes that stay; null where
    nothing goes)."""
    document = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    text = text_of().cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document.alias("document"), F.xxhash64(text).alias("own"), text.alias("text"))
    heads = written(texts.select("doc_id", "document", "own", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "heads")
    long = texts.filter(F.octet_length("text") >= window)

    total = heads.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(4 * partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    # Texts by content, with their first document; hot groups are small by then.
    firsts = written(heads.groupBy("sha", "own").agg(F.min("document").alias("first_document"), F.count("*").alias("n")), "firsts")
    told = _told(_sent(long, buckets, window, anchor), buckets).groupBy("own").agg(F.collect_list("keys").alias("keys"))
    told = written(told.join(firsts.select("own", F.col("first_document").alias("document")), "own"), "told")
    passages = written(_passages(long.join(told, ["own", "document"]), buckets, window, anchor), "passages")
    distinct = written(_distinct(passages), "distinct")
    drop_scratch(told)
    seen = _resolved(distinct, window, anchor)
    known = distinct.select("key", "digest", "owner").join(seen.drop("owner"), ["key", "digest"], "left")
    found = passages.drop("passage").join(known, ["key", "digest"]).select("own", "document", _windows().alias("at")).filter(F.size("at") > 0)
    found = written(found.groupBy("own", "document").agg(F.collect_list("at").alias("seen")), "found")
    drop_scratch(passages, distinct)
    # Repeated rows are cut by themselves and told apart by nothing, so one of them is enough.
    cut = _cut(long.join(found, ["own", "document"]), window).withColumn("kept_sha256", F.sha2("kept", 256)).dropDuplicates(["own", "document"])

    copies = firsts.filter("n > 1").select("sha", "own", "first_document")
    heads = heads.join(copies, ["sha", "own"], "left").withColumn("gone", F.coalesce(F.col("first_document") < F.col("document"), F.lit(False)) & (F.col("n_bytes") >= window))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(F.col("gone"), all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPANS)))
    return heads.join(cut, ["own", "document"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(F.col("gone"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        spans.alias("spans"),
        F.when(F.col("gone"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
