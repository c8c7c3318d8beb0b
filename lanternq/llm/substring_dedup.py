"""Substring dedup with suffix automata of reference shards.

A word goes if some window of ``WINDOW`` words over it starts in a document
with a smaller doc_id as well.

Every window has an anchor, the least hash among its runs of ``ANCHOR``
words.  Equal windows have equal anchors, so an anchor's passages (the
stretches of consecutive windows that share it) are a reference shard of
their own.  Only anchors that occur in two different texts are looked at, and
of equal passages only the first document's is kept with its content.  In
each shard the passages stream in doc_id order past a suffix automaton of the
passages before them: matching statistics give, for each position, the state
of the longest match, and the state's first document tells whether the window
that ends there has been seen.  Passages with unseen windows then extend the
automaton.

The automata of all shards grow with the corpus, so they are not broadcast
whole: each is built in the task that its shard's passages are sent to.  A
shard of more than ``SHARD_PASSAGES`` different passages is split: its
different passages (not the documents that hold them) are anchored anew with
longer anchors, parts that only one owner has are set aside, and the other
parts form shards of their own; in the end an anchor is a whole window.  What
is seen in a part is carried back to its passages, and documents meet their
passages once, at the end.

Defined results: a null or blank text has no words; texts of fewer than
``WINDOW`` words lose nothing; rows with the same doc_id do not remove each
other's words; rows without doc_id come after all others; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, numbered, partitions, written

WINDOW = 50
ANCHOR = 10
SHARD_PASSAGES = 512
NO_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchored_runs(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first window and number of windows of each run that shares an anchor."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = len(words) - anchor + 1
    rolled = np.zeros(grams, np.uint64)
    for j in range(anchor):
        rolled = rolled * _ODD + hashes[j : j + grams]
    rolled = _mixed(rolled)
    span = window - anchor + 1
    at = np.empty(n, np.int64)
    for low in range(0, n, 1 << 15):
        part = rolled[low : low + (1 << 15) + span - 1]
        views = np.lib.stride_tricks.sliding_window_view(part, span)[: n - low]
        at[low : low + len(views)] = views.argmin(axis=1) + np.arange(low, low + len(views))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    return rolled[at[first]].view(np.int64), first.astype(np.int32), count.astype(np.int32)


class SuffixAutomaton:
    """Of word sequences added in the order of their documents; each state
    knows the first document that its sequences occur in."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, following: dict[bytes, int], length: int, link: int, first: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The part of state q whose sequences are no longer than p's and the word."""
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q], self.first[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], document: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new = self._state({}, self.length[last] + 1, 0, document)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def seen_before(self, words: list[bytes], document: int, window: int = WINDOW) -> list[int]:
        """First words of the windows that occur in a smaller document."""
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                matched = window
                if self.first[state] < document:
                    out.append(i - window + 1)
        return out


def seen_in_shard(passages: list[tuple[int, list[bytes]]], window: int = WINDOW) -> list[list[int]]:
    """For each passage (document, words), in document order, its windows seen earlier."""
    automaton, out = SuffixAutomaton(), []
    for document, words in passages:
        seen = automaton.seen_before(words, document, window)
        if len(seen) < len(words) - window + 1:
            automaton.add(words, document)
        out.append(seen)
    return out


# -- stages ---------------------------------------------------------------


def _numbered(docs: DataFrame) -> DataFrame:
    stored, number = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return stored.withColumnRenamed(number, "row")


def _scan(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """A head row for each document (key is null) and a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, runs = [], []
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                words = words_of(text.as_py())
                joined = b" ".join(words)
                content = xxhash.xxh3_128_digest(joined)
                heads.append((row.as_py(), doc_id.as_py(), len(words), content, hashlib.sha256(joined).hexdigest()))
                key, first, count = anchored_runs(words, window, anchor)
                if len(key):
                    own = int.from_bytes(content[:8], "little", signed=True)
                    runs.append((np.full(len(key), row.as_py()), np.full(len(key), own), key, first, count))
            n = len(heads)
            row, doc_id, n_words, content, sha = zip(*heads) if heads else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n_words, pa.int64()), pa.array(content, pa.binary()), pa.array(sha, pa.string()),
                    *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())),
                ],
                NAMES,
            )
            if runs:
                row, own, key, first, count = (np.concatenate(x) for x in zip(*runs))
                n = len(row)
                nulls = (pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(row), *nulls, *map(pa.array, (own, key, first, count))], NAMES)

    return docs.mapInArrow(run, "row long, doc_id long, n_words long, content binary, sha string, own long, key long, first int, count int")


NAMES = ["row", "doc_id", "n_words", "content", "sha", "own", "key", "first", "count"]


def _passages(held: DataFrame, window: int) -> DataFrame:
    """row, document, key, digest, first, count, passage of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, document, text, runs in zip(*(batch.column(c).to_pylist() for c in ("row", "document", "text", "runs"))):
                words = words_of(text)
                out = []
                for r in runs:
                    passage = b" ".join(words[r["first"] : r["first"] + r["count"] + window - 1])
                    out.append((row, document, r["key"], xxhash.xxh3_128_digest(passage), r["first"], r["count"], passage))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PASSAGE_TYPES)], PASSAGE_NAMES)

    return held.select("row", "document", "text", "runs").mapInArrow(run, PASSAGE_SCHEMA)


def _seen(distinct: DataFrame, window: int) -> DataFrame:
    """digest, owner, seen (windows of the owner's passage found in earlier
    documents) for each different passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "owner", "passage"))))
        pending = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)  # at most SHARD_PASSAGES
            seen = seen_in_shard([(owner, passage.split()) for _, _, owner, passage in group], window)
            pending += [(digest, owner, s) for (_, digest, owner, _), s in zip(group, seen)]
            if len(pending) > 5000:
                yield batch_of(pending)
                pending = []
        if pending:
            yield batch_of(pending)

    def batch_of(rows: list) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", "owner", "seen"])

    dealt = distinct.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "owner", "digest")
    return dealt.select("key", "digest", "owner", "passage").mapInArrow(run, "digest binary, owner long, seen array<int>")


def _parts(distinct: DataFrame, window: int, anchor: int) -> DataFrame:
    """The different passages of large shards cut by longer anchors: parent
    (digest), owner, at (first window in the parent), count, key, digest, passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parent, owner, passage in zip(*(batch.column(c).to_pylist() for c in ("digest", "owner", "passage"))):
                words = passage.split()
                for key, first, count in zip(*(x.tolist() for x in anchored_runs(words, window, anchor))):
                    part = b" ".join(words[first : first + count + window - 1])
                    out.append((parent, owner, first, count, key, xxhash.xxh3_128_digest(part), part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PART_TYPES)], PART_NAMES)

    return distinct.select("digest", "owner", "passage").mapInArrow(run, PART_SCHEMA)


PART_SCHEMA = "parent binary, owner long, at int, count int, key long, digest binary, passage binary"
PART_NAMES = [x.split()[0] for x in PART_SCHEMA.split(", ")]
PART_TYPES = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _resolved(distinct: DataFrame, window: int, anchor: int) -> DataFrame:
    """digest, owner, seen (windows of the owner's passage found in documents
    before it) for each different passage (key, digest, owner, passage).

    Small shards are streamed past their automata.  Passages of large ones are
    cut anew, level by level; only the different parts that several owners
    have go on, and what is seen in a part is carried back to its parents.
    """
    levels: list[tuple[DataFrame, DataFrame]] = []  # passages that were cut, and their parts
    found: list[DataFrame] = []  # at each level, those of small shards
    while True:
        big = written(distinct.groupBy("key").count().filter(F.col("count") > SHARD_PASSAGES).filter(F.lit(anchor < window)).select("key"), "big")
        found.append(written(_seen(distinct.join(big, "key", "left_anti"), window), "seen"))
        if big.isEmpty():
            break
        # Longer anchors, by three quarters of what they leave free of a window: few rounds.
        anchor += -(-3 * (window - anchor) // 4)
        cut = distinct.join(big, "key", "left_semi")
        parts = written(_parts(cut, window, anchor), "parts")
        shared = parts.groupBy("key").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).filter("a <> b").select("key")
        parts = written(parts.join(written(shared, "shared"), "key", "left_semi"), "parts")
        levels.append((cut.select("digest", "owner"), parts.select("parent", F.col("owner").alias("document"), F.col("at").alias("first"), "count", "digest")))
        distinct = written(_distinct(parts.withColumnRenamed("owner", "document")), "distinct")
    seen = found.pop()
    while levels:
        cut, parts = levels.pop()
        windows = parts.join(seen, "digest").select("parent", _seen_windows().alias("at")).filter(F.size("at") > 0)
        windows = windows.groupBy("parent").agg(F.flatten(F.collect_list("at")).alias("seen"))
        back = cut.join(windows, cut.digest == windows.parent, "left").select("digest", "owner", F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))
        seen = written(found.pop().unionByName(back), "resolved")
    return seen


def _distinct(passages: DataFrame) -> DataFrame:
    """The different passages, each with its first document as owner."""
    return passages.groupBy("key", "digest").agg(F.min("document").alias("owner"), F.first("passage").alias("passage"))


PASSAGE_SCHEMA = "row long, document long, key long, digest binary, first int, count int, passage binary"
PASSAGE_NAMES = [x.split()[0] for x in PASSAGE_SCHEMA.split(", ")]
PASSAGE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())


def _cut(held: DataFrame, window: int) -> DataFrame:
    """row, n_removed, kept_sha256 and kept (text) from the windows seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, seen in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "seen"))):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.array(seen, np.int64))
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, s in zip(words, stay.tolist()) if s])
                out.append((row, int(len(words) - stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "n_removed", "kept_sha256", "kept"])

    return held.select("row", "text", "seen").mapInArrow(run, "row long, n_removed long, kept_sha256 string, kept string")


def _removals(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """Head rows with copy_of_earlier, and the rows that lose some words."""
    docs = _numbered(docs)
    scan = written(_scan(docs, window, anchor), "scan")
    document = F.coalesce("doc_id", F.lit(NO_ID))
    heads = scan.filter("key is null").select("row", "doc_id", document.alias("document"), "n_words", "content", "sha")
    # Whole texts that repeat are settled by their first document.
    copies = written(heads.groupBy("content").agg(F.min("document").alias("first_document"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "copies")
    heads = heads.join(copies, "content", "left").withColumn("copied", F.coalesce(F.col("first_document") < F.col("document"), F.lit(False)))
    heads = written(heads.select("row", "doc_id", "document", "n_words", "sha", "copied"), "heads")

    runs = scan.filter("key is not null")
    shared = written(runs.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a <> b").select("key"), "shared")
    runs = written(runs.join(shared, "key", "left_semi").select("row", "key", "first", "count"), "runs")
    own = runs.join(heads.filter("copied").select("row"), "row", "left_anti").groupBy("row").agg(F.collect_list(F.struct("first", "count", "key")).alias("runs"))
    held = docs.join(own, "row").withColumn("document", document)
    held = written(held.select("row", "document", "text", "runs"), "held")

    passages = written(_passages(held, window), "passages")
    distinct = written(_distinct(passages), "distinct")
    seen = _resolved(distinct, window, anchor)
    drop_scratch(scan, copies, shared, runs, distinct)
    found = passages.drop("passage").join(seen, "digest").select("row", _seen_windows().alias("at")).filter(F.size("at") > 0)
    seen_rows = found.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("seen"))
    return heads, held.select("row", "text").join(seen_rows, "row")


def _seen_windows() -> Column:
    """All windows of a passage that an earlier document owns, else the
    owner's windows found in documents before it."""
    every = F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)
    own = F.transform("seen", lambda i: i + F.col("first"))
    return F.when(F.col("document") > F.col("owner"), every).when(F.col("document") == F.col("owner"), own)


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs, and kept,
    the text that stays (null where the text is unchanged)."""
    heads, seen = _removals(docs, window, anchor)
    cut = written(_cut(seen, window), "cut")
    gone = F.col("copied") & (F.col("n_words") >= window)
    return heads.join(cut, "row", "left").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
