"""Regular-expression search by trigram posting lists.

The index says for each run of three ASCII characters (in lower case) which
files have it in a line; it is a table bucketed and sorted by the trigram, so
that a look-up reads the buckets it asks for.  Files are numbers in it, and the
trigrams of many files are made at once, by array operations over their bytes.  A regular expression is turned
into a tree of trigrams that every line it matches must hold, joined by *and*
and *or*.  Files whose postings fulfil the tree are candidates, and only their
lines are searched; a pattern that asks for no trigram is searched for in all
files.  The rows are those of ``search.search_text``.

Only ASCII characters count, as their lower case never depends on what stands
around them.  What the tree cannot say is left out of it, which makes it
weaker but never wrong.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_scratch, fresh_path, written
from ..sources.corpus import lines
from . import search

#: Trigrams of a pattern that are looked up, and alternatives that are spelt out, at most.
MOST_TRIGRAMS, MOST_SPELLINGS = 48, 16
#: Repetitions that are written out.
MOST_COPIES = 4
ALL = ("all",)
#: Plain characters: what an index holds besides blanks and signs that control.
PLAIN = re.compile(r"[\x20-\x7e\t]")


def _both(op: str, parts: list[tuple]) -> tuple:
    """The parts under one operator, without what says nothing."""
    if op == "or" and ALL in parts:
        return ALL
    flat: list[tuple] = []
    for part in parts:
        flat += [x for x in (part[1:] if part[0] == op else (part,)) if x != ALL and x not in flat]
    return ALL if not flat else flat[0] if len(flat) == 1 else (op, *flat)


def trigrams_of(text: str) -> tuple:
    """All trigrams of a text that must stand in a line."""
    return _both("and", [("has", text[i : i + 3]) for i in range(len(text) - 2)])


class _Spelt:
    """What is known of a part of a pattern: a tree that holds for the part
    alone, and all its spellings if they are few (None: not known)."""

    def __init__(self, spellings: list[str] | None, tree: tuple = ALL):
        self.spellings, self.tree = spellings, tree

    def closed(self) -> tuple:
        if self.spellings is None:
            return self.tree
        return _both("and", [self.tree, _both("or", [trigrams_of(s) for s in self.spellings])])


def _sequence(parts: list[_Spelt]) -> _Spelt:
    trees, run = [], _Spelt([""])
    whole = True
    for part in parts:
        joined = None
        if run.spellings is not None and part.spellings is not None and len(run.spellings) * len(part.spellings) <= MOST_SPELLINGS:
            joined = [a + b for a in run.spellings for b in part.spellings]
        if joined is not None:
            run = _Spelt(joined)
        else:
            trees.append(run.closed())
            run, whole = _Spelt(part.spellings), False
        trees.append(part.tree)
    if whole:
        return _Spelt(run.spellings, _both("and", trees))
    return _Spelt(None, _both("and", [*trees, run.closed()]))


def _cut(pattern: str, at: int = 0) -> tuple[list[_Spelt], int]:
    """The parts of a branch list from a place on, up to its closing bracket or the end."""
    branches: list[list[_Spelt]] = [[]]
    while at < len(pattern) and pattern[at] != ")":
        c = pattern[at]
        if c == "|":
            branches.append([])
            at += 1
            continue
        if c == "(":
            part, at = _group(pattern, at)
        elif c == "[":
            part, at = _class(pattern, at)
        elif c == "\\":
            part, at = _escaped(pattern, at)
        elif c in ".^$":
            part, at = _Spelt([""] if c != "." else None), at + 1
        else:
            part, at = _Spelt([c.lower()] if PLAIN.match(c) else None), at + 1
        repeat = re.compile(r"[*+?]|\{(\d+)(,?)(\d*)\}").match(pattern, at)
        if repeat:
            at = repeat.end()
            at += at < len(pattern) and pattern[at] in "+?"
            least = {"*": 0, "?": 0, "+": 1}.get(repeat[0], int(repeat[1] or 0))
            if repeat[0] == "?" and part.spellings is not None:
                branches[-1].append(_Spelt(["", *part.spellings]))
            elif not least:
                branches[-1].append(_Spelt(None))
            else:
                more = [] if repeat[1] and not repeat[2] and least <= MOST_COPIES else [_Spelt(None), part]
                branches[-1] += [part] * min(least, MOST_COPIES) + more
            continue
        branches[-1].append(part)
    if len(branches) == 1:
        return [_sequence(branches[0])], at
    ways = [_sequence(b) for b in branches]
    tree = _both("or", [w.closed() for w in ways])
    spelt = [s for w in ways for s in w.spellings] if all(w.spellings is not None for w in ways) else None
    return [_Spelt(spelt if spelt is not None and len(spelt) <= MOST_SPELLINGS else None, tree)], at


def _group(pattern: str, at: int) -> tuple[_Spelt, int]:
    opened = re.compile(r"\((\?:|\?<[A-Za-z]\w*>|\?[a-zA-Z-]+:|\?<?[=!]|\?>|\?[a-zA-Z-]+\)|(?!\?))").match(pattern, at)
    if not opened:
        raise ValueError(pattern)
    if opened[1].endswith(")"):  # flags alone
        if set(opened[1][1:-1]) - set("ims"):
            raise ValueError(pattern)
        return _Spelt([""]), opened.end()
    if opened[1].endswith(":") and set(opened[1][1:-1]) - set("ims"):
        raise ValueError(pattern)
    parts, end = _cut(pattern, opened.end())
    if end >= len(pattern):
        raise ValueError(pattern)
    # What is looked at without being taken says nothing of what stands next to it.
    return (_Spelt([""]) if opened[1][1:] in ("=", "!", "<=", "<!") else parts[0]), end + 1


def _class(pattern: str, at: int) -> tuple[_Spelt, int]:
    """A class of a few plain characters is its spellings."""
    simple = re.compile(r"\[([^\[\]\\^&-][^\[\]\\&-]*)\]").match(pattern, at)
    if simple:
        known = sorted({c.lower() for c in simple[1]}) if all(PLAIN.match(c) for c in simple[1]) else None
        return _Spelt(known if known and len(known) <= MOST_SPELLINGS else None), simple.end()
    if re.compile(r"\[\^?\]").match(pattern, at):
        raise ValueError(pattern)
    depth, end = 1, at + 1
    while depth:
        if end >= len(pattern):
            raise ValueError(pattern)
        depth += {"[": 1, "]": -1}.get(pattern[end], 0)
        end += 2 if pattern[end] == "\\" else 1
    return _Spelt(None), end


def _escaped(pattern: str, at: int) -> tuple[_Spelt, int]:
    c = pattern[at + 1 : at + 2]
    if c in tuple("bBAzZG"):
        return _Spelt([""]), at + 2
    if c in tuple("dDwWsSRXvVhHtnrfae"):
        return _Spelt(None), at + 2
    named = re.compile(r"\\[pP](?:\{\w+\}|\w)|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}").match(pattern, at)
    if named:
        return _Spelt(None), named.end()
    if c and not c.isalnum() and PLAIN.match(c):
        return _Spelt([c]), at + 2
    raise ValueError(pattern)


def required(pattern: str) -> tuple:
    """The tree of trigrams of every line that a regular expression matches;
    ``ALL`` where it cannot be told."""
    try:
        parts, end = _cut(pattern)
    except ValueError:
        return ALL
    return parts[0].closed() if end == len(pattern) else ALL


def known_trigrams(tree: tuple) -> list[str]:
    return [tree[1]] if tree[0] == "has" else sorted({t for part in tree[1:] for t in known_trigrams(part)}) if tree != ALL else []


def within(tree: tuple, most: int) -> tuple:
    """A weaker tree that asks for at most so many trigrams."""
    if len(known_trigrams(tree)) <= most:
        return tree
    if tree[0] != "and":
        return ALL
    kept: list[tuple] = []
    for part in tree[1:]:
        if len(known_trigrams(("and", *kept, part))) <= most:
            kept.append(part)
    return _both("and", kept)


def fulfilled(tree: tuple) -> Column:
    """Whether a file's postings (rows with a column trigram) fulfil the tree, as an aggregate."""
    if tree == ALL:
        return F.lit(True)
    if tree[0] == "has":
        return F.max(F.col("trigram") == tree[1])
    parts = [fulfilled(part) for part in tree[1:]]
    return reduce(Column.__and__ if tree[0] == "and" else Column.__or__, parts)


# -- index ----------------------------------------------------------------

#: Bytes of a text whose trigrams are told apart at once.
PIECE = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
HELD = np.zeros(256, bool)
HELD[[9, *range(0x20, 0x7F)]] = True


def codes(text: bytes) -> np.ndarray:
    """The different trigrams of a text in UTF-8, each as a number of 21 bits, in order.
    A line's end is no plain character, so none reaches over it."""
    found = []
    for low in range(0, max(1, len(text) - 2), PIECE):
        part = LOWER[np.frombuffer(text, np.uint8, min(PIECE + 2, len(text) - low), low)]
        plain, part = HELD[part], part.astype(np.int32)
        found.append(np.unique((part[:-2] << 14 | part[1:-1] << 7 | part[2:])[plain[:-2] & plain[1:-1] & plain[2:]]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


POSTINGS = "trigram string, base bigint, offsets array<int>, paths array<string>"


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of files a row for each of its trigrams with the places
    of the files that have it, and one with the batch's paths."""
    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column("content").cast(pa.large_binary())
        each = [codes(x.as_buffer()) if x.is_valid else np.empty(0, np.int32) for x in texts]
        every = np.concatenate(each or [np.empty(0, np.int32)])
        order = np.argsort(every, kind="stable")
        files = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])[order]
        known, first = np.unique(every[order], return_index=True)
        names = [chr(c >> 14) + chr(c >> 7 & 127) + chr(c & 127) for c in known.tolist()]
        n = len(known)
        offsets = pa.ListArray.from_arrays(pa.array(np.append(first, len(files)).astype(np.int32)), pa.array(files))
        paths = batch.column("path").cast(pa.string())
        columns = [
            pa.array([*names, None], pa.string()),
            pa.array(np.full(n + 1, base)),
            pa.concat_arrays([offsets, pa.nulls(1, offsets.type)]),
            pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(paths)], pa.int32()), paths)]),
        ]
        base += batch.num_rows
        yield pa.RecordBatch.from_arrays(columns, ["trigram", "base", "offsets", "paths"])


def postings(files: DataFrame) -> DataFrame:
    """trigram, base, offsets: the numbers (base and an offset) of the files that
    have a trigram in a line; and rows without a trigram, whose paths are
    those of the numbers from base on.  Numbers are those of a run, so the
    rows are to be written before they are used."""
    return files.select("path", "content").mapInArrow(_posted, POSTINGS)


def build_index(files: DataFrame, buckets: int | None = None, name: str | None = None, path: str | None = None) -> str:
    """Writes the index of files (path, content) as a bucketed table, whose name
    it returns, and the paths of its numbers as a table beside it."""
    spark = files.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"trigrams_{uuid.uuid4().hex}"
    path = path or fresh_path(spark, "trigrams")
    every = written(postings(files), "postings")
    numbers = every.filter("trigram is null").select("base", F.posexplode("paths").alias("at", "path")).select((F.col("base") + F.col("at")).alias("number"), "path")
    numbers.write.option("path", f"{path}-files").saveAsTable(f"{name}_files")
    rows = every.filter("trigram is not null").select("trigram", "base", "offsets").repartition(buckets, "trigram")
    rows.write.bucketBy(buckets, "trigram").sortBy("trigram").option("path", path).saveAsTable(name)
    drop_scratch(every)
    return name


def candidates(spark: SparkSession, index: str, pattern: str) -> DataFrame | None:
    """path of the files that may hold a match; None if any may."""
    tree = within(required(pattern), MOST_TRIGRAMS)
    if tree == ALL:
        return None
    held = spark.table(index).filter(F.col("trigram").isin(known_trigrams(tree)))
    held = held.select("trigram", "base", F.explode("offsets").alias("offset")).select("trigram", (F.col("base") + F.col("offset")).alias("number"))
    some = held.groupBy("number").agg(fulfilled(tree).alias("may")).filter("may")
    return spark.table(f"{index}_files").join(some, "number", "left_semi").select("path")


def indexed_search(files: DataFrame, index: str, pattern: str, max_results: int | None = 100, case_sensitive: bool = False, whole_word: bool = False, regex: bool = True) -> DataFrame:
    """The rows of ``search.search_text``, from the candidates' lines only."""
    plain = pattern if regex else re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", pattern)
    some = candidates(files.sparkSession, index, plain)
    held = files if some is None else files.join(some, "path", "left_semi")
    return search.search_text(lines(held), pattern, None, max_results, case_sensitive, whole_word, regex)
