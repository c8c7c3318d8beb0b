"""Periodic runs of words by string synchronising sets.

A run is a stretch of words that repeats with a smallest period q over at
least ``LEAST_EXPONENT`` periods and that no neighbouring word prolongs.

At each dyadic scale t a synchronising set picks positions by the hashes of
the t words that follow: a position is in it if the least hash among it and
the next t positions is its own or that of the last of them.  Whether a
position is picked depends on the next 2t words alone, so equal contexts are
picked alike; and any t positions in a row hold a pick unless the words there
repeat with a period of at most t/3.  In a run of period q (2t <= q < 4t) two
picks with equal contexts therefore lie q apart: picks of equal context at
such a distance propose their distance, and the longest common stretch on
either side of the pair gives the run.

Positions whose next t words have a period of at most t/3 take no part in
the choice.  They are known when a scale begins, as runs of three periods or
more of the smaller scales; those of period 1, below all scales, are stretches
of equal words.

The words of many texts stand one after another, longest text first and each
closed by a mark of its own, so that no run crosses texts and a scale works on
the texts at its beginning that are long enough for it.  Hashes only choose
and propose: every run is compared word by word before it counts, and where
hashes were misleading the words around the pair decide.

Defined results: words are stretches without ASCII white space; a null or
blank text has no words and no runs; repeated rows get the same result; an
empty table gives an empty result; further columns are left alone.  A text
takes about 150 bytes a word of its task's memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, resting, slices, text_of

#: Runs of this many periods are looked for at least; the method needs them for the scales above.
FOUND_EXPONENT = 3
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Bytes of texts that are handled together.
TOGETHER = 2 << 20
#: Hashes of 2^0 ... 2^STORED words are kept for comparing stretches.
STORED = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Stretches:
    """How far two places of a sequence agree, by hashes of dyadic lengths.

    levels[k][i] is the hash of the 2^k words from i; it may cover less than
    the whole sequence, and then only the first part can be asked for."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def _steps(self, a: np.ndarray, d: np.ndarray, back: bool) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            hashes, step = self.levels[k], 1 << k
            todo = np.arange(len(a))
            while len(todo):
                at = a[todo] - total[todo] - step if back else a[todo] + total[todo]
                todo, at = (x[(at >= 0) & (at + d[todo] < len(hashes))] for x in (todo, at))
                todo = todo[hashes[at] == hashes[at + d[todo]]]
                total[todo] += step
                if k < len(self.levels) - 1:
                    break
        return total

    def after(self, a: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Words from a that equal those d words on."""
        return self._steps(a, d, False)

    def before(self, a: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Words before a that equal those d words on."""
        return self._steps(a, d, True)


def synchronising(values: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Positions picked at scale t; values are hashes of t words, periodic marks those that take no part."""
    shown = np.where(periodic, _MOST, values >> _ONE)
    least, width = shown, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == shown[:n]) | (least == shown[t : t + n])) & (least != _MOST))


def proposals(places: np.ndarray, contexts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Picks and distances (2t to 4t - 1) to later picks of equal context."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    near, found = np.arange(len(places)), []
    for step in range(1, len(places)):
        near = near[near < len(places) - step]
        near = near[(contexts[near] == contexts[near + step]) & (places[near + step] - places[near] < 4 * t)]
        if not len(near):
            break
        far = near[places[near + step] - places[near] >= 2 * t]
        found.append((places[far], places[far + step] - places[far]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretch(ids: np.ndarray, at: int, d: int) -> tuple[int, int, int]:
    """The stretch of period d around a place and the one d words on, word by word."""
    low, high = at, at
    while high + d < len(ids) and ids[high] == ids[high + d]:
        high += 1
    while high > at and low and ids[low - 1] == ids[low - 1 + d]:
        low -= 1
    return low, high - low + d, d


def stretches(ids: np.ndarray, at: np.ndarray, d: np.ndarray, t: int, compare: Stretches) -> np.ndarray:
    """Different rows (start, length, period) of at least FOUND_EXPONENT periods
    around the pairs (at, at + d), whose next 2t words have equal hashes.

    Pairs of one distance that are no further apart than 2t lie in one stretch
    and the first of them is measured.  Words decide in the end: where they
    differ from what hashes say, each pair is looked at by itself."""
    order = np.lexsort((at, d))
    at, d = at[order], d[order]
    head = np.concatenate(([True], (d[1:] != d[:-1]) | (at[1:] - at[:-1] > 2 * t)))
    chain = np.cumsum(head) - 1
    first, period = at[head], d[head]
    low = first - compare.before(first, period)
    high = first + compare.after(first, period)  # of the words that equal those a period on
    same = np.array([np.array_equal(ids[a:b], ids[a + q : b + q]) for a, b, q in zip(low.tolist(), high.tolist(), period.tolist())], bool)
    apart = ~same[chain] | (at < low[chain]) | (at >= high[chain])
    out = [np.stack([low, high - low + period, period], axis=1)[same]]
    if apart.any():
        out.append(np.array([_stretch(ids, *x) for x in zip(at[apart].tolist(), d[apart].tolist())], np.int64))
    rows = np.concatenate(out)
    return np.unique(rows[rows[:, 1] >= FOUND_EXPONENT * rows[:, 2]], axis=0)


def repeated_words(ids: np.ndarray) -> np.ndarray:
    """Stretches of one word: rows (start, length, 1)."""
    edge = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    length = np.diff(edge)
    long = length >= FOUND_EXPONENT
    return np.stack([edge[:-1][long], length[long], np.ones(long.sum(), np.int64)], axis=1)


def runs_of(ids: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Rows (start, length, period), by start, of the runs of FOUND_EXPONENT periods or more.

    ids has a number for each word, text after text, longest text first, and a
    number of its own after each text; lengths counts the words of each text."""
    if not len(ids):
        return np.empty((0, 3), np.int64)
    sizes = np.array(lengths)
    ends = np.cumsum(sizes + 1)

    def covered(least: int) -> int:
        """Where the texts of so many words end."""
        n = int(np.searchsorted(-sizes, -least, side="right"))
        return int(ends[n - 1]) if n else 0

    current = mixed((ids.astype(np.uint64) + _ONE) * _ODD)
    levels = [current]
    while len(levels) <= STORED and (end := covered(2 << len(levels) - 1)) >= 2 << len(levels) - 1:
        levels.append(_doubled(levels[-1], 1 << len(levels) - 1)[:end])
    compare = Stretches(levels)
    runs, k = repeated_words(ids), 0
    while (end := covered(2 * FOUND_EXPONENT << k)) > 0:
        t = 1 << k
        values = levels[k] if k < len(levels) else _doubled(current, t >> 1)
        current = values
        values = values[:end]
        small = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] >= t) & (runs[:, 0] < len(values))]
        mark = np.zeros(len(values) + 1, np.int64)
        np.add.at(mark, small[:, 0], 1)
        np.add.at(mark, np.minimum(small[:, 0] + small[:, 1] - t + 1, len(values)), -1)
        contexts = _doubled(values, t)
        places = synchronising(values, np.cumsum(mark[:-1]) > 0, t)
        places = places[places < len(contexts)]
        at, d = proposals(places, contexts[places], t)
        if len(at):
            runs = np.concatenate([runs, stretches(ids, at, d, t, compare)])
        k += 1
    # A stretch has multiples of its period too; the smallest one is its own.
    order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _doubled(hashes: np.ndarray, step: int) -> np.ndarray:
    return mixed(hashes[:-step] * _ODD + hashes[step:])


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs of LEAST_EXPONENT periods and LEAST_LENGTH words or more,
    rows (start, length, period) by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number = defaultdict(count().__next__)
    flat: list[int] = []
    for i in order:
        flat += map(number.__getitem__, texts[i])
        flat.append(-i - 1)
    lengths = [len(texts[i]) for i in order]
    runs = runs_of(np.array(flat, np.int64), lengths)
    runs = runs[runs[:, 1] >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    starts = np.cumsum([0, *(n + 1 for n in lengths)])
    cuts = np.searchsorted(runs[:, 0], starts)
    out = [np.empty((0, 3), np.int64)] * len(texts)
    for k, i in enumerate(order):
        if cuts[k] < cuts[k + 1]:
            out[i] = runs[cuts[k] : cuts[k + 1]] - [starts[k], 0, 0]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those of a run after its first period."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, gone in zip(words, np.cumsum(edge).tolist()) if not gone]
    return b" ".join(words)


# -- stage ----------------------------------------------------------------


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and
    collapsed (the text without what the runs repeat) for each row of docs."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                words = [(t.as_py() or "").encode().split() for t in part.column("text")]
                runs = runs_of_texts(words)
                rows = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in runs], run_type)
                texts = pa.array([collapsed(w, r).decode() for w, r in zip(words, runs)], pa.string())
                counts = pa.array(map(len, words), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, rows, texts], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(resting(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of every tenth text by the hash of its doc_id
    repeat from some place on, which plants runs of known periods."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(text_of(), BLANKS), "")
    n, g = F.size(words).cast("long"), F.expr("h div 10")
    a = g % n
    left = n - a
    p = F.lit(1) + F.floor(left / (F.lit(3) + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil(left / p).cast("int")))
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), left.cast("int")))
    planted = F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h")).select("doc_id", planted.alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Digests and the longest run (ties: smallest start, then period) of what periodic_runs gives."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, -r.start, -r.period, r.alias("run"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.getField("run").alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

