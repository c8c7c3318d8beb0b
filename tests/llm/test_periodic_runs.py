"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lanternq.llm import entries, periodic_runs
from lanternq.llm.common import written


def plain_runs(words, least=6, exponent=4):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                out.setdefault((start, i - start + q), q)  # smaller periods come first
    return sorted((start, length, q) for (start, length), q in out.items())


def fast_plain_runs(words):
    """The same, by whole arrays, for long texts."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    out = {}
    for q in range(1, len(ids) // 4 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start + q >= max(6, 4 * q):
                out.setdefault((start, end - start + q), q)
    return sorted((start, length, q) for (start, length), q in out.items())


def made_words(rng):
    n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 200, 500]), rng.choice([1, 2, 2, 3, 5, 50])
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 3 else 0):
        a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 3))
        for i in range(a, rng.randrange(a, n + 1)):
            words[i] = words[a + (i - a) % p]
    return words


def assert_same(rng, rounds):
    for _ in range(rounds):
        texts = [made_words(rng) for _ in range(rng.randrange(1, 12))]
        for words, runs in zip(texts, periodic_runs.runs_of_texts(texts)):
            assert list(map(tuple, runs.tolist())) == plain_runs(words)


def test_random_words():
    assert_same(random.Random(1), 150)


@pytest.mark.parametrize("bits", [0, 1, 7, 255])
def test_misleading_hashes_change_nothing(monkeypatch, bits):
    own = periodic_runs.mixed
    monkeypatch.setattr(periodic_runs, "mixed", lambda x: own(x) & np.uint64(bits))
    assert_same(random.Random(bits), 25)


def test_few_stored_levels(monkeypatch):
    monkeypatch.setattr(periodic_runs, "STORED", 1)
    assert_same(random.Random(3), 60)


def test_words_of_strings_without_runs():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(9):  # Fibonacci words have no run of four periods
        a, b = b, b + a
    assert len(periodic_runs.runs_of_texts([b])[0]) == 0


def test_picks_depend_on_their_context_only():
    rng = np.random.default_rng(4)
    for t in (1, 2, 4, 8):
        ids = rng.integers(0, 3, 2000)
        values = np.array([hash(tuple(ids[i : i + t])) & 0xFFFFFFFF for i in range(2000 - t + 1)], np.uint64)
        periodic = np.array([any((ids[i + p : i + t] == ids[i : i + t - p]).all() for p in range(1, t // 3 + 1)) for i in range(len(values))])
        picked = set(periodic_runs.synchronising(values, periodic, t).tolist())
        seen = {}
        for i in range(2000 - 2 * t + 1):
            assert seen.setdefault(tuple(ids[i : i + 2 * t]), i in picked) == (i in picked)
        for i in range(2000 - 3 * t):  # t positions without a pick lie in a region of small period
            if not picked & set(range(i, i + t)):
                part = ids[i : i + 3 * t - 1]
                assert any((part[p:] == part[:-p]).all() for p in range(1, t // 3 + 1))


def test_long_texts():
    t = time.time()
    period = [b"w%d" % i for i in range(4999)]
    texts = [[b"a"] * 100_000, period * 5 + [b"x"], [b"x", b"y", b"z"] * 30_000, [b"a" * 1_000_000]]
    got = periodic_runs.runs_of_texts(texts)
    assert [x.tolist() for x in got] == [[[0, 100_000, 1]], [[0, 24_995, 4999]], [[0, 90_000, 3]], []]
    assert time.time() - t < 5


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, words):
    runs = fast_plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept))


def test_query_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = sorted(expected(r.doc_id, planted(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs)
    df = entries.QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, df.collect())) == wanted
    assert sum(r[1] > 0 for r in wanted) > len(wanted) // 30


def test_odd_rows(spark):
    rows = [(None, "a b " * 9), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "x\u00a0y " * 8), (4, "x\u00a0y " * 8), (5, "é " * 6 + "tail"), (6, "no run here"), (10, "w " * 5)]
    docs = written(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, runs int, h int, collapsed int"))
    got = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {
        (None, "a b", ((0, 18, 2),)), (None, "", ()), (1, "", ()), (2, "", ()), (3, "", ()), (4, "x\u00a0y", ((0, 8, 1),)),
        (5, "é tail", ((0, 6, 1),)), (6, "no run here", ()), (10, "w w w w w", ()),
    }
    assert periodic_runs.periodic_runs(docs).count() == len(rows)
    told = periodic_runs.summary(periodic_runs.periodic_runs(periodic_runs.with_repeated_tail(docs))).collect()
    assert len(told) == len(rows) and all(r.runs_sha256 and r.collapsed_sha256 for r in told)
    assert periodic_runs.summary(periodic_runs.periodic_runs(docs.limit(0))).collect() == []
