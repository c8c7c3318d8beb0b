"""Suffix-array dedup and its parts against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from lanternq.llm import entries, suffix_arrays
from lanternq.llm.common import written


def plain_seen(passages, window):
    first = {}
    for d, p in passages:
        for i in range(len(p) - window + 1):
            first[p[i : i + window]] = min(d, first.get(p[i : i + window], 1 << 62))
    return [[i for i in range(len(p) - window + 1) if first[p[i : i + window]] < d] for d, p in passages]


def plain_rows(docs, window=50):
    """doc_id, n_bytes, n_removed, n_spans, digest; rows without doc_id come last."""
    big = 1 << 62
    texts = [((big if d is None else d), (t or "").encode()) for d, t in docs]
    out = []
    for (doc_id, _), (_, data), seen in zip(docs, texts, plain_seen(texts, window)):
        gone = np.zeros(len(data) + 2, bool)
        for i in seen:
            gone[i + 1 : i + 1 + window] = True
        kept = bytes(b for b, x in zip(data, gone[1:]) if not x)
        out.append((doc_id, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(200):
        window, kinds = rng.choice([1, 3, 8, 9, 16, 20]), rng.choice([1, 2, 4])
        passages = [(rng.randrange(6), bytes(rng.randrange(kinds) for _ in range(rng.randrange(window, window + 60)))) for _ in range(rng.randrange(1, 9))]
        assert [x.tolist() for x in suffix_arrays.repeated_windows(passages, window)] == plain_seen(passages, window)


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(100):
        n, kinds, depth = rng.randrange(1, 60), rng.choice([1, 2, 3]), rng.choice([5, 8, 13])
        documents = np.array([rng.randrange(4) for _ in range(n)])
        full = bytes(rng.randrange(kinds) for _ in range(n)) + bytes(range(100, 107 + depth))
        got = suffix_arrays.longest_previous_factors(np.frombuffer(full, np.uint8), np.arange(n), documents, depth)
        for i in range(n):
            common = [next((k for k in range(depth) if full[i + k] != full[j + k]), depth) for j in range(n) if documents[j] < documents[i]]
            assert got[i] == max(common, default=0)


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = random.Random(4)
    for _ in range(100):
        window = rng.choice([8, 12, 20])
        monkeypatch.setattr(suffix_arrays, "PIECE_BYTES", rng.choice([16, 64, 1000]))
        monkeypatch.setattr(suffix_arrays, "MOST_WINDOWS", rng.choice([4, 4096]))
        texts = [bytes(rng.randrange(3) for _ in range(rng.randrange(window, 200))) for _ in range(5)]
        seen, covered = {}, []
        for key, doc, first, count in zip(*(x.tolist() for x in suffix_arrays.anchored_runs(texts, window, rng.randrange(8, window + 1)))):
            for i in range(first, first + count):
                covered.append((doc, i))
        assert sorted(covered) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - window + 1)]
        for key, doc, first, count in zip(*(x.tolist() for x in suffix_arrays.anchored_runs(texts, window, 8))):
            assert all(seen.setdefault(texts[doc][i : i + window], key) == key for i in range(first, first + count))


def test_query_against_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = entries.QUERIES["op11_suffix_array_dedup"](spark, sf_dir)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == plain_rows(docs)
    assert sum(r[2] > 0 for r in got) > len(got) // 10


def made(spark, rows):
    return written(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, own int, key int, seen int, document int").repartition(3))


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_shards_of_any_size(spark, monkeypatch, shard):
    """Low alphabets make every key hot; small shards are cut by longer anchors."""
    monkeypatch.setattr(suffix_arrays, "SHARD_BYTES", shard)
    rng = random.Random(shard)
    shared = ["".join(rng.choice("abc") for _ in range(80)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice([rng.choice("ab"), rng.choice("abcé"), (s := rng.choice(shared))[(a := rng.randrange(60)) : a + 25]]) for _ in range(rng.randrange(12)))
        rows.append((None if i % 40 == 7 else i % 90, text))
    rows += [(200 + i, shared[0] * 2) for i in range(5)] + [(300, "z" * 500), (301, "z" * 400 + "y" + "z" * 30), (302, "z" * 20)]
    got = suffix_arrays.drop_repeats(made(spark, rows), 20, 9).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == plain_rows(rows, 20)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300_000))
    rows = [
        (1, None), (2, ""), (None, None), (3, "x" * 49), (4, "x" * 50), (4, "x" * 50), (5, "x" * 50), (None, "x" * 50), (6, long), (7, "ü" * 20 + long[1000:200_000]), (7, long),
        (8, "é" * 40), (9, "o" + "é" * 40), (10, "é" * 30),
    ]
    got = suffix_arrays.drop_repeats(made(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == plain_rows(rows)
    assert suffix_arrays.drop_repeats(made(spark, rows).limit(0)).collect() == []
