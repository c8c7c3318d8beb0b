"""Centroid clustering against a plain version and SQL."""

import glob
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from lanternq.llm import centroids, entries
from lanternq.llm.common import written


def plain(rows, dimensions=64, count=16, rounds=3):
    """vec_id, cluster, distance, cluster_inertia, inertia, digest by Python's whole numbers only."""
    kept = [(i, [int(x) * 64 if abs(x) >= 2.0**53 else math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    now = [v for _, v in order[:count]]

    def assign():
        for i, v in kept:
            yield min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for (_, k), (_, v) in zip(assign(), kept):
            groups.setdefault(k, []).append(v)
        now = [[sum(x) // len(x) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(now)]
    got = list(assign())
    sums = {}
    for d, k in got:
        sums[k] = sums.get(k, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, k, fits(d), fits(sums[k]), fits(sum(sums.values())), shas[k]) for (d, k), (i, _) in zip(got, kept)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_against_plain_version(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert ordered(entries.QUERIES["op13_centroid_clustering"](spark, sf_dir).collect()) == ordered(plain(rows))


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/embeddings.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entries.QUERIES["op13_centroid_clustering"](spark, sf_dir)
    found = con.execute(entries.ORACLE_SQL["op13_centroid_clustering"])
    assert [d[0] for d in found.description] == df.columns
    assert ordered(df.collect()) == ordered(found.fetchall())


def made(spark, rows, kind="double"):
    return written(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, ids int"))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01]), (1, [0.5, -0.01]), (1, [3.0, 9.0]), (None, [1.0, 1.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [0.0, -inf]), (7, []), (8, [1.0, 2.0, 3.0])]
    got = centroids.cluster(made(spark, rows), dimensions=2, centroids=3).collect()
    assert ordered(got) == ordered(plain(rows, 2, 3))
    assert len(got) == 4


def test_empty_tables(spark):
    assert centroids.cluster(made(spark, [])).collect() == []
    assert centroids.cluster(made(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("large", [2.0**25, 2.0**40, 1e300])
def test_large_components_stay_exact(spark, large):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * (large if i % 3 else 1)).tolist()) for i in range(200)]
    assert ordered(centroids.cluster(made(spark, rows), dimensions=3, centroids=4).collect()) == ordered(plain(rows, 3, 4))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    got = centroids.cluster(made(spark, rows, "float"), dimensions=2, centroids=8).collect()
    assert ordered(got) == ordered(plain(rows, 2, 8))
    assert len({r.cluster for r in got}) == 2


def test_limbs_add_up():
    for x in (0, -1, 5, -(1 << 30), 1 << 30, 3**90, -(7**200)):
        assert sum(d << centroids.LIMB * k for k, d in enumerate(centroids.limbs(x))) == x
