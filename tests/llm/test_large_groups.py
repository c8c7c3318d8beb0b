"""Groups of near copies beyond what a task may hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternq.llm import similar, simhash
from lanternq.llm.common import written

from .test_similar import firsts, stage_keeps


def chain_texts(rng):
    """Chains, whose ends are unlike, stars, and rows near nothing."""
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(90)]
        for _ in range(14):
            texts[len(texts)] = " ".join(words)
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
    return texts


@pytest.mark.parametrize("held", [1, 4000, 20_000])
def test_blocks_lose_no_link(spark, monkeypatch, held):
    monkeypatch.setattr(similar, "HELD_BYTES", held)
    texts = chain_texts(random.Random(held))
    kept = stage_keeps(spark, texts)
    assert len(kept) == len(set(kept)) and set(kept) == firsts(texts)


def test_a_large_group_is_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "HELD_BYTES", 1 << 20)
    rng = np.random.default_rng(8)
    base = rng.integers(1, 1 << 63, 100).astype(np.uint64)
    rows = []
    for i in range(20_000):
        own = base.copy()
        own[rng.integers(0, 100, 3)] = rng.integers(1, 1 << 63, 3).astype(np.uint64)
        if i % 5000 == 0:
            own = rng.integers(1, 1 << 63, 100).astype(np.uint64)  # near nothing
        rows.append((1, i, bytearray(np.unique(own).tobytes())))
    sets = written(spark.createDataFrame(rows, "bucket long, row long, own binary").repartition(8))
    sizes = []

    def edges_of(df):
        groups = df.groupBy("bucket").agg(F.sum(F.length("own") + similar.ROW_BYTES).alias("size"), F.count("*").alias("n")).agg(F.max("size"), F.sum("n")).first()
        sizes.append(tuple(groups))
        return similar._edges(df, simhash.ALIKE)

    edges = similar._in_blocks(sets, "own", edges_of)
    assert max(size for size, _ in sizes) < 1.2 * (1 << 20)
    assert sum(n for _, n in sizes) < 6 * len(rows)
    assert edges.count() < 3 * len(rows)
    labels = simhash.components(edges)
    assert labels.count() == len(rows) - 4 and labels.select("label").distinct().count() == 1
