"""Results do not depend on how a scan is split, which may change between jobs."""

import pytest
from pyspark.sql import functions as F

from lanternq.llm import decontamination, exact_dedup, similar, simhash, substring_dedup
from lanternq.llm.common import written

from .test_edges import QUESTION

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, monkeypatch):
    words = lambda i: " ".join(f"w{i}x{j % (37 + i)}" for j in range(120))
    rows = [(i, words(i % 50) + (f" {QUESTION}" if i % 50 < 5 else "")) for i in range(100)]
    out = written(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(16, "doc_id"), "docs")
    turn = [0]

    def shifted(df, name):
        turn[0] += 1
        spark.conf.set(SPLITS, "64k" if turn[0] % 2 else "128m")
        result = written(df, name)
        spark.conf.set(SPLITS, "128m" if turn[0] % 2 else "64k")
        return result

    for module in (decontamination, exact_dedup, similar, simhash, substring_dedup):
        monkeypatch.setattr(module, "written", shifted)
    before = spark.conf.get(SPLITS)
    yield out
    spark.conf.set(SPLITS, before)


def test_rows_are_found_again(spark, docs):
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    for keep in (exact_dedup.keep_first, simhash.keep_one_each):
        assert ids(keep(docs)) == list(range(50))
    leaked = [i for i in range(100) if i % 50 < 5]
    assert ids(decontamination.leaks(docs, bench)) == leaked
    assert ids(decontamination.keep_unleaked(docs, bench)) == [i for i in range(100) if i not in leaked]
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(docs).filter(F.col("n_removed") > 0).collect()}
    assert set(got) == set(range(50, 100))
