"""The pipeline's stages against plain versions of each, on their own inputs."""

import re

import corpus_pipeline
from lanternq.llm import entries
from lanternq.llm.common import written

from .test_edges import ODD, QUESTION, table
from .test_similar import firsts_of, grams

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, before, SF_DIR), name)
        steps[name] = ({r.doc_id: r.text or "" for r in before.collect()}, {r.doc_id for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == columns

    given, kept = steps["toxicity"]
    predicted = {r.doc_id: r.predicted for r in entries.QUERIES["op8_toxicity"](spark, SF_DIR).collect()}
    assert kept == {d for d in given if not predicted[d]}

    given, kept = steps["exact_dedup"]
    first = {}
    for d in sorted(given):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", given[d]), d)
    assert kept == set(first.values())

    given, kept = steps["simhash_near_dedup"]
    sets = {d: grams(t) for d, t in given.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    assert pairs and kept == firsts_of(given, pairs)

    given, kept = steps["benchmark_decontamination"]
    plain = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaked = {d for d, t in given.items() if any(i in plain(t) for i in items)}
    assert leaked and not leaked & kept and len(given) - len(kept) <= len(leaked) + 2

    given, kept = steps["bpe"]
    assert kept == set(given) and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_run_on_odd_tables(spark, tmp_path):
    documents = table(spark, [*ODD, (20, QUESTION, 1), (20, QUESTION, 1), (21, "clean text of a few words", 1)])
    labels = spark.createDataFrame([(1, 1, 0), (None, None, 1), (1, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, QUESTION), (2, None), (None, "")], "item_id long, text string")
    for name, rows in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        rows.write.parquet(f"{tmp_path}/some/{name}.parquet")
        rows.filter("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 6, 9, 9, 21]
    assert all(len(r.ids) == 4 * r.n_tokens for r in got) and {r.n_tokens for r in got if r.doc_id == 3} == {0}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
