"""Keyed state with a time to live, over batches and a restart."""

import json
import os

import pytest

from lanternq.streaming import expiry


@pytest.fixture
def provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_entries_grow_old(spark, tmp_path, provider):
    (tmp_path / "in").mkdir()
    seen = []

    def put(n, rows):
        path = tmp_path / f"{n}.json"
        path.write_text("\n".join(json.dumps({"key": k, "value": v, "stored_at": f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"}) for k, v, s in rows))
        os.rename(path, tmp_path / "in" / f"{n}.json")

    def run():
        entries = spark.readStream.schema("key string, value string, stored_at timestamp").json(f"file://{tmp_path}/in")
        got = []
        query = expiry.expiring(entries, 60).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check")
        query = query.foreachBatch(lambda rows, _: got.extend((r.key, r.value, r.event) for r in rows.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted(got))

    put(1, [("a", "1", 0), ("b", "1", 10), ("a", "0", 0)])
    run()
    put(2, [("a", "2", 50), ("a", "old", 20), ("c", "1", 55)])
    run()
    put(3, [("d", "1", 100)])  # b (10 + 60) is past its time, a and c are not
    run()
    put(4, [("e", "1", 300)])
    run()
    assert seen[0] == [("a", "1", "stored"), ("b", "1", "stored")]
    assert seen[1] == [("a", "2", "stored"), ("c", "1", "stored")]
    assert seen[2] == [("b", "1", "expired"), ("d", "1", "stored")]
    assert seen[3] == [("a", "2", "expired"), ("c", "1", "expired"), ("d", "1", "expired"), ("e", "1", "stored")]
