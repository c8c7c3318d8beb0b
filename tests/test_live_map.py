"""The incremental code map against maps built from all files."""

import random

import pytest

from lanternq.plans import engine
from lanternq.plans.live_map import LiveMap
from lanternq.shared import written

START = {
    "/src/a.py": "from b import g\n\ndef find(x):\n    return g(x)\n", "/src/b.py": "def g(x):\n    return h(x)\n\ndef h(x):\n    return x\n",
    "/src/c.py": "import a\nimport gone\n\nclass C:\n    def m(self):\n        return find(self)\n", "/web/p.js": "import x from './q';\nfunction show(a) {\n  return find(a);\n}\n",
    "/src/main/java/app/P.java": "package app;\nimport app.Q;\npublic class P {\n    public int price(int q) {\n        return find(q);\n    }\n}\n",
}


def corpus(spark, texts):
    return written(spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], t) for p, t in texts.items()], "path string, ext string, content string"))


def shape(nodes, edges):
    return (
        sorted((r.id, r.type, r.name or "", r.path or "", r.start_line or 0, r.end_line or 0, r.code or "") for r in nodes.collect()),
        sorted((r.source, r.target, r.type, r.name) for r in edges.collect()),
    )


def test_updates_equal_rebuilds(spark, tmp_path):
    held = LiveMap(spark, f"file://{tmp_path}/map")
    texts = dict(START)
    assert held.update(corpus(spark, texts))["parsed"] == 5
    assert shape(*held.graph()) == shape(*engine.code_map(corpus(spark, texts)))
    assert held.update(corpus(spark, texts)) == {"files": 0, "parsed": 0, "imports": 0, "calls": 0}

    texts["/src/b.py"] = texts["/src/b.py"].replace("def h", "def k")  # the call of h leads nowhere now
    told = held.update(corpus(spark, texts))
    assert told["files"] == told["parsed"] == 1 and told["imports"] == 0
    assert shape(*held.graph()) == shape(*engine.code_map(corpus(spark, texts)))

    texts["/src/gone.py"] = "def find(x):\n    return x\n"  # an import of another file leads somewhere now, and find is two functions
    told = held.update(corpus(spark, texts))
    assert told["parsed"] == 1 and told["imports"] == 1 and told["calls"] == 3
    assert shape(*held.graph()) == shape(*engine.code_map(corpus(spark, texts)))

    del texts["/src/a.py"]
    told = held.update(corpus(spark, texts))
    assert told["files"] == 1 and told["parsed"] == 0
    assert shape(*held.graph()) == shape(*engine.code_map(corpus(spark, texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_changes(spark, tmp_path, seed):
    rng = random.Random(seed)
    held, texts = LiveMap(spark, f"file://{tmp_path}/map"), {}
    for _ in range(4):
        new = {f"/src/m{rng.randrange(8)}.py": f"import m{rng.randrange(8)}\n\ndef f{rng.randrange(5)}(x):\n    return f{rng.randrange(5)}(x)\n" for _ in range(3)}
        out = [p for p in texts if p not in new and rng.random() < 0.3]
        held.upsert(corpus(spark, new), spark.createDataFrame([(p,) for p in out], "path string"))
        texts = {p: t for p, t in (texts | new).items() if p not in out}
    assert shape(*held.graph()) == shape(*engine.code_map(corpus(spark, texts)))


def test_a_stream_keeps_the_map(spark, tmp_path):
    (tmp_path / "in").mkdir()
    held = LiveMap(spark, f"file://{tmp_path}/map")
    corpus(spark, START).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("path string, ext string, content string").json(f"file://{tmp_path}/in")
    query = stream.writeStream.foreachBatch(lambda rows, _: held.upsert(rows) and None).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert shape(*held.graph()) == shape(*engine.code_map(corpus(spark, START)))
