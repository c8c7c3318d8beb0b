"""Hand-made cases for what the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from lanternq.config import Config
from lanternq.functions import scores, text
from lanternq.operators import graph, pack, search, structure
from lanternq.plans import cache, engine, progress, prompt
from lanternq.sources import corpus
from lanternq.streaming import live


def one(spark, column, value="x"):
    return spark.range(1).select(F.lit(value).alias("v")).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "question,wanted",
    [
        ("", []), ("what is the", []), ("a 'b c' d", ["b c"]), ("the user's cat and it's mat", ["user", "cat", "mat", "s cat and it"]),
        ("one two three four five six_7 one", ["one", "two", "three", "four", "five", "six_7"]), ("étude 3rd", ["tude"]), ('find "a.*b"', ["find", "a.*b"]),
    ],
)
def test_keywords(spark, question, wanted):
    assert one(spark, text.keywords(F.col("v")), question) == wanted
    assert engine.question_keywords(question) == wanted


def test_features_agree_on_driver_and_in_columns(spark):
    question = "Which class handles the 'login' request in my_module of the user's API?"
    got = one(spark, text.query_features(F.col("v")), question)
    own = scores.Features.of(question)
    assert (got.tokens, got.technical_tokens, got.identifiers, got.quoted) == (own.tokens, own.technical_tokens, own.identifiers, own.quoted)


@pytest.mark.parametrize("content,count", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\r\nb\rc\n", 3), ("\n", 1)])
def test_lines(spark, content, count):
    files = spark.createDataFrame([("p", content)], "path string, content string")
    assert corpus.lines(files).count() == count


def lines_of(spark, *rows):
    return spark.createDataFrame([("a.py", i, line) for i, line in enumerate(rows, 1)], "path string, line_number int, line string")


def test_search_options(spark):
    rows = lines_of(spark, "  Übung on and On ", "upon", "a.b", "axb", "")
    found = lambda *a, **k: [r.line_number for r in search.search_text(rows, *a, **k).orderBy("line_number").collect()]
    assert found("on") == [1, 2] and found("On", case_sensitive=True) == [1] and found("on", whole_word=True) == [1]
    assert found("a.b") == [3, 4] and found("a.b", regex=False) == [3] and found("o", max_results=1) == [1]
    assert found("on", file_types=["js"]) == []
    hit = search.search_text(rows, "on").orderBy("line_number").first()
    assert (hit.line, hit.column, hit.match_count) == ("Übung on and On", 9, 2)
    assert search.search_patterns(rows, []).count() == 0


def test_decoders(spark):
    raw = spark.createDataFrame([("a/b.py:12: x = 1 ",), ("no match",), ("c:d",)], "raw string")
    assert [tuple(r) for r in search.decode_grep(raw).collect()] == [("a/b.py", 12, "x = 1")]
    log = ['{"type":"match","data":{"path":{"text":"src/a.py"},"line_number":3,"lines":{"text":" hit \\n"},"submatches":[{"start":1,"end":4}]}}', '{"type":"end"}', "junk"]
    got = search.decode_rg_json(spark.createDataFrame([(x,) for x in log], "raw string")).collect()
    assert [(r.path, r.line_number, r.line, r.column, r.match_count, round(r.score, 2)) for r in got] == [("src/a.py", 3, "hit", 1, 1, 1.32)]


def test_merged_ranges(spark):
    ranges = spark.createDataFrame([("p", 1, 3), ("p", 4, 6), ("p", 8, 9), ("p", 2, 2), ("q", 5, 5)], "path string, start_line int, end_line int")
    assert sorted(map(tuple, pack.merged_ranges(ranges).collect())) == [("p", 1, 6), ("p", 8, 9), ("q", 5, 5)]


def test_packing_skips_what_does_not_fit(spark):
    items = [("big", 1, 0, 500, 400), ("small", 2, 0, 60, 10), ("part", 3, 0, 90, 20), ("low", 4, 2, 15, 0), ("last", 5, 2, 1, 0)]
    df = spark.createDataFrame(items, "path string, rank int, tier int, full_size int, partial_size int")
    kept = lambda budget: [(r.path, r.is_partial, r.size) for r in pack.packed(df, budget).orderBy("rank").collect()]
    assert kept(100) == [("small", False, 60), ("part", True, 20), ("low", False, 15)]
    assert kept(5) == [("low", True, 0), ("last", False, 1)]


PY = '''"""module"""
import os, a.b
from ..x import y

class A:
    """of A"""
    def outer(self):
        def inner():
            return g().f(self.h())
        return inner()
'''
JAVA = """package p; // {
/** Doc of C { */
@Ann("{")
public class C implements I {
    C() { run(); }
    abstract void no();
    static <T> int two(int a,
            int b) throws E {
        if (a > b) { return '}'; }
        return 1;
    }
    interface J { void m(); }
}
"""


def test_structure(spark):
    rows = [r[:4] for r in structure.python_rows(PY)]
    assert {("class", "A", 5, 10), ("function", "outer", 7, 10), ("function", "inner", 8, 9), ("module_docstring", "", 1, 1), ("class_docstring", "A", 6, 6)} <= set(rows)
    assert {r[1] for r in rows if r[0] == "import"} == {"os", "a.b", "..x"} and {r[1] for r in rows if r[0] == "call"} == {"f", "self.h", "inner", "g"}
    assert [r[:2] for r in structure.python_rows("def ok(:\nclass B\n")] == [("function", "ok"), ("class", "B")]
    java = [r[:4] for r in structure.java_rows(JAVA)]
    assert set(java) == {("javadoc", "", 2, 2), ("class", "C", 3, 13), ("constructor", "C", 5, 5), ("function", "two", 7, 11), ("class", "J", 12, 12)}
    files = spark.createDataFrame([("a.py", ".py", PY), ("C.java", ".java", JAVA), ("n.py", ".py", None)], "path string, ext string, content string")
    parsed = structure.structure(files)
    assert structure.node_at(parsed, "a.py", 9).first().name == "inner"
    assert structure.matching_nodes(files, "Call").count() == 4
    assert [n[3] for n in structure.tree_rows("x = 1")] == ["Module", "Assign", "Name", "Store", "Constant"]


def test_import_candidates(spark):
    rows = [("p/q/a.py", ".py", ".m"), ("p/q/a.py", ".py", "..m.n"), ("a.py", ".py", "os"), ("w/a.js", ".js", "../x"), ("A.java", ".java", "org.p.C.member"), ("p/q/a.py", ".py", "z")]
    files = ["p/q/m.py", "p/m/n/__init__.py", "x/index.ts", "src/org/p/C.java", "src/z.py", "z/__init__.py"]
    imports = spark.createDataFrame(rows, "path string, ext string, name string")
    got = structure.resolved_imports(imports, spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert {(r.name, r.target) for r in got} == {
        (".m", "file:p/q/m.py"), ("..m.n", "file:p/m/n/__init__.py"), ("os", "import:os"), ("../x", "file:x/index.ts"), ("org.p.C.member", "file:src/org/p/C.java"), ("z", "file:z/__init__.py"),
    }


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("x", "y", "contains")], "source string, target string, type string")
    edges = edges.withColumn("edge_id", F.monotonically_increasing_id())
    nodes = spark.createDataFrame([(i,) for i in "abcxyz"], "id string")
    start = nodes.filter("id = 'a'")
    assert sorted((r.node, r.distance) for r in graph.related_nodes(edges, start, 2).collect()) == [("b", 1), ("c", 1)]
    assert sorted("".join(r.chain) for r in graph.call_chains(edges, start, 4).collect()) == ["ab", "abc", "abca", "abcab"]
    pairs = spark.createDataFrame([("a", "c"), ("a", "y"), ("q", "a"), ("a", "a")], "source string, target string")
    assert sorted(("".join(r.path)) for r in graph.shortest_paths(edges, pairs).collect()) == ["a", "abc"]
    assert sorted(map(tuple, graph.connected_components(edges, nodes).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    kinds = graph.relationship_types(spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "a"), ("a", "none")], "source string, target string"), edges, nodes)
    assert {r.relationship for r in kinds.collect()} == {"calls", "reverse_calls", "indirect", "unknown"}
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")], "source string, target string")
    central = {r.id: r.centrality for r in graph.betweenness(path, spark.createDataFrame([(i,) for i in "abcde"], "id string")).collect()}
    assert {k: round(v * 12, 6) for k, v in central.items()} == {"a": 0, "b": 1, "c": 3, "d": 1, "e": 0}


def test_trees_and_prompts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/login.py").write_text("from util import check\n\ndef login(user):\n    return check(user)\n")
    (tmp_path / "src/util.py").write_text("def check(x):\n    return x\n")
    (tmp_path / "node_modules/login.py").write_text("login")
    (tmp_path / "src/bad.txt").write_bytes(b"\xff\xfe login")
    files = corpus.read_tree(spark, str(tmp_path))
    assert {r.path: r.error for r in files.collect()} == {"/src/login.py": None, "/src/util.py": None, "/src/bad.txt": "not UTF-8"}
    good = files.filter("content is not null").withColumn("path", F.regexp_replace("path", "^/", ""))
    packed = {r.path: r for r in engine.context(good, "How does login work?").collect()}
    assert packed["src/login.py"].n_matches == 1 and "   3 >>> def login(user):" in packed["src/login.py"].content
    assert packed["src/util.py"].n_matches == 0
    answer = prompt.answers(engine.ask(good, "How does login work?")).first().answer
    assert "def login(user):" in answer
    aware = engine.context(good, "Who calls login?", semantic_hits=engine.semantic_hits(engine.code_map(good)[0], "Who may check and login?"))
    assert {r.path: r.n_matches for r in aware.collect()} == {"src/login.py": 1, "src/util.py": 1}
    assert prompt.answers(engine.ask(good, "what is the")).first().answer == "Nothing was found."


def test_cache(spark, tmp_path):
    now = [1000.0]
    held = cache.Cache(spark, str(tmp_path), 60, lambda: now[0])
    key = cache.key_of("search", query="q", patterns=["b", "a"])
    assert key == cache.key_of("search", patterns=["a", "b"], query="q") and held.get(key) is None
    held.put(key, spark.range(3), "search")
    assert held.get(key).count() == 3 and held.stats() == {"hits": 1, "misses": 1, "hit_rate": 50.0, "entries": 1}
    now[0] += 61
    assert held.get(key) is None and held.cleanup() == 1 and held.stats()["entries"] == 0


def test_config():
    got = Config.from_env({"LANTERNQ_MAX_CONTEXT_SIZE": "5", "SEMANTIC_ANALYSIS": "true", "OTHER": "x"})
    assert got.max_context_size == 5 and got.semantic_analysis and Config().with_(max_context_size=0).max_context_size == 900_000
    with pytest.raises(ValueError):
        Config().with_(context_buffer=2.0)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("one\ntwo hits\n")
    run = lambda: live.write_matches(live.watch_tree(spark, str(tmp_path / "in")), "TWO", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    run()
    (tmp_path / "in/b.py").write_text("two more\n")
    run()
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["two hits", "two more"]


def test_history_and_parts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    more = prompt.appended(turns, spark.createDataFrame([(1, "q", "a")], "conv_id long, question string, answer string"))
    assert prompt.history(more).orderBy("turn").collect()[-1].history == "user: hi\nassistant: yes\nuser: q"
    parts = spark.createDataFrame([(1, 0, True, "t"), (1, 1, False, "x"), (1, 2, False, "y")], "qid int, pos int, is_thought boolean, text string")
    assert tuple(prompt.split_parts(parts).first()) == (1, "t", "xy")


def test_fuzzy_search(spark):
    rows = lines_of(spark, "the handler", "a handlr here", "hand")
    assert [r.line_number for r in search.search_fuzzy(rows, "Handler").orderBy("line_number").collect()] == [1, 2]


def test_step_log(spark):
    now = iter(range(100))
    log = progress.StepLog(lambda: float(next(now)))
    log.start("search")
    log.complete("search", found=3)
    log.start("parse")
    log.fail("parse", "broken")
    assert log.timing() == {"search": 1.0, "parse": 1.0, "total": 2.0} and log.steps["parse"].status == "failed"
    df, seen = progress.observed(spark.range(5), "rows")
    df.collect()
    assert seen.get == {"rows": 5}


def test_equal_regions_have_an_order(spark):
    """Whichever comes first, the reason of equal regions is the same."""
    rows = [("a", 1, 2, 0, "line 1"), ("a", 1, 2, 0, "line 2")]
    made = lambda some: spark.createDataFrame(some, "path string, start_line int, end_line int, priority int, reason string").coalesce(1)
    assert [[tuple(r) for r in pack.merged_regions(made(some)).collect()] for some in (rows, rows[::-1])] == [[("a", 1, 2, 0, "line 2")]] * 2
