"""Caches, sessions, batches, settings, and cases without bounds."""

import pytest
from pyspark.sql import functions as F

from lanternq import cli, shared
from lanternq.config import Config, ConfigManager, ModelSettings
from lanternq.operators import graph, pack, rank, search, structure
from lanternq.plans import batch, cache, engine, progress, prompt
from lanternq.sources import corpus

FILES = [
    ("src/login.py", ".py", "from util import check\n\ndef login(user):\n    return check(user)\n"),
    ("src/util.py", ".py", "def check(x):\n    return x\n"),
    ("docs/notes.md", ".md", "How a login works.\nSomething else.\n"),
    ("web/app.js", ".js", "import x from './lib';\nfunction check(a) { return a; }\n"),
    ("web/lib.js", ".js", "export default 1;\n"),
]
FIELDS = "path string, ext string, content string"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, FIELDS)


def test_a_batch_gives_what_single_questions_give(spark, files):
    asked = [(1, "How does login work?"), (2, "Who uses check in 'return a'?"), (3, "what is the"), (4, "nothing_like_it")]
    questions = spark.createDataFrame(asked, "qid int, question string")
    got = {}
    for r in batch.batch_context(files, questions, Config(max_context_size=2000)).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.path, r.n_matches, r.is_partial, r.content))
    prompts = {r.qid: r.prompt for r in batch.ask_all(files, questions, Config(max_context_size=2000)).collect()}
    for qid, question in asked:
        single = [(r["rank"], r.path, r.n_matches, r.is_partial, r.content) for r in engine.context(files, question, Config(max_context_size=2000)).collect()]
        assert sorted(got.get(qid, [])) == sorted(single)
        assert prompts[qid].startswith(f"Question: {question}") and (not single or single[0][4] in prompts[qid])


def test_caches_follow_the_state_of_the_files(spark, files, tmp_path):
    now = [1000.0]
    held = cache.Cache(spark, f"file://{tmp_path}/cache", 10_000, lambda: now[0])
    first = engine.context(files, "How does login work?", cache=held).count()
    hits = held.hits
    assert engine.context(files, "How does login work?", cache=held).count() == first and held.hits == hits + 1
    more = files.unionByName(spark.createDataFrame([("src/new.py", ".py", "login = 1\n")], FIELDS))
    assert engine.context(more, "How does login work?", cache=held).count() == first + 1
    nodes, _ = engine.code_map(files, held)
    assert engine.code_map(more, held)[0].count() == nodes.count()  # within the grace time
    now[0] += engine.MAP_GRACE_SECONDS + 1
    assert engine.code_map(more, held)[0].count() == nodes.count() + 1
    now[0] += engine.MAP_GRACE_SECONDS + 1
    assert engine.code_map(files, held)[0].count() == nodes.count() and held.clear("context") == 2
    assert held.clear() > 0 and held.stats()["entries"] == 0


def test_steps_are_logged(files):
    log = progress.StepLog()
    engine.context(files, "How does login work?", log=log)
    assert [s.status for s in log.steps.values()] == ["completed"] * 5 and "search" in log.summary()
    with pytest.raises(ValueError), log.step("broken"):
        raise ValueError("no")
    assert log.steps["broken"].status == "failed"
    log.reset()
    assert not log.steps


def test_settings_change_searches(files):
    found = lambda **k: {(r.path, r.line_number) for r in engine.keyword_hits(files, ["LOGIN"], Config(**k)).collect()}
    assert found() == {("src/login.py", 3), ("docs/notes.md", 1)} and found(case_sensitive=True) == set()
    near = lambda **k: {r.path for r in engine.keyword_hits(files, ["logim"], Config(**k)).collect()}
    assert near() == set() and near(fuzzy_search=True) == {"src/login.py", "docs/notes.md"}
    assert engine.keyword_hits(files, ["^def"], Config()).count() == 2


def test_streams_thoughts_and_sessions(spark):
    def stream(question, text):
        yield "hm", True
        yield f"{question}!", False
        yield str(len(text)), False

    prompts = spark.createDataFrame([("q", "p" * 40), ("r", "")], "question string, prompt string")
    assert [tuple(r) for r in prompt.answer_chunks(prompts.filter("question = 'q'"), stream).orderBy("chunk_no").collect()] == [("q", 0, "hm", True), ("q", 1, "q!", False), ("q", 2, "40", False)]
    got = {r.question: tuple(r)[1:] for r in prompt.answers_with_thoughts(prompts, stream).collect()}
    assert got == {"q": ("q!40", "hm", 10, 1, 1), "r": ("r!0", "hm", 0, 1, 1)}
    seen = []
    session = prompt.ChatSession(lambda q: seen.append(q) or f"context of {q}", stream)
    assert session.ask("one") == "one!14" and list(session.ask_stream("two")) == ["two!", "43"]
    assert seen == ["one", "two"] and session.history()[-2:] == [{"role": "user", "content": "two"}, {"role": "assistant", "content": "two!43"}]
    assert "".join(t for t, _ in prompt.in_pieces(lambda q, p: "abcdef", 4)("", "")) == "abcdef"


def test_settings_files(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# note\nexport LANTERNQ_MAX_SEARCH_RESULTS='7'\nFUZZY_SEARCH=yes\nbroken\n")
    manager = ConfigManager(str(path), {"LANTERNQ_CHARS_PER_TOKEN": "3"})
    assert (manager.config.max_search_results, manager.config.fuzzy_search, manager.config.chars_per_token) == (7, True, 3)
    path.write_text(manager.update(max_related_files=2).sample())
    assert ConfigManager(str(path), {}).config == manager.config and manager.reload().max_related_files == 2
    assert ModelSettings.of(api_key="a", env={"LANTERNQ_API_KEY": "b"}).api_key == "a"
    assert ModelSettings.of(env={"LANTERNQ_API_KEY": "b", "API_KEY": "c"}).api_key == "b" and ModelSettings.of(env={"API_KEY": "c"}).api_key == "c"


def test_command_line(tmp_path, capsys, monkeypatch):
    args = cli.parser().parse_args(["-p", "x", "-m", "m", "-k", "key", "-i", "-s", "-d", "-c", "9", "--no-show-progress", "why"])
    assert (args.path, args.model, args.api_key, args.interactive, args.stream, args.debug, args.max_context, args.show_progress, args.question) == ("x", "m", "key", True, True, True, 9, False, "why")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--config", "-k", "secret"]) == 0 and cli.main(["--sample-config"]) == 0
    out = capsys.readouterr().out
    assert "api_key: set" in out and "secret" not in out and "LANTERNQ_MAX_CONTEXT_SIZE=900000" in out


def test_command_line_answers(spark, tmp_path, capsys, monkeypatch):
    for path, _, content in FILES:
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(content)
    (tmp_path / "src/bad.py").write_bytes(b"login \xff = 1\n")
    monkeypatch.setattr("pyspark.sql.SparkSession.builder", type("B", (), {"appName": lambda self, n: self, "getOrCreate": lambda self: spark})())
    monkeypatch.setattr("sys.stdin", iter(["How is login done?\n", "\n", "quit\n", "never\n"]))
    assert cli.main(["-p", str(tmp_path), "-i", "-s", "-d", "--env-file", "none", "How does login work?"]) == 0
    assert capsys.readouterr().out.count("|/src/login.py") == 2


def test_tolerant_reads(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("ä\xff".encode("latin-1") + "é\r\nb".encode())
    read = lambda **k: corpus.read_tree(spark, str(tmp_path), **k).first()
    assert read().content is None and read().error == "not UTF-8"
    assert read(strict=False).content == "é\nb" and read(strict=False).error is None
    assert corpus.ignore_union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_paths_of_any_length(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "calls", "f") for i in range(30)], "source string, target string, type string, name string")
    pairs = spark.createDataFrame([("n00", "n26"), ("n05", "n00"), ("n03", "n03")], "source string, target string")
    assert {(r.source, r.target): len(r.path) for r in graph.shortest_paths(edges, pairs).collect()} == {("n00", "n26"): 27, ("n03", "n03"): 1}
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(31)], "id string")
    whole = {r.id: round(r.centrality, 9) for r in graph.betweenness(edges, nodes).collect()}
    assert whole == {r.id: round(r.centrality, 9) for r in graph.betweenness(edges, nodes, sources=10).collect()}
    assert whole["n15"] == round(15 * 15 / 30 / 29, 9)


def test_the_last_row_of_an_id_counts(spark):
    row = "id string, type string, name string, path string, start_line int, end_line int, code string"
    a = spark.createDataFrame([("x", "file", "a", "p", None, None, None), ("y", "file", "b", "p", None, None, None)], row)
    b = spark.createDataFrame([("x", "function", "c", "p", 1, 2, "one"), ("x", "function", "c", "p", 5, 6, "two")], row)
    assert {r.id: (r.type, r.code) for r in graph.upserted([a, b]).collect()} == {"x": ("function", "two"), "y": ("file", None)}


def test_java_syntax(spark):
    text = "/** A. */\nclass A {\n  A() { go(); }\n  int f(int x) {\n    return x;\n  }\n}\n"
    files = spark.createDataFrame([("A.java", ".java", text), ("B.java", ".java", "class B { void f() { }")], FIELDS)
    tree = {(r.path, r.type, r.name): r for r in structure.syntax_tree(files).collect()}
    assert {(k[1], k[2], r.depth, r.start_line, r.end_line) for k, r in tree.items() if k[0] == "A.java"} == {
        ("block_comment", None, 1, 1, 1), ("class_declaration", "A", 1, 2, 7), ("constructor_declaration", "A", 2, 3, 3), ("method_declaration", "f", 2, 4, 6),
    }
    assert tree["A.java", "method_declaration", "f"].parent == tree["A.java", "class_declaration", "A"].node
    assert {r.path: r.parse_error for r in structure.functions_with_errors(structure.structure(files)).collect()} == {"A.java": False, "B.java": True}
    assert structure.structure(files, ("python",)).count() == 0


def test_ranks_over_ranges(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("path"), (F.col("id") % 7).alias("w")).repartition(9)
    got = [(r.w, r.path) for r in pack.ranked(rows, (F.desc("w"), "path")).orderBy("rank").collect()]
    assert got == sorted(((i % 7, str(i)) for i in range(500)), key=lambda x: (-x[0], x[1]))


def test_projects(spark):
    rows = [("a", "setup.py"), ("a", "pom.xml"), ("a", "tests/x.py"), ("b", "x/y.ts"), ("b", "z.java"), ("c", "notes"), ("d", "sub/setup.py")]
    table = spark.createDataFrame(rows, "project string, path string")
    assert sorted(map(tuple, rank.project_types(table, sample=100).collect())) == [
        ("a", "Python", "Python", True), ("b", "JavaScript", "JavaScript", False), ("c", "Unknown", "Mixed", False), ("d", "Python", "Python", False),
    ]
    assert {r.project: r.type for r in rank.project_metadata(table).collect()} == {"a": "python", "b": "unknown", "c": "unknown", "d": "unknown"}


def test_types_and_tables(spark, files):
    assert [search.ending_of_type(t) for t in ("python", "Rust", "md", ".x")] == [".py", ".rs", ".md", ".x"]
    assert search.search_text(corpus.lines(files), "check", ["python"]).select("path").distinct().count() == 2
    table = shared.written(files, "t")
    shared.drop_scratch(table)
    with pytest.raises(Exception):
        table.count()
