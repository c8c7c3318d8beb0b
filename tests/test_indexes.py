"""Keyword automata, trigram postings, spans and starts as bits against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lanternq.operators import automaton, graph, intervals, search, trigrams
from lanternq.plans import engine
from lanternq.shared import written
from lanternq.sources import corpus


def test_automaton_against_plain_search(monkeypatch):
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "aé漢😀 "])
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))})
        lines = ["".join(rng.choice(letters + "z") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(9))]
        monkeypatch.setattr(automaton, "PIECE", rng.choice([1, 3, 512]))
        line, word = automaton.Automaton(words).find(lines)
        assert list(zip(line.tolist(), word.tolist())) == [(i, j) for i, x in enumerate(lines) for j, w in enumerate(words) if w in x]


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_word_hits(spark, monkeypatch, cells):
    monkeypatch.setattr(automaton, "MOST_CELLS", cells)
    rows = [("a", 1, "Foo bar"), ("a", 2, "foofoo"), ("b", 1, ""), ("b", 2, None), ("c", 7, "x" * 3000 + "BAR" + "y" * 3000)]
    lines = spark.createDataFrame(rows, "path string, line_number int, line string")
    words = spark.createDataFrame([("foo", 1), ("bar", 2), ("", 3), (None, 4), ("foo", 5), ("oo b", 6)], "word string, rank int")
    assert sorted(map(tuple, automaton.word_hits(lines, words).collect())) == [("bar", "a", 1), ("bar", "c", 7), ("foo", "a", 1), ("foo", "a", 2), ("oo b", "a", 1)]
    assert automaton.word_hits(lines, words.limit(0)).collect() == [] == automaton.word_hits(lines.limit(0), words).collect()


def test_one_scan_for_ten_thousand_words(spark):
    words = spark.range(10_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    lines = spark.range(300).select(F.lit("p").alias("path"), F.col("id").cast("int").alias("line_number"), F.concat(F.lit("see W"), F.col("id").cast("string")).alias("line"))
    found = automaton.word_hits(lines, words)
    assert found._jdf.queryExecution().toString().count("MapInArrow") == 4 * 1  # parsed, analysed, optimised and physical plan
    assert found.count() == sum(len({str(i)[:k] for k in range(1, len(str(i)) + 1)}) for i in range(300))


def holds(tree, line):
    if tree == trigrams.ALL:
        return True
    if tree[0] == "has":
        return tree[1] in line.lower()
    return (all if tree[0] == "and" else any)(holds(x, line) for x in tree[1:])


def test_required_trigrams_are_in_every_match():
    rng, n = random.Random(5), 0
    atoms = ["a", "b", "c", "A", ".", "[ab]", "[a-c]", "[^a]", r"\.", r"\w", "(ab|c)", "(?:abc|b|ca)", "(a|)", r"\b", "x", "(?=a)", "(abc)", "abc", "bca", "cab", "ab", "é", "[]a]", "(?i)", r"[a\\]", r"[b\]c]"]
    counts = [""] * 9 + ["?", "*", "+", "{2}", "{1,2}", "{0,3}", "+?", "|"]
    for _ in range(20_000):
        pattern = "".join(rng.choice(atoms) + rng.choice(counts) for _ in range(rng.randrange(1, 6)))
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        tree = trigrams.required(pattern)
        for _ in range(6 if tree != trigrams.ALL else 0):
            line = "".join(rng.choice(["a", "b", "c", "AB", "abc", "abc", "bca", "cab", "x", "é", ".", "bb", "\\", "]"]) for _ in range(rng.randrange(9)))
            if compiled.search(line):
                n += 1
                assert holds(tree, line), (pattern, line, tree)
    assert n > 2000


@pytest.mark.parametrize("pattern, known", [
    ("foo(bar|baz)", ["arb", "bar", "baz", "foo", "oba", "oob"]), ("ab?cd", ["abc", "acd", "bcd"]), ("x{3}yz", ["xxx", "xxy", "xyz"]), ("a|bcd", []), ("(", []), (r"\Qabc\E", []), (r"\p{L}abc", ["abc"]),
])
def test_required_trigrams(pattern, known):
    assert set(trigrams.known_trigrams(trigrams.required(pattern))) == set(known) - {"arb"}


def test_indexed_search_gives_the_same_rows(spark):
    texts = {"a": "def login(user):\n  return check(user)\n", "b": "class Login:\n\tpass", "c": "nothing\nhere", "d": "", "e": "LOGIN ΟΔΟΣ k", "f": None, "g": "ab\ncd"}
    files = written(spark.createDataFrame([(p, f".{p}", t) for p, t in texts.items()], "path string, ext string, content string"))
    index = trigrams.build_index(files)
    lines = corpus.lines(files.filter("content is not null"))
    for pattern in ["login", "log(in|out)", "log|here", "a.c", "", r"def\s+\w+", "ΟΔΟΣ", "foo(", "[x", "nothing$", "^class log", "b\nc", "(?=def)def l"]:
        got = trigrams.indexed_search(files, index, pattern, None).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, search.search_text(lines, pattern, max_results=None).collect())), pattern
    some = trigrams.candidates(spark, index, "def login")
    assert [r.path for r in some.collect()] == ["a"]
    assert "PushedFilters: [In(trigram" in some._jdf.queryExecution().toString()
    assert trigrams.candidates(spark, index, "a.c") is None


def test_spans_and_points(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), f"s{i}", a, a + rng.choice([0, 1, 2, 30, 5000, 1 << 20, -3])) for i in range(120) for a in [rng.randrange(0, 6000)]] + [("a", "null", None, 4), ("a", "end", 4, None)]
    points = [(rng.choice("abc"), rng.randrange(0, 8000)) for _ in range(300)] + [("a", None), ("b", 1 << 20)]
    s = written(spark.createDataFrame(spans, "path string, name string, start_line int, end_line int"))
    p = written(spark.createDataFrame(points, "path string, line_number int"))
    inside = lambda x, y: x[0] == y[0] and None not in (x[1], y[2], y[3]) and y[2] <= x[1] <= y[3]
    got = sorted((r.path, r.line_number, r.name) for r in intervals.stabbed(p, s, "line_number").collect())
    assert got == sorted((*x, y[1]) for x in points for y in spans if inside(x, y))
    best = {(r.path, r.line_number): r.span.name for r in intervals.smallest_around(p, s, "line_number").collect()}
    assert best == {x: min((y for y in spans if inside(x, y)), key=lambda y: (y[3] - y[2], y[2], y[1]))[1] for x in points if any(inside(x, y) for y in spans)}
    assert intervals.stabbed(p, s.limit(0), "line_number").collect() == []


def test_bits_reach_what_single_starts_reach(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}", "calls", "f") for _ in range(450)], "source string, target string, type string, name string")
    starts = spark.createDataFrame([(f"n{i % 350}",) for i in range(500)] + [("none",)], "id string")
    for most in (1, 3, 6):
        got = graph.related_by_bits(edges, starts, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.related_nodes(edges, starts, most).collect()))
    assert graph.related_by_bits(edges, starts.limit(0), 2).collect() == []


def test_bad_patterns_find_nothing(spark):
    lines = spark.createDataFrame([("a.py", 1, "call foo( here"), ("a.py", 2, "other")], "path string, line_number int, line string")
    assert search.search_text(lines, "foo(").collect() == []
    assert [r.line_number for r in search.search_text(lines, "foo(", regex=False).collect()] == [1]
    assert [r.pattern for r in search.search_patterns(lines, ["foo(", "other", "[a"]).collect()] == ["other"]
    assert [(r.line_number, r.hits) for r in search.initial_search(lines, ["foo(", "other"]).collect()] == [(2, 1)]
    files = spark.createDataFrame([("/a.py", ".py", "def foo(x):\n    return x\n")], "path string, ext string, content string")
    assert "return x" in engine.ask(files, 'What does "foo(" return?').first().prompt


def test_projects_in_one_cache(spark, tmp_path):
    from lanternq.plans.cache import Cache

    held = Cache(spark, f"file://{tmp_path}/cache")
    made = lambda name: written(spark.createDataFrame([(f"/{name}.py", ".py", f"def {name}():\n    pass\n")], "path string, ext string, content string"))
    names = lambda files, project: {r.name for r in engine.code_map(files, held, project=project)[0].filter("type = 'function'").collect()}
    assert names(made("one"), "p1") == {"one"} and names(made("two"), "p2") == {"two"}
    assert names(made("three"), "p1") == {"one"}  # young enough to be taken unseen


def test_replacement_signs_stay(spark):
    raw = "ä�b".encode() + b"\xff" + "é�".encode() + b"\xc3"
    got = spark.createDataFrame([(bytearray(raw),)], "b binary").select(corpus.tolerant(F.col("b").cast("string")).alias("t")).first().t
    assert got == "ä�bé�"


def test_index_of_a_long_line(spark, monkeypatch):
    """Trigrams are cut in one pass: by a substring from the line's start for each, this took minutes."""
    rng = random.Random(7)
    texts = {"long": "".join(rng.choice("abcdefgh é\t") for _ in range(1_000_000)) + "zqX y\nzq", "short": "zq\r\nxa", "none": None, "two": "z"}
    files = written(spark.createDataFrame(list(texts.items()), "path string, content string"))
    start = time.monotonic()
    index = trigrams.build_index(files)
    assert [r.path for r in trigrams.candidates(spark, index, "zqx").collect()] == ["long"]
    assert time.monotonic() - start < 60
    kept = {x[i : i + 3] for t in texts.values() for x in re.split("\r?\n", (t or "").lower()) for i in range(len(x) - 2)}
    assert {r.trigram for r in spark.table(index).select("trigram").collect()} == {x for x in kept if "é" not in x}
    text, whole = b"\xc3\xa9 ABC" * 40, trigrams.codes(b"\xc3\xa9 abc" * 40)
    monkeypatch.setattr(trigrams, "PIECE", 5)
    assert trigrams.codes(text).tolist() == whole.tolist() and len(whole) == 2
    assert not len(trigrams.codes(b"ab")) and not len(trigrams.codes(b""))


def test_starts_with_the_same_neighbour_share_words(spark, monkeypatch):
    """Of 640 starts around 10 hubs, every node is reached by 64, which are few words."""
    rows = [(f"s{i}", f"hub{i % 10}", "calls", "f") for i in range(640)]
    edges = spark.createDataFrame(rows, "source string, target string, type string, name string").repartition(7)
    words, kept = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, *a: (lambda x: ("word" in x.columns and words.append(x)) or x)(kept(df, *a)))
    got = graph.related_by_bits(edges, edges.select(F.col("source").alias("id")), 2)
    assert got.count() == 640 + 640 * 63
    assert max(x.groupBy("node").count().agg(F.max("count")).first()[0] for x in words) <= 4


def test_nodes_of_files_are_those_of_the_graph(spark, sf_dir):
    from lanternq.catalogue import graph_queries

    code = graph_queries._code(spark, sf_dir)
    paths = ["src/s_1.py", "src/main/java/app/P3.java", "web/p2.js", "none.py"]
    got = graph.nodes_of_files(code.filter(F.col("path").isin(paths)))
    wanted = graph_queries._graph(spark, sf_dir)[0].filter(F.col("path").isin(paths))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
