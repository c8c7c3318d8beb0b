"""Whole syntax trees and tree patterns."""

import itertools
import random

import pytest

from lanternq.operators import patterns, structure, syntax_nodes
from lanternq.shared import written

JAVA = '''package app;
import java.util.List;
/** Doc. */
@Ann(x = 1) public class P<T> extends Q {
    private final int a = f(1);
    public P(int q) { reset(); }
    static { go("x"); }
    public <T> List<T> price(int q, Map<String, T> m) throws E {
        if (x > 1) { return P.price(q, g(2)); } else { y(); }
        int k = new Foo(3).bar();
    }
    int ### broken = ;
    void after() { ok(); }
}
interface I { void m(); }
'''


def outline(root, wanted):
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.type in wanted:
            out.append((node.type, next((JAVA[c.start : c.end] for c in node.children if c.field == "name"), None)))
        todo += reversed(node.children)
    return out


def test_java_trees():
    root = syntax_nodes.tree_of(".java", JAVA)
    found = outline(root, {"class_declaration", "method_declaration", "constructor_declaration", "field_declaration", "interface_declaration", "ERROR", "method_invocation", "block_comment"})
    assert found == [
        ("block_comment", None), ("class_declaration", "P"), ("field_declaration", None), ("method_invocation", "f"), ("constructor_declaration", "P"), ("method_invocation", "reset"),
        ("method_invocation", "go"), ("method_declaration", "price"), ("method_invocation", "price"), ("method_invocation", "g"), ("method_invocation", "y"),
        ("method_invocation", "bar"), ("ERROR", None), ("method_declaration", "after"), ("method_invocation", "ok"), ("interface_declaration", "I"), ("method_declaration", "m"),
    ]


def test_java_files_never_fail():
    rng = random.Random(7)
    pieces = ["class", "A", "{", "}", "(", ")", ";", "=", "void", "public", "@", "interface", "f", ",", "<", ">", "\n", '"', "'", "/*", "*/", "//", "import", "new", "if", "[", "]", "#", "static", "1", "."]
    for _ in range(3000):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        root = syntax_nodes.tree_of(".java", text)
        rows = list(syntax_nodes.rows_of(root, text))
        assert [r[0] for r in rows] == list(range(len(rows)))
        todo = [root]
        while todo:
            node = todo.pop()
            assert 0 <= node.start <= node.end <= len(text)
            todo += node.children
    for cut in range(0, len(JAVA), 7):  # whatever is cut off, the beginning stays
        kept = outline(syntax_nodes.tree_of(".java", JAVA[:cut]), {"class_declaration"})
        assert not JAVA[:cut].count("class P<") or kept[0] == ("class_declaration", "P")
    spoiled = JAVA[:200] + " }}} void ( { " + JAVA[200:]
    assert "after" in [text for _, _, field, kind, text, *_ in syntax_nodes.rows_of(syntax_nodes.tree_of(".java", spoiled), spoiled) if field == "name"]


PYTHON = '''# top
# more
"""doc"""
import os

@dec
def f(x, y=1):
    """d"""
    # note
    return g(x).h

class C(B):
    """c"""
    def m(self):
        pass
    def é(self): return 1; return 2
'''


@pytest.fixture(scope="module")
def tree(spark):
    files = [("a.py", ".py", PYTHON), ("b.py", ".py", "x = 1\n"), ("bad.py", ".py", "def ("), ("c.java", ".java", JAVA), ("d.md", ".md", "text"), ("e.py", ".py", None)]
    return written(syntax_nodes.syntax_nodes(spark.createDataFrame(files, "path string, ext string, content string")), "nodes")


def found(tree, query, *columns):
    return sorted(tuple(r[c] for c in columns or ("capture", "text")) for r in patterns.captures(tree, query).collect())


@pytest.mark.parametrize("query, wanted", [
    ("(module . (comment)* . (expression_statement (string)) @d)", [("d", '"""doc"""')]),
    ("(function_definition body: (block . (expression_statement (string)) @d))", [("d", '"""d"""')]),
    ("(class_definition name: (identifier) @n superclasses: (argument_list (identifier) @b))", [("b", "B"), ("n", "C")]),
    ("(function_definition name: (identifier) @n !decorator)", [("n", "m"), ("n", "é")]),
    ("(function_definition body: (block (_) @last .)) ; the last statement", [("last", "pass"), ("last", "return 2"), ("last", "return g(x).h")]),
    ("(block . (return_statement) @a . (return_statement) @b .)", [("a", "return 1"), ("b", "return 2")]),
    ("(function_definition body: (block (return_statement)+ @r .))", [("r", "return 1"), ("r", "return 2"), ("r", "return g(x).h")]),
    ("[(pass_statement) (call function: (identifier) @f)] @x", [("f", "g"), ("x", "g(x)"), ("x", "pass")]),
    ('((identifier) @i (#match? @i "^[a-z]$") (#eq? @i "x"))', [("i", "x"), ("i", "x"), ("i", "x"), ("i", "x")]),
    ("(method_declaration name: (identifier) @n body: (block)?)", [("n", "after"), ("n", "m"), ("n", "price")]),
    ("(module", []), ("(a (b)", []), ("((a) (b))", []), ("", []),
])
def test_patterns(tree, query, wanted):
    if "#match" in query:
        assert {t for _, t in found(tree, query)} == {"x"}
    else:
        assert found(tree, query) == wanted


def test_a_group_keeps_its_tests(tree):
    grouped = patterns.parse('((call function: (identifier) @f) @c (#eq? @f "g") (#match? @c "x"))')
    assert [(p.type, p.tests, p.items[0].pattern.tests) for p in grouped] == [("call", [("#match?", "x")], [("#eq?", "g")])]
    assert found(tree, '(call function: ((identifier) @f (#eq? @f "g"))) ((pass_statement) @p (#eq? @p "other"))') == [("f", "g")]
    for bad in ('((identifier) @i (#eq? @i "x")', '((identifier) @i (#eq? @i "x") (call))', '((identifier) @i (#any? @i "x"))'):
        with pytest.raises(patterns.BadPattern):
            patterns.parse(bad)


def plain(pattern, node, kids):
    """Whether a node matches, and the captures of all its matches, by trying every choice of children."""
    if pattern.choices:
        got = [plain(c, node, kids) for c in pattern.choices]
        some = [g for g in got if g is not None]
        return set.union({(n, node[0]) for n in pattern.captures}, *some) if some else None
    if pattern.type and node[3] != pattern.type:
        return None
    if any(k[2] == name for name in pattern.without for k in kids[node[0]]):
        return None
    children, out, some = kids[node[0]], set(), not pattern.items
    counts = [range(0 if not i.least else 1, (len(children) if i.many else 1) + 1) for i in pattern.items]
    for times in itertools.product(*counts) if pattern.items else ():
        need = [(i, k) for i, t in zip(pattern.items, times) for k in range(t)]
        skipped_next = []
        for n, (i, t) in enumerate(zip(pattern.items, times)):
            skipped_next.append(i.next)
        for chosen in itertools.combinations(range(len(children)), len(need)):
            good, parts, last = True, set(), -1
            for (item, k), at in zip(need, chosen):
                if item.next and at != last + 1:
                    good = False
                inside = plain(item.pattern, children[at], kids) if good and (not item.field or children[at][2] == item.field) else None
                if inside is None:
                    good = False
                    break
                parts |= inside
                last = at
            if good and (not pattern.last or last == len(children) - 1):
                some, out = True, out | parts
    return out | {(n, node[0]) for n in pattern.captures} if some else None


def test_patterns_against_all_choices(spark):
    rng = random.Random(9)
    rows = []
    for f in range(6):
        n = 22
        parents = [None] + [rng.randrange(max(0, k - 5), k) for k in range(1, n)]
        order = []

        def walk(k, up):
            me = len(order)
            order.append((me, up, rng.choice([None, "f", "g"]), rng.choice("abc")))
            for c in range(n):
                if parents[c] == k:
                    walk(c, me)

        walk(0, None)
        rows += [(f"p{f}", *r, f"t{r[0]}", 1, 1, 0, 0) for r in order]
    schema = "path string, node int, parent int, field string, type string, text string, start_line int, end_line int, start_column int, end_column int"
    tree = written(spark.createDataFrame(rows, schema))
    queries = [
        "(a (b) @x (c) @y) @z", "(a . (b) @x)", "(_ (b)* @x . (c) @y .)", "(a f: (_) @x !g)", "(b (a (c) @deep))", "(a [(b) (c (a) @in)] @x . (_) @y)", "(c (a)+ @x (b)? @y)",
        "(a . (b)+ @x . (c) @y)", "(_ (a)* @x . (b) @y . (c)? @z .)",
    ]
    for query in queries:
        wanted = set()
        for path in {r[0] for r in rows}:
            nodes = [r[1:] for r in rows if r[0] == path]
            kids = {k[0]: [c for c in nodes if c[1] == k[0]] for k in nodes}
            for node in nodes:
                for pattern in patterns.parse(query):
                    wanted |= {(path, name, f"t{k}") for name, k in plain(pattern, node, kids) or ()}
        assert {(r.path, r.capture, r.text) for r in patterns.captures(tree, query).collect()} == wanted, query


def test_patterns_give_the_scanned_definitions(spark, sf_dir):
    from lanternq.sources.corpus import code_corpus

    code = written(code_corpus(spark, sf_dir).filter("ext <> '.js'"))
    scanned = {(r.path, r.name, r.start_line) for r in structure.functions(structure.structure(code)).collect()}
    tree = written(syntax_nodes.syntax_nodes(code))
    names = patterns.captures(tree, "[(function_definition name: (_) @n) (method_declaration name: (_) @n) (constructor_declaration name: (_) @n)]")
    assert {(r.path, r.text, r.start_line) for r in names.collect()} == scanned


def test_no_table_of_nodes_goes_through_the_driver(spark, sf_dir, monkeypatch):
    """Joins are by sorting, in the plans of all tables on the way and of the result."""
    from lanternq.catalogue import index_queries

    plans, kept = [], patterns.saved
    monkeypatch.setattr(patterns, "saved", lambda df, *a: plans.append(df) or kept(df, *a))
    plans.append(index_queries.java_calls_in_classes(spark, sf_dir))
    made = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum("SortMergeJoin" in p for p in made) > 3 and not any("BroadcastHashJoin" in p for p in made)
