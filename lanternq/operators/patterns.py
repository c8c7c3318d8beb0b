"""Tree patterns over syntax nodes: S-expressions, matched by joins.

A pattern names a node type and what its children must be:

    (class_definition name: (identifier) @name body: (block . (comment)* (_) @first)) @whole

``field:`` asks for a child in a field, ``!field`` for none, ``_`` or ``(_)``
for any node, ``[a b]`` for one of several patterns.  Children follow each
other in order; ``.`` asks for the very next one (or the first, or the last).
A child may be there ``?`` zero or one, ``*`` zero or more, ``+`` one or more
times.  ``@name`` captures a node; ``(#eq? @name "text")`` and
``(#match? @name "expression")`` filter what is captured.  Only named nodes
are in the table, so quoted signs match nothing.

Nodes are rows (path, node, parent, place among the siblings, field, type ...).
Patterns are matched from the leaves up: a child list is followed from left to
right as a set of places that it may have reached, one join for each item,
and from right to left in the same way; a child takes part if it is met from
both sides.  Then captures are collected from the top down.  A join never
meets two children of a node with each other, so the work follows the number
of nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written as saved

TOKEN = re.compile(r';[^\n]*|\s+|[()\[\]]|"(?:[^"\\]|\\.)*"|@[\w.-]+|#[\w-]+[?!]|![A-Za-z_]\w*|[A-Za-z_]\w*:|[A-Za-z_]\w*|[?*+.]')


@dataclass
class Pattern:
    type: str | None = None  # None: any
    choices: list[Pattern] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    last: bool = False  # the last item is the last child
    without: list[str] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    tests: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Item:
    pattern: Pattern
    field: str | None = None
    next: bool = False  # comes right after the item before
    least: int = 1
    many: bool = False


class BadPattern(ValueError):
    pass


def parse(text: str) -> list[Pattern]:
    """The patterns of a query; raises BadPattern."""
    tokens, at = [], 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise BadPattern(f"{text[at : at + 20]!r} cannot be read")
        at = found.end()
        if found[0][0] not in "; \t\r\n\v\f":
            tokens.append(found[0])
    out, tests, at = [], [], 0
    while at < len(tokens):
        if tokens[at] == "(" and tokens[at + 1 : at + 2] and tokens[at + 1][0] == "#":
            test, at = _test(tokens, at)
            tests.append(test)
            continue
        pattern, at = _pattern(tokens, at)
        item, at = _counted(tokens, at, Item(pattern))
        if item.least != 1 or item.many:
            raise BadPattern("a pattern by itself is not counted")
        out.append(pattern)
    for pattern in out:
        _attach(pattern, tests)
    return out


def _pattern(tokens: list[str], at: int) -> tuple[Pattern, int]:
    token = tokens[at] if at < len(tokens) else ""
    if token == "[":
        out, at = Pattern(), at + 1
        while tokens[at : at + 1] not in ([], ["]"]):
            choice, at = _pattern(tokens, at)
            item, at = _counted(tokens, at, Item(choice))
            out.choices.append(item.pattern)
        if at >= len(tokens):
            raise BadPattern("a bracket is open")
        return out, at + 1
    if token == "_":
        return Pattern(), at + 1
    if token[:1] == '"':
        return Pattern(type=token), at + 1
    if token != "(":
        raise BadPattern(f"{token or 'the end'} where a pattern should begin")
    at += 1
    if tokens[at : at + 1] in (["("], ["["]):  # a group of one, and its tests
        out, at = _pattern(tokens, at)
        item, at = _counted(tokens, at, Item(out))
        tests = []
        while tokens[at : at + 1] == ["("] and tokens[at + 1 : at + 2] and tokens[at + 1][0] == "#":
            test, at = _test(tokens, at)
            tests.append(test)
        if tokens[at : at + 1] != [")"]:
            raise BadPattern("groups of several patterns are not known")
        _attach(out, tests)
        return out, at + 1
    kind = tokens[at] if at < len(tokens) else ""
    if not re.fullmatch(r"[A-Za-z_]\w*", kind):
        raise BadPattern(f"{kind or 'the end'} where a type should stand")
    out, at = Pattern(None if kind == "_" else kind), at + 1
    anchored, tests = False, []
    while tokens[at : at + 1] not in ([], [")"]):
        token = tokens[at]
        if token == ".":
            anchored, at = True, at + 1
        elif token[0] == "!":
            out.without.append(token[1:])
            at += 1
        elif token == "(" and tokens[at + 1 : at + 2] and tokens[at + 1][0] == "#":
            test, at = _test(tokens, at)
            tests.append(test)
        else:
            name = token[:-1] if token[-1] == ":" else None
            child, at = _pattern(tokens, at + (name is not None))
            item, at = _counted(tokens, at, Item(child, name, anchored))
            out.items.append(item)
            anchored = False
    if at >= len(tokens):
        raise BadPattern("a parenthesis is open")
    out.last = anchored and bool(out.items)
    _attach(out, tests)
    return out, at + 1


def _counted(tokens: list[str], at: int, item: Item) -> tuple[Item, int]:
    """Counts and captures after a pattern."""
    while at < len(tokens) and (tokens[at] in "?*+" or tokens[at][0] == "@"):
        if tokens[at][0] == "@":
            item.pattern.captures.append(tokens[at][1:])
        else:
            item.least, item.many = int(tokens[at] == "+"), tokens[at] != "?"
        at += 1
    return item, at


def _test(tokens: list[str], at: int) -> tuple[tuple[str, str, str], int]:
    kind, name, value, end = (tokens[at + 1 : at + 5] + [""] * 4)[:4]
    if kind not in ("#eq?", "#match?") or name[:1] != "@" or value[:1] != '"' or end != ")":
        raise BadPattern(f"{kind} with {name} and {value} is not known")
    return (name[1:], kind, re.sub(r"\\(.)", r"\1", value[1:-1])), at + 5


def _attach(pattern: Pattern, tests: list[tuple[str, str, str]]) -> None:
    pattern.tests += [(kind, value) for name, kind, value in tests if name in pattern.captures]
    for child in [*pattern.choices, *(i.pattern for i in pattern.items)]:
        _attach(child, tests)


# -- matching -------------------------------------------------------------


def _met(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting.  Spark would judge tables of nodes by their size on disk,
    where they are many times smaller, and send whole ones through the driver."""
    return rows.hint("merge").join(others.hint("merge"), on, how)


class _Matching:
    """Of patterns over one table of nodes (path, node, parent, ord, siblings, children, field, type, text)."""

    def __init__(self, tree: DataFrame):
        self.tree = tree
        self.known: dict[int, DataFrame] = {}
        self.met: dict[int, list[DataFrame]] = {}

    def matches(self, pattern: Pattern) -> DataFrame:
        """The nodes that a pattern matches."""
        if id(pattern) not in self.known:
            self.known[id(pattern)] = self._matches(pattern)
        return self.known[id(pattern)]

    def _matches(self, pattern: Pattern) -> DataFrame:
        if pattern.choices:
            out = reduce(DataFrame.unionByName, map(self.matches, pattern.choices)).dropDuplicates(["path", "node"])
        else:
            out = self.tree.filter(F.col("type") == pattern.type) if pattern.type else self.tree
        for kind, value in pattern.tests:
            out = out.filter(F.col("text") == value if kind == "#eq?" else F.col("text").rlike(value))
        for name in pattern.without:
            has = self.tree.filter(F.col("field") == name).select("path", F.col("parent").alias("node"))
            out = _met(out, has, ["path", "node"], "left_anti")
        if not pattern.items:
            return out
        start = out.select("path", F.col("node").alias("parent"), F.lit(-1).alias("place"), "children")
        ends, forth = self._along(start, pattern.items, [i.next for i in pattern.items], pattern.last, "ord")
        out = saved(_met(out, ends.select("path", F.col("parent").alias("node")).distinct(), ["path", "node"], "left_semi"))
        start = out.select("path", F.col("node").alias("parent"), F.lit(-1).alias("place"), "children")
        backwards = [pattern.last, *(i.next for i in reversed(pattern.items[1:]))]
        _, back = self._along(start, pattern.items[::-1], backwards, pattern.items[0].next, "from_end")
        both = [_met(f, b.select("path", "node"), ["path", "node"], "left_semi") for f, b in zip(forth, back[::-1])]
        self.met[id(pattern)] = [saved(x.select("path", "node", "parent").distinct()) for x in both]
        return out

    def _along(self, at: DataFrame, items: list[Item], close: list[bool], last: bool, side: str) -> tuple[DataFrame, list[DataFrame]]:
        """Follows a child list: parents (path, parent, place, children) that get to its end, and the children met at each item."""
        steps = []
        for item, near in zip(items, close):
            nodes = self.matches(item.pattern)
            nodes = nodes.filter(F.col("field") == item.field) if item.field else nodes
            place = F.col("ord") if side == "ord" else F.col("siblings") - 1 - F.col("ord")
            nodes = nodes.select("path", "node", "parent", place.alias("place"))
            if near:
                before = at.select("path", "parent", (F.col("place") + 1).alias("place")).distinct()
                met = _met(nodes, before, ["path", "parent", "place"])
                if item.many:
                    # Children that follow each other form stretches, which are gone along as wholes.
                    order = Window.partitionBy("path", "parent").orderBy("place")
                    stretch = nodes.withColumn("stretch", F.col("place") - F.row_number().over(order))
                    entry = _met(stretch, before, ["path", "parent", "place"]).groupBy("path", "parent", "stretch").agg(F.min("place").alias("entry"))
                    met = _met(stretch, entry, ["path", "parent", "stretch"]).filter("place >= entry").select("path", "node", "parent", "place")
            else:
                first = at.groupBy("path", "parent").agg(F.min("place").alias("first"))
                met = _met(nodes, first, ["path", "parent"]).filter("place > first").drop("first")
            met = saved(met)
            steps.append(met)
            to = _met(met, at.select("path", "parent", "children").distinct(), ["path", "parent"]).select("path", "parent", "place", "children")
            at = saved(to if item.least else at.unionByName(to).distinct())
        return (at.filter(F.col("place") == F.col("children") - 1) if last else at), steps

    def captured(self, pattern: Pattern, nodes: DataFrame) -> list[DataFrame]:
        """path, node, capture of what takes part in matches at nodes."""
        out = [nodes.select("path", "node", F.lit(name).alias("capture")) for name in pattern.captures]
        for choice in pattern.choices:
            out += self.captured(choice, _met(self.matches(choice), nodes, ["path", "node"], "left_semi").select("path", "node"))
        for item, met in zip(pattern.items, self.met.get(id(pattern), [])):
            if _captures(item.pattern):
                inside = _met(met, nodes.select("path", F.col("node").alias("parent")), ["path", "parent"], "left_semi")
                out += self.captured(item.pattern, inside.select("path", "node").distinct())
        return out


def _captures(pattern: Pattern) -> bool:
    return bool(pattern.captures) or any(map(_captures, [*pattern.choices, *(i.pattern for i in pattern.items)]))


def placed(nodes: DataFrame) -> DataFrame:
    """nodes (path, node, parent and more; numbered in the order of their places) with their
    place among the siblings, the number of siblings and of children."""
    siblings = Window.partitionBy("path", "parent")
    ordered = nodes.withColumn("ord", F.row_number().over(siblings.orderBy("node")) - 1).withColumn("siblings", F.count("*").over(siblings).cast("int"))
    counts = nodes.groupBy("path", F.col("parent").alias("node")).agg(F.count("*").cast("int").alias("children"))
    return _met(ordered, counts, ["path", "node"], "left").fillna(0, ["children"])


def captures(tree: DataFrame, query: str) -> DataFrame:
    """path, capture, text, type, start_line, end_line, start_column, end_column
    of what a query captures, each node once for each name; a query that cannot
    be read captures nothing."""
    columns: list[str | Column] = ["path", "capture", "text", "type", "start_line", "end_line", "start_column", "end_column"]
    try:
        patterns = parse(query)
    except BadPattern:
        patterns = []
    tree = saved(placed(tree))
    matching, rows = _Matching(tree), []
    for pattern in patterns:
        rows += matching.captured(pattern, matching.matches(pattern).select("path", "node"))
    if not rows:
        return tree.withColumn("capture", F.lit("")).select(*columns).limit(0)
    return _met(reduce(DataFrame.unionByName, rows).distinct(), tree, ["path", "node"]).select(*columns)
