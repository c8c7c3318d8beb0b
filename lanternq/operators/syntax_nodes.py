"""Whole syntax trees of Python and Java files, a row for each node.

A table function reads a file and gives its nodes in pre-order; it is joined
to the files laterally.  Python trees come from the standard library, with
identifiers, parameter lists and blocks as nodes of their own, and with
comments.  Java files are read by a parser that does not give up: what it
cannot read becomes an ``ERROR`` node that reaches to the next semicolon,
brace or closing line of the part around it, and what follows is read as
usual; brackets that are never closed end with the file.

Columns are counted in characters from zero, lines from one.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "node int, parent int, field string, type string, text string, start_line int, end_line int, start_column int, end_column int"


class Node:
    """Bounds are places in the text."""

    __slots__ = ("type", "start", "end", "field", "children")

    def __init__(self, type: str, start: int, end: int, field: str | None = None, children: list[Node] | None = None):
        self.type, self.start, self.end, self.field, self.children = type, start, end, field, children or []


# -- Python ---------------------------------------------------------------

PYTHON_TYPES = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Expr": "expression_statement",
    "Return": "return_statement", "Import": "import_statement", "ImportFrom": "import_from_statement", "Call": "call", "Name": "identifier",
    "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment", "If": "if_statement", "For": "for_statement",
    "AsyncFor": "for_statement", "While": "while_statement", "Try": "try_statement", "With": "with_statement", "AsyncWith": "with_statement",
    "Raise": "raise_statement", "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "Assert": "assert_statement",
    "BinOp": "binary_operator", "BoolOp": "boolean_operator", "UnaryOp": "unary_operator", "Compare": "comparison_operator", "Dict": "dictionary",
    "ListComp": "list_comprehension", "IfExp": "conditional_expression", "JoinedStr": "string", "alias": "dotted_name", "arg": "identifier",
    "ExceptHandler": "except_clause", "keyword": "keyword_argument", "Global": "global_statement", "Delete": "delete_statement",
}
CONSTANTS = {str: "string", bytes: "string", bool: "boolean", int: "integer", float: "float", complex: "complex", type(None): "none", type(...): "ellipsis"}
FIELDS = {"func": "function", "test": "condition", "target": "left", "targets": "left", "value": "value", "iter": "right", "args": "arguments"}
BLOCKS = {"body": "body", "orelse": "alternative", "finalbody": "finally", "handlers": None}


class _Python:
    def __init__(self, text: str):
        self.text = text
        self.lines = [0]
        for line in text.split("\n")[:-1]:
            self.lines.append(self.lines[-1] + len(line) + 1)

    def place(self, line: int, column: int) -> int:
        """Of a column in bytes, as the standard library counts."""
        start = self.lines[line - 1]
        end = self.lines[line] if line < len(self.lines) else len(self.text)
        row = self.text[start:end]
        return start + (column if row.isascii() else len(row.encode()[:column].decode(errors="ignore")))

    def bounds(self, node: ast.AST) -> tuple[int, int]:
        return self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)

    def tree(self) -> Node:
        comments = []
        for token in tokenize.generate_tokens(io.StringIO(self.text).readline):
            if token.type == tokenize.COMMENT:
                start = self.lines[token.start[0] - 1] + token.start[1]
                comments.append(Node("comment", start, start + len(token.string)))
        root = Node("module", 0, len(self.text), None, self.several(ast.parse(self.text).body))
        for comment in comments:
            around = root
            while inner := next((c for c in around.children if c.start <= comment.start < c.end), None):
                around = inner
            around.children.append(comment)
            around.children.sort(key=lambda c: c.start)
        return root

    def several(self, nodes: list[ast.AST], field: str | None = None) -> list[Node]:
        return [self.node(n, field) for n in nodes]

    def name(self, name: str, start: int, end: int, field: str) -> Node:
        found = re.compile(rf"(?<!\w){re.escape(name)}(?!\w)").search(self.text, start, end)
        at = found.start() if found else start
        return Node("identifier", at, at + len(name) if found else at, field)

    def block(self, body: list[ast.AST], field: str | None) -> Node:
        children = self.several(body)
        return Node("block", children[0].start, children[-1].end, field, children)

    def node(self, node: ast.AST, field: str | None = None) -> Node:
        start, end = self.bounds(node)
        kind = type(node).__name__
        out = Node(PYTHON_TYPES.get(kind) or re.sub(r"(?<!^)(?=[A-Z])", "_", kind).lower(), start, end, field)
        if isinstance(node, ast.Constant):
            out.type = CONSTANTS.get(type(node.value), "constant")
            return out
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.children = self.definition(node, start)
            return out
        if isinstance(node, ast.Attribute):
            out.children = [self.node(node.value, "object"), Node("identifier", end - len(node.attr), end, "attribute")]
            return out
        for name, value in ast.iter_fields(node):
            if name in BLOCKS and isinstance(value, list) and value:
                out.children += self.several(value) if BLOCKS[name] is None else [self.block(value, BLOCKS[name])]
            elif isinstance(value, list):
                out.children += [x for n in value if isinstance(n, ast.AST) for x in self.placed(n, FIELDS.get(name, name))]
            elif isinstance(value, ast.AST):
                out.children += self.placed(value, FIELDS.get(name, name))
        out.children.sort(key=lambda c: c.start)
        return out

    def placed(self, node: ast.AST, field: str) -> list[Node]:
        """The node, or those below it if it has no place itself."""
        if hasattr(node, "lineno"):
            return [self.node(node, field)]
        return [x for child in ast.iter_child_nodes(node) for x in self.placed(child, field)]

    def definition(self, node: ast.FunctionDef | ast.ClassDef, start: int) -> list[Node]:
        body = self.block(node.body, "body")
        name = self.name(node.name, start, body.start, "name")
        out = [*self.several(node.decorator_list, "decorator"), name]
        if isinstance(node, ast.ClassDef):
            bases = self.several([*node.bases, *node.keywords])
            if bases:
                out.append(Node("argument_list", bases[0].start, bases[-1].end, "superclasses", bases))
        else:
            low = self.text.find("(", name.end)
            inside = self.placed(node.args, None)
            high = self.text.find(")", inside[-1].end if inside else low) + 1
            out.append(Node("parameters", low, max(low, high), "parameters", inside))
            if node.returns:
                out.append(self.node(node.returns, "return_type"))
        return [*out, body]


# -- Java -----------------------------------------------------------------

JAVA_TOKEN = re.compile(
    r"(?P<block_comment>/\*[\s\S]*?(?:\*/|\Z))|(?P<line_comment>//[^\n]*)|(?P<string_literal>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?)"
    r"|(?P<character_literal>'(?:[^'\\\n]|\\.)*'?)|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*)|(?P<sign>\S)"
)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
KINDS = {"class": ("class_declaration", "class_body"), "interface": ("interface_declaration", "interface_body"), "enum": ("enum_declaration", "enum_body"), "record": ("record_declaration", "class_body")}
STATEMENTS = {
    "return": "return_statement", "if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "try": "try_statement",
    "switch": "switch_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement", "synchronized": "synchronized_statement",
}
NO_CALLS = {*STATEMENTS, "catch", "new", "super", "this", "assert", "else", "case", "finally"}
CLOSING = {"(": ")", "[": "]", "{": "}"}


class _Java:
    """Tokens are (kind, text, start, end); comments stand apart and are put into the tree at its end."""

    def __init__(self, text: str):
        self.text, self.comments, self.tokens = text, [], []
        for found in JAVA_TOKEN.finditer(text):
            if found.lastgroup in ("block_comment", "line_comment"):
                self.comments.append(Node(found.lastgroup, *found.span()))
            else:
                self.tokens.append((found.lastgroup, found[0], *found.span()))
        self.at = 0
        self.closes = self._closes()

    def _closes(self) -> dict[int, int]:
        """For each opening bracket its closing one; one that a brace closes too early has none."""
        out, held = {}, []
        for k, (_, text, _, _) in enumerate(self.tokens):
            if text in CLOSING:
                held.append(k)
            elif text in CLOSING.values():
                if text == "}":
                    while held and self.tokens[held[-1]][1] != "{":
                        held.pop()
                if held and CLOSING[self.tokens[held[-1]][1]] == text:
                    out[held.pop()] = k
        return out

    def word(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def node(self, type: str, first: int, last: int, field: str | None = None, children: list[Node] | None = None) -> Node:
        """Of tokens first up to last, which is not included."""
        first, last = min(first, len(self.tokens)), min(last, len(self.tokens))
        if first >= last:
            end = self.tokens[first - 1][3] if first else 0
            return Node(type, end, end, field, children)
        return Node(type, self.tokens[first][2], self.tokens[last - 1][3], field, children)

    def tree(self) -> Node:
        root = Node("program", 0, len(self.text), None, self.members(len(self.tokens), ""))
        for comment in self.comments:
            around = root
            while inner := next((c for c in around.children if c.start <= comment.start < c.end), None):
                around = inner
            around.children.append(comment)
            around.children.sort(key=lambda c: c.start)
        return root

    def members(self, end: int, owner: str) -> list[Node]:
        """Declarations up to a token."""
        out = []
        while self.at < end:
            if self.word() == ";":
                self.at += 1
            else:
                out.append(self.member(end, owner))
        return out

    def member(self, end: int, owner: str) -> Node:
        first = self.at
        if self.word() in ("package", "import"):
            kind = f"{self.word()}_declaration"
            stop = self._until({";"}, end, line=True)
            name = self.node("scoped_identifier", first + 1 + (self.word(1) == "static"), stop, "name")
            self.at = stop + (stop < end and self.tokens[stop][1] == ";")
            return self.node(kind, first, self.at, None, [name])
        while self.at < end and (self.word() in MODIFIERS or self.word() == "@"):
            if self.word() == "@" and self.word(1) != "interface":
                self.at += 2
                while self.word() == "." and self.at < end:
                    self.at += 2
                if self.word() == "(":
                    self.at = self.closes.get(self.at, self.at) + 1
            elif self.word() == "@":
                break
            else:
                self.at += 1
        modifiers = [self.node("modifiers", first, self.at)] if self.at > first else []
        at_sign = self.word() == "@"
        kind = self.word(at_sign)
        if kind in KINDS and self.at + at_sign + 1 < end and self.tokens[self.at + at_sign + 1][0] == "word":
            return self.type(first, end, modifiers, at_sign)
        if self.word() == "{":
            block = self.body("block", end, "body", self.statements)
            return self.node("static_initializer" if modifiers else "block", first, self.at, None, [*modifiers, block])
        return self.declared(first, end, modifiers, owner)

    def type(self, first: int, end: int, modifiers: list[Node], at_sign: bool) -> Node:
        kind, body = KINDS[self.word(at_sign)]
        self.at += 1 + at_sign
        name, own = self.node("identifier", self.at, self.at + 1, "name"), self.word()
        self.at = self._until({"{", ";", "}"}, end)
        children = [*modifiers, name]
        if self.word() == "{" and self.at < end:
            children.append(self.body(body, end, "body", lambda stop: self.members(stop, own)))
        else:
            children.append(self.node("ERROR", self.at, self.at))
        return self.node(kind, first, self.at, None, children)

    def declared(self, first: int, end: int, modifiers: list[Node], owner: str) -> Node:
        """A method, a constructor or a field; an ERROR node if it is none of them."""
        start, angles = self.at, 0
        while self.at < end:
            text = self.word()
            angles += {"<": 1, ">": -1}.get(text, 0)
            if text in "(=;{}" or self.tokens[self.at][0] not in ("word", "sign") or text not in "<>,.?&[]@" and self.tokens[self.at][0] == "sign":
                break
            self.at += 1
        named = self.at > start and self.tokens[self.at - 1][0] == "word" and angles == 0
        if named and self.word() == "(" and self.at in self.closes:
            name = self.node("identifier", self.at - 1, self.at, "name")
            builds = self.at - 1 == start or self.tokens[self.at - 2][1] == ">" and self.tokens[start][1] == "<" and self.word(-1) == owner
            low, self.at = self.at, self.closes[self.at] + 1
            children = [*modifiers, *([] if builds else [self.node("type", start, low - 1, "type")]), name, self.parameters(low, self.at)]
            stop = self._until({"{", ";", "}"}, end)
            clause = [self.node("throws", self.at, stop)] if stop > self.at else []
            self.at = stop
            children += clause
            if self.word() == "{" and self.at < end:
                children.append(self.body("constructor_body" if builds else "block", end, "body", self.statements))
            elif self.word() == ";":
                self.at += 1
            else:
                children.append(self.node("ERROR", self.at, self.at))
            return self.node("constructor_declaration" if builds else "method_declaration", first, self.at, None, children)
        if named and self.at - start >= 2 and self.word() in ("=", ";", ","):
            name = self.node("identifier", self.at - 1, self.at, "name")
            low = self.at
            self.at = stop = self._until({";"}, end, line=True)
            value = self.expressions(low, stop)
            self.at = stop + (stop < end and self.tokens[stop][1] == ";")
            declarator = self.node("variable_declarator", low - 1, stop, "declarator", [name, *value])
            return self.node("field_declaration", first, self.at, None, [*modifiers, self.node("type", start, low - 1, "type"), declarator])
        return self.error(first, end)

    def error(self, first: int, end: int) -> Node:
        """What cannot be read, to the next semicolon, behind the next block, or before a closing brace."""
        self.at = stop = self._until({";", "{", "}"}, end, line=True)
        inside = []
        if stop < end and self.word() == "{":
            inside = [self.body("block", end, None, self.statements)]
        elif stop < end and self.word() == ";" or self.at == first:
            self.at += 1
        return self.node("ERROR", first, max(self.at, first + 1), None, inside)

    def _until(self, signs: set[str], end: int, line: bool = False) -> int:
        """The next of some signs outside round and square brackets; with line, also the first
        token of a later line that starts a declaration."""
        k = self.at
        while k < end:
            text = self.tokens[k][1]
            if text in signs or text == "}":
                return k
            if line and k > self.at and (text in MODIFIERS or text in KINDS) and "\n" in self.text[self.tokens[k - 1][3] : self.tokens[k][2]]:
                return k
            k = self.closes.get(k, k) + 1 if text in "([" or text == "{" and "{" not in signs else k + 1
        return end

    def body(self, type: str, end: int, field: str | None, read) -> Node:
        first = self.at
        stop = min(self.closes.get(first, end), end)
        self.at = first + 1
        children = read(stop)
        closed = first in self.closes and self.closes[first] < end
        if not closed:
            children.append(self.node("ERROR", stop, stop))
        self.at = stop + closed
        return self.node(type, first, self.at, field, children)

    def parameters(self, low: int, high: int) -> Node:
        out, start, depth = [], low + 1, 0
        for k in range(low + 1, high):
            text = self.tokens[k][1]
            depth += {"<": 1, ">": -1, "(": 1, ")": -1}.get(text, 0) if k < high - 1 else 0
            if (text == "," and not depth or k == high - 1) and k > start:
                name = self.node("identifier", k - 1, k, "name")
                out.append(self.node("formal_parameter", start, k, None, [self.node("type", start, k - 1, "type"), name] if k - start > 1 else [name]))
            start = k + 1 if text == "," and not depth else start
        return self.node("formal_parameters", low, high, "parameters", out)

    def statements(self, end: int) -> list[Node]:
        out = []
        while self.at < end:
            first, text = self.at, self.word()
            if text == ";":
                self.at += 1
            elif text == "{":
                out.append(self.body("block", end, None, self.statements))
            elif self._is_method(end):
                out.append(self.member(end, ""))
            elif text in KINDS and self.word(1).isidentifier() and self.word(2) in ("{", "extends", "implements", "<"):
                out.append(self.member(end, ""))
            elif text in ")]}":
                self.at += 1
                out.append(self.node("ERROR", first, self.at))
            else:
                out.append(self.statement(end))
        return out

    def _is_method(self, end: int) -> bool:
        """Whether a method begins here, as in a block that a lost brace has left open."""
        k = self.at
        while k < end and self.tokens[k][0] == "word" and self.tokens[k][1] not in NO_CALLS:
            k += 1
        close = self.closes.get(k, end)
        return k - self.at > 1 and k < end and self.tokens[k][1] == "(" and close + 1 < end and self.tokens[close + 1][1] == "{"

    def statement(self, end: int) -> Node:
        first = self.at
        kind = STATEMENTS.get(self.word(), "expression_statement")
        children = []
        while self.at < end and self.word() not in (";", "}"):
            stop = self._until({";", "{", "}"}, end)
            children += self.expressions(self.at, stop)
            self.at = stop
            if self.at < end and self.word() == "{":
                children.append(self.body("block", end, "body", self.statements))
                if self.word() not in ("else", "catch", "finally", "while", ")", ".", ";", ","):
                    break
        self.at += self.at < end and self.word() == ";"
        two_words = first + 2 < len(self.tokens) and self.tokens[first][0] == self.tokens[first + 1][0] == "word" and self.tokens[first + 2][1] in ("=", ";", ",")
        if kind == "expression_statement" and two_words:
            kind = "local_variable_declaration"
        if self.at == first:
            self.at += 1
        return self.node(kind, first, self.at, None, children)

    def expressions(self, first: int, end: int) -> list[Node]:
        """Calls, new objects and literals among some tokens."""
        out, k = [], first
        while k < end:
            kind, text, _, _ = self.tokens[k]
            following = self.tokens[k + 1][1] if k + 1 < end else ""
            if kind == "word" and following == "(" and k + 1 in self.closes and self.closes[k + 1] < end and text not in NO_CALLS:
                close = self.closes[k + 1]
                made = k > first and self.tokens[k - 1][1] == "new"
                arguments = self.node("argument_list", k + 1, close + 1, "arguments", self.expressions(k + 2, close))
                name = self.node("type_identifier" if made else "identifier", k, k + 1, "type" if made else "name")
                out.append(self.node("object_creation_expression" if made else "method_invocation", k - made, close + 1, None, [name, arguments]))
                k = close + 1
                continue
            if kind in ("string_literal", "character_literal", "number"):
                out.append(self.node({"number": "decimal_integer_literal" if text.isdigit() else "decimal_floating_point_literal"}.get(kind, kind), k, k + 1))
            k += 1
        return out


# -- rows -----------------------------------------------------------------


def tree_of(ext: str | None, content: str | None) -> Node | None:
    """The tree of a Python or Java file; None if there is none."""
    text = re.sub(r"\r\n?", "\n", content or "")
    if ext == ".py":
        try:
            return _Python(text).tree()
        except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
            return None
    return _Java(text).tree() if ext == ".java" else None


def rows_of(root: Node, text: str) -> Iterator[tuple]:
    starts = [m.end() for m in re.finditer("\n", text)]
    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at)
        return line + 1, at - (starts[line - 1] if line else 0)

    todo, count = [(root, None)], 0
    while todo:
        node, parent = todo.pop()
        (a, low), (b, high) = place(node.start), place(node.end)
        yield count, parent, node.field, node.type, "" if parent is None else text[node.start : node.end], a, b, low, high
        todo += [(child, count) for child in reversed(node.children)]
        count += 1


@F.udtf(returnType=SCHEMA)
class SyntaxNodes:
    def eval(self, ext: str, content: str):
        root = tree_of(ext, content)
        if root:
            yield from rows_of(root, re.sub(r"\r\n?", "\n", content or ""))


def syntax_nodes(files: DataFrame) -> DataFrame:
    """path and the nodes of each Python and Java file, in pre-order; Python files
    with a syntax error have none.  A file's root has no parent and no text."""
    chosen = files.filter(F.col("ext").isin(".py", ".java")).select("path", "ext", "content")
    nodes = chosen.lateralJoin(SyntaxNodes(F.col("ext").outer(), F.col("content").outer()))
    return nodes.select("path", "node", "parent", "field", "type", "text", "start_line", "end_line", "start_column", "end_column")
