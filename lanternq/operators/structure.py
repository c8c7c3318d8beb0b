"""Definitions, docstrings, imports and calls of source files.

Python files are parsed with the standard library, Java files by a brace
scanner that knows comments and literals; one pass over a file gives all its
rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import docstring_text, found, is_java_library, is_project_module
from ..shared import written as saved
from . import intervals

SCHEMA = "path string, kind string, name string, start_line int, end_line int, start_column int, code string, parse_error boolean"


def _called(node: ast.expr) -> str:
    """A name, or the dotted end of an attribute chain."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def python_rows(content: str) -> Iterator[tuple]:
    """(kind, name, first line, last line, column, code, parse error)."""
    rows = content.split("\n")
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        for i, line in enumerate(rows, 1):
            m = re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line)
            if m:
                yield ("function" if m[1] == "def" else "class", m[2], i, i, m.start(1), line, True)
        return
    code = lambda n: "\n".join(rows[n.lineno - 1 : n.end_lineno])
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield ("class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno, node.col_offset, code(node), False)
        if isinstance(node, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            body = node.body[0] if node.body else None
            if isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str):
                of = "module" if isinstance(node, ast.Module) else "class" if isinstance(node, ast.ClassDef) else "function"
                yield (f"{of}_docstring", getattr(node, "name", ""), body.lineno, body.end_lineno, body.col_offset, body.value.value, False)
        if isinstance(node, ast.Import):
            for alias in node.names:
                yield ("import", alias.name, node.lineno, node.lineno, node.col_offset, "", False)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield ("import", "." * node.level + node.module, node.lineno, node.lineno, node.col_offset, "", False)
        elif isinstance(node, ast.Call) and (name := _called(node.func)):
            yield ("call", name, node.lineno, node.lineno, node.col_offset, "", False)


JAVA_SKIP = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
JAVA_HEAD = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*\([^()]*\)\s*(?:throws\s+[\w\s.,]+)?$", re.S)
NOT_METHODS = frozenset("if for while switch catch synchronized try do else return new".split())


def java_rows(content: str) -> Iterator[tuple]:
    """Classes, interfaces, methods and constructors with a body, and doc comments."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = JAVA_SKIP.sub(blank, content)
    line_of = lambda at: content.count("\n", 0, at) + 1
    rows = content.split("\n")
    for m in JAVA_SKIP.finditer(content):
        if m[0].startswith("/**"):
            yield ("javadoc", "", line_of(m.start()), line_of(m.end()), m.start() - content.rfind("\n", 0, m.start()) - 1, m[0], False)
    opened: list[tuple | None] = []
    last, types = 0, []
    broken = text.count("{") != text.count("}")
    for m in re.finditer("[{};]", text):
        head, start = text[last : m.start()], last
        last = m.end()
        if m[0] == "{":
            h = None
            for h in JAVA_HEAD.finditer(head.rstrip()):
                pass
            entry = None
            if h and h[1]:
                entry = ("class", h[2], start + len(head) - len(head.lstrip()))
                types.append(h[2])
            elif h and h[3] not in NOT_METHODS and "=" not in head[: h.start()].split(")")[-1]:
                # Annotations and modifiers before it belong to the definition.
                entry = ("constructor" if types and h[3] == types[-1] else "function", h[3], start + len(head) - len(head.lstrip()))
            opened.append(entry)
        elif m[0] == "}" and opened:
            entry = opened.pop()
            if entry:
                if entry[0] == "class" and types:
                    types.pop()
                a, b = line_of(entry[2]), line_of(m.start())
                yield (*entry[:2], a, b, entry[2] - content.rfind("\n", 0, entry[2]) - 1, "\n".join(rows[a - 1 : b]), broken)


#: What reads the files of each language that can be parsed.
PARSERS = {"python": (".py", python_rows), "java": (".java", java_rows)}


def structure(files: DataFrame, languages: tuple[str, ...] = fixed.PARSED_LANGUAGES) -> DataFrame:
    """All rows of the files of a corpus (path, ext, content) in languages that can be parsed."""
    readers = {ext: read for name, (ext, read) in PARSERS.items() if name in languages}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"]):
                if content is not None:
                    out += [(path, *row) for row in readers[ext](content)]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "start_line", "end_line", "start_column", "code", "parse_error"])

    rows = files.filter(F.col("ext").isin(*readers)).select("path", "ext", "content")
    return rows.mapInPandas(run, SCHEMA)


def functions(structured: DataFrame) -> DataFrame:
    return structured.filter(F.col("kind").isin("function", "constructor")).select("path", "name", F.col("kind").alias("type"), "start_line", "end_line", "code")


def functions_with_errors(structured: DataFrame) -> DataFrame:
    """path, name, start_line, parse_error: what was found in files that could not be read whole, too."""
    return structured.filter(F.col("kind").isin("function", "constructor")).select("path", "name", "start_line", "parse_error").distinct()


def classes(structured: DataFrame) -> DataFrame:
    return structured.filter("kind = 'class'").select("path", "name", "start_line", "end_line", "code")


def docstrings(structured: DataFrame) -> DataFrame:
    """Doc strings without quotes at their ends, and doc comments as they stand."""
    kind = F.regexp_replace("kind", "_docstring$", "")
    structured = structured.withColumn("code", F.when(F.col("kind") == "javadoc", F.col("code")).otherwise(docstring_text(F.col("code"))))
    return structured.filter(F.col("kind").endswith("docstring") | (F.col("kind") == "javadoc")).select(
        "path", kind.alias("type"), F.col("code").alias("content"), "start_line", "end_line"
    )


def node_at(structured: DataFrame, path: str, line: int) -> DataFrame:
    """The smallest definition that holds a line."""
    inside = structured.filter((F.col("path") == path) & F.col("kind").isin("function", "constructor", "class") & F.lit(line).between(F.col("start_line"), F.col("end_line")))
    return inside.orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name").limit(1)


def nodes_at(structured: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (path, line_number) inside a definition the smallest one:
    path, line_number, name, kind, start_line, end_line."""
    spans = structured.filter(F.col("kind").isin("function", "constructor", "class")).select("path", "name", "kind", "start_line", "end_line")
    return intervals.smallest_around(points, spans, "line_number").select("path", "line_number", "span.*")


#: Node types of Java files, by what the scanner finds.
JAVA_TYPES = {"class": "class_declaration", "function": "method_declaration", "constructor": "constructor_declaration", "javadoc": "block_comment"}


def _pre_order(content: str) -> Iterator[tuple[int, int | None, int, ast.AST]]:
    """(number, number of the parent, depth, node) of a Python file's whole tree."""
    todo: list[tuple[ast.AST, int | None, int]] = [(ast.parse(content), None, 0)]
    count = 0
    while todo:
        node, parent, depth = todo.pop()
        yield count, parent, depth, node
        todo += [(child, count, depth + 1) for child in reversed(list(ast.iter_child_nodes(node)))]
        count += 1


def tree_rows(content: str) -> Iterator[tuple[int, int | None, int, str, int]]:
    """(node, parent, depth, type, line) of a Python file in pre-order, nodes without a place among them."""
    for count, parent, depth, node in _pre_order(content):
        yield count, parent, depth, type(node).__name__, getattr(node, "lineno", 0)


def syntax_rows(content: str, ext: str) -> Iterator[tuple]:
    """(type, name, text, start line, end line, start column, end column, depth,
    number of the parent) of each syntax node with a place, in pre-order.
    Of Java files only definitions and doc comments are nodes."""
    if ext == ".py":
        try:
            walk = list(_pre_order(content))
        except (SyntaxError, ValueError, RecursionError):
            return
        number: dict[int, int] = {0: -1}  # by place in the walk: of the node itself or of the nearest one above with a place
        count = 0
        for k, parent, depth, node in walk[1:]:
            above = number[parent]
            if hasattr(node, "lineno"):
                text = ast.get_source_segment(content, node) or ""
                yield type(node).__name__, getattr(node, "name", None), text, node.lineno, node.end_lineno, node.col_offset, node.end_col_offset, depth, above
                above, count = count, count + 1
            number[k] = above
        return
    rows = [r for r in java_rows(content) if r[0] in JAVA_TYPES]
    around: list[tuple[int, int]] = []  # number and last line of the definitions around
    for count, (kind, name, a, b, column, code, _) in enumerate(sorted(rows, key=lambda r: (r[2], -r[3], r[4]))):
        while around and around[-1][1] < b:
            around.pop()
        last = code.rsplit("\n", 1)[-1]
        text = code[column:] if kind != "javadoc" else code
        yield JAVA_TYPES[kind], name or None, text, a, b, column, len(last) + (column if kind == "javadoc" and a == b else 0), len(around) + 1, around[-1][0] if around else -1
        if kind != "javadoc":
            around.append((count, b))


SYNTAX_SCHEMA = (
    "path string, node int, type string, name string, text string, start_line int, end_line int, start_column int, end_column int, depth int, parent int"
)


def syntax_tree(files: DataFrame) -> DataFrame:
    """The syntax nodes of Python and Java files in pre-order: path, node (a
    number from zero), type, name, text, place, depth, parent (-1 at the top)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"]):
                out += [(path, k, *row) for k, row in enumerate(syntax_rows(content or "", ext))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SYNTAX_SCHEMA.split(", ")])

    return files.filter(F.col("ext").isin(".py", ".java")).select("path", "ext", "content").mapInPandas(run, SYNTAX_SCHEMA)


def matching_nodes(files: DataFrame, node_types: list[str] | str, capture: str = "node") -> DataFrame:
    """The syntax nodes of some types: path, capture, text, type, start_line, end_line, start_column, end_column."""
    wanted = [node_types] if isinstance(node_types, str) else node_types
    return syntax_tree(files).filter(F.col("type").isin(*wanted)).select("path", F.lit(capture).alias("capture"), "text", "type", "start_line", "end_line", "start_column", "end_column")


def owners(tree: DataFrame, owner_types: tuple[str, ...] = ("FunctionDef", "AsyncFunctionDef", "ClassDef", *JAVA_TYPES.values())) -> DataFrame:
    """path, node, owner: the definition that each syntax node lies in directly
    or through nodes that are no definitions; rounds follow the parents."""
    is_owner = F.col("type").isin(*owner_types)
    known = tree.select("path", F.col("node").alias("parent"), is_owner.alias("ends"), F.col("parent").alias("above"))
    open_rows, done = tree.select("path", "node", "parent"), None
    while True:
        step = open_rows.join(known, ["path", "parent"])
        found = saved(step.select("path", "node", F.when(F.col("ends"), F.col("parent")).alias("owner"), "above"))
        here = found.filter("owner is not null").select("path", "node", "owner")
        done = here if done is None else done.unionByName(here)
        open_rows = found.filter("owner is null and above >= 0").select("path", "node", F.col("above").alias("parent"))
        if open_rows.isEmpty():
            return done


def tags(structured: DataFrame) -> DataFrame:
    """symbol, path, pattern (its first line), type of each definition."""
    kinds = structured.filter(F.col("kind").isin("function", "constructor", "class"))
    return kinds.select(F.col("name").alias("symbol"), "path", F.substring_index("code", "\n", 1).alias("pattern"), F.col("kind").alias("type"))


def tags_with_prefix(structured: DataFrame, prefix: str) -> DataFrame:
    return tags(structured).filter(F.col("symbol").startswith(prefix))


# -- what a file's matches lie among ---------------------------------------


def expanded(matches: DataFrame, structured: DataFrame) -> DataFrame:
    """path, n_matches, functions, classes: for each file with matches, its
    distinct functions and classes (name, first line, last line)."""
    spans = lambda kinds, name: structured.filter(F.col("kind").isin(*kinds)).groupBy("path").agg(
        F.array_sort(F.collect_set(F.struct("name", "start_line", "end_line"))).alias(name)
    )
    out = matches.groupBy("path").agg(F.count("*").alias("n_matches"))
    out = out.join(spans(("function", "constructor"), "functions"), "path", "left").join(spans(("class",), "classes"), "path", "left")
    none = F.array().cast("array<struct<name:string,start_line:int,end_line:int>>")
    return out.withColumn("functions", F.coalesce("functions", none)).withColumn("classes", F.coalesce("classes", none))


def expansion_totals(rows: DataFrame) -> DataFrame:
    """functions_found, classes_found, files_analyzed of ``expanded`` rows."""
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return rows.agg(total("functions").alias("functions_found"), total("classes").alias("classes_found"), F.count("*").alias("files_analyzed"))


# -- imports and calls by pattern -----------------------------------------


def _exploded(files: DataFrame, endings: tuple[str, ...], patterns: list[str], content: Column) -> DataFrame:
    every = F.concat(*(found(content, p, 1) for p in patterns))
    return files.filter(F.col("ext").isin(*endings)).select("path", "ext", F.posexplode(every).alias("at", "name"))


def java_imports(files: DataFrame) -> DataFrame:
    return _exploded(files, (".java",), [fixed.GRAPH_JAVA_IMPORT], F.col("content")).select("path", "name")


def java_calls(files: DataFrame) -> DataFrame:
    rows = _exploded(files, (".java",), [fixed.JAVA_CALL], F.col("content"))
    return rows.filter(~F.col("name").isin(fixed.JAVA_NO_CALLS) & (F.length("name") > 1)).select("path", "name")


def js_imports(files: DataFrame) -> DataFrame:
    return _exploded(files, (".js", ".ts"), list(fixed.GRAPH_JS_IMPORTS), F.col("content")).select("path", "name")


def js_calls(files: DataFrame) -> DataFrame:
    rows = _exploded(files, (".js", ".ts"), [fixed.JS_CALL], F.col("content"))
    return rows.filter(~F.col("name").isin(fixed.JS_NO_CALLS) & (F.length("name") > 1)).select("path", "name")


def context_imports(files: DataFrame) -> DataFrame:
    """path, ext, at, name: what context expansion takes for imports."""
    content = F.col("content")
    return (
        _exploded(files, (".py",), [fixed.PY_FROM, fixed.PY_IMPORT], content)
        .unionByName(_exploded(files, (".js", ".jsx", ".ts", ".tsx"), [fixed.JS_FROM], content))
        .unionByName(_exploded(files, (".java",), [fixed.JAVA_IMPORT, fixed.JAVA_STATIC], content))
    )


def dependencies(files: DataFrame, structured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports and calls (path, name, line) of all languages."""
    of = lambda kind: structured.filter((F.col("kind") == kind) & F.col("path").endswith(".py")).select("path", "name", F.col("start_line").alias("line"))
    no_line = lambda rows: rows.withColumn("line", F.lit(0))
    imports = of("import").unionByName(no_line(java_imports(files))).unionByName(no_line(js_imports(files)))
    calls = of("call").unionByName(no_line(java_calls(files))).unionByName(no_line(js_calls(files)))
    return imports, calls


# -- resolving ------------------------------------------------------------


def python_candidates(path: Column, name: Column) -> Column:
    """Files that a Python import may mean, best first."""
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    folders = F.split(path, "/")
    up = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.lit(0), F.size(folders) - dots)), "/")
    base = F.when(up == "", "").otherwise(F.concat(up, F.lit("/")))
    package = F.when(module == "", F.array(F.concat(base, F.lit("__init__.py")))).otherwise(
        F.array(F.concat(base, module, F.lit("/__init__.py")), F.concat(base, module, F.lit(".py")))
    )
    absolute = F.array(*(F.concat(F.lit(root), module, F.lit(end)) for root in ("", "src/") for end in ("/__init__.py", ".py")))
    return F.when(dots > 0, package).otherwise(absolute)


def js_candidates(path: Column, name: Column) -> Column:
    folder = F.regexp_replace(path, "[^/]*$", "")
    plain = F.regexp_replace(F.when(name.startswith("."), F.concat(folder, name)).otherwise(name), r"(^|/)(?:\./)+", "$1")
    plain = F.regexp_replace(plain, r"[^/]+/\.\./", "")
    return F.transform(F.array(*map(F.lit, ("", ".js", ".ts", "/index.js", "/index.ts"))), lambda end: F.concat(plain, end))


def java_candidates(name: Column) -> Column:
    whole = F.replace(name, F.lit("."), F.lit("/"))
    outer = F.regexp_replace(whole, "/[^/]*$", "")  # a static import names a member
    roots = ("src/main/java/", "src/test/java/", "src/", "")
    return F.array(*(F.concat(F.lit(r), c, F.lit(".java")) for c in (whole, outer) for r in roots))


def candidates(path: Column, ext: Column, name: Column) -> Column:
    """Paths that an import may mean, best first; they begin with a slash if the file's own does."""
    found = F.when(ext == ".py", python_candidates(path, name)).when(ext == ".java", java_candidates(name)).otherwise(js_candidates(path, name))
    rooted = F.transform(found, lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)))
    return F.when(path.startswith("/"), rooted).otherwise(found)


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, target: the first candidate that exists, else import:<name>."""
    from ..sources.corpus import extension

    rows = imports.select("path", "name").distinct()
    tried = rows.select("path", "name", F.posexplode(candidates(F.col("path"), extension(F.col("path")), F.col("name"))).alias("pos", "target"))
    there = tried.join(files.select(F.col("path").alias("target")), "target")
    best = there.groupBy("path", "name").agg(F.min_by("target", "pos").alias("file"))
    out = rows.join(best, ["path", "name"], "left")
    return out.select("path", "name", F.coalesce(F.concat(F.lit("file:"), "file"), F.concat(F.lit("import:"), "name")).alias("target"))


def resolved_calls(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """path, name, target_path, start_line, cross_file: functions of that name
    in the same file, or else in all files."""
    known = defs.select(F.col("path").alias("target_path"), "name", "start_line")
    rows = calls.select("path", "name").distinct()
    same = rows.join(known, (rows.path == known.target_path) & (rows.name == known.name)).select(rows.path, rows.name, "target_path", "start_line")
    other = rows.join(same.select("path", "name").distinct(), ["path", "name"], "left_anti").join(known, "name")
    return same.withColumn("cross_file", F.lit(False)).unionByName(other.select("path", "name", "target_path", "start_line").withColumn("cross_file", F.lit(True)))


def related_files(imports: DataFrame, files: DataFrame, context: DataFrame, most: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Files that the imports (path, ext, at, name) of context files (path, pos)
    lead to and that are not in the context yet: path, rank, for each value of by."""
    wanted = imports.join(context.select(*by, "path", F.col("pos").alias("importer")), "path")
    name = F.col("name")
    wanted = wanted.filter(((F.col("ext") != ".py") | name.startswith(".") | is_project_module(name)) & ((F.col("ext") != ".java") | ~is_java_library(name)))
    tried = wanted.select(*by, "importer", "at", F.posexplode(candidates(F.col("path"), F.col("ext"), name)).alias("pos", "target"))
    there = tried.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    new = there.join(context.select(*by, F.col("path").alias("target")), [*by, "target"], "left_anti")
    first = new.groupBy(*by, F.col("target").alias("path")).agg(F.min(F.struct("importer", "at", "pos")).alias("first"))
    if not by:
        first = first.orderBy("first", "path").limit(most)
    order = Window.partitionBy(*by).orderBy("first", "path")  # without by, over the few rows of the limit
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(*by, "path", "rank")
