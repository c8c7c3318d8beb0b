"""Tables, questions and SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from ..sources import corpus

QUESTION = 'How does "this was" relate to that from others?'
KEYWORDS = ["this", "was", "relate", "that", "from", "others", "this was"]
PATTERN = "t[hr]e+[a-z]*n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_corpus(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines(files(spark, sf_dir))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return ", ".join(map(quoted, items))


def _pick(names: tuple[str, ...], by: int) -> str:
    return f"list_extract([{words(list(names))}], CAST(doc_id % {by} + 1 AS BIGINT))"


CORPUS = f"""
corpus AS (
    SELECT doc_id, {_pick(corpus.FOLDERS, 6)} || '/' || source || '/doc_' || doc_id || {_pick(corpus.ENDINGS, 5)} AS path,
           {_pick(corpus.ENDINGS, 5)} AS ext, text AS content
    FROM documents
)"""


def lines_of(source: str, name: str = "lines") -> str:
    """SQL for the lines of a relation with path and content."""
    return f"""
{name}_parts AS (SELECT path, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM {source}),
{name}_kept AS (SELECT path, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM {name}_parts),
{name} AS (SELECT path, CAST(i AS INTEGER) AS line_number, parts[i] AS line FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM {name}_kept))"""


LINES = CORPUS + "," + lines_of("corpus")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def right_strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\s+$', '')"


def column_sql(line: str, pattern: str, flags: str = "(?is)") -> str:
    return f"CAST(strlen(regexp_extract({line}, {quoted(f'{flags}^(.*?)(?:{pattern})')}, 1)) AS INTEGER)"


def path_score_sql(path: str) -> str:
    p = f"('/' || {path})"
    ends = lambda xs: " OR ".join(f"ends_with({p}, {quoted(x)})" for x in xs)
    return (
        f"(CAST(CASE WHEN {ends(fixed.BOOSTED_ENDINGS)} THEN 1.2 ELSE 1.0 END AS DOUBLE)"
        f" * CAST(CASE WHEN contains({p}, '/src/') OR contains({p}, '/lib/') THEN 1.1 ELSE 1.0 END AS DOUBLE)"
        f" * CAST(CASE WHEN contains({p}, '/test/') OR {ends(fixed.TEST_ENDINGS)} THEN 0.8 ELSE 1.0 END AS DOUBLE))"
    )


def match_columns(pattern: str, flags: str = "(?is)") -> str:
    count = f"CAST(len(regexp_extract_all(line, {quoted(flags + '(?:' + pattern + ')')})) AS INTEGER)"
    return f"{strip_sql('line')} AS line, {column_sql('line', pattern, flags)} AS \"column\", {count} AS match_count, round({path_score_sql('path')}, 6) AS score"


# -- the code corpus in SQL -----------------------------------------------


def _filled(template: str, **columns: str) -> str:
    out = quoted(template)
    for name, column in columns.items():
        out = f"replace({out}, '{{{name}}}', CAST({column} AS VARCHAR))"
    return out


CODE = f"""
nat AS (SELECT n_nationkey, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) AS n FROM nation),
sup AS (SELECT s_suppkey AS k, n FROM supplier JOIN nat ON s_nationkey = n_nationkey),
code AS (
    SELECT 'src/s_' || k || '.py' AS path, '.py' AS ext, {_filled(corpus.SUPPLIER_FILE, k="k", n="n")} AS content FROM sup
    UNION ALL SELECT 'src/n_' || n || '.py', '.py', {_filled(corpus.NATION_FILE, n="n")} FROM nat
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', '.java', {_filled(corpus.JAVA_FILE, k="p_partkey", s="p_size")} FROM part
    UNION ALL SELECT 'web/p' || p_partkey || '.js', '.js', {_filled(corpus.JS_FILE, k="p_partkey", s="p_size")} FROM part
)"""
# What the parser must find, in closed form.
DEFINITIONS = CODE + """,
funcs AS (
    SELECT 'src/s_' || k || '.py' AS path, 'f_' || k AS name, 'function' AS type, 3 AS start_line, 5 AS end_line FROM sup
    UNION ALL SELECT 'src/s_' || k || '.py', 'm_' || k, 'function', 8, 9 FROM sup
    UNION ALL SELECT 'src/n_' || n || '.py', 'g_' || n, 'function', 1, 2 FROM nat
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'P' || p_partkey, 'constructor', 7, 9 FROM part
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'price' || p_partkey, 'function', 10, 12 FROM part
),
cls AS (
    SELECT 'src/s_' || k || '.py' AS path, 'C_' || k AS name, 7 AS start_line, 9 AS end_line FROM sup
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'P' || p_partkey, 6, 13 FROM part
)"""
IMPORTS = """
imports AS (
    SELECT 'src/s_' || k || '.py' AS path, 'n_' || n AS name FROM sup
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'java.util.List' FROM part
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'app.P' || p_size FROM part
    UNION ALL SELECT 'web/p' || p_partkey || '.js', './p' || p_size FROM part
    UNION ALL SELECT 'web/p' || p_partkey || '.js', 'lib' || p_size FROM part
),
calls AS (
    SELECT 'src/s_' || k || '.py' AS path, 'g_' || n AS name, 5 AS line FROM sup
    UNION ALL SELECT 'src/s_' || k || '.py', 'f_' || k, 9 FROM sup
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', unnest(['P' || p_partkey, 'reset', 'price' || p_partkey, 'price' || p_size]), 0 FROM part
    UNION ALL SELECT 'web/p' || p_partkey || '.js', unnest(['require', 'show' || p_partkey, 'render']), 0 FROM part
)"""
TARGETS = """
targets AS (
    SELECT DISTINCT i.path, i.name, coalesce('file:' || c.path, 'import:' || i.name) AS target
    FROM imports i LEFT JOIN code c ON c.path = CASE
        WHEN i.path LIKE '%.py' THEN 'src/' || i.name || '.py'
        WHEN i.path LIKE '%.java' THEN 'src/main/java/' || replace(i.name, '.', '/') || '.java'
        WHEN i.name LIKE './%' THEN 'web/' || substr(i.name, 3) || '.js' END
),
distinct_calls AS (SELECT DISTINCT path, name FROM calls),
same_file AS (SELECT c.path, c.name, f.path AS target_path, f.start_line FROM distinct_calls c JOIN funcs f ON c.path = f.path AND c.name = f.name),
call_targets AS (
    SELECT *, false AS cross_file FROM same_file
    UNION ALL
    SELECT c.path, c.name, f.path, f.start_line, true FROM distinct_calls c JOIN funcs f ON c.name = f.name
    WHERE (c.path, c.name) NOT IN (SELECT path, name FROM same_file)
)"""
GRAPH = """
g_nodes AS (
    SELECT 'file:' || path AS id, 'file' AS type, regexp_extract(path, '([^/]*)$', 1) AS name, path, NULL::INTEGER AS start_line, NULL::INTEGER AS end_line FROM code
    UNION ALL SELECT 'func:' || path || ':' || name || ':' || start_line, 'function', name, path, start_line, end_line FROM funcs
    UNION ALL SELECT 'class:' || path || ':' || name || ':' || start_line, 'class', name, path, start_line, end_line FROM cls
    UNION ALL SELECT DISTINCT target, 'import', name, NULL, NULL, NULL FROM targets WHERE target LIKE 'import:%'
),
g_edges AS (
    SELECT 'file:' || path AS source, 'func:' || path || ':' || name || ':' || start_line AS target, 'contains' AS type, name FROM funcs
    UNION ALL SELECT 'file:' || path, 'class:' || path || ':' || name || ':' || start_line, 'contains', name FROM cls
    UNION ALL SELECT 'file:' || path, target, 'imports', name FROM targets
    UNION ALL SELECT 'file:' || path, 'func:' || target_path || ':' || name || ':' || start_line, 'calls', name FROM call_targets
)"""
CODE_GRAPH = "WITH RECURSIVE " + DEFINITIONS + "," + IMPORTS + "," + TARGETS + "," + GRAPH
