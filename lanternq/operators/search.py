"""Line search over a corpus.

Patterns are known when a plan is made, so each is a literal of the plan that
is compiled once; one scan serves any number of them.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scores import path_score
from ..functions.text import stripped, symbol_patterns
from ..sources.corpus import extension, glob_regex, is_ignored

WORD_CHAR = r"[\p{L}\p{N}_]"


def effective(pattern: str, case_sensitive: bool = False, whole_word: bool = False, regex: bool = True) -> str:
    """The regular expression that a search runs."""
    out = pattern if regex else re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", pattern)
    if whole_word:
        out = f"(?<!{WORD_CHAR})(?:{out})(?!{WORD_CHAR})"
    return out if case_sensitive else f"(?i){out}"


def _inner(pattern: str) -> tuple[str, str]:
    flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    return flags, pattern.removeprefix("(?i)")


def first_column(line: Column, pattern: str) -> Column:
    """Bytes before the first match."""
    flags, inner = _inner(pattern)
    return F.octet_length(F.regexp_extract(line, f"{flags}^(.*?)(?:{inner})", 1)).cast("int")


def first_n_per_file(matches: DataFrame, most: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by, "path").orderBy("line_number")
    return matches.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def runnable(spark: SparkSession, patterns: list[str]) -> dict[str, bool]:
    """Whether each regular expression can be run.  A search with one that
    cannot finds nothing; the others of a question go on."""

    compiler = spark.sparkContext._jvm.java.util.regex.Pattern
    out = {}
    for pattern in patterns:
        try:
            compiler.compile(pattern)
            out[pattern] = True
        except PySparkException:
            out[pattern] = False
    return out


#: The one backend; there is no external program to choose.
PRIMARY_SEARCH_TOOL = "spark"


def ending_of_type(name: str) -> str:
    """The file ending of a type, given by name or as the ending itself."""
    return "." + fixed.FILE_TYPES.get(name.lower(), name).lstrip(".")


def search_text(
    lines: DataFrame,
    pattern: str,
    file_types: list[str] | None = None,
    max_results: int | None = 100,
    case_sensitive: bool = False,
    whole_word: bool = False,
    regex: bool = True,
) -> DataFrame:
    """Matching lines: path, line_number, line (stripped), column, match_count,
    score, search_tool; at most max_results of each file.

    column counts bytes of the line as it stands, before stripping.  A pattern
    that is no regular expression has no rows.
    """
    p = effective(pattern, case_sensitive, whole_word, regex)
    if not runnable(lines.sparkSession, [p])[p]:
        lines, p = lines.filter(F.lit(False)), ""
    if file_types:
        lines = lines.filter(extension(F.col("path")).isin(*map(ending_of_type, file_types)))
    hits = lines.filter(F.col("line").rlike(p))
    if max_results:
        hits = first_n_per_file(hits, max_results)
    return hits.select(
        *(c for c in lines.columns if c != "line"),
        stripped(F.col("line")).alias("line"),
        first_column(F.col("line"), p).alias("column"),
        F.regexp_count("line", F.lit(p)).cast("int").alias("match_count"),
        path_score(F.concat(F.lit("/"), "path")).alias("score"),
        F.lit(PRIMARY_SEARCH_TOOL).alias("search_tool"),
    )


def search_as_grep(lines: DataFrame, pattern: str, file_types: list[str] | None = None, max_results: int | None = 100, **options) -> DataFrame:
    """path, line_number, line: what a search gives without columns, counts and scores."""
    return search_text(lines, pattern, file_types, max_results, **options).select("path", "line_number", "line")


def search_as_ag(lines: DataFrame, pattern: str, file_types: list[str] | None = None, max_results: int | None = 100, **options) -> DataFrame:
    """path, line_number, line, column and score, which are constant."""
    return search_as_grep(lines, pattern, file_types, max_results, **options).select("*", F.lit(0).alias("column"), F.lit(1.0).alias("score"))


def search_patterns(lines: DataFrame, patterns: list[str], max_results: int = 100, case_sensitive: bool = False) -> DataFrame:
    """One scan for several patterns; a row for each (pattern, line).  One that
    is no regular expression has no rows."""
    usable = runnable(lines.sparkSession, [effective(p, case_sensitive) for p in patterns])
    tried = [(k, p) for k, p in enumerate(patterns) if usable[effective(p, case_sensitive)]]
    if not tried:
        return lines.withColumn("rank", F.lit(0)).withColumn("pattern", F.lit(None).cast("string")).filter(F.lit(False))
    hit = F.array(*(F.when(F.col("line").rlike(effective(p, case_sensitive)), F.struct(F.lit(k).alias("rank"), F.lit(p).alias("pattern"))) for k, p in tried))
    rows = lines.select("*", F.explode(F.array_compact(hit)).alias("hit")).select(*lines.columns, "hit.rank", "hit.pattern")
    return first_n_per_file(rows, max_results, "pattern")


def search_fuzzy(lines: DataFrame, word: str, most_edits: int = 1, max_results: int = 100) -> DataFrame:
    """Lines with a word that a few edits turn into the one asked for (an extension)."""
    near = F.exists(F.regexp_extract_all(F.lower("line"), F.lit(f"{WORD_CHAR}+"), F.lit(0)), lambda w: F.levenshtein(w, F.lit(word.lower()), most_edits) >= 0)
    return first_n_per_file(lines.filter(near), max_results)


def search_symbols(lines: DataFrame, name: str, kind: str | None = None, most: int = 20) -> DataFrame:
    """Lines that look like the definition of a name."""
    return search_patterns(lines, symbol_patterns(name, kind), most)


def initial_search(
    lines: DataFrame, keywords: list[str], most_per_file: int = 50, most: int = 100, searched: int = 5, case_sensitive: bool = False
) -> DataFrame:
    """The best lines for a question's keywords.

    The first few keywords are searched as patterns; a line belongs to the
    first that finds it; all keywords count as literals for hits.  The top
    lines by hits are then ordered by path score.
    """
    hits = sum((F.lower("line").contains(k.lower()).cast("int") for k in keywords), F.lit(0))
    found = search_patterns(lines, keywords[:searched], most_per_file, case_sensitive)
    first = Window.partitionBy("path", "line_number").orderBy("rank")
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    found = found.withColumn("hits", hits).withColumn("score", path_score(F.concat(F.lit("/"), "path")))
    arrival = ("rank", F.desc("score"), "path", "line_number")
    top = found.orderBy(F.desc("hits"), *arrival).limit(most)
    column = F.lit(None).cast("int")
    count = F.lit(None).cast("int")
    patterns = [effective(word, case_sensitive) for word in keywords[:searched]]
    usable = runnable(lines.sparkSession, patterns)
    for k, p in enumerate(patterns):
        if not usable[p]:
            continue
        column = F.when(F.col("rank") == k, first_column(F.col("line"), p)).otherwise(column)
        count = F.when(F.col("rank") == k, F.regexp_count("line", F.lit(p)).cast("int")).otherwise(count)
    return top.select(
        "path", "line_number", stripped(F.col("line")).alias("line"), column.alias("column"), count.alias("match_count"), "score", "hits",
        F.col("rank").alias("keyword_rank"), F.col("pattern").alias("keyword"), F.lit("spark").alias("search_tool"),
    )


def merge_results(keyword_hits: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """Both lists by path and line, where the keyword hit counts, best scores
    first, then most hits; missing scores count as zero."""
    both = keyword_hits.withColumn("origin", F.lit(0)).unionByName(semantic_hits.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy("path", "line_number").orderBy("origin")
    out = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumn("score", F.coalesce("score", F.lit(0.0)))
    hits = F.desc_nulls_last("hits") if "hits" in out.columns else F.asc("origin")
    return out.orderBy(F.desc("score"), hits, "origin", "path", "line_number")


def file_context(lines: DataFrame, targets: DataFrame, around: int = 5) -> DataFrame:
    """The lines around each target (path, line_number): an equi-join on the
    window's line numbers, not a range join."""
    wanted = targets.select("path", F.col("line_number").alias("target_line")).distinct()
    wanted = wanted.select("path", "target_line", F.explode(F.sequence(F.greatest(F.lit(1), F.col("target_line") - around), F.col("target_line") + around)).alias("line_number"))
    out = wanted.join(lines, ["path", "line_number"])
    return out.select("path", "target_line", "line_number", "line", (F.col("line_number") == F.col("target_line")).alias("is_target"))


def find_files(files: DataFrame, pattern: str, syntax: str = "regex", extensions: list[str] | None = None, ignores: list[str] | None = None) -> DataFrame:
    """Files whose name matches a regular expression or a glob."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    out = files.filter(name.rlike(pattern if syntax == "regex" else f"^{glob_regex(pattern)}$"))
    if extensions:
        out = out.filter(extension(F.col("path")).isin(extensions))
    return out.filter(~is_ignored(F.col("path"), ignores)) if ignores else out


def decode_grep(rows: DataFrame, column: str = "raw") -> DataFrame:
    """path, line_number, line of ``path:line:text`` rows; others go."""
    part = lambda k: F.regexp_extract(column, fixed.GREP_LINE, k)
    return rows.filter(F.col(column).rlike(fixed.GREP_LINE)).select(part(1).alias("path"), part(2).cast("int").alias("line_number"), stripped(part(3)).alias("line"))


def decode_ag(rows: DataFrame, column: str = "raw") -> DataFrame:
    """As ``decode_grep``, with a constant column and score."""
    return decode_grep(rows, column).select("*", F.lit(0).alias("column"), F.lit(1.0).alias("score"))


RG_SCHEMA = (
    "type string, data struct<path:struct<text:string>,line_number:int,lines:struct<text:string>,submatches:array<struct<start:int,`end`:int>>>"
)


def decode_rg_json(rows: DataFrame, column: str = "raw") -> DataFrame:
    """The match rows of a JSON-lines search log; rows that cannot be read go."""
    d = F.from_json(column, RG_SCHEMA)
    out = rows.select(d.alias("d")).filter("d.type = 'match' and d.data.path.text is not null and d.data.lines.text is not null")
    return out.select(
        F.col("d.data.path.text").alias("path"),
        F.col("d.data.line_number").alias("line_number"),
        stripped(F.col("d.data.lines.text")).alias("line"),
        F.coalesce(F.get("d.data.submatches", F.lit(0))["start"], F.lit(0)).alias("column"),
        path_score(F.concat(F.lit("/"), "d.data.path.text")).alias("score"),
        F.greatest(F.size("d.data.submatches"), F.lit(0)).alias("match_count"),
    )
