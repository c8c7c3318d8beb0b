"""Queries on questions, lines and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import search
from ..sources.corpus import glob_regex
from .shared import (
    CORPUS, KEYWORDS, LINES, PATTERN, column_sql, files, lines, match_columns, path_score_sql, quoted, strip_sql, table, words,
)

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'")


def _user_words(stops: list[str]) -> str:
    ids = f"list_filter(regexp_extract_all(text, '{fixed.IDENTIFIER}'), lambda w: length(w) > 2 AND NOT list_contains([{words(stops)}], lower(w)))"
    every = f"list_concat({ids}, regexp_extract_all(text, {quoted(fixed.QUOTED)}, 1))"
    return f"array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i), '|')"


@query(f"WITH {LINES} SELECT path, line_number, line FROM lines")
def line_explode(spark, sf_dir):
    return lines(spark, sf_dir)


@query(f"SELECT conv_id, turn, {_user_words(fixed.KEYWORD_STOPS)} AS keywords FROM conversations WHERE role = 'user'")
def keyword_extract(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), "|").alias("keywords"))


@query(f"SELECT conv_id, turn, {_user_words(fixed.TERM_STOPS)} AS key_terms FROM conversations WHERE role = 'user'")
def key_terms(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(text.key_terms(F.col("text")), "|").alias("key_terms"))


_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: NOT list_contains([{words(fixed.FEATURE_STOPS)}], t))"
_WHOLE = f"list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '{fixed.IDENTIFIER}'))"


@query(f"""
    SELECT conv_id, turn, array_to_string({_TOKENS}, '|') AS tokens,
           array_to_string(list_filter({_TOKENS}, lambda t: list_contains([{words(fixed.TECHNICAL_TERMS)}], t)), '|') AS technical_tokens,
           array_to_string({_WHOLE}, '|') AS identifiers,
           array_to_string(regexp_extract_all(text, {quoted(fixed.QUOTED)}, 1), '|') AS quoted, CAST(len({_TOKENS}) AS INTEGER) AS token_count
    FROM conversations WHERE role = 'user'""")
def query_features(spark, sf_dir):
    rows = _questions(spark, sf_dir).select("conv_id", "turn", text.query_features(F.col("text")).alias("f"))
    joined = [F.array_join(f"f.{c}", "|").alias(c) for c in ("tokens", "technical_tokens", "identifiers", "quoted")]
    return rows.select("conv_id", "turn", *joined, F.col("f.token_count").alias("token_count"))


@query(f"WITH {LINES} SELECT path, line_number, {match_columns(PATTERN)} FROM lines WHERE regexp_matches(line, '(?i){PATTERN}')")
def search_regex_ci(spark, sf_dir):
    found = search.search_text(lines(spark, sf_dir), PATTERN, max_results=None)
    return found.withColumn("score", F.round("score", 6)).drop("search_tool")


@query(f"WITH {LINES} SELECT path, line_number, {match_columns('The', '(?s)')} FROM lines WHERE regexp_matches(line, 'The')")
def search_case_sensitive(spark, sf_dir):
    found = search.search_text(lines(spark, sf_dir), "The", max_results=None, case_sensitive=True)
    return found.withColumn("score", F.round("score", 6)).drop("search_tool")


@query(rf"""WITH {LINES} SELECT path, line_number, {strip_sql("line")} AS line FROM lines
    WHERE regexp_matches(line, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:on)($|[^\p{{L}}\p{{N}}_])')""")
def search_whole_word(spark, sf_dir):
    return search.search_text(lines(spark, sf_dir), "on", max_results=None, whole_word=True).select("path", "line_number", "line")


@query(f"WITH {LINES} SELECT path, line_number, {match_columns(chr(92) + '. A')} FROM lines WHERE contains(lower(line), '. a')")
def search_fixed(spark, sf_dir):
    found = search.search_text(lines(spark, sf_dir), ". A", max_results=None, regex=False)
    return found.withColumn("score", F.round("score", 6)).drop("search_tool")


@query(f"WITH {LINES} SELECT path, line_number, {match_columns('an')} FROM lines WHERE regexp_matches(line, '(?i)an') AND (path LIKE '%.py' OR path LIKE '%.js')")
def search_file_types(spark, sf_dir):
    found = search.search_text(lines(spark, sf_dir), "an", file_types=["py", "js"], max_results=None)
    return found.withColumn("score", F.round("score", 6)).drop("search_tool")


@query(f"""WITH {LINES} SELECT path, line_number, {strip_sql("line")} AS line FROM lines WHERE regexp_matches(line, '(?i)th')
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 3""")
def search_cap_per_file(spark, sf_dir):
    return search.search_text(lines(spark, sf_dir), "th", max_results=3).select("path", "line_number", "line")


_PATTERNS = ["threre", "queel+", "achge[a-z]*n"]


@query(f"""WITH {LINES}, p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(p)})" for i, p in enumerate(_PATTERNS))}) v(rank, pattern))
    SELECT path, line_number, line, CAST(rank AS INTEGER) AS rank, pattern FROM lines JOIN p ON regexp_matches(line, '(?i)' || pattern)
    QUALIFY row_number() OVER (PARTITION BY pattern, path ORDER BY line_number) <= 100""")
def search_multi_pattern(spark, sf_dir):
    return search.search_patterns(lines(spark, sf_dir), _PATTERNS)


@query(f"""WITH {LINES} SELECT path, line_number, {column_sql("line", "an")} AS "column",
    CAST(len(regexp_extract_all(line, '(?i)an')) AS INTEGER) AS match_count FROM lines WHERE regexp_matches(line, '(?i)an')""")
def match_columns_counts(spark, sf_dir):
    return search.search_text(lines(spark, sf_dir), "an", max_results=None).select("path", "line_number", "column", "match_count")


@query(f"WITH {CORPUS} SELECT path, round({path_score_sql('path')}, 6) AS score FROM corpus")
def path_score(spark, sf_dir):
    from ..functions.scores import path_score as score

    return files(spark, sf_dir).select("path", F.round(score(F.concat(F.lit("/"), "path")), 6).alias("score"))


_VALUES = ", ".join(f"({i}, {quoted(k)})" for i, k in enumerate(KEYWORDS[:5]))
_HITS = " + ".join(f"CAST(contains(lower(line), {quoted(k)}) AS INTEGER)" for k in KEYWORDS)
TOP = f"""
kw AS (SELECT * FROM (VALUES {_VALUES}) v(rank, keyword)),
found AS (SELECT path, line_number, line, rank, keyword FROM lines JOIN kw ON regexp_matches(line, '(?i)' || keyword)
          QUALIFY row_number() OVER (PARTITION BY keyword, path ORDER BY line_number) <= 50),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY path, line_number ORDER BY rank) = 1),
scored AS (SELECT *, {_HITS} AS hits, {path_score_sql("path")} AS score FROM firsts),
top AS (SELECT * FROM scored ORDER BY hits DESC, rank, score DESC, path, line_number LIMIT 100)"""


def top_matches(spark, sf_dir):
    return search.initial_search(lines(spark, sf_dir), KEYWORDS)


@query(f"""WITH {LINES}, {TOP} SELECT path, line_number, {strip_sql("line")} AS line,
    CAST(strlen(regexp_extract(line, '(?is)^(.*?)(?:' || keyword || ')', 1)) AS INTEGER) AS "column",
    CAST(len(regexp_extract_all(line, '(?i)' || keyword)) AS INTEGER) AS match_count, round(score, 6) AS score, CAST(hits AS INTEGER) AS hits,
    CAST(rank AS INTEGER) AS keyword_rank, keyword FROM top""")
def initial_search_top100(spark, sf_dir):
    return top_matches(spark, sf_dir).withColumn("score", F.round("score", 6)).drop("search_tool")


@query(f"""WITH {LINES}, {TOP}, sem AS (SELECT path, line_number FROM lines WHERE regexp_matches(line, '(?i)threre')),
    both_lists AS (SELECT path, line_number, NULL AS score, 1 AS origin FROM sem UNION ALL SELECT path, line_number, score, 0 FROM top)
    SELECT path, line_number, round(coalesce(CAST(score AS DOUBLE), 0.0), 6) AS score, CAST(origin AS INTEGER) AS origin FROM both_lists
    QUALIFY row_number() OVER (PARTITION BY path, line_number ORDER BY origin) = 1""")
def merge_results(spark, sf_dir):
    semantic = lines(spark, sf_dir).filter(F.col("line").rlike("(?i)threre")).select("path", "line_number").withColumn("score", F.lit(None).cast("double"))
    merged = search.merge_results(top_matches(spark, sf_dir).select("path", "line_number", "score"), semantic)
    return merged.select("path", "line_number", F.round("score", 6).alias("score"), "origin")


@query(f"""WITH {LINES}, t AS (SELECT DISTINCT path, line_number AS target_line FROM lines WHERE regexp_matches(line, '(?i)threre'))
    SELECT l.path, target_line, line_number, line, line_number = target_line AS is_target
    FROM t JOIN lines l ON l.path = t.path AND line_number BETWEEN target_line - 2 AND target_line + 2""")
def file_context_band(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return search.file_context(rows, rows.filter(F.col("line").rlike("(?i)threre")), 2)


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '1[0-9]*5')")
def find_files_regex(spark, sf_dir):
    return search.find_files(files(spark, sf_dir), "1[0-9]*5").select("path")


_GLOB = "doc_?1*.py"


@query(f"""WITH {CORPUS} SELECT path FROM corpus WHERE regexp_full_match(regexp_extract(path, '([^/]*)$', 1), {quoted(glob_regex(_GLOB))})
    AND NOT regexp_matches(path, '(^|/)docs(/|$)')""")
def find_files_glob(spark, sf_dir):
    return search.find_files(files(spark, sf_dir), _GLOB, syntax="glob", ignores=["docs"]).select("path")


@query(f"""WITH {LINES}, raw AS (SELECT path || ':' || line_number || ':' || line AS raw FROM lines)
    SELECT regexp_extract(raw, '{fixed.GREP_LINE}', 1) AS path, CAST(regexp_extract(raw, '{fixed.GREP_LINE}', 2) AS INTEGER) AS line_number,
    {strip_sql(f"regexp_extract(raw, '{fixed.GREP_LINE}', 3)")} AS line FROM raw WHERE regexp_matches(raw, '{fixed.GREP_LINE}')""")
def grep_line_decode(spark, sf_dir):
    raw = lines(spark, sf_dir).select(F.concat_ws(":", "path", "line_number", "line").alias("raw"))
    return search.decode_grep(raw)


@query(f"""WITH {LINES} SELECT count(DISTINCT path) AS unique_files, count(*) AS matches, sum(len(regexp_extract_all(line, '(?i){PATTERN}')))::BIGINT AS occurrences
    FROM lines WHERE regexp_matches(line, '(?i){PATTERN}')""")
def unique_files_stats(spark, sf_dir):
    found = search.search_text(lines(spark, sf_dir), PATTERN, max_results=None)
    return found.agg(F.countDistinct("path").alias("unique_files"), F.count("*").alias("matches"), F.sum("match_count").alias("occurrences"))


@query(f"""WITH {LINES} SELECT path, count(*) AS n_matches, min(line_number) AS first_line, string_agg(line_number, ',' ORDER BY line_number) AS line_numbers
    FROM lines WHERE regexp_matches(line, '(?i){PATTERN}') GROUP BY path""")
def group_by_file(spark, sf_dir):
    found = search.search_text(lines(spark, sf_dir), PATTERN, max_results=None)
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("line_number")), lambda n: n.cast("string")), ",")
    return found.groupBy("path").agg(F.count("*").alias("n_matches"), F.min("line_number").alias("first_line"), numbers.alias("line_numbers"))


@query(f"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(regexp_replace({strip_sql("text")}, '\\s+', ' ', 'g')) // 4) END AS tokens,
    greatest(1, n_chars // 4) AS max_tokens FROM documents""")
def token_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), text.max_tokens(F.col("n_chars")).alias("max_tokens"))


@query("""WITH a AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), '')) AS x, list_distinct(string_split('steel', '')) AS y FROM part)
    SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a""")
def char_jaccard(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.round(text.character_jaccard(F.col("p_name"), F.lit("steel")), 6).alias("jaccard"))
