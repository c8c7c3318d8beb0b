"""Ranking of results and files, and summaries of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions.text import language_of
from ..sources.corpus import extension, first_files


def mean_distances(matches: DataFrame) -> DataFrame:
    """path, mean_distance between a file's successive matches (null for one match)."""
    order = Window.partitionBy("path").orderBy("line_number")
    gaps = matches.select("path", F.abs(F.col("line_number") - F.lag("line_number").over(order)).alias("gap"))
    return gaps.groupBy("path").agg(F.avg("gap").alias("mean_distance"))


def match_counts(matches: DataFrame) -> DataFrame:
    """path, n (matches), n_lines (different lines)."""
    return matches.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("line_number").alias("n_lines"))


def scored_results(matches: DataFrame, features: scores.Features) -> DataFrame:
    """path, line_number, score of matching lines: the file's relevance as if
    the match were its only one, times that of the line."""
    one = F.lit(1)
    score = scores.file_relevance(F.col("path"), features, one, one) * scores.snippet_relevance(F.col("line"), features)
    return matches.select("path", "line_number", score.alias("score"))


def rank_results(matches: DataFrame, features: scores.Features, most: int | None = None, digits: int = 6) -> DataFrame:
    """path, line_number, score (rounded), best first."""
    ranked = scored_results(matches, features).withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "path", "line_number")
    return ranked.limit(most) if most else ranked


def file_importance(files: DataFrame, matches: DataFrame, features: scores.Features) -> DataFrame:
    """path, importance: a file's relevance times 0.3 of the sum and 0.7 of the
    best score of its matches; without matches the relevance alone."""
    merged = scored_results(matches, features).groupBy("path").agg((F.sum("score") * 0.3 + F.max("score") * 0.7).alias("merged"))
    rows = files.select("path").join(match_counts(matches), "path", "left").fillna(0, ["n"]).fillna(1, ["n_lines"]).join(merged, "path", "left")
    score = scores.file_relevance(F.col("path"), features, F.col("n"), F.col("n_lines")) * F.coalesce("merged", F.lit(1.0))
    return rows.select("path", score.alias("importance"))


def strategy_summary(results: DataFrame, strategy: Column) -> DataFrame:
    """strategy (unknown where there is none), results."""
    return results.groupBy(F.coalesce(strategy, F.lit("unknown")).alias("strategy")).agg(F.count("*").alias("results"))


def context_metadata(packed: DataFrame) -> DataFrame:
    """file_count, has_partial_files, total_size of packed files."""
    return packed.agg(
        F.count("*").alias("file_count"), F.coalesce(F.bool_or("is_partial"), F.lit(False)).alias("has_partial_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )


def cache_lookups(lookups: DataFrame, by: str, hit: str, entry: str) -> DataFrame:
    """lookups, hits, hit_rate (percent) and different entries for each value of a column."""
    return lookups.groupBy(by).agg(
        F.count("*").alias("lookups"), F.sum(hit).alias("hits"), F.round(F.sum(hit) * 100.0 / F.count("*"), 6).alias("hit_rate"), F.countDistinct(entry).alias("entries")
    )


def debug_table(packed: DataFrame) -> DataFrame:
    """rank, path, matches, partial (Yes or No), size of packed files."""
    return packed.select("rank", "path", F.col("n_matches").alias("matches"), F.when(F.col("is_partial"), "Yes").otherwise("No").alias("partial"), "size")


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def project_types(files: DataFrame, project: str = "project", sample: int | None = None) -> DataFrame:
    """project, type, language, has_tests of each project's files (project,
    path): the first manifest at the project's root decides, else the endings
    (of its first files, if a sample is asked for)."""
    rank = {name: i for i, name in enumerate(fixed.MANIFESTS)}
    rows = files.withColumn("at", F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("path")))
    rows = rows.withColumn("ending", F.regexp_extract("path", r"\.([^./]+)$", 1))
    if sample:
        order = Window.partitionBy(project).orderBy("path")
        rows = rows.withColumn("sampled", F.row_number().over(order) <= sample)
    else:
        rows = rows.withColumn("sampled", F.lit(True))
    test = F.substring_index("path", "/", 1).isin(*fixed.TEST_FOLDERS) & F.col("path").contains("/")
    found = rows.groupBy(project).agg(
        F.min_by("path", "at").alias("manifest"), F.min("at").alias("at"), F.bool_or(test).alias("has_tests"),
        *(F.bool_or(F.col("sampled") & F.col("ending").isin(*endings)).alias(f"has_{name}") for endings, name in fixed.ENDING_TYPES),
    )
    by_ending = F.coalesce(*(F.when(F.col(f"has_{name}"), name) for _, name in fixed.ENDING_TYPES))
    manifest = F.when(F.col("at").isNotNull(), F.col("manifest"))
    return found.select(
        project,
        F.coalesce(_mapped(fixed.MANIFESTS, manifest), by_ending, F.lit("Unknown")).alias("type"),
        F.coalesce(_mapped(fixed.MANIFEST_LANGUAGES, manifest), by_ending, F.lit("Mixed")).alias("language"),
        "has_tests",
    )


def project_metadata(files: DataFrame, project: str = "project") -> DataFrame:
    """project, type, main_language by the short list of manifests, unknown without one."""
    rank = {name: i for i, name in enumerate(fixed.METADATA_MANIFESTS)}
    kinds = {name: kind for name, (kind, _) in fixed.METADATA_MANIFESTS.items()}
    languages = {name: language for name, (_, language) in fixed.METADATA_MANIFESTS.items()}
    at = F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("path"))
    found = files.withColumn("at", at).groupBy(project).agg(F.min_by("path", "at").alias("manifest"), F.min("at").alias("at"))
    manifest = F.when(F.col("at").isNotNull(), F.col("manifest"))
    return found.select(
        project, F.coalesce(_mapped(kinds, manifest), F.lit("unknown")).alias("type"), F.coalesce(_mapped(languages, manifest), F.lit("unknown")).alias("main_language")
    )


def languages_in_use(files: DataFrame, sample: int | None = 1000) -> DataFrame:
    """language, parsed: what the first files by path are written in; Python if nothing is known."""
    some = files.filter(extension(F.col("path")).isin(*fixed.ACTIVE_LANGUAGES))
    some = first_files(some, sample) if sample else some
    found = some.select(language_of(extension(F.col("path")), fixed.ACTIVE_LANGUAGES, None).alias("language")).distinct()
    return found.select("language", F.col("language").isin(*fixed.PARSED_LANGUAGES).alias("parsed"))
