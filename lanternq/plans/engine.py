"""Questions end to end: search, structure, related files, packing, prompt."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import fixed
from ..functions.text import language_of
from ..operators import graph, pack, search, structure
from ..operators.graph import saved
from ..sources.corpus import extension, graph_files, lines
from .cache import Cache, corpus_state, key_of
from .progress import StepLog
from .prompt import prompt


def question_keywords(question: str) -> list[str]:
    """What ``functions.text.keywords`` gives, for one question on the driver."""
    plain = [w for w in re.findall(fixed.IDENTIFIER, question) if len(w) > 2 and w.lower() not in fixed.KEYWORD_STOPS]
    return list(dict.fromkeys(plain + re.findall(fixed.QUOTED, question)))


def question_terms(question: str) -> list[str]:
    """What ``functions.text.key_terms`` gives, for one question on the driver."""
    plain = [w for w in re.findall(fixed.IDENTIFIER, question) if len(w) > 2 and w.lower() not in fixed.TERM_STOPS]
    return list(dict.fromkeys(plain + re.findall(fixed.QUOTED, question)))


#: A map as young as this is taken without a look at the files.
MAP_GRACE_SECONDS = 300


def code_map(files: DataFrame, cache: Cache | None = None, log: StepLog | None = None, force: bool = False, grace: float = MAP_GRACE_SECONDS, project: str = "") -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a corpus; with a cache, those stored for its present
    state.  project tells corpora apart that share a cache: a young map is taken
    without a look at the files."""
    log = log or StepLog()

    def build() -> tuple[DataFrame, DataFrame]:
        with log.step("scan"):
            held = graph_files(files)
        with log.step("parse"):
            parsed = saved(structure.structure(held))
            functions, classes = structure.functions(parsed), structure.classes(parsed)
            imports, calls = structure.dependencies(held, parsed)
        with log.step("resolve"):
            imports, targets = structure.resolved_imports(imports, held), saved(structure.resolved_calls(calls, functions))
        with log.step("graph"):
            nodes = saved(graph.nodes(held, functions, classes, imports))
            every = graph.with_function_calls(graph.edges(functions, classes, imports, targets), calls, targets, functions)
            return nodes, saved(graph.with_ends(every, nodes))

    if cache is None:
        return build()
    kind = f"map:{project}" if project else "map"
    key = None if force else cache.latest(f"{kind}:nodes", grace)
    key = key.removesuffix("-nodes") if key else key_of("map", project=project, state=corpus_state(files))
    nodes, edges = (None, None) if force else (cache.get(f"{key}-nodes"), cache.get(f"{key}-edges"))
    if nodes is None or edges is None:
        for name, rows in zip(("nodes", "edges"), build()):
            cache.put(f"{key}-{name}", rows, f"{kind}:{name}")
        nodes, edges = (cache.spark.read.parquet(f"{cache.folder}/data/{key}-{name}") for name in ("nodes", "edges"))
    return nodes, edges


def semantic_hits(nodes: DataFrame, question: str, per_term: int = 10) -> DataFrame | None:
    """path, line_number, score, excerpt of the definitions that a question's terms name."""
    terms = question_terms(question)
    if not terms:
        return None
    best = graph.term_search(nodes, terms, per_term).groupBy("id").agg(F.max("relevance").alias("score"))
    places = best.join(nodes.select("id", "path", "start_line", graph.excerpt(F.col("code")).alias("excerpt")), "id").filter("path is not null and start_line is not null")
    return places.groupBy("path", F.col("start_line").alias("line_number")).agg(F.max("score").alias("score"), F.max_by("excerpt", "score").alias("excerpt"))


def keyword_hits(files: DataFrame, keywords: list[str], config: Config) -> DataFrame:
    """path, line_number, score, hits, keyword_rank of the best lines; with
    fuzzy_search also of lines with a word that is nearly a keyword."""
    # A file without any keyword has no line to split off.
    usable = search.runnable(files.sparkSession, [search.effective(k, config.case_sensitive) for k in keywords[: config.max_searched_keywords]])
    wanted = [p for p, good in usable.items() if good]
    some = files.filter(F.col("content").rlike("(?m)" + "|".join(f"(?:{w})" for w in wanted))) if wanted and not config.fuzzy_search else files
    every_line = lines(some)
    columns = ["path", "line_number", "score", "hits", "keyword_rank"]
    found = search.initial_search(
        every_line, keywords, config.max_results_per_keyword, config.max_search_results, config.max_searched_keywords, config.case_sensitive
    ).select(*columns)
    if config.fuzzy_search:
        words = [k for k in keywords[: config.max_searched_keywords] if re.fullmatch(fixed.IDENTIFIER, k)]
        for k, word in enumerate(words):
            near = search.search_fuzzy(every_line, word, 1, config.max_results_per_keyword)
            near = near.select("path", "line_number", F.lit(0.0).alias("score"), F.lit(0).alias("hits"), F.lit(config.max_searched_keywords + k).alias("keyword_rank"))
            found = search.merge_results(found, near).select(*columns)
        found = found.orderBy(F.desc("hits"), "keyword_rank", F.desc("score"), "path", "line_number").limit(config.max_search_results)
    return found


def context(
    files: DataFrame,
    question: str,
    config: Config = Config(),
    semantic_hits: DataFrame | None = None,
    cache: Cache | None = None,
    log: StepLog | None = None,
) -> DataFrame:
    """The packed files for a question: path, language, rank, n_matches,
    is_partial, size, content.  files has path, ext and content.

    Only the matched and the related files (a bounded number) are rendered;
    contents are read again for them by a semi-join.  With a cache, the
    keyword hits and the whole context are kept for the files' present state.
    """
    log = log or StepLog()
    if cache is not None:
        state = corpus_state(files)
        settings = {k: v for k, v in vars(config).items() if k != "cache_ttl_seconds"}
        key = key_of("context", question=question, state=state, semantic=semantic_hits is not None, **settings)
        return cache.kept(key, "context", lambda: _context(files, question, config, semantic_hits, cache, log, state))
    return _context(files, question, config, semantic_hits, None, log, "")


def _context(files: DataFrame, question: str, config: Config, semantic_hits: DataFrame | None, cache: Cache | None, log: StepLog, state: str) -> DataFrame:
    with log.step("keywords") as step:
        keywords = question_keywords(question)
        step.details["keywords"] = keywords
    with log.step("search"):
        if cache is not None:
            patterns = [config.case_sensitive, config.fuzzy_search, config.max_results_per_keyword, config.max_search_results, config.max_searched_keywords]
            key = key_of("search", query="\n".join(keywords), state=state, options=str(patterns))
            matches = cache.kept(key, "search", lambda: keyword_hits(files, keywords, config))
        else:
            matches = keyword_hits(files, keywords, config)
        if semantic_hits is not None:
            matches = search.merge_results(matches, semantic_hits.drop("excerpt"))
        matches = saved(matches.select("path", "line_number", "score", "hits", "keyword_rank"))
    by_file = matches.groupBy("path").agg(
        F.count("*").alias("n_matches"), F.max(F.struct("score", "hits", F.negative("keyword_rank"), F.negative("line_number"))).alias("best")
    )
    found = by_file.select("path", "n_matches", F.row_number().over(Window.orderBy(F.desc("best"), "path")).alias("pos"))
    found = saved(found)

    log.start("structure")
    held = saved(files.join(F.broadcast(found.select("path")), "path", "left_semi").select("path", "ext", "content"))  # as many paths as results are kept, and ten a term
    parsed = structure.structure(held)
    spans = parsed.filter(F.col("kind").isin("function", "constructor", "class")).select("path", "start_line", "end_line")
    log.complete("structure")
    log.start("related")
    related = structure.related_files(structure.context_imports(held), files.select("path"), found, config.max_related_files)
    chosen = saved(
        found.select("path", "n_matches", "pos", F.lit(False).alias("is_related")).unionByName(
            related.select("path", F.lit(0).cast("long").alias("n_matches"), F.col("rank").alias("pos"), F.lit(True).alias("is_related"))
        )
    )
    log.complete("related")
    log.start("packing")
    ranked = pack.tiers(chosen.withColumn("n_definitions", F.lit(0)))

    texts = files.join(F.broadcast(chosen.select("path")), "path", "left_semi").select("path", "ext", "content")
    own_lines = saved(lines(texts))
    sizes = own_lines.groupBy("path").agg(F.max("line_number").alias("n_lines"))
    important = pack.important_lines(matches, spans, own_lines)
    ranges = pack.merged_ranges(pack.windows(matches, sizes, config.partial_window))
    full = saved(pack.rendered_full(own_lines, important))
    partial = saved(pack.rendered_partial(own_lines, matches, ranges))
    length = lambda rows, name: rows.select("path", F.length("content").alias(name))
    items = ranked.join(length(full, "full_size"), "path", "left").join(length(partial, "partial_size"), "path", "left").fillna(0, ["full_size", "partial_size"])
    taken = pack.packed(items, config.max_context_size, config.context_buffer)
    log.complete("packing")
    both = full.withColumn("is_partial", F.lit(False)).unionByName(partial.withColumn("is_partial", F.lit(True)))
    out = taken.join(both, ["path", "is_partial"], "left").join(chosen.select("path", "n_matches"), "path")
    return out.select(
        "path", language_of(extension(F.col("path"))).alias("language"), "rank", "n_matches", "is_partial", "size", F.coalesce("content", F.lit("")).alias("content")
    )


def ask(files: DataFrame, question: str, config: Config = Config(), cache: Cache | None = None, log: StepLog | None = None, project: str = "") -> DataFrame:
    """One row: question, prompt."""
    hits = semantic_hits(code_map(files, cache, log, project=project)[0], question) if config.semantic_analysis else None
    packed = context(files, question, config, hits, cache, log)
    return prompt(packed, question, question_keywords(question)).select(F.lit(question).alias("question"), "prompt")
