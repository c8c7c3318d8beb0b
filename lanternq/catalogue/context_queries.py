"""Queries on ranges, rendering, ranking, packing, prompts and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import fixed, scores, text
from ..operators import pack, rank, structure
from ..plans import cache, engine, prompt
from ..sources import corpus
from .shared import (
    CORPUS, DEFINITIONS, KEYWORDS, LINES, PATTERN, QUESTION, files, lines, lines_of, quoted, right_strip_sql, table,
)
from .text_queries import TOP, top_matches

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _matches(spark, sf_dir):
    return lines(spark, sf_dir).filter(F.col("line").rlike(f"(?i){PATTERN}")).select("path", "line_number")


MATCHES = f"m AS (SELECT path, line_number FROM lines WHERE regexp_matches(line, '(?i){PATTERN}')), sizes AS (SELECT path, max(line_number) AS n_lines FROM lines GROUP BY path)"


def merged_sql(source: str, name: str, gap: int = 1) -> str:
    return f"""
{name}_new AS (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
    THEN 1 ELSE 0 END AS new FROM {source}),
{name}_isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM {name}_new),
{name} AS (SELECT path, min(start_line) AS start_line, max(end_line) AS end_line FROM {name}_isl GROUP BY path, island)"""


def windows_sql(around: int) -> str:
    return (
        f"win AS (SELECT DISTINCT m.path, line_number, greatest(1, line_number - {around}) AS start_line, least(n_lines, line_number + {around}) AS end_line "
        "FROM m JOIN sizes USING (path))"
    )


@query(f"WITH {LINES}, {MATCHES}, {windows_sql(2)}, {merged_sql('win', 'merged')} SELECT path, start_line, end_line FROM merged")
def merge_ranges(spark, sf_dir):
    rows = lines(spark, sf_dir)
    sizes = rows.groupBy("path").agg(F.max("line_number").alias("n_lines"))
    return pack.merged_ranges(pack.windows(_matches(spark, sf_dir), sizes, 2))


@query(f"""WITH RECURSIVE {LINES}, {MATCHES},
reg AS (SELECT m.path, greatest(1, line_number - 1) AS start_line, least(n_lines, line_number + 1) AS end_line,
        CAST(len(regexp_extract_all(line, '(?i)th')) AS INTEGER) AS priority, 'line ' || line_number AS reason
        FROM m JOIN lines USING (path, line_number) JOIN sizes USING (path)),
reg_new AS (SELECT *, row_number() OVER w AS place, CASE WHEN start_line > max(end_line) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 1 ELSE 0 END AS new
        FROM reg WINDOW w AS (PARTITION BY path ORDER BY start_line, priority DESC, end_line)),
reg_isl AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM reg_new),
merged AS (SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, max(priority) AS priority,
        arg_max(reason, priority * 1000000 + place) AS reason FROM reg_isl GROUP BY path, island),
sized AS (SELECT r.path, start_line, end_line, priority, reason, sum(length(line))::BIGINT AS size
        FROM merged r JOIN lines l ON l.path = r.path AND line_number BETWEEN start_line AND end_line GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY -priority, start_line) AS k FROM sized),
pick AS (SELECT *, CASE WHEN size <= 360.0 THEN size ELSE 0 END AS used, size <= 360.0 AS chosen FROM ordered WHERE k = 1
        UNION ALL SELECT o.*, p.used + CASE WHEN p.used + o.size <= 360.0 THEN o.size ELSE 0 END, p.used + o.size <= 360.0
        FROM pick p JOIN ordered o ON o.path = p.path AND o.k = p.k + 1)
SELECT path, start_line, end_line, priority, reason, size FROM pick WHERE chosen""")
def merge_regions_budget(spark, sf_dir):
    rows = lines(spark, sf_dir)
    sizes = rows.groupBy("path").agg(F.max("line_number").alias("n_lines"))
    hit = rows.filter(F.col("line").rlike(f"(?i){PATTERN}")).join(sizes, "path")
    regions = hit.select(
        "path", F.greatest(F.lit(1), F.col("line_number") - 1).alias("start_line"), F.least("n_lines", F.col("line_number") + 1).alias("end_line"),
        F.regexp_count("line", F.lit("(?i)th")).cast("int").alias("priority"), F.concat(F.lit("line "), F.col("line_number").cast("string")).alias("reason"),
    )
    merged = pack.merged_regions(regions)
    inside = merged.withColumn("line_number", F.explode(F.sequence("start_line", "end_line"))).join(rows, ["path", "line_number"])
    sized = inside.groupBy("path", "start_line", "end_line", "priority", "reason").agg(F.sum(F.length("line")).alias("size"))
    return pack.chosen_regions(sized, 400)


CODE_LINES = DEFINITIONS + "," + lines_of("code")
IMPORTANT = """
spans AS (SELECT path, start_line, end_line FROM funcs UNION ALL SELECT path, start_line, end_line FROM cls),
hits AS (SELECT path, line_number FROM lines WHERE regexp_matches(line, '(?i)return')),
important AS (SELECT DISTINCT path, line_number FROM (
    SELECT path, line_number FROM hits UNION ALL SELECT l.path, l.line_number FROM lines l JOIN spans s ON l.path = s.path AND l.line_number BETWEEN s.start_line AND s.end_line))"""


def _important(spark, sf_dir):
    code = corpus.code_corpus(spark, sf_dir)
    rows = corpus.lines(code)
    spans = structure.structure(code).filter(F.col("kind").isin("function", "constructor", "class")).select("path", "start_line", "end_line")
    return pack.important_lines(rows.filter(F.col("line").rlike("(?i)return")), spans, rows), rows


@query(f"WITH {CODE_LINES}, {IMPORTANT} SELECT path, line_number FROM important")
def important_lines(spark, sf_dir):
    return _important(spark, sf_dir)[0]


def numbered_sql(mark: str) -> str:
    number = "CASE WHEN line_number < 10000 THEN lpad(CAST(line_number AS VARCHAR), 4, ' ') ELSE CAST(line_number AS VARCHAR) END"
    return f"{number} || CASE WHEN {mark} THEN ' >>> ' ELSE '     ' END || {right_strip_sql('line')}"


FULL = f"""
full_text AS (SELECT l.path, string_agg({numbered_sql("i.path IS NOT NULL")}, chr(10) ORDER BY l.line_number) AS content
    FROM (SELECT path, line_number, line FROM lines) l LEFT JOIN (SELECT DISTINCT path AS path, line_number AS n FROM {{important}}) i ON i.path = l.path AND i.n = l.line_number
    GROUP BY l.path)"""


@query(f"WITH {CODE_LINES}, {IMPORTANT}, {FULL.format(important='important')} SELECT path, content FROM full_text")
def render_full(spark, sf_dir):
    important, rows = _important(spark, sf_dir)
    return pack.rendered_full(rows, important)


PARTIAL = f"""
heads AS (SELECT path, start_line AS line_number, 0 AS part, chr(10) || '# Lines ' || start_line || '-' || end_line || ':' || chr(10) AS t FROM merged),
body AS (SELECT l.path, line_number, 1 AS part, {numbered_sql("(l.path, line_number) IN (SELECT path, line_number FROM m)")} AS t
    FROM lines l JOIN merged r ON l.path = r.path AND line_number BETWEEN start_line AND end_line),
partial_text AS (SELECT path, string_agg(t, chr(10) ORDER BY line_number, part) AS content FROM (SELECT * FROM heads UNION ALL SELECT * FROM body) GROUP BY path)"""


@query(f"WITH {LINES}, {MATCHES}, {windows_sql(10)}, {merged_sql('win', 'merged')}, {PARTIAL} SELECT path, content FROM partial_text")
def render_partial(spark, sf_dir):
    rows = lines(spark, sf_dir)
    sizes = rows.groupBy("path").agg(F.max("line_number").alias("n_lines"))
    found = _matches(spark, sf_dir)
    return pack.rendered_partial(rows, found, pack.merged_ranges(pack.windows(found, sizes, 10)))


TIER_INPUT = """
t_in AS (SELECT c.path, coalesce(n, 0) AS n_matches, CAST(doc_id % 3 AS INTEGER) AS n_definitions, doc_id % 2 = 0 AS is_related, doc_id AS pos
    FROM corpus c LEFT JOIN (SELECT path, count(*) AS n FROM m GROUP BY path) USING (path)),
t_tier AS (SELECT *, CAST(CASE WHEN n_matches > 0 THEN 0 WHEN n_definitions > 0 THEN 1 WHEN is_related THEN 2 END AS INTEGER) AS tier FROM t_in)"""


@query(f"""WITH {LINES}, {MATCHES}, {TIER_INPUT} SELECT path, n_matches, tier, CAST(row_number() OVER (ORDER BY tier,
    CASE tier WHEN 0 THEN n_matches WHEN 1 THEN n_definitions ELSE 0 END DESC, pos, path) AS INTEGER) AS rank FROM t_tier WHERE tier IS NOT NULL""")
def tiering(spark, sf_dir):
    counts = _matches(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"))
    rows = files(spark, sf_dir).join(counts, "path", "left").select(
        "path", F.coalesce("n", F.lit(0)).alias("n_matches"), (F.col("doc_id") % 3).cast("int").alias("n_definitions"), (F.col("doc_id") % 2 == 0).alias("is_related"),
        F.col("doc_id").alias("pos"),
    )
    return pack.tiers(rows).select("path", "n_matches", "tier", "rank")


BUDGET = 60_000
PACKED = f"""
m AS (SELECT path, line_number, score, hits, rank FROM top),
sizes AS (SELECT path, max(line_number) AS n_lines FROM lines GROUP BY path),
{windows_sql(10)}, {merged_sql("win", "merged")}, {PARTIAL}, {FULL.format(important="m")},
by_file AS (SELECT path, count(*) AS n_matches, row_number() OVER (ORDER BY max((score, hits, -rank, -line_number)) DESC, path) AS pos FROM m GROUP BY path),
items AS (SELECT path, n_matches, length(f.content) AS full_size, length(p.content) AS partial_size, row_number() OVER (ORDER BY n_matches DESC, pos, path) AS rank
    FROM by_file JOIN full_text f USING (path) JOIN partial_text p USING (path)),
pack AS (SELECT 0 AS k, 0::BIGINT AS used, NULL::VARCHAR AS path, false AS is_partial, 0::BIGINT AS size, false AS chosen
    UNION ALL SELECT k + 1, used + CASE WHEN used + full_size <= {BUDGET} THEN full_size WHEN used + partial_size <= {BUDGET} THEN partial_size ELSE 0 END, i.path,
        used + full_size > {BUDGET}, CASE WHEN used + full_size <= {BUDGET} THEN full_size ELSE partial_size END, used + full_size <= {BUDGET} OR used + partial_size <= {BUDGET}
    FROM pack JOIN items i ON i.rank = k + 1)"""
PACK = f"WITH RECURSIVE {LINES}, {TOP}, {PACKED}"


def _packed(spark, sf_dir, budget: int = BUDGET):
    # The Markdown-like corpus has no imports, so nothing is related.
    return engine.context(files(spark, sf_dir).withColumn("ext", F.lit(".txt")), QUESTION, Config(max_context_size=budget))


@query(PACK + " SELECT path, is_partial, size, CAST(k AS INTEGER) AS rank FROM pack WHERE chosen")
def pack_budget(spark, sf_dir):
    return _packed(spark, sf_dir).select("path", "is_partial", "size", "rank")


@query(
    PACK
    + f""", u AS (SELECT sum(size)::BIGINT AS used FROM pack WHERE chosen)
    SELECT used, used // 4 AS tokens, round(used * 100.0 / {BUDGET}, 6) AS percent,
    CASE WHEN used * 100.0 / {BUDGET} < 50 THEN 'green' WHEN used * 100.0 / {BUDGET} < 80 THEN 'yellow' ELSE 'red' END AS level FROM u"""
)
def utilization(spark, sf_dir):
    used = _packed(spark, sf_dir).agg(F.sum("size").alias("used"))
    percent = prompt.utilization(F.col("used"), BUDGET)
    return used.select("used", text.max_tokens(F.col("used")).alias("tokens"), percent.cast("double").alias("percent"), text.level(percent).alias("level"))


# -- ranking --------------------------------------------------------------

FEATURES = scores.Features.of("Where is the request handler of src doc_11 in Then the 'thonble' class?")


def _product(factors: list[str]) -> str:
    return " * ".join(["CAST(1.0 AS DOUBLE)", *(f"CAST({f} AS DOUBLE)" for f in factors)])


def file_relevance_sql(path: str, n: str | None = None, n_lines: str | None = None) -> str:
    parts = f"string_split(lower({path}), '/')"
    weights = [f"pow({w}, len(list_filter({parts}, lambda p: contains(p, {quoted(k)}))))" for k, w in fixed.PATH_WEIGHTS.items()]
    name = f"{parts}[-1]"
    ending = f"regexp_extract({name}, '.(\\.[^.]+)$', 1)"
    by_ending = "CASE " + ending + "".join(f" WHEN {quoted(k)} THEN {w}" for k, w in fixed.EXTENSION_WEIGHTS.items()) + " ELSE 1.0 END"
    stem = f"regexp_replace({name}, '(.)\\.[^.]+$', '\\1')"
    tokens = [f"CASE WHEN contains({stem}, {quoted(t)}) THEN 1.5 ELSE 1.0 END" for t in FEATURES.tokens]
    found = [f"CASE WHEN {n} > 0 THEN (1 + ln({n} + 1.0) * 0.3) * (1 + ({n} / {n_lines}) * 0.2) ELSE 1.0 END"] if n else []
    return _product([*weights, by_ending, *tokens, *found])


def snippet_relevance_sql(code: str) -> str:
    low = f"lower({code})"
    count = lambda t: f"((length({low}) - length(replace({low}, {quoted(t)}, ''))) // {len(t)})"
    factors = [f"CASE WHEN contains({low}, {quoted(t)}) THEN 1 + ln({count(t)} + 1.0) * 0.2 ELSE 1.0 END" for t in FEATURES.tokens]
    factors += [f"CASE WHEN contains({low}, {quoted(t)}) THEN 1.3 ELSE 1.0 END" for t in FEATURES.technical_tokens]
    factors += [f"CASE WHEN contains({code}, {quoted(t)}) THEN 2.0 ELSE 1.0 END" for t in FEATURES.identifiers]
    factors += [f"CASE WHEN contains({code}, {quoted(t)}) THEN 2.5 ELSE 1.0 END" for t in FEATURES.quoted]
    return _product(factors)


COUNTS = "counts AS (SELECT path, count(*) AS n, count(DISTINCT line_number) AS n_lines FROM m GROUP BY path)"


def _with_counts(spark, sf_dir):
    counts = rank.match_counts(_matches(spark, sf_dir))
    return files(spark, sf_dir).join(counts, "path", "left").fillna(0, ["n"]).fillna(1, ["n_lines"])


@query(f"""WITH {LINES}, {MATCHES}, {COUNTS} SELECT path, round({file_relevance_sql("path", "coalesce(n, 0)", "coalesce(n_lines, 1)")}, 6) AS score
    FROM corpus LEFT JOIN counts USING (path)""")
def file_relevance(spark, sf_dir):
    return _with_counts(spark, sf_dir).select("path", F.round(scores.file_relevance(F.col("path"), FEATURES, F.col("n"), F.col("n_lines")), 6).alias("score"))


@query(f"""WITH {LINES}, {MATCHES},
    gaps AS (SELECT path, abs(line_number - lag(line_number) OVER (PARTITION BY path ORDER BY line_number)) AS gap FROM m),
    mean AS (SELECT path, avg(gap) AS mean_distance FROM gaps GROUP BY path)
    SELECT c.path, round(({snippet_relevance_sql("content")}) * CASE WHEN mean_distance IS NOT NULL THEN 1 + 0.3 / (1 + mean_distance * 0.1) ELSE 1.0 END, 6) AS score
    FROM corpus c LEFT JOIN mean USING (path)""")
def snippet_relevance(spark, sf_dir):
    mean = rank.mean_distances(_matches(spark, sf_dir))
    rows = files(spark, sf_dir).join(mean, "path", "left")
    return rows.select("path", F.round(scores.snippet_relevance(F.col("content"), FEATURES, mean_distance=F.col("mean_distance")), 6).alias("score"))


# A match alone scores an empty snippet and counts as the file's only match.
RANKED = f"""
ranked AS (SELECT path, line_number, ({file_relevance_sql("path")}) * ((1 + ln(2.0) * 0.3) * 1.2) * ({snippet_relevance_sql("line")}) AS score FROM hit)"""


def _hits(spark, sf_dir):
    return lines(spark, sf_dir).filter(F.col("line").rlike(f"(?i){PATTERN}"))


HIT = f"hit AS (SELECT path, line_number, line FROM lines WHERE regexp_matches(line, '(?i){PATTERN}'))"


@query(f"""WITH {LINES}, {HIT}, {RANKED} SELECT path, line_number, round(score, 6) AS score FROM ranked
    ORDER BY round(score, 6) DESC, path, line_number LIMIT 200""")
def rank_results(spark, sf_dir):
    return rank.rank_results(_hits(spark, sf_dir), FEATURES, 200)


@query(f"""WITH {LINES}, {MATCHES}, {COUNTS}, {HIT}, {RANKED}, s AS (SELECT path, sum(score) * 0.3 + max(score) * 0.7 AS merged FROM ranked GROUP BY path)
    SELECT path, round(({file_relevance_sql("path", "coalesce(n, 0)", "coalesce(n_lines, 1)")}) * coalesce(merged, 1.0), 4) AS importance
    FROM corpus LEFT JOIN counts USING (path) LEFT JOIN s USING (path)""")
def file_importance(spark, sf_dir):
    found = rank.file_importance(files(spark, sf_dir), _hits(spark, sf_dir), FEATURES)
    return found.withColumn("importance", F.round("importance", 4))


# -- projects, strategies, prompts, chats, caches --------------------------


def _language_case(languages: dict[str, str], default: str) -> str:
    return "CASE ext" + "".join(f" WHEN {quoted(k)} THEN {quoted(v)}" for k, v in languages.items()) + f" ELSE {default} END"


@query(f"WITH {CORPUS} SELECT {_language_case(fixed.LANGUAGES, quoted('text'))} AS language, count(*) AS files FROM corpus GROUP BY 1")
def language_detect(spark, sf_dir):
    rows = files(spark, sf_dir).select(text.language_of(F.col("ext")).alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("files"))


@query(f"""WITH {CORPUS} SELECT DISTINCT {_language_case(fixed.ACTIVE_LANGUAGES, "NULL")} AS language,
    coalesce({_language_case(fixed.ACTIVE_LANGUAGES, "NULL")} IN ('python', 'java'), false) AS parsed FROM corpus WHERE {_language_case(fixed.ACTIVE_LANGUAGES, "NULL")} IS NOT NULL""")
def active_languages(spark, sf_dir):
    rows = files(spark, sf_dir).select(text.language_of(F.col("ext"), fixed.ACTIVE_LANGUAGES, None).alias("language")).filter("language is not null").distinct()
    return rows.select("language", F.col("language").isin(*fixed.PARSED_LANGUAGES).alias("parsed"))


_PROJECT_FILES = "proj AS (SELECT r_name AS project, unnest([CASE r_regionkey % 4 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'README.md' ELSE 'Cargo.toml' END, 'package.json2', 'go.mod']) AS file FROM region)"


@query(f"""WITH {_PROJECT_FILES}, known AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(fixed.MANIFESTS.items()))}) v(rank, file, type))
    SELECT project, coalesce(arg_min(type, rank), 'unknown') AS type FROM proj LEFT JOIN known USING (file) GROUP BY project""")
def project_type(spark, sf_dir):
    first = F.when(F.col("r_regionkey") % 4 == 0, "setup.py").when(F.col("r_regionkey") % 4 == 1, "pom.xml").when(F.col("r_regionkey") % 4 == 2, "README.md").otherwise("Cargo.toml")
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("project"), F.explode(F.array(first, F.lit("package.json2"), F.lit("go.mod"))).alias("file"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(fixed.MANIFESTS) for x in (k, i)])
    kind = F.create_map(*[F.lit(x) for kv in fixed.MANIFESTS.items() for x in kv])
    rows = rows.select("project", F.element_at(rank, F.col("file")).alias("rank"), F.element_at(kind, F.col("file")).alias("type"))
    return rows.groupBy("project").agg(F.coalesce(F.min_by("type", "rank"), F.lit("unknown")).alias("type"))


@query(f"""WITH {LINES}, {TOP} SELECT CASE WHEN rank < 2 THEN 'first' WHEN rank < 4 THEN 'second' ELSE 'unknown' END AS strategy, count(*) AS results
    FROM top GROUP BY 1""")
def strategy_summary(spark, sf_dir):
    kind = F.when(F.col("keyword_rank") < 2, "first").when(F.col("keyword_rank") < 4, "second")
    return rank.strategy_summary(top_matches(spark, sf_dir), kind)


@query(PACK + " SELECT count(*) AS file_count, bool_or(is_partial) AS has_partial_files, sum(size)::BIGINT AS total_size FROM pack WHERE chosen")
def context_metadata(spark, sf_dir):
    return rank.context_metadata(_packed(spark, sf_dir))


@query(PACK + " SELECT CAST(k AS INTEGER) AS rank, path, n_matches AS matches, CASE WHEN is_partial THEN 'Yes' ELSE 'No' END AS partial, size FROM pack JOIN items USING (path) WHERE chosen")
def debug_table(spark, sf_dir):
    return rank.debug_table(_packed(spark, sf_dir))


_RULE = "repeat('=', 80)"


@query(
    PACK
    + f""", section AS (SELECT k, {_RULE} || chr(10) || 'File: ' || path || chr(10) || 'Language: ' || {_language_case(fixed.LANGUAGES, quoted("text")).replace("CASE ext", "CASE regexp_extract(path, '(\\.[^./]+)$', 1)")}
        || chr(10) || 'Matches: ' || n_matches || CASE WHEN is_partial THEN chr(10) || '(parts of the file)' ELSE '' END || chr(10) || {_RULE} || chr(10)
        || CASE WHEN is_partial THEN p.content ELSE f.content END AS t
        FROM pack JOIN items USING (path) JOIN full_text f USING (path) JOIN partial_text p USING (path) WHERE chosen)
    SELECT {quoted(QUESTION)} AS question, {quoted(f"Question: {QUESTION}")} || repeat(chr(10), 2) || {quoted(prompt.INTRO)} || repeat(chr(10), 2)
        || string_agg(t, repeat(chr(10), 2) ORDER BY k) || repeat(chr(10), 2) || {quoted("Keywords: " + ", ".join(KEYWORDS))} || repeat(chr(10), 2) || {quoted(prompt.CLOSING)} AS prompt
    FROM section"""
)
def prompt_assembly(spark, sf_dir):
    return engine.ask(files(spark, sf_dir).withColumn("ext", F.lit(".txt")), QUESTION, Config(max_context_size=BUDGET))


@query("""SELECT conv_id, turn, role, text, CAST(count(*) OVER w AS INTEGER) AS n_before, coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '') AS history
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chat_history(spark, sf_dir):
    return prompt.history(table(spark, sf_dir, "conversations"))


@query("SELECT event_id, substr(sha256(event_type || ':' || user_id || ':' || props), 1, 16) AS key FROM events")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.cache_key(F.concat_ws(":", "event_type", "user_id", "props")).alias("key"))


@query("""WITH seen AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
    hit AS (SELECT *, before IS NOT NULL AND epoch(ts) - epoch(before) < 3600 AS hit FROM seen)
    SELECT event_type, count(*) AS lookups, sum(hit::INTEGER)::BIGINT AS hits, round(100.0 * sum(hit::INTEGER) / count(*), 6) AS hit_rate, count(DISTINCT user_id) AS entries
    FROM hit GROUP BY event_type""")
def cache_stats(spark, sf_dir):
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(order))
    rows = rows.withColumn("hit", F.coalesce((seconds("ts") - seconds("before") < 3600).cast("int"), F.lit(0)))
    return rank.cache_lookups(rows, "event_type", "hit", "user_id")


@query("""WITH last AS (SELECT user_id, max(ts) AS stored_at FROM events GROUP BY user_id), now AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, epoch(now) - epoch(stored_at) > 86400 AS expired FROM last, now""")
def cache_expiry(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    now = events.agg(F.max("t").alias("now"))
    last = events.groupBy("user_id").agg(F.max("t").alias("stored_at"))
    return last.join(F.broadcast(now)).select("user_id", cache.is_expired(F.col("stored_at"), F.col("now"), 86400).alias("expired"))  # one row


@query()
def end_to_end_context(spark, sf_dir):
    return engine.ask(files(spark, sf_dir), QUESTION)


# No file of this corpus is imported by another or holds a definition, so the
# default budget is all that differs from the assembly above.
ORACLES["end_to_end_context"] = ORACLES["prompt_assembly"].replace(str(BUDGET), str(Config().max_context_size))
