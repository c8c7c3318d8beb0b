"""Queries on code structure and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import graph, search, structure
from ..shared import fresh_path
from ..sources import corpus
from .shared import CODE, CODE_GRAPH, DEFINITIONS, IMPORTS, TARGETS, lines_of, strip_sql, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _code(spark, sf_dir):
    return corpus.code_corpus(spark, sf_dir)


def _parsed(spark, sf_dir):
    return structure.structure(_code(spark, sf_dir))


@query(f"WITH {DEFINITIONS} SELECT path, name, type, start_line, end_line FROM funcs")
def functions(spark, sf_dir):
    return structure.functions(_parsed(spark, sf_dir)).drop("code")


@query(f"WITH {DEFINITIONS} SELECT path, name, start_line, end_line FROM cls")
def classes(spark, sf_dir):
    return structure.classes(_parsed(spark, sf_dir)).drop("code")


@query(f"""WITH {DEFINITIONS} SELECT 'src/s_' || k || '.py' AS path, 'function' AS type, 'doc ' || k AS content, 4 AS start_line, 4 AS end_line FROM sup
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', 'javadoc', '/** Part ' || p_partkey || '. */', 5, 5 FROM part""")
def docstrings(spark, sf_dir):
    return structure.docstrings(_parsed(spark, sf_dir))


@query(f"""WITH {CODE}, {lines_of("code")} SELECT path, line_number, {strip_sql("line")} AS line FROM lines WHERE regexp_matches(line, '(?i)def\\s+f_1\\s*\\(')""")
def symbols_search(spark, sf_dir):
    rows = search.search_symbols(corpus.lines(_code(spark, sf_dir)), "f_1", "function")
    return rows.select("path", "line_number", search.stripped(F.col("line")).alias("line"))


@query(f"WITH {DEFINITIONS}, {IMPORTS} SELECT 'import' AS kind, path, name, 1 AS line FROM imports WHERE path LIKE '%.py' UNION ALL SELECT 'call', path, name, line FROM calls WHERE path LIKE '%.py'")
def py_imports_calls(spark, sf_dir):
    rows = _parsed(spark, sf_dir).filter(F.col("kind").isin("import", "call") & F.col("path").endswith(".py"))
    return rows.select("kind", "path", "name", F.col("start_line").alias("line"))


@query(f"WITH {DEFINITIONS}, {IMPORTS} SELECT 'import' AS kind, path, name FROM imports WHERE path LIKE '%.java' UNION ALL SELECT 'call', path, name FROM (SELECT path, unnest(['P' || p_partkey, 'reset', 'price' || p_partkey, 'price' || p_size]) AS name FROM (SELECT *, 'src/main/java/app/P' || p_partkey || '.java' AS path FROM part))")
def java_imports_calls(spark, sf_dir):
    files = _code(spark, sf_dir)
    return structure.java_imports(files).select(F.lit("import").alias("kind"), "*").unionByName(structure.java_calls(files).select(F.lit("call").alias("kind"), "*"))


@query(f"WITH {DEFINITIONS}, {IMPORTS} SELECT 'import' AS kind, path, name FROM imports WHERE path LIKE '%.js' UNION ALL SELECT 'call', path, name FROM calls WHERE path LIKE '%.js'")
def js_imports_calls(spark, sf_dir):
    files = _code(spark, sf_dir)
    return structure.js_imports(files).select(F.lit("import").alias("kind"), "*").unionByName(structure.js_calls(files).select(F.lit("call").alias("kind"), "*"))


CONTEXT_IMPORTS = """
ctx AS (
    SELECT 'src/s_' || k || '.py' AS path, '.py' AS ext, 'n_' || n AS name, 0 AS place FROM sup UNION ALL SELECT 'src/s_' || k || '.py', '.py', 'g_' || n, 1 FROM sup
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', '.java', 'java.util.List', 0 FROM part
    UNION ALL SELECT 'src/main/java/app/P' || p_partkey || '.java', '.java', 'app.P' || p_size, 1 FROM part
    UNION ALL SELECT 'web/p' || p_partkey || '.js', '.js', './p' || p_size, 0 FROM part
)"""


@query(f"WITH {DEFINITIONS}, {CONTEXT_IMPORTS} SELECT path, name, place FROM ctx")
def context_imports(spark, sf_dir):
    return structure.context_imports(_code(spark, sf_dir)).select("path", "name", F.col("at").alias("place"))


@query(f"""WITH {DEFINITIONS}, {CONTEXT_IMPORTS}, given AS (SELECT path, row_number() OVER (ORDER BY path) AS pos FROM code WHERE path LIKE 'src/s_%' OR path LIKE 'web/%'),
    tried AS (SELECT pos, place, CASE WHEN ext = '.py' THEN 'src/' || name || '.py' ELSE 'web/' || substr(name, 3) || '.js' END AS target FROM ctx JOIN given USING (path)),
    firsts AS (SELECT target, min((pos, place)) AS first FROM tried WHERE target IN (SELECT path FROM code) AND target NOT IN (SELECT path FROM given) GROUP BY target)
    SELECT target AS path, CAST(row_number() OVER (ORDER BY first, target) AS INTEGER) AS rank FROM firsts ORDER BY first, target LIMIT 10""")
def related_files(spark, sf_dir):
    files = _code(spark, sf_dir)
    given = files.filter(F.col("path").startswith("src/s_") | F.col("path").startswith("web/")).select("path", F.col("path").alias("pos"))
    return structure.related_files(structure.context_imports(files), files, given, 10)


def _resolved(spark, sf_dir):
    files = _code(spark, sf_dir)
    parsed = structure.structure(files)
    imports, calls = structure.dependencies(files, parsed)
    defs = structure.functions(parsed)
    return files, parsed, structure.resolved_imports(imports, files), structure.resolved_calls(calls, defs)


@query(f"WITH {DEFINITIONS}, {IMPORTS}, {TARGETS} SELECT path, name, target FROM targets")
def import_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)[2]


@query(f"WITH {DEFINITIONS}, {IMPORTS}, {TARGETS} SELECT path, name, target_path, start_line, cross_file FROM call_targets")
def call_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)[3]


def _graph(spark, sf_dir):
    files, parsed, imports, calls = _resolved(spark, sf_dir)
    functions_, classes_ = structure.functions(parsed), structure.classes(parsed)
    return graph.saved(graph.nodes(files, functions_, classes_, imports)), graph.saved(graph.edges(functions_, classes_, imports, calls))


@query(f"{CODE_GRAPH} SELECT * FROM g_nodes")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].drop("code")


@query(f"{CODE_GRAPH} SELECT source, target, type, name FROM g_edges")
def graph_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.with_ends(edges, nodes).drop("edge_id")


@query(f"{CODE_GRAPH} SELECT id, type, name, path FROM g_nodes WHERE name = 'f_1' AND type = 'function'")
def find_node(spark, sf_dir):
    return graph.find_node(_graph(spark, sf_dir)[0], "f_1", "function").select("id", "type", "name", "path")


@query(f"{CODE_GRAPH} SELECT id, name FROM g_nodes WHERE type = 'class'")
def nodes_by_type(spark, sf_dir):
    return graph.nodes_of_type(_graph(spark, sf_dir)[0], "class").select("id", "name")


@query(f"{CODE_GRAPH} SELECT id, type, name FROM g_nodes WHERE path = 'src/s_1.py'")
def nodes_in_file(spark, sf_dir):
    """Only this file is parsed: no other one has a part in its nodes."""
    files = _code(spark, sf_dir).filter(F.col("path") == "src/s_1.py")
    return graph.nodes_in_file(graph.nodes_of_files(files), "src/s_1.py").select("id", "type", "name")


@query(f"{CODE_GRAPH} SELECT DISTINCT source AS id, target AS other FROM g_edges WHERE type IN ('calls', 'imports')")
def dependencies(spark, sf_dir):
    return graph.dependencies(_graph(spark, sf_dir)[1], ["calls", "imports"])


@query(f"{CODE_GRAPH} SELECT DISTINCT target AS id, source AS other FROM g_edges WHERE type IN ('calls', 'imports')")
def dependents(spark, sf_dir):
    return graph.dependents(_graph(spark, sf_dir)[1], ["calls", "imports"])


GEO = """
geo AS (SELECT 'supplier:' || s_suppkey AS source, 'nation:' || s_nationkey AS target FROM supplier
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
geo_both AS (SELECT source AS a, target AS b FROM geo UNION SELECT target, source FROM geo)"""


def _geo(spark, sf_dir):
    pair = lambda name, key, other, label: table(spark, sf_dir, name).select(
        F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("source"), F.concat(F.lit(f"{label}:"), F.col(other).cast("string")).alias("target")
    )
    every = pair("supplier", "s_suppkey", "s_nationkey", "nation").unionByName(pair("customer", "c_custkey", "c_nationkey", "nation"))
    every = every.unionByName(pair("nation", "n_nationkey", "n_regionkey", "region"))
    return every.select("source", "target", F.lit("references").alias("type"), F.lit("").alias("name"), F.xxhash64("source", "target").alias("edge_id"))


@query(f"""WITH {GEO}, s AS (SELECT 'region:' || r_regionkey AS start FROM region),
    one AS (SELECT start, b AS node FROM s JOIN geo_both ON a = start), two AS (SELECT DISTINCT start, b AS node FROM one JOIN geo_both ON a = node)
    SELECT start, node, CAST(min(d) AS INTEGER) AS distance FROM (SELECT start, node, 1 AS d FROM one UNION ALL SELECT start, node, 2 FROM two) WHERE node <> start GROUP BY start, node""")
def related_nodes_bfs(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.related_nodes(_geo(spark, sf_dir), starts, 2)


CALLS = """
chain_edges AS (SELECT DISTINCT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target FROM lineitem
    UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


def _calls(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    links = items.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target"))
    geo = _geo(spark, sf_dir).filter(~F.col("source").startswith("customer:")).select("source", "target")
    return links.unionByName(geo).select("source", "target", F.lit("calls").alias("type"))


@query(f"""WITH RECURSIVE {CALLS}, starts AS (SELECT DISTINCT source AS start FROM chain_edges WHERE source LIKE 'part:%'),
    chain AS (SELECT start, start || ' -> ' || target AS chain, target AS last, 1 AS depth FROM starts JOIN chain_edges ON source = start
        UNION ALL SELECT start, chain || ' -> ' || target, target, depth + 1 FROM chain JOIN chain_edges ON source = last WHERE depth < 5)
    SELECT start, chain FROM chain""")
def call_chains(spark, sf_dir):
    edges = _calls(spark, sf_dir)
    starts = edges.filter(F.col("source").startswith("part:")).select(F.col("source").alias("id")).distinct()
    return graph.call_chains(edges, starts, 5).select("start", F.array_join("chain", " -> ").alias("chain"))


@query(f"""WITH RECURSIVE {CALLS}, paths AS (SELECT source AS root, target AS node, source || ' -> ' || target AS path, 1 AS length FROM chain_edges WHERE source LIKE 'part:%'
        UNION ALL SELECT root, target, path || ' -> ' || target, length + 1 FROM paths JOIN chain_edges ON source = node WHERE length < 4)
    SELECT root AS source, node AS target, CAST(min(length) AS INTEGER) AS length FROM paths WHERE node LIKE 'region:%' GROUP BY root, node""")
def shortest_path(spark, sf_dir):
    edges = _calls(spark, sf_dir)
    parts = edges.filter(F.col("source").startswith("part:")).select("source").distinct()
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("target"))
    pairs = parts.join(F.broadcast(regions))  # the five regions
    return graph.shortest_paths(edges, pairs).select("source", "target", (F.size("path") - 1).alias("length"))


HREF = 'href="/([^"]*)"'
LINKS = f"""
links AS (SELECT DISTINCT 'page:' || page_id AS source, 'import:' || unnest(regexp_extract_all(html, '{HREF}', 1)) AS target FROM pages)"""


def _links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("t"))
    return rows.select("source", F.concat(F.lit("import:"), "t").alias("target")).distinct()


@query(f"""WITH RECURSIVE {LINKS}, both_ways AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links),
    reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node)
    SELECT node AS id, min(root) AS component FROM reach GROUP BY node""")
def connected_components(spark, sf_dir):
    edges = _links(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return graph.connected_components(edges, nodes)


@query(f"""WITH RECURSIVE {GEO}, ids AS (SELECT source AS id FROM geo UNION SELECT target FROM geo),
    walk AS (SELECT id AS s, id AS t, 0 AS d FROM ids UNION ALL SELECT s, target, d + 1 FROM walk JOIN geo ON source = t WHERE d < 4),
    dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t), sigma AS (SELECT w.s, w.t, w.d, count(*) AS n FROM walk w JOIN dist USING (s, t, d) GROUP BY ALL),
    part AS (SELECT a.t AS id, sum(a.n * b.n / whole.n) AS share FROM sigma a JOIN sigma b ON b.s = a.t JOIN sigma whole ON whole.s = a.s AND whole.t = b.t AND whole.d = a.d + b.d
        WHERE a.d > 0 AND b.d > 0 GROUP BY a.t)
    SELECT id, round(coalesce(share, 0) / ((SELECT count(*) FROM ids) - 1) / ((SELECT count(*) FROM ids) - 2), 9) AS centrality FROM ids LEFT JOIN part USING (id)""")
def betweenness(spark, sf_dir):
    edges = _geo(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return graph.betweenness(edges, nodes).withColumn("centrality", F.round("centrality", 9))


@query(f"""{CODE_GRAPH}, kinds AS (SELECT unnest(['{"','".join(fixed.NODE_TYPES)}']) AS type), ekinds AS (SELECT unnest(['{"','".join(fixed.EDGE_TYPES)}']) AS type)
    SELECT 'total_nodes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM g_nodes UNION ALL SELECT 'total_edges', count(*) FROM g_edges
    UNION ALL SELECT 'nodes:' || k.type, count(n.id) FROM kinds k LEFT JOIN g_nodes n ON n.type = k.type GROUP BY k.type
    UNION ALL SELECT 'edges:' || k.type, count(e.source) FROM ekinds k LEFT JOIN g_edges e ON e.type = k.type GROUP BY k.type
    UNION ALL SELECT 'files', count(DISTINCT path) FROM g_nodes
    UNION ALL SELECT 'average_degree', round(2.0 * (SELECT count(*) FROM g_edges) / count(*), 6) FROM g_nodes""")
def graph_stats(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.statistics(nodes, edges).withColumn("value", F.round("value", 6))


@query(f"""{CODE_GRAPH}, fn AS (SELECT id FROM g_nodes WHERE name = 'g_nation_0' AND type = 'function'),
    bw AS (SELECT source AS a, target AS b FROM g_edges UNION SELECT target, source FROM g_edges),
    r1 AS (SELECT DISTINCT b AS id FROM bw JOIN fn ON a = fn.id), r2 AS (SELECT DISTINCT b AS id FROM bw JOIN r1 ON a = r1.id), r3 AS (SELECT DISTINCT b AS id FROM bw JOIN r2 ON a = r2.id),
    near AS (SELECT id FROM (SELECT * FROM r1 UNION SELECT * FROM r2 UNION SELECT * FROM r3) WHERE id NOT IN (SELECT id FROM fn))
    SELECT 'direct_caller' AS kind, source AS id FROM g_edges JOIN fn ON target = fn.id WHERE type = 'calls'
    UNION SELECT 'indirect', id FROM near UNION SELECT 'file', path FROM g_nodes WHERE path IS NOT NULL AND (id IN (SELECT id FROM near) OR id IN (SELECT id FROM fn))""")
def impact_analysis(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.impact(nodes, edges, "g_nation_0")


@query(f"""{CODE_GRAPH}, pairs AS (SELECT DISTINCT source, target FROM g_edges UNION SELECT DISTINCT target, source FROM g_edges UNION SELECT id, 'file:none.py' FROM g_nodes WHERE type = 'class'
        UNION SELECT c.id, f.id FROM g_nodes c JOIN g_nodes f ON f.path = c.path WHERE c.type = 'class' AND f.type = 'function'),
    firsts AS (SELECT source, target, arg_min(type, list_position(['contains', 'imports', 'calls'], type)) AS type FROM g_edges GROUP BY source, target)
    SELECT p.source, p.target, CASE WHEN p.source NOT IN (SELECT id FROM g_nodes) OR p.target NOT IN (SELECT id FROM g_nodes) THEN 'unknown'
        WHEN f.type IS NOT NULL THEN f.type WHEN b.type IS NOT NULL THEN 'reverse_' || b.type ELSE 'indirect' END AS relationship
    FROM pairs p LEFT JOIN firsts f ON f.source = p.source AND f.target = p.target LEFT JOIN firsts b ON b.source = p.target AND b.target = p.source""")
def relationship_type(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    pair = edges.select("source", "target")
    cls = nodes.filter("type = 'class'").select(F.col("id").alias("source"), "path")
    mates = cls.join(nodes.filter("type = 'function'").select(F.col("id").alias("target"), "path"), "path").select("source", "target")
    pairs = pair.union(edges.select("target", "source")).union(cls.select("source", F.lit("file:none.py"))).union(mates)
    return graph.relationship_types(pairs, edges, nodes)


@query(f"""{CODE_GRAPH}, bw AS (SELECT source AS a, target AS b FROM g_edges UNION SELECT target, source FROM g_edges),
    st AS (SELECT id AS start FROM g_nodes WHERE contains(lower(name), 'g_nation_1')), r1 AS (SELECT DISTINCT start, b AS node FROM st JOIN bw ON a = start),
    r2 AS (SELECT DISTINCT start, b AS node FROM r1 JOIN bw ON a = node),
    near AS (SELECT start, node, min(d) AS distance FROM (SELECT *, 1 AS d FROM r1 UNION ALL SELECT *, 2 FROM r2) WHERE start <> node GROUP BY ALL)
    SELECT start, node, CAST(distance AS INTEGER) AS distance, round(1.0 / (distance + 1), 6) AS strength FROM near ORDER BY strength DESC, start, node LIMIT 20""")
def related_concepts(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.related_concepts(nodes, edges, "g_nation_1").select("start", "node", "distance", F.round("strength", 6).alias("strength"))


@query(f"""{CODE_GRAPH}, {lines_of("code")}, bodies AS (SELECT n.id, n.name, string_agg(line, chr(10) ORDER BY line_number) AS code FROM g_nodes n JOIN lines l
        ON l.path = n.path AND line_number BETWEEN n.start_line AND n.end_line GROUP BY ALL),
    scored AS (SELECT id, name, CASE WHEN lower(name) = 'f_1' THEN 1.0 WHEN starts_with(lower(name), 'f_1') THEN 0.9 ELSE 0.7 END AS relevance, 'name' AS match_type FROM g_nodes WHERE contains(lower(name), 'f_1')
        UNION ALL SELECT id, name, least(least((length(code) - length(replace(lower(code), 'f_1', ''))) // 3 * 0.1, 0.6)
            + CASE WHEN contains(lower(code), 'def f_1') OR contains(lower(code), 'class f_1') THEN 0.3 ELSE 0 END, 1.0), 'code' FROM bodies WHERE contains(lower(code), 'f_1')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY relevance DESC, match_type DESC) = 1)
    SELECT id, name, round(CAST(relevance AS DOUBLE), 6) AS relevance, match_type FROM best ORDER BY relevance DESC, id LIMIT 50""")
def semantic_search(spark, sf_dir):
    rows = graph.semantic_search(_graph(spark, sf_dir)[0].withColumn("code", F.col("code")), "f_1")
    return rows.withColumn("relevance", F.round("relevance", 6))


def _term_sql(term: str) -> str:
    """Nodes, files and impact of one term."""
    count = f"(length(code) - length(replace(lower(code), '{term}', ''))) // {len(term)}"
    return f"""
    scored_{term} AS (SELECT id, path, greatest(CASE WHEN contains(lower(name), '{term}') THEN CASE WHEN lower(name) = '{term}' THEN 1.0 WHEN starts_with(lower(name), '{term}') THEN 0.9 ELSE 0.7 END END,
            CASE WHEN contains(lower(code), '{term}') THEN least(least({count} * 0.1, 0.6) + CASE WHEN contains(lower(code), 'def {term}') OR contains(lower(code), 'class {term}') THEN 0.3 ELSE 0 END, 1.0) END) AS relevance
        FROM coded WHERE contains(lower(name), '{term}') OR contains(lower(code), '{term}')),
    best_{term} AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM scored_{term} QUALIFY rank <= 10),
    fn_{term} AS (SELECT id FROM g_nodes WHERE name = '{term}' AND type = 'function'),
    r1_{term} AS (SELECT DISTINCT b AS id FROM bw JOIN fn_{term} f ON a = f.id), r2_{term} AS (SELECT DISTINCT b AS id FROM bw JOIN r1_{term} r ON a = r.id),
    r3_{term} AS (SELECT DISTINCT b AS id FROM bw JOIN r2_{term} r ON a = r.id),
    near_{term} AS (SELECT id FROM (FROM r1_{term} UNION FROM r2_{term} UNION FROM r3_{term}) WHERE id NOT IN (FROM fn_{term})),
    all_{term} AS (SELECT 'node' AS kind, id FROM best_{term} UNION ALL SELECT DISTINCT 'file', path FROM best_{term} WHERE rank <= 5 AND path IS NOT NULL
        UNION ALL SELECT DISTINCT 'impact:direct_caller', source FROM g_edges JOIN fn_{term} f ON target = f.id WHERE type = 'calls' UNION ALL SELECT 'impact:indirect', id FROM near_{term}
        UNION ALL SELECT DISTINCT 'impact:file', path FROM g_nodes WHERE path IS NOT NULL AND (id IN (FROM near_{term}) OR id IN (FROM fn_{term})))"""


_CONTEXT_TERMS = ["f_1", "g_nation_0", "price"]


@query(f"""{CODE_GRAPH}, {lines_of("code")}, bodies AS (SELECT n.id, string_agg(line, chr(10) ORDER BY line_number) AS code FROM g_nodes n JOIN lines l
        ON l.path = n.path AND line_number BETWEEN n.start_line AND n.end_line GROUP BY ALL),
    coded AS (SELECT n.id, n.name, n.path, b.code FROM g_nodes n LEFT JOIN bodies b USING (id)),
    bw AS (SELECT source AS a, target AS b FROM g_edges UNION SELECT target, source FROM g_edges), {", ".join(map(_term_sql, _CONTEXT_TERMS))}
    {" UNION ALL ".join(f"SELECT '{t}' AS term, kind, id FROM all_{t}" + ("" if t != "price" else " WHERE NOT starts_with(kind, 'impact')") for t in _CONTEXT_TERMS)}""")
def question_context(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.question_context(nodes, edges, "What would change with f_1, g_nation_0 and price?", _CONTEXT_TERMS)


@query(f"{CODE_GRAPH} SELECT 'node' AS kind, id, type FROM g_nodes UNION ALL SELECT 'edge', source || ' ' || target, type FROM g_edges")
def graph_json_roundtrip(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    folder = fresh_path(spark, "graph")
    graph.write_graph(nodes, edges, folder)
    nodes, edges = graph.read_graph(spark, folder)
    return nodes.select(F.lit("node").alias("kind"), "id", "type").unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "target").alias("id"), "type"))


_FUNCTION_CALLS = """fe AS (SELECT 'func:src/s_' || k || '.py:f_' || k || ':3' AS source, 'func:src/n_' || n || '.py:g_' || n || ':1' AS target FROM sup
        UNION ALL SELECT 'func:src/s_' || k || '.py:m_' || k || ':8', 'func:src/s_' || k || '.py:f_' || k || ':3' FROM sup),
    calls_of AS (SELECT source, target FROM fe UNION SELECT source, target FROM g_edges WHERE type = 'calls'),
    walks AS (SELECT source AS start, target AS last, source || ' -> ' || target AS chain, 1 AS depth FROM calls_of WHERE starts_with(source, 'func:')
        UNION ALL SELECT start, target, chain || ' -> ' || target, depth + 1 FROM walks JOIN calls_of ON source = last WHERE depth < 4),
    named AS (SELECT id, name FROM g_nodes WHERE type = 'function' AND name IN ('m_1', 'f_1'))"""


@query(f"""{CODE_GRAPH}, {_FUNCTION_CALLS}
    SELECT name AS term, 'chain' AS kind, chain AS id FROM walks JOIN named ON start = named.id WHERE depth <= 3
    UNION ALL SELECT 'm_1', 'flow', a.id || ' -> ' || b.id FROM named a, named b WHERE a.name = 'm_1' AND b.name = 'f_1'
    UNION SELECT name, 'impact:call_chain', chain FROM walks JOIN named ON start = named.id
    UNION SELECT name, 'impact:direct_caller', c.source FROM calls_of c JOIN named ON c.target = named.id""")
def function_context(spark, sf_dir):
    """Chains, a flow and the reach of a change along calls between functions, on a map as questions use it."""
    from ..plans import engine

    nodes, edges = engine.code_map(_code(spark, sf_dir).filter("ext = '.py'"))
    found = graph.question_context(nodes, edges, "What would change with m_1 and f_1?", ["m_1", "f_1"])
    return found.filter(~F.col("kind").isin("node", "file", "impact:indirect", "impact:file"))
