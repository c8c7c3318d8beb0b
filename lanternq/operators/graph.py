"""Property graph of a corpus: nodes(id, type, name, path, start_line,
end_line, code) and edges(edge_id, source, target, type, name).

Traversals are loops of joins over the frontier; every round is written to
the shared folder, so plans stay short and a lost executor costs one
round.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scores import code_relevance, name_relevance
from ..functions.text import language_of
from ..shared import written as saved
from ..sources.corpus import extension
from . import structure

# -- building -------------------------------------------------------------


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def _definition_id(kind: str, path: str = "path", name: str = "name", line: str = "start_line") -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(path), F.lit(":"), F.col(name), F.lit(":"), F.col(line).cast("string"))


def nodes(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """A node for each file, function, class and import that leads nowhere; the last row of an id counts."""
    none = F.lit(None)
    file_nodes = files.select(
        file_id(F.col("path")).alias("id"), F.lit("file").alias("type"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path",
        none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("code"),
    )
    of = lambda rows, kind, label: rows.select(
        _definition_id(kind).alias("id"), F.lit(label).alias("type"), "name", "path", "start_line", "end_line", "code"
    )
    outside = imports.filter(F.col("target").startswith("import:")).select(
        F.col("target").alias("id"), F.lit("import").alias("type"), "name", none.cast("string").alias("path"), none.cast("int").alias("start_line"),
        none.cast("int").alias("end_line"), none.cast("string").alias("code"),
    )
    return upserted([file_nodes, of(functions, "func", "function"), of(classes, "class", "class"), outside])


def upserted(arrivals: list[DataFrame], key: str = "id") -> DataFrame:
    """One row for each id: of the last table that has it, there the one that lies last in its file."""
    every = None
    for k, rows in enumerate(arrivals):
        rows = rows.withColumn("_at", F.lit(k))
        every = rows if every is None else every.unionByName(rows)
    columns = [c for c in every.columns if c not in ("_at", key)]
    order = F.struct("_at", *(F.coalesce(c, F.lit(-1)) for c in ("start_line", "end_line")), *(F.coalesce(c, F.lit("")) for c in ("name", "path", "code")))
    return every.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last")).select(key, *(f"last.{c}" for c in columns))


#: In the order in which a file's edges are made; the first of parallel edges counts.
EDGE_ORDER = ("contains", "imports", "calls")


def edges(functions: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """contains, imports and calls edges; calls start at the calling file.
    edge_id grows in the order of ``EDGE_ORDER``."""
    contains = lambda rows, kind: rows.select(
        file_id(F.col("path")).alias("source"), _definition_id(kind).alias("target"), F.lit("contains").alias("type"), "name"
    )
    imported = imports.select(file_id(F.col("path")).alias("source"), "target", F.lit("imports").alias("type"), "name")
    called = calls.select(file_id(F.col("path")).alias("source"), _definition_id("func", "target_path").alias("target"), F.lit("calls").alias("type"), "name")
    every = contains(functions, "func").unionByName(contains(classes, "class")).unionByName(imported).unionByName(called)
    return every.withColumn("edge_id", edge_number("source", "target", "type", "name"))


def edge_number(source: str, target: str, type: str, name: str) -> Column:
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EDGE_ORDER)), F.col(type)), F.lit(0)).cast("long")
    return F.shiftleft(rank, 60).bitwiseOR(F.shiftrightunsigned(F.xxhash64(source, target, type, name), 4))


def function_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Optional calls edges from function to function: the innermost function
    around the call's line (calls: path, name, line, target_path, start_line)."""
    around = functions.select(F.col("path"), F.col("name").alias("caller"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inside = calls.join(around, "path").filter("line between a and b")
    inner = inside.groupBy("path", "name", "line", "target_path", "start_line").agg(F.max_by(F.struct("caller", "a"), "a").alias("c"))
    source = F.concat(F.lit("func:"), "path", F.lit(":"), "c.caller", F.lit(":"), F.col("c.a").cast("string"))
    return inner.select(source.alias("source"), _definition_id("func", "target_path").alias("target"), F.lit("calls").alias("type"), "name").distinct()


def with_function_calls(edges: DataFrame, calls: DataFrame, targets: DataFrame, functions: DataFrame) -> DataFrame:
    """edges and those from function to function (of calls whose line is known),
    along which chains, flows and the reach of a change are followed."""
    placed = calls.filter("line > 0").select("path", "name", "line").join(targets.select("path", "name", "target_path", "start_line"), ["path", "name"])
    between = function_calls(placed, functions)
    return edges.unionByName(between.withColumn("edge_id", edge_number("source", "target", "type", "name")))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, F.col("target") == ids.id, "left_semi")


# -- look-ups -------------------------------------------------------------


def find_node(nodes: DataFrame, name: str, type: str | None = None, path: str | None = None) -> DataFrame:
    out = nodes.filter(F.col("name") == name)
    out = out.filter(F.col("type") == type) if type else out
    return out.filter(F.col("path") == path) if path else out


def nodes_of_type(nodes: DataFrame, type: str) -> DataFrame:
    return nodes.filter(F.col("type") == type)


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("path") == path)


def nodes_of_files(files: DataFrame) -> DataFrame:
    """The nodes that stand in files (path, ext, content), from these files alone: ids
    hold their path, and what imports lead to stands in none."""
    parsed = saved(structure.structure(files))
    none = files.select("path", F.lit("").alias("name"), F.lit("").alias("target")).limit(0)
    return nodes(files, structure.functions(parsed), structure.classes(parsed), none)


def dependencies(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """id, other: distinct targets of each source."""
    chosen = edges.filter(F.col("type").isin(types)) if types else edges
    return chosen.select(F.col("source").alias("id"), F.col("target").alias("other")).distinct()


def dependents(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    return dependencies(edges, types).select(F.col("other").alias("id"), F.col("id").alias("other"))


# -- traversals -----------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    pair = edges.select("source", "target")
    return pair.union(edges.select("target", "source")).filter("source <> target").distinct()


def related_nodes(edges: DataFrame, starts: DataFrame, most: int = 2) -> DataFrame:
    """start, node, distance of all nodes within most steps, either way; starts has column id."""
    both = saved(undirected(edges))
    reached = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct()
    front = reached
    for step in range(1, most + 1):
        new = front.join(both, front.node == both.source).select("start", F.col("target").alias("node")).distinct()
        front = saved(new.join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached.filter("distance > 0")


#: Starts whose reached nodes are bits of one word.
WORD_BITS = 64


def related_by_bits(edges: DataFrame, starts: DataFrame, most: int = 2) -> DataFrame:
    """``related_nodes`` for many starts at once.

    Starts are numbered, and 64 of them share a word: a node holds, for each
    word, the bits of the starts that have reached it.  A round takes the
    bitwise or over a node's neighbours; bits that were not there before are
    the starts that reach it at that distance.  A round moves a row for each
    node and word instead of one for each node and start.  Starts with the same
    least neighbour are numbered in a row, as they reach the same nodes: a
    node then has full words instead of many with a few bits.
    """
    both = saved(undirected(edges))
    near = both.groupBy(F.col("source").alias("start")).agg(F.min("target").alias("near"))
    placed = starts.select(F.col("id").alias("start")).distinct().join(near, "start", "left")
    placed = placed.repartitionByRange("near", "start").sortWithinPartitions("near", "start")
    named = saved(placed.select("start", F.monotonically_increasing_id().alias("n")))
    place = named.select("start", F.shiftright("n", 6).alias("word"), (F.col("n") % WORD_BITS).cast("int").alias("bit"))
    shift = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    front = saved(place.groupBy(F.col("start").alias("node"), "word").agg(F.bit_or(shift).alias("bits")))
    seen, rounds = front, []
    for step in range(1, most + 1):
        came = front.join(both, front.node == both.source).groupBy(F.col("target").alias("node"), "word").agg(F.bit_or("bits").alias("came"))
        known = came.join(seen.withColumnRenamed("bits", "had"), ["node", "word"], "left")
        fresh = F.col("came").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        front = saved(known.select("node", "word", fresh.alias("bits")).filter("bits <> 0"))
        if front.isEmpty():
            break
        rounds.append(front.withColumn("distance", F.lit(step)))
        if step < most:
            seen = saved(seen.unionByName(front).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    if not rounds:
        return place.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).filter("distance > 0")
    rows = reduce(DataFrame.unionByName, rounds)
    every = rows.select("node", "word", "bits", "distance", F.explode(F.sequence(F.lit(0), F.lit(WORD_BITS - 1))).alias("bit"))
    return every.filter(F.getbit("bits", "bit") == 1).join(place, ["word", "bit"]).select("start", "node", "distance")


def call_chains(edges: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """start, chain (array of ids) of every directed calls path of one to most
    edges; parallel edges count once; cycles run on until the bound."""
    calls = saved(edges.filter("type = 'calls'").select("source", "target").distinct())
    front = starts.select(F.col("id").alias("start"), F.array("id").alias("chain"), F.col("id").alias("at"))
    out = None
    for _ in range(most):
        front = front.join(calls, front["at"] == calls.source).select("start", F.concat("chain", F.array("target")).alias("chain"), F.col("target").alias("at"))
        front = saved(front)
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
    return (out if out is not None else front).select("start", "chain")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, path (the least of the shortest) of each pair that is
    connected, however far.  A source goes on only while it has open pairs."""
    step = saved(edges.select("source", "target").distinct().withColumnsRenamed({"source": "a", "target": "b"}))
    waiting = saved(pairs.select("source", "target").distinct())
    front = waiting.select(F.col("source").alias("root"), F.col("source").alias("node"), F.array("source").alias("path")).distinct()
    reached, done = [saved(front.select("root", "node"))], []
    while True:
        hit = front.join(waiting, (front.root == waiting.source) & (front.node == waiting.target)).select("source", "target", "path")
        done.append(saved(hit))
        waiting = saved(waiting.join(done[-1], ["source", "target"], "left_anti"))
        new = front.join(waiting.select(F.col("source").alias("root")).distinct(), "root", "left_semi").join(step, F.col("node") == step.a)
        new = new.groupBy("root", F.col("b").alias("node")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        for known in reached:
            new = new.join(known, ["root", "node"], "left_anti")
        front = saved(new)
        if front.isEmpty():
            break
        reached.append(front.select("root", "node"))
        if len(reached) > 8:  # long walks: few tables to look into
            reached = [saved(_union(reached))]
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (least id that is connected, either way)."""
    both = saved(undirected(edges))
    labels = saved(nodes.select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(labels, both.target == labels.id).groupBy(F.col("source").alias("id")).agg(F.min("component").alias("seen"))
        hooked = labels.join(seen, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("component"))
        hooked = saved(hooked)
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        new = saved(hooked.join(jump, "component").select("id", "old", F.col("jump").alias("component")))
        if new.filter("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


#: Sources whose paths are counted at once.
BETWEENNESS_SOURCES = 100_000


def betweenness(edges: DataFrame, nodes: DataFrame, sources: int = BETWEENNESS_SOURCES) -> DataFrame:
    """id, centrality: directed betweenness, normalised, over all nodes as
    sources, a batch of them at a time; each batch is summed before the next."""
    step = saved(edges.select("source", "target").filter("source <> target").distinct())
    n = nodes.count()
    batches = max(1, math.ceil(n / sources))
    sums = []
    for k in range(batches):
        part = nodes.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        found = _dependencies_of(step, part.select("id"))
        if found is not None:
            sums.append(saved(found.groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("share"))))
    if not sums:
        return nodes.select("id", F.lit(0.0).alias("centrality"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    total = _union(sums).groupBy("id").agg((F.sum("share") * scale).alias("centrality"))
    return nodes.select("id").join(total, "id", "left").fillna(0.0, ["centrality"])


def _dependencies_of(step: DataFrame, starts: DataFrame) -> DataFrame | None:
    """s, v, share of each reached node, by counting shortest paths from the
    starts in rounds of joins and adding up dependencies backwards (Brandes)."""
    levels = [saved(starts.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    reached = levels[0].select("s", "v")
    while True:
        front = levels[-1]
        new = front.join(step, front.v == step.source).groupBy("s", F.col("target").alias("v")).agg(F.sum("paths").alias("paths"))
        new = saved(new.join(reached, ["s", "v"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        reached = reached.unionByName(new.select("s", "v"))
    total, below = None, None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        if below is None:
            here = here.withColumn("share", F.lit(0.0))
        else:
            here = here.join(below, ["s", "v"], "left").fillna(0.0, ["share"])
        here = saved(here)
        part = here.select("s", "v", "share")
        total = part if total is None else total.unionByName(part)
        up = levels[depth - 1].withColumnsRenamed({"v": "u", "paths": "paths_u"})
        edge = here.join(step, here.v == step.target).join(up, (here.s == up.s) & (step.source == up.u))
        below = edge.groupBy(here.s, F.col("u").alias("v")).agg(F.sum(F.col("paths_u") / F.col("paths") * (1 + F.col("share"))).alias("share"))
    return total


# -- statistics and composed questions ------------------------------------


def statistics(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """metric, value: counts of nodes and edges, by type (all types), of files, components, and the mean degree."""
    spark = nodes.sparkSession
    one = lambda name, df, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    def by_type(rows: DataFrame, kinds: list[str], label: str) -> DataFrame:
        known = spark.range(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("type"))
        counts = rows.groupBy("type").count()
        return known.join(counts, "type", "left").select(F.concat(F.lit(f"{label}:"), "type").alias("metric"), F.coalesce("count", F.lit(0)).cast("double").alias("value"))

    out = one("total_nodes", nodes, F.count("*")).unionByName(one("total_edges", edges, F.count("*")))
    out = out.unionByName(by_type(nodes, fixed.NODE_TYPES, "nodes")).unionByName(by_type(edges, fixed.EDGE_TYPES, "edges"))
    out = out.unionByName(one("files", nodes, F.countDistinct("path")))
    if components is not None:
        out = out.unionByName(one("components", components, F.countDistinct("component")))
    sizes = nodes.agg(F.count("*").alias("n")).join(edges.agg(F.count("*").alias("e")))
    degree = F.when(F.col("n") > 0, 2 * F.col("e") / F.col("n")).otherwise(0.0)
    return out.unionByName(sizes.select(F.lit("average_degree").alias("metric"), degree.alias("value")))


def map_statistics(nodes: DataFrame, edges: DataFrame, files: DataFrame, seconds: float | None = None) -> DataFrame:
    """metric, value: nodes, edges, files by language, and the seconds that the map took, if known."""
    count = lambda rows, name: rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    by_language = files.groupBy(language_of(extension(F.col("path"))).alias("language")).agg(F.count("*").alias("value"))
    out = count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(by_language.select(F.concat(F.lit("language:"), "language").alias("metric"), "value"))
    if seconds is not None:
        out = out.unionByName(nodes.sparkSession.createDataFrame([("seconds", int(seconds))], "metric string, value long"))
    return out


def excerpt(code: Column, chars: int = 100) -> Column:
    return F.substring(code, 1, chars)


def relationship_types(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, relationship: the first edge's type, that of the reverse
    edge with a prefix, indirect, or unknown where an end is no node."""
    first = edges.groupBy("source", "target").agg(F.min_by("type", F.struct("edge_id", "type")).alias("type"))
    back = first.select(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("reverse_"), "type").alias("reverse"))
    out = pairs.select("source", "target").distinct().join(first, ["source", "target"], "left").join(back, ["source", "target"], "left")
    known = lambda c, name: nodes.select(F.col("id").alias(c), F.lit(True).alias(name))
    out = out.join(known("source", "has_a"), "source", "left").join(known("target", "has_b"), "target", "left")
    there = F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    return out.select("source", "target", F.when(there, F.coalesce("type", "reverse", F.lit("indirect"))).otherwise("unknown").alias("relationship"))


def semantic_search(nodes: DataFrame, query: str, most: int = 50) -> DataFrame:
    """id, name, relevance, match_type of the nodes whose name or code holds the query, each once with its best score."""
    return term_search(nodes, [query], most).drop("term", "rank").orderBy(F.desc("relevance"), "id")


def term_search(nodes: DataFrame, terms: list[str], most: int = 50) -> DataFrame:
    """term, rank, id, name, relevance, match_type: the best nodes of each term.

    The terms of a question are few: they are literals of one scan over the nodes.
    """

    def best(term: str) -> Column:
        q = term.lower()
        by_name = F.when(F.lower("name").contains(q), name_relevance(F.col("name"), term))
        by_code = F.when(F.lower("code").contains(q), code_relevance(F.col("code"), term))
        kind = F.when(by_name.isNotNull() & (by_code.isNull() | (by_name >= by_code)), "name").otherwise("code")
        return F.when(by_name.isNotNull() | by_code.isNotNull(), F.struct(F.lit(term).alias("term"), F.greatest(by_name, by_code).alias("relevance"), kind.alias("match_type")))

    found = nodes.select("id", "name", F.explode(F.array_compact(F.array(*map(best, terms)))).alias("m")).select("m.term", "id", "name", "m.relevance", "m.match_type")
    order = Window.partitionBy("term").orderBy(F.desc("relevance"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def with_context(found: DataFrame, edges: DataFrame, kind: str = "all") -> DataFrame:
    """found (id, ...) with related_nodes, the sorted context nodes of each id."""
    around = context_nodes(edges, found.select("id").distinct(), kind).groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("related_nodes"))
    return found.join(around, "id", "left").withColumn("related_nodes", F.coalesce("related_nodes", F.array().cast("array<string>")))


def function_terms(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """pos, term of the terms that name a function."""
    ranked = nodes.sparkSession.createDataFrame([(i, t) for i, t in enumerate(terms)], "pos int, term string")
    named = nodes.filter("type = 'function'").filter(F.col("name").isin(*terms)).select(F.col("name").alias("term")).distinct()
    return ranked.join(named, "term", "left_semi").select("pos", "term")


def related_concepts(nodes: DataFrame, edges: DataFrame, concept: str, most_distance: int = 2, most: int = 20) -> DataFrame:
    """start, node, distance, strength, relationship of what lies around nodes that a concept names."""
    starts = nodes.filter(F.lower("name").contains(concept.lower())).select("id")
    near = related_nodes(edges, starts, most_distance).withColumn("strength", F.lit(1.0) / (F.col("distance") + 1))
    top = saved(near.orderBy(F.desc("strength"), "start", "node").limit(most))
    kinds = relationship_types(top.select(F.col("start").alias("source"), F.col("node").alias("target")), edges, nodes)
    return top.join(kinds, (top.start == kinds.source) & (top.node == kinds.target)).select("start", "node", "distance", "strength", "relationship")


def context_nodes(edges: DataFrame, ids: DataFrame, kind: str = "all") -> DataFrame:
    """id, other: direct neighbours (all), the first five dependencies
    (minimal), or the first fifteen within two steps (comprehensive)."""
    if kind == "all":
        both = dependencies(edges).unionByName(dependents(edges))
        return both.join(ids.select("id"), "id", "left_semi")
    if kind == "minimal":
        rows, order, most = dependencies(edges).join(ids.select("id"), "id", "left_semi").withColumn("distance", F.lit(1)), "other", 5
    else:
        rows, order, most = related_nodes(edges, ids, 2).select(F.col("start").alias("id"), F.col("node").alias("other"), "distance"), "other", 15
    first = Window.partitionBy("id").orderBy("distance", order)
    return rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).select("id", "other")


def impact(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """kind, id of what a change of the functions of a name touches: direct
    callers, nodes within three steps, files, and call chains."""
    targets = saved(find_node(nodes, name, "function").select("id"))
    direct = dependents(edges, ["calls"]).join(targets, "id", "left_semi").select(F.lit("direct_caller").alias("kind"), F.col("other").alias("id"))
    near = related_nodes(edges, targets, 3).select(F.col("node").alias("id")).distinct()
    indirect = near.select(F.lit("indirect").alias("kind"), "id")
    touched = near.unionByName(targets).join(nodes.select("id", "path"), "id").filter("path is not null").select(F.lit("file").alias("kind"), F.col("path").alias("id"))
    chains = call_chains(edges, targets, 4).select(F.lit("call_chain").alias("kind"), F.array_join("chain", " -> ").alias("id"))
    return direct.unionByName(indirect).unionByName(touched).unionByName(chains).distinct()


def data_flows(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """Shortest paths between functions that different terms name, earlier term first."""
    spark = nodes.sparkSession
    ranked = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "pos int, name string")
    named = nodes.filter("type = 'function'").join(F.broadcast(ranked), "name").select("id", "pos")  # as many terms as a question has
    ends = named.select(F.col("id").alias("target"), F.col("pos").alias("later"))
    pairs = named.withColumnRenamed("id", "source").join(ends, F.col("pos") < F.col("later")).select("source", "target")
    return shortest_paths(edges, pairs)


def question_context(nodes: DataFrame, edges: DataFrame, question: str, terms: list[str], per_term: int = 10, files: int = 5) -> DataFrame:
    """term, kind, id: the best nodes of each term (node), the files of its
    first few (file), call chains of up to three steps from the functions it
    names (chain), shortest paths between functions of different terms (flow),
    and, if the question asks for a change, what the change touches (impact)."""
    if not terms:
        return nodes.select(F.lit("").alias("term"), F.lit("").alias("kind"), "id").limit(0)
    best = saved(term_search(nodes, terms, per_term))
    out = best.select("term", F.lit("node").alias("kind"), "id")
    held = best.filter(F.col("rank") <= files).join(nodes.select("id", "path"), "id").filter("path is not null")
    out = out.unionByName(held.select("term", F.lit("file").alias("kind"), F.col("path").alias("id")).distinct())
    named = saved(nodes.filter((F.col("type") == "function") & F.col("name").isin(*terms)).select("id", F.col("name").alias("term")))
    text = F.array_join("chain", " -> ")
    chains = call_chains(edges, named.select("id"), 3).join(named.withColumnRenamed("id", "start"), "start")
    out = out.unionByName(chains.select("term", F.lit("chain").alias("kind"), text.alias("id")))
    flows = data_flows(nodes, edges, terms).join(named, F.col("source") == named.id)
    out = out.unionByName(flows.select("term", F.lit("flow").alias("kind"), F.array_join("path", " -> ").alias("id")))
    if is_change(question):
        for r in function_terms(nodes, terms).collect():  # at most the question's terms
            touched = impact(nodes, edges, r.term)
            out = out.unionByName(touched.select(F.lit(r.term).alias("term"), F.concat(F.lit("impact:"), "kind").alias("kind"), "id"))
    return out


def is_change(question: str) -> bool:
    return any(w in question.lower() for w in fixed.CHANGE_WORDS)


# -- JSON -----------------------------------------------------------------

NODE_SCHEMA = "id string, type string, name string, path string, start_line int, end_line int, code string"
EDGE_SCHEMA = "source string, target string, type string, name string, edge_id bigint"


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """JSON lines, in as many files as there are partitions."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODE_SCHEMA).json(f"{folder}/nodes"), spark.read.schema(EDGE_SCHEMA).json(f"{folder}/edges")
