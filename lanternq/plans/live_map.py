"""A code map that is kept up to date file by file.

Definitions, imports, calls and what they lead to are tables in parts by path.
An update parses changed files only, resolves only those imports and calls
anew whose candidates have changed, and writes only the parts in which rows
change.  An import's candidates change when one of the files it could lead to
comes or goes; a call's, when a function of its name does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, structure
from ..shared import drop_scratch, written
from ..sources.corpus import extension, graph_files

PARTS = 64

TABLES = {
    "state": "path string, ext string, digest long",
    "functions": "path string, name string, start_line int, end_line int, code string",
    "classes": "path string, name string, start_line int, end_line int, code string",
    "imports": "path string, name string, line int",
    "calls": "path string, name string, line int",
    "import_targets": "path string, name string, target string",
    "call_targets": "path string, name string, target_path string, start_line int, cross_file boolean",
}


def part_of(path: str = "path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(PARTS)).cast("int")


class LiveMap:
    """Kept in a folder that the driver and all executors can reach; one update at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not held.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(held):
            return self.spark.createDataFrame([], f"{TABLES[name]}, part int")
        return self.spark.read.schema(f"{TABLES[name]}, part int").parquet(path)

    def rows(self, name: str) -> DataFrame:
        return self.table(name).filter("path is not null").drop("part")

    def _replace(self, name: str, out: DataFrame, rows: DataFrame, by: tuple[str, ...] = ("path",)) -> int:
        """Rows with the keys of out go, rows come; only their parts are written.
        Returns the number of rows that came."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = written(rows.select(*columns).withColumn("part", part_of()), name)
        parts = written(rows.select("part").union(out.select(part_of().alias("part"))).distinct(), "parts")  # at most PARTS
        stay = self.table(name).filter("path is not null").join(F.broadcast(parts), "part", "left_semi").join(out, list(by), "left_anti")
        # A part without rows is still written, as otherwise its old rows would stay.
        mark = parts.select(*(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in TABLES[name].split(", ")), "part")
        new = written(stay.select(*columns, "part").unionByName(rows).unionByName(mark), name)
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")
        came = rows.count()
        drop_scratch(rows, parts, new)
        return came

    def update(self, files: DataFrame) -> dict[str, int]:
        """Brings the map to the state of files (path, ext, content; all of the
        corpus); returns how many files and rows were touched."""
        held = graph_files(files)
        now = held.select("path", F.xxhash64(F.coalesce("content", F.lit(""))).alias("digest"))
        old = self.rows("state").select("path", F.col("digest").alias("had"))
        differ = now.join(old, "path", "full").filter("not (digest <=> had)")
        differ = written(differ.select("path", F.col("digest").isNull().alias("gone")), "differ")
        changed = held.join(differ.filter("not gone"), "path", "left_semi")
        out = self._apply(changed, differ.select("path"))
        drop_scratch(differ)
        return out

    def upsert(self, files: DataFrame, deleted: DataFrame | None = None) -> dict[str, int]:
        """Takes new contents of some files and paths (column path) of deleted ones;
        files that the map leaves out count as deleted.  Fits ``foreachBatch``."""
        paths = files.select("path") if deleted is None else files.select("path").union(deleted.select("path"))
        return self._apply(graph_files(files), written(paths.distinct(), "paths"))

    def _apply(self, changed: DataFrame, touched: DataFrame) -> dict[str, int]:
        """changed: files with their contents; touched: paths of these and of deleted files."""
        if touched.isEmpty():
            return dict.fromkeys(("files", "parsed", "imports", "calls"), 0)
        changed = written(changed.select("path", "ext", "content"), "changed")
        state = changed.select("path", "ext", F.xxhash64(F.coalesce("content", F.lit(""))).alias("digest"))
        before = self.rows("state").select("path").join(touched, "path", "left_semi")
        moved = written(state.select("path").subtract(before).union(before.subtract(state.select("path"))), "moved")

        parsed = written(structure.structure(changed), "parsed")
        functions, classes = structure.functions(parsed), structure.classes(parsed)
        imports, calls = structure.dependencies(changed, parsed)
        names = self.rows("functions").join(touched, "path", "left_semi").select("name").union(functions.select("name"))
        names = written(names.distinct(), "names")
        self._replace("functions", touched, functions)
        self._replace("classes", touched, classes)
        self._replace("imports", touched, imports)
        self._replace("calls", touched, calls)
        n_files = self._replace("state", touched, state)

        held = self.rows("imports").select("path", "name").distinct()
        tried = held.select("path", "name", F.explode(structure.candidates(F.col("path"), extension(F.col("path")), F.col("name"))).alias("target"))
        again = tried.join(moved.select(F.col("path").alias("target")), "target", "left_semi").select("path", "name")
        again = written(again.union(held.join(touched, "path", "left_semi")).distinct(), "imports_again")
        gone = self.rows("import_targets").select("path", "name").join(touched, "path", "left_semi").union(again).distinct()
        n_imports = self._replace("import_targets", written(gone, "gone"), structure.resolved_imports(again, self.rows("state")), ("path", "name"))

        held = self.rows("calls").select("path", "name").distinct()
        again = written(held.join(names, "name", "left_semi").select("path", "name").union(held.join(touched, "path", "left_semi")).distinct(), "calls_again")
        gone = self.rows("call_targets").select("path", "name").join(touched, "path", "left_semi").union(again).distinct()
        n_calls = again.count()
        self._replace("call_targets", written(gone, "gone"), structure.resolved_calls(again, self.rows("functions")), ("path", "name"))
        drop_scratch(changed, moved, parsed, names, again)
        return {"files": touched.count(), "parsed": n_files, "imports": n_imports, "calls": n_calls}

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """nodes and edges, as ``engine.code_map`` makes them from all files."""
        t = {name: self.rows(name) for name in TABLES}
        nodes = graph.nodes(t["state"], t["functions"], t["classes"], t["import_targets"])
        edges = graph.edges(t["functions"], t["classes"], t["import_targets"], t["call_targets"])
        return nodes, graph.with_ends(graph.with_function_calls(edges, t["calls"], t["call_targets"], t["functions"]), nodes)

