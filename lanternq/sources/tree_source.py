"""Files of a folder as a data source that does not list what is ignored.

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("root", "s3://bucket/project").load()

Folders are listed level by level, several at a time, and one with an ignored
name is never listed.  Filters on the ending, the path's beginning and the
size reach the listing too, so that files which they leave out are not opened.
The files are dealt into partitions of about ``bytesPerPartition``; contents
are read by the tasks.  Any store that Arrow's file systems know can be read.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import language_of

SCHEMA = "path string, ext string, size_bytes long, mtime timestamp, content binary"
COLUMNS = ("path", "ext", "size_bytes", "mtime", "content")
#: Folders that are listed at a time.
LISTERS = 16


def ending(name: str) -> str:
    found = re.search(r"[^/](\.[^./]+)$", name)
    return found[1] if found else ""


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:", root) else (fs.LocalFileSystem(), os.path.abspath(root))
    return store, path.rstrip("/")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int, object]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.ignores = options["ignores"].split() if "ignores" in options else list(fixed.SEARCH_IGNORES)
        self.bytes = int(options.get("bytespartition", options.get("bytesperpartition", 32 << 20)))
        self.endings: set[str] | None = None
        self.starts: list[str] = []
        self.most = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what a listing can decide; the others come back."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, (EqualTo, In)) and column == ("ext",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.endings = values if self.endings is None else self.endings & values
            elif isinstance(f, StringStartsWith) and column == ("path",):
                self.starts.append(f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == ("size_bytes",):
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            else:
                yield f

    def _ignored(self, name: str) -> bool:
        return any(fnmatch.fnmatchcase(name, pattern) for pattern in self.ignores)

    def _leads(self, path: str) -> bool:
        """Whether files below a folder may have the beginnings asked for."""
        return all(path.startswith(s) or s.startswith(path + "/") for s in self.starts)

    def listed(self) -> Iterator[tuple[str, int, object]]:
        store, base = file_system(self.root)
        level = [base]
        with ThreadPoolExecutor(LISTERS) as pool:
            while level:
                below = []
                for infos in pool.map(lambda folder: self._list(store, folder), level):
                    for info in infos:
                        path = info.path[len(base) :]
                        if self._ignored(info.base_name):
                            continue
                        if info.type == fs.FileType.Directory:
                            if self._leads(path):
                                below.append(info.path)
                        elif self._asked(path, info.size):
                            yield path, info.size, info.mtime
                level = below

    def _list(self, store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        return store.get_file_info(fs.FileSelector(folder))

    def _asked(self, path: str, size: int) -> bool:
        right_end = self.endings is None or ending(path) in self.endings
        return right_end and all(path.startswith(s) for s in self.starts) and (self.most is None or size <= self.most)

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for file in sorted(self.listed(), key=lambda f: f[0]):
            held.append(file)
            size += file[1]
            if size >= self.bytes:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, base = file_system(self.root)
        types = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary())
        for path, size, mtime in partition.files:
            with store.open_input_stream(base + path) as stream:
                row = (path, ending(path), size, mtime, stream.read())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], list(COLUMNS))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_source_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, ignores: list[str] = fixed.SEARCH_IGNORES, strict: bool = True) -> DataFrame:
    """The rows of ``corpus.read_tree``, from a listing that leaves out ignored folders."""
    from .corpus import one_newline, tolerant

    # Filters reach Python sources only if this is set.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    files = spark.read.format("source_tree").option("root", root).option("ignores", " ".join(ignores)).load()
    if extensions:
        files = files.filter(F.col("ext").isin(extensions))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    rest = F.lit(None) if strict else one_newline(tolerant(text))
    return files.select(
        "path", F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), "ext", language_of(F.col("ext")).alias("language"), "size_bytes", "mtime",
        F.when(valid, one_newline(text)).otherwise(rest).alias("content"), F.when(~valid & F.lit(strict), F.lit("not UTF-8")).alias("error"),
    )
