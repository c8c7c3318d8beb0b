"""A corpus of files as a DataFrame: path, ext, content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import language_of


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def glob_regex(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def is_ignored(path: Column, ignores: list[str] = fixed.SEARCH_IGNORES, substring: bool = False) -> Column:
    """Whether a segment of the path is on the list; with substring, whether
    any listed text occurs anywhere in the path."""
    if substring:
        return path.rlike("|".join(re.escape(i) for i in ignores))
    return path.rlike("(^|/)(" + "|".join(map(glob_regex, ignores)) + ")(/|$)")


def ignore_union(*lists: list[str]) -> list[str]:
    """Ignore lists together, each entry once."""
    return list(dict.fromkeys(i for some in lists for i in some))


def read_tree(
    spark: SparkSession, root: str, extensions: list[str] | None = None, ignores: list[str] = fixed.SEARCH_IGNORES, strict: bool = True
) -> DataFrame:
    """Files below root: path (from root on, with a leading slash), file_name,
    ext, language, size_bytes, mtime, content, error.  Spark's own file listing
    leaves out empty files and names that begin with a dot or an underscore;
    ``tree_source.read_source_tree`` has them and lists no ignored folder.

    Bytes that are no UTF-8 give a row with an error and no content, or, if not
    strict, are left out of the content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/")))
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base}", "")
    out = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")
    out = out.filter(~is_ignored(F.col("path"), ignores)).withColumn("ext", extension(F.col("path")))
    if extensions:
        out = out.filter(F.col("ext").isin(extensions))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    rest = F.lit(None) if strict else one_newline(tolerant(text))
    return out.select(
        "path",
        F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"),
        "ext",
        language_of(F.col("ext")).alias("language"),
        "size_bytes",
        "mtime",
        F.when(valid, one_newline(text)).otherwise(rest).alias("content"),
        F.when(~valid & F.lit(strict), F.lit("not UTF-8")).alias("error"),
    )


def one_newline(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def tolerant(text: Column) -> Column:
    """The text without bytes that are no UTF-8.  Replacement signs of its own
    stay: they are spelt another way while those of bad bytes are taken out."""
    mark, sign = "\ue000", "\ufffd"
    spelt = F.replace(F.replace(text, F.lit(mark), F.lit(mark + "a")), F.lit(sign), F.lit(mark + "b"))
    good = F.replace(F.make_valid_utf8(spelt), F.lit(sign), F.lit(""))
    back = F.replace(F.replace(good, F.lit(mark + "b"), F.lit(sign)), F.lit(mark + "a"), F.lit(mark))
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def capped(content: Column, size_bytes: Column, most_bytes: int = 1 << 20, most_chars: int = 512 << 10) -> Column:
    """The content that graph analysis looks at: none of large files, else its first part."""
    return F.when(size_bytes <= most_bytes, F.substring(content, 1, most_chars))


def line_list(content: str = "content") -> Column:
    """The lines of a text; an end of line at the end opens no further line."""
    parts = F.split(one_newline(F.col(content)), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """A row for each line, numbered from one."""
    return files.select(*keep, F.posexplode(line_list(content)).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_number"), "line")


def is_analysable(size_bytes: Column, ext: Column, most_mb: int = 1) -> Column:
    return (size_bytes <= most_mb << 20) & ~F.lower(ext).isin(*fixed.BINARY_ENDINGS)


def graph_files(files: DataFrame, most_mb: int = 1) -> DataFrame:
    """What dependency graphs look at: files of the parsed languages outside
    ignored folders (anywhere in the path) that are not too large, and of those the first part."""
    size = F.octet_length("content")
    kept = files.filter(F.col("ext").isin(*fixed.GRAPH_ENDINGS) & ~is_ignored(F.col("path"), fixed.GRAPH_IGNORES, substring=True) & is_analysable(size, F.col("ext"), most_mb))
    return kept.withColumn("content", capped(F.col("content"), size, most_mb << 20))


def pre_scan(files: DataFrame) -> DataFrame:
    """path, size_bytes of the files that a graph is made from, small ones first."""
    return graph_files(files).select("path", F.octet_length("content").alias("size_bytes")).orderBy("size_bytes", "path")


def first_files(files: DataFrame, most: int) -> DataFrame:
    """The first files by path: samples for language and project detection."""
    return files.orderBy("path").limit(most)


# -- corpora that stand on the given tables -------------------------------

FOLDERS = ("src/core", "lib", "test", "docs", "examples", "app")
ENDINGS = (".py", ".java", ".js", ".md", ".json")


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, path, ext, content."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % by + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = pick(ENDINGS, len(ENDINGS))
    path = F.concat(pick(FOLDERS, len(FOLDERS)), F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return docs.select("doc_id", path.alias("path"), ext.alias("ext"), F.col("text").alias("content"))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files for suppliers and nations, Java and JavaScript files for parts: path, ext, content."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", "_")).alias("n"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return (
        supplier.select(F.format_string(SUPPLIER_PATH, "s_suppkey").alias("path"), F.lit(".py").alias("ext"), _fill(SUPPLIER_FILE, k="s_suppkey", n="n").alias("content"))
        .unionByName(nation.select(F.format_string("src/n_%s.py", "n").alias("path"), F.lit(".py").alias("ext"), _fill(NATION_FILE, n="n").alias("content")))
        .unionByName(
            part.select(F.format_string("src/main/java/app/P%d.java", "p_partkey").alias("path"), F.lit(".java").alias("ext"), _fill(JAVA_FILE, k="p_partkey", s="p_size").alias("content"))
        )
        .unionByName(part.select(F.format_string("web/p%d.js", "p_partkey").alias("path"), F.lit(".js").alias("ext"), _fill(JS_FILE, k="p_partkey", s="p_size").alias("content")))
    )


def _fill(template: str, **columns: str) -> Column:
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.col(column).cast("string"))
    return out


SUPPLIER_PATH = "src/s_%d.py"
SUPPLIER_FILE = """from n_{n} import g_{n}

def f_{k}(x):
    \"\"\"doc {k}\"\"\"
    return g_{n}(x)

class C_{k}:
    def m_{k}(self):
        return f_{k}(self)
"""
NATION_FILE = "def g_{n}(x):\n    return x\n"
JAVA_FILE = """package app;
import java.util.List;
import app.P{s};

/** Part {k}. */
public class P{k} {
    public P{k}() {
        reset();
    }
    public int price{k}(int q) {
        return P{s}.price{s}(q);
    }
}
"""
JS_FILE = """import x from './p{s}';
const y = require('lib{s}');
function show{k}(a) {
  return render(a);
}
"""
