"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of characters.  Sorting the
blocks gives each distinct one an integer name; then the names of adjacent
pairs are named in the same way, level by level, until a single integer is
left for each text.  Names come from comparing whole blocks and whole pairs,
never from a digest, so two texts share an identity only if they are equal.

The name of a block is the smallest row number among the rows that carry it.
Rows of one block meet in one sort group.  A block that holds more than a
small share of all rows is dealt over ``SALTS`` groups, each of which names
its own part, and the parts' names are then lowered to their minimum.

Defined results: a null text counts as empty; rows without doc_id sort after
all others, and keep_id is null only if every row of a group lacks an id; of
rows that repeat one doc_id with one text, a single one is kept; an empty
table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, drop_scratch, kept_rows, numbered, partitions, text_of, written

BLOCK_CHARS = 8192
SALTS = 32
#: A block, pair or text is hot above this many rows, or above a 16th of a
#: partition's share of rows, whichever is more.
HOT_ROWS = 256


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), BLANKS, " ")


def _hot(keys: DataFrame, rows: int) -> DataFrame:
    """Keys with many rows.  At most rows / threshold <= 16 x partitions of
    them can exist, which bounds what is broadcast."""
    least = max(HOT_ROWS, rows // (16 * partitions(keys.sparkSession)))
    return keys.groupBy("hk").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("hk")


def _named(rows: DataFrame, content: list[str], rows_count: int) -> DataFrame:
    """Adds ``name``: the smallest (row, pos) code among rows of equal content."""
    hot = written(_hot(rows.select(F.xxhash64(*content).alias("hk")), rows_count), "hot").withColumn("is_hot", F.lit(True))
    salted = (
        rows.withColumn("hk", F.xxhash64(*content))
        .join(F.broadcast(hot), "hk", "left")
        .withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.col("row"), F.lit(SALTS))).otherwise(F.lit(-1)))
    )
    part = Window.partitionBy("hk", *content, "salt")
    local = salted.withColumn("name", F.min("code").over(part))
    first = F.when((F.col("salt") >= 0) & (F.col("code") == F.col("name")), F.struct(*content))
    local = written(local.select("row", "pos", "code", "name", "salt", *KEPT, "hk", first.alias("content")), "names")
    # At most SALTS rows for each of the boundedly many hot contents.
    merged = (
        local.filter("content is not null")
        .withColumn("global", F.min("name").over(Window.partitionBy("hk", "content")))
        .select("name", "global")
    )
    return (
        local.join(F.broadcast(merged), "name", "left")
        .withColumn("name", F.coalesce("global", "name"))
        .select("row", "pos", "code", "name", *KEPT)
    )


KEPT = ("doc_id", "text_sha256", "n_blocks")


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, number: str | None = None) -> DataFrame:
    """One row per row of docs: row (the stored column number, if given), doc_id, text_sha256, level, name."""
    row = F.col(number) if number else F.monotonically_increasing_id()
    norm = docs.select("doc_id", normalised().alias("norm"), row.alias("row"))
    blocks = F.when(F.length("norm") <= block_chars, F.array("norm")).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    )
    base = norm.select(
        "doc_id", "row", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(blocks).alias("pos", "block"), F.size(blocks).alias("n_blocks")
    ).withColumn("code", F.struct("row", "pos"))
    count = docs.count()
    named = written(_named(base, ["block"], count), "level0")
    levels = [named]
    level, ready = 0, [named.filter("n_blocks = 1").select("row", "doc_id", "text_sha256", F.lit(0).alias("level"), "name")]
    rest = named.filter("n_blocks > 1")
    while (left := rest.count()) > 0:
        level += 1
        pairs = (
            rest.groupBy("row", *KEPT, F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.min_by("name", "pos").alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
            .withColumn("b", F.coalesce("b", F.struct(F.lit(-1).cast("long").alias("row"), F.lit(-1).alias("pos"))))
            .withColumn("code", F.struct("row", "pos"))
            .withColumn("n_blocks", F.expr("(n_blocks + 1) div 2").cast("int"))
        )
        named = written(_named(pairs, ["a", "b"], left), f"level{level}")
        levels.append(named)
        ready.append(named.filter("n_blocks = 1").select("row", "doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        rest = named.filter("n_blocks > 1")
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    out = written(out, "identities")
    drop_scratch(*levels)
    return out


def _groups(docs: DataFrame, block_chars: int, number: str | None = None) -> DataFrame:
    ident = identities(docs, block_chars, number)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = ident.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    # Only texts that repeat need the lookup; both sides of the join are
    # exchanges over written tables, so that adaptive execution splits the
    # rows of a large group.
    many = written(groups.filter("group_size > 1"), "groups")
    return ident.join(many, ["level", "name"], "left")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    return _groups(docs, block_chars).select(
        "doc_id",
        F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows whose text an earlier row has already."""
    stored, number = numbered(docs)
    return kept_rows(stored, number, _groups(stored, block_chars, number).filter("first is null or row = first.row").select("row"))
