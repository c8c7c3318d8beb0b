"""Which spans hold which points: a stabbing join without a range join.

A span of whole numbers is cut into dyadic pieces (of 2^k numbers from a
multiple of 2^k on), at most two of each size.  A point lies in exactly one
piece of each size, so points and spans meet by equality of group, size and
number of the piece.  The work follows the number of spans and points, not the
spans' lengths, and a group with many rows is dealt by pieces too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes up to 2^30; numbers are not negative.
LEVELS = 31


def pieces(start: Column, end: Column) -> Column:
    """Array of (level, piece) that make up start to end, both included; empty if end comes first."""

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("long")
        low = F.ceil(start / size)
        high = F.floor((end.cast("long") + 1) / size)
        piece = lambda n: F.struct(k.alias("level"), n.cast("long").alias("piece"))
        left = F.when((low < high) & (low % 2 == 1), piece(low))
        right = F.when((low < high) & (high % 2 == 1), piece(high - 1))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))


def stabbed(points: DataFrame, spans: DataFrame, point: str, start: str = "start_line", end: str = "end_line", by: tuple[str, ...] = ("path",)) -> DataFrame:
    """The points with the columns of each span that holds them; rows without a
    point, a start or an end meet nothing."""
    cut = spans.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select("*", F.explode(pieces(F.col(start), F.col(end))).alias("_p"))
    cut = cut.select(*spans.columns, "_p.level", "_p.piece").withColumnsRenamed({"level": "_level", "piece": "_piece"})
    # Only sizes that occur are asked for.
    levels = cut.select("_level").distinct()
    sizes = sorted(r[0] for r in levels.collect())  # at most LEVELS rows
    if not sizes:
        sizes = [0]
    number = F.col(point).cast("long")
    asked = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(number, k).alias("piece")) for k in sizes))
    rows = points.filter(F.col(point).isNotNull()).select("*", F.explode(asked).alias("_q"))
    rows = rows.select(*points.columns, F.col("_q.level").alias("_level"), F.col("_q.piece").alias("_piece"))
    return rows.join(cut, [*by, "_level", "_piece"]).drop("_level", "_piece")


def smallest_around(points: DataFrame, spans: DataFrame, point: str, start: str = "start_line", end: str = "end_line", name: str = "name", by: tuple[str, ...] = ("path",)) -> DataFrame:
    """For each different point that a span holds, the smallest such span
    (ties: first start, then name) as a struct column span."""
    rest = [c for c in spans.columns if c not in by]
    found = stabbed(points.select(*by, point).distinct(), spans, point, start, end, by)
    order = F.struct(F.col(end) - F.col(start), F.col(start), F.col(name))
    return found.groupBy(*by, point).agg(F.min_by(F.struct(*rest), order).alias("span"))
