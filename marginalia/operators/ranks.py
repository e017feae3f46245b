"""Places of rows in an order, of all rows or inside groups of any size, as a prefix sum over sorted partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import dropped, written

#: Bits of a generated id that number the rows of one partition.
ROW_BITS = 33


def ranked(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """``_rn``, a row's place in its group from 0, and ``_n``, the group's size; without groups, among all rows.

    Rows are written once and then dealt to tasks by ranges of group and order, whose bounds Spark samples from what was
    written; each task sorts its range. What a partition holds is counted, the counts are added up, and a row's place is what
    stands before its partition and before it there. So a group may be as large as the table, no window has more rows than
    there are partitions, and ``rows`` are computed once. Only rows that are equal in group and whole order share a task.
    The result reads a table in the shared folder, which dropped() deletes once nothing needs it.
    """
    once = written(rows, "to-rank")
    placed = once.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "in-order")
    dropped(once)
    part = F.shiftright("_at", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    all_parts = Window.orderBy("_part")  # a row a partition
    sizes = sizes.withColumns({"_before": F.sum("_size").over(all_parts) - F.col("_size"), "_all": F.sum("_size").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    numbered = placed.join(F.broadcast(sizes), part == F.col("_part")).withColumn("_rn", place)
    if not by:
        out = numbered.withColumn("_n", F.col("_all")).drop("_at", "_part", "_size", "_before", "_all")
        out._written_at = placed._written_at
        return out
    numbered = numbered.drop("_part", "_size", "_before", "_all", "_at")
    groups = numbered.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_rn").alias("_first"), F.count("*").alias("_n"))
    met = numbered.join(groups, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    out = met.withColumn("_rn", F.col("_rn") - F.col("_first")).drop("_first", *[f"_of_{c}" for c in by])
    out._written_at = placed._written_at
    return out


def in_pieces(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rows dealt by ranges of group and order, with ``_part`` and, inside a part, ``_at``: what carried() works on. Rows are
    computed once; a group of any size is spread over as many tasks as it has parts."""
    once = written(rows, "to-scan")
    placed = once.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", ROW_BITS)), "in-order")
    dropped(once)
    return placed


def carried(placed: DataFrame, by: list[str], value: Column, name: str, least: bool = False) -> DataFrame:
    """``name``: the largest (or least) ``value`` among the rows before a row in its group, null where there are none.

    An associative scan: each task takes the running maximum of its own piece of a group, and the maxima of pieces are carried on
    from piece to piece. No window has more rows of a group than one part holds, or than the group has parts."""
    best, both = (F.min, F.least) if least else (F.max, F.greatest)
    valued = placed.withColumn("_value", value)
    pieces = valued.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_piece")).agg(best("_value").alias("_most"))
    earlier = Window.partitionBy(*[f"_of_{c}" for c in by]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # pieces without one before them need no row; most groups have a single piece
    brought = pieces.withColumn("_brought", best("_most").over(earlier)).filter("_brought is not null").drop("_most")
    here = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_piece")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    met = valued.withColumn("_own", best("_value").over(here)).join(brought, same, "left")
    return met.withColumn(name, both("_own", "_brought")).drop("_value", "_piece", "_own", "_brought", *[f"_of_{c}" for c in by])


def running_max(rows: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` among the rows before a row in its group and order, null where there are none."""
    return carried(in_pieces(rows, by, order), by, value, name).drop("_at", "_part")
