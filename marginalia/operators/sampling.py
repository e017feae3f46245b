"""Units chosen: strata, seeded draws, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_stratum(stratum: dict) -> Column:
    """``unit_kind``, and optionally ``min_bytes``, ``from`` and ``before`` (days), over columns ``unit_kind, start, end, time``."""
    day = F.substring(F.coalesce("time", F.lit("")), 1, 10)
    out = (F.col("unit_kind") == stratum["unit_kind"]) & (F.col("end") - F.col("start") >= stratum.get("min_bytes", 0))
    if stratum.get("from"):
        out = out & (day >= stratum["from"])
    if stratum.get("before"):
        out = out & (day < stratum["before"])
    return out


def seeded(seed: str, *cols: str) -> Column:
    """A place in an order that follows from a seed and the columns alone."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]).cast("binary"), 256)


def stratified_sample(units: DataFrame, strata: list[dict], seed: int) -> DataFrame:
    """``units(unit, unit_kind, start, end, time, group, text_key)`` to ``stratum, unit``: at most ``n`` units a stratum, one
    group at a time in seeded order, one unit for each text, also across strata. The same seed gives the same draw; order
    comes from digests. Units without a text key are not compared with others."""
    key = F.coalesce(F.col("text_key").cast("string"), F.concat(F.lit("unit "), F.col("unit").cast("string")))
    rest, drawn = units.withColumn("_key", key), []
    for stratum in strata:  # a handful, each excluding the texts of those before it
        label = f"{seed}:{stratum['label']}"
        pool = rest.filter(in_stratum(stratum)).withColumn("_place", seeded(label, "unit"))
        pool = pool.withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy("_place"))).filter("_first = 1")
        pool = pool.withColumn("_turn", F.row_number().over(Window.partitionBy("group").orderBy("_place"))).filter(F.col("_turn") <= stratum["n"])  # no more of one group can be drawn, so ranking is cut short
        got = pool.orderBy("_turn", seeded(label, "group"), "_place").limit(stratum["n"]).select(F.lit(stratum["label"]).alias("stratum"), "unit", "_key")
        drawn.append(got)
        rest = rest.join(got.select(F.col("_key").alias("_taken")), F.col("_key") == F.col("_taken"), "left_anti")
    return reduce(DataFrame.unionByName, drawn).select("stratum", "unit")


def deal_batches(units: DataFrame, seed: int, size: int) -> DataFrame:
    """``unit, batch, place``: units in seeded order, cut in batches of ``size``. Units are ranked inside ranges of the order
    and ranges are offset by the counts before them, so that no task sorts all units."""
    order = units.select("unit", seeded(str(seed), "unit").alias("_place"))
    rows = order.withColumn("_bucket", F.conv(F.left("_place", F.lit(3)), 16, 10).cast("int"))  # 4096 ranges of the order
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n"))  # one row a range
    rows = rows.join(F.broadcast(before.select("_bucket", "_before")), "_bucket")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_place", "unit")) - 1 + F.col("_before")
    rows = rows.select("unit", rank.cast("long").alias("place"))
    return rows.select("unit", F.floor(F.col("place") / size).alias("batch"), "place")


def unread_batches(batches: DataFrame, read: DataFrame) -> DataFrame:
    """Batches as dealt, without the units read already, so that resumed batches align with the first ones."""
    return batches.join(read.select("unit").distinct(), "unit", "left_anti")


def units_of(samples: DataFrame) -> DataFrame:
    """``samples(sample, about)``: the units that a sample names, in order."""
    return samples.select("sample", F.posexplode("about").alias("place", "unit"))
