"""Marked passages: overlapping spans merged, numbered by how many families marked them, counted by day and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .ranks import carried, in_pieces, ranked


def merge_passages(entries: DataFrame) -> DataFrame:
    """``entries(id, unit, source, start, end, family, ...)`` with ``passage`` added: half-open spans of one unit and source
    that overlap chain into one passage, touching ones do not. Entries without a span stand alone. ``passage`` is a
    struct of unit, source and the passage's start, or of the entry's id. A unit's spans are merged piece by piece, and how
    far they reach is carried on, so a unit that very many have marked is spread over tasks."""
    placed = F.col("start").isNotNull() & F.col("end").isNotNull()
    by = ["unit", "source"]
    found = carried(in_pieces(entries.filter(placed), by, ["start", "end", "id"]), by, F.col("end"), "reach")
    found = found.withColumn("first", F.col("reach").isNull() | (F.col("start") >= F.col("reach")))
    # starts never fall in this order, so the last first one is the largest
    found = carried(found, by, F.when(F.col("first"), F.col("start")), "since").drop("_at", "_part")
    found = found.withColumn("group_start", F.when(F.col("first"), F.col("start")).otherwise(F.col("since"))).withColumn("alone", F.lit(None).cast("string"))
    rest = entries.filter(~placed).withColumns({"group_start": F.lit(None).cast("long"), "alone": F.col("id").cast("string")})
    both = found.drop("reach", "first", "since").withColumn("group_start", F.col("group_start").cast("long")).unionByName(rest)
    return both.withColumn("passage", F.struct("unit", "source", "group_start", "alone")).drop("group_start", "alone")


def passages(merged: DataFrame) -> DataFrame:
    """One row a passage: its span, tier (distinct families), entries."""
    rows = merged.groupBy("passage").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.countDistinct("family").alias("tier"), F.count("*").alias("entries"), F.min("id").alias("first_entry"))
    return rows.select("passage.unit", "passage.source", "start", "end", "tier", "entries", "first_entry")


def number_passages(rows: DataFrame) -> DataFrame:
    """``number`` such as ``2.014``: within a tier by first seen, page, unit, found before not found, start, first entry;
    at least three digits. Tiers are few and each holds a large share of all passages, which are sorted by ranges."""
    seen, page, unit = F.coalesce("first_seen", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("unit").cast("string")
    order = [seen, page, unit, F.col("start").isNull(), F.coalesce("start", F.lit(0)), F.col("first_entry")]
    rows = ranked(rows, ["tier"], order).withColumn("place", F.col("_rn") + 1)
    width = F.greatest(F.lit(3), F.length(F.col("_n").cast("string")))
    digits = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(F.col("place").cast("string")))), F.col("place").cast("string"))
    return rows.withColumn("number", F.concat(F.col("tier").cast("string"), F.lit("."), digits)).drop("place", "_rn", "_n")


def passages_by_day(rows: DataFrame) -> DataFrame:
    """``rows(day, tier)``: passages per day and tier, and a row of day ``all``: day, tier, passages."""
    out = rows.groupBy("day", "tier").agg(F.count("*").alias("passages"))
    return out.unionByName(rows.groupBy("tier").agg(F.count("*").alias("passages")).withColumn("day", F.lit("all")))


def tier_table(rows: DataFrame, unread: DataFrame) -> DataFrame:
    """Per tier: passages, and those whose unit every reader has read. ``unread(unit)`` are units that some reader has not."""
    marked = rows.join(unread.select(F.col("unit").alias("missing")).distinct(), F.col("unit") == F.col("missing"), "left")
    return marked.groupBy("tier").agg(F.count("*").alias("passages"), F.count_if(F.col("missing").isNull()).alias("read_by_all"))


def tiers_by_reader(merged: DataFrame) -> DataFrame:
    """Per reader (``family``) and tier: passages it took part in."""
    tier = merged.groupBy("passage").agg(F.countDistinct("family").alias("tier"))
    return merged.select("passage", "family").distinct().join(tier, "passage").groupBy("family", "tier").agg(F.count("*").alias("passages"))


def wordings(marks: DataFrame) -> DataFrame:
    """``marks(exact, unit, family)``: each exact wording with distinct units, marks and families; case and punctuation
    kept."""
    return marks.groupBy("exact").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("marks"), F.countDistinct("family").alias("families"))


def family_names(unfit: DataFrame, k: int = 15) -> DataFrame:
    """``unfit(family, suggested_name)``: per family its records, unnamed ones, distinct folded names, names used once, the
    count of the k-th name where there are more, and how many after it tie with it."""
    rows = unfit.select("family", fold(F.coalesce("suggested_name", F.lit(""))).alias("name"))
    base = rows.groupBy("family").agg(F.count("*").alias("records"), F.count_if(F.col("name") == "").alias("unnamed"))
    counts = rows.filter("name <> ''").groupBy("family", "name").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.col("n").desc(), "name")))
    cut = ranked.filter(F.col("place") == k).select("family", F.col("n").alias("cut"))
    tied = ranked.join(cut, "family").groupBy("family").agg(F.max("cut").alias("cut"), F.count_if((F.col("place") > k) & (F.col("n") == F.col("cut"))).alias("tied"), F.max("place").alias("last"))
    tied = tied.select("family", F.when(F.col("last") > k, F.col("cut")).alias("cut_count"), "tied")
    names = counts.groupBy("family").agg(F.count("*").alias("distinct_names"), F.count_if(F.col("n") == 1).alias("once"))
    out = base.join(names, "family", "left").join(tied, "family", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("distinct_names", "once", "tied")})


def top_names(unfit: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent folded names of each family."""
    rows = unfit.select("family", fold(F.coalesce("suggested_name", F.lit(""))).alias("name")).filter("name <> ''")
    counts = rows.groupBy("family", "name").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.col("n").desc(), "name"))).filter(F.col("place") <= k)


def wordings_by_family(marks: DataFrame) -> DataFrame:
    """``exact, family, units``: in how many distinct units each family marked a wording."""
    return marks.groupBy("exact", "family").agg(F.countDistinct("unit").alias("units"))


def entries_by_day(entries: DataFrame, read: DataFrame, units: DataFrame) -> DataFrame:
    """``entries(day, lens)``, ``read(unit, lens)`` and ``units(unit, day)``: per day and lens the entries it made on the day's
    units and how many of those units it had read; rows of day ``all`` for the totals."""
    made = entries.groupBy("day", "lens").agg(F.count("*").alias("entries"))
    had = read.select("unit", "lens").distinct().join(units.select("unit", "day"), "unit").groupBy("day", "lens").agg(F.count("*").alias("units_read"))
    by = made.join(had, ["day", "lens"], "full").select("day", "lens", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entries", "units_read")])
    whole = by.groupBy("lens").agg(F.sum("entries").alias("entries"), F.sum("units_read").alias("units_read")).withColumn("day", F.lit("all"))
    return by.unionByName(whole)
