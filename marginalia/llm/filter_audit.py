"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A document only matters by which filters it fails, so a part of the corpus is at most 32 counted cells, one for each set of failed
filters. Each cell folds across the array of all orders, a literal of 120 times 5 numbers: along an order the first failed filter
removes the cell's documents, later ones are redundant. That gives 600 structs weighted by the cell's counts, and those of all
cells of a part are added up element by element. All of it is DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
NULL_ID = -(2**63)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
BLANKS = "[\\x20\\x09-\\x0D]+"

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_ENTRY = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">"


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Slim rows ``id, part, digest, failed``: bit k of ``failed`` is set if filter k of A to D rejects the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # words by themselves first, so that a text is split once
    rows = rows.select("id", "part", "text", F.array_remove(F.split("text", BLANKS), "").alias("words"))
    words, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = (
        words < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * words,
        100 * capitals.cast("long") > MAX_CAPITALS * F.length("text").cast("long"),
        F.col("text").rlike(MARKS),
    )
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("digest"), bits.cast("int").alias("failed"))


def _fold(cell: Column, orders: Column) -> Column:
    """The 600 entries of one cell: an order after the other, its steps in order."""

    def along(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("here"), F.array().cast(f"array<{_ENTRY}>").alias("steps"))

        def step(state: Column, f: Column) -> Column:
            fails, here = F.getbit(cell["failed"], f) == 1, state["here"]
            of = lambda when, count: F.when(when, cell[count]).otherwise(F.lit(0).cast("long"))
            entry = F.struct(
                of(here & ~fails, "n").alias("kept"),
                of(here & fails, "n").alias("removed"),
                of(~here & fails, "n").alias("redundant"),
                of(fails & (F.bit_count(cell["failed"]) == 1), "n").alias("unique_fails"),
                of(here & fails, "good").alias("good_lost"),
                of(here & fails, "toxic").alias("toxic_lost"),
            )
            return F.struct((here & ~fails).alias("here"), F.array_append(state["steps"], entry).alias("steps"))

        return F.aggregate(order, start, step, lambda state: state["steps"])

    return F.flatten(F.transform(orders, along))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in _COUNTS]))


def audit_cells(cells: DataFrame) -> DataFrame:
    """From ``part, failed, n, good, toxic``, one row for each set of failed filters of a part (bits, A is 1): the audit."""
    orders = F.array(*[F.array(*[F.lit(k) for k in order]) for order in ORDERS])
    names = F.array(*[F.lit("".join(FILTERS[k] for k in order)) for order in ORDERS])
    letters = F.flatten(orders)
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # 32 at most
    whole = parts.select("part", F.aggregate("cells", F.array_repeat(zero, 600), lambda sums, cell: _added(sums, _fold(cell, orders))).alias("entries"))
    mine = lambda f: F.zip_with("entries", letters, lambda e, k: F.when(k == f, e["removed"]).otherwise(F.lit(0).cast("long")))
    shapley = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda f: F.aggregate(mine(f), F.lit(0).cast("long"), lambda a, b: a + b))
    rows = whole.withColumn("shapley", shapley).select("part", "shapley", F.posexplode("entries").alias("i", "e"))
    at = F.col("i") % 5
    return rows.select("part", F.get(names, F.floor(F.col("i") / 5).cast("int")).alias("filter_order"), (at + 1).cast("int").alias("step"), *[F.col(f"e.{c}").alias(c) for c in _COUNTS], F.get("shapley", F.get(letters, F.col("i"))).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: documents of the part that are kept after the step, removed at it,
    redundant (failing its filter, removed before), failing its filter alone, the removed ones of good quality and the toxic
    ones, and what its filter removes in all orders together.

    Filters: A fewer than 200 words; B distinct words under half of the words; C over 2 percent capitals A-Z; D any of
    ``#$%&*|``; E the same text under a smaller id anywhere in the table. Null texts are empty ones, a null part is the empty
    string, a null id is smaller than all others and has no labels; rows that share id and text all count, and none of them
    makes another fail E. A document is good or toxic if any of its labels says so. Other columns are not looked at; an empty
    table gives an empty result.

    A text is read by one task and goes no further than its digest. Rows that agree in id, part and digest are counted before
    they are shuffled; the first holder of each digest is found by a partial aggregate and met by digest and id together, so a
    text that a third of all documents repeat spreads over their ids.
    """
    scratch = Scratch(docs.sparkSession)
    once = scratch.write(_judged(docs, id_col, text_col, part_col).groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("n")), "judged")
    first = once.groupBy("digest").agg(F.min("id").alias("first_id")).withColumnRenamed("digest", "of")
    first = scratch.write(first, "first")  # joined from files, so that skewed partitions can be split
    marked = once.join(first, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("first_id")), "left")
    marked = marked.select("id", "part", "n", F.when(F.col("of").isNull(), F.col("failed") + 16).otherwise(F.col("failed")).cast("int").alias("failed"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    told = labels.select(F.col(id_col).cast("long").alias("label_id"), "quality", "toxic").filter("label_id is not null and (quality = 1 or toxic = 1)")
    told = scratch.write(told.groupBy("label_id").agg(is_one("quality"), is_one("toxic")), "labels")
    told_of = marked.join(told, F.col("id") == F.col("label_id"), "left")
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    cells = told_of.groupBy("part", "failed").agg(F.sum("n").alias("n"), weighed("quality").alias("good"), weighed("toxic").alias("toxic"))
    return audit_cells(scratch.keep(cells, "cells"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit_filters(docs, table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH doc AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
label AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
first AS (SELECT t, min(id) AS first_id FROM doc GROUP BY t),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN id > first_id THEN 'E' ELSE '' END) AS fails
  FROM doc JOIN first USING (t) LEFT JOIN label USING (doc_id)),
cell AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails = f AS alone, contains(fails, f) AS hit,
         len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM cell, steps),
summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
