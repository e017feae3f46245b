"""Term lists: one line a term, plain or ``label = regex``, with headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PYWS

EDGE_LEFT, EDGE_RIGHT = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: What may stand between the words of a term.
BETWEEN = rf"(?:{PYWS}|[-_])+"


def terms_table(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``lines(ord, line)`` to ``term, pattern, ord, heading``; ``by`` names the columns that tell several lists apart.

    A plain term matches as a whole word or phrase, with any run of white space, hyphens or underscores between its
    words; written in capitals it matches capitals only. ``#`` starts a comment; a comment directly above a term
    is the heading of that term and of those after it. A label that comes again becomes ``x (2)``.
    """
    by = by or []
    order = Window.partitionBy(*by, F.lit(0)).orderBy("ord")  # a list is written by hand
    bare = F.trim(F.regexp_replace(F.split_part("line", F.lit("#"), F.lit(1)), rf"^{PYWS}+|{PYWS}+\z", ""))
    rows = lines.withColumn("bare", bare).withColumn("is_term", F.col("bare") != "")
    comment = F.trim(F.regexp_replace(F.trim("line"), "^#+", ""))
    rows = rows.withColumn("note", F.when(~F.col("is_term") & F.trim("line").startswith("#"), F.nullif(comment, F.lit(""))))
    rows = rows.withColumn("above", F.when(F.col("is_term"), F.lag("note").over(order)))
    rows = rows.withColumn("heading", F.last("above", ignorenulls=True).over(order)).filter("is_term")
    custom = F.instr("bare", " = ") > 0
    label = F.when(custom, F.trim(F.split_part("bare", F.lit(" = "), F.lit(1)))).otherwise(F.col("bare"))
    given = F.trim(F.expr("substring(bare, instr(bare, ' = ') + 3)"))
    words = F.transform(F.split("bare", rf"(?:{PYWS}|-)+"), lambda w: F.regexp_replace(w, r"([^A-Za-z0-9_])", r"\\$1"))
    body = F.concat(F.lit(EDGE_LEFT), F.array_join(words, BETWEEN), F.lit(EDGE_RIGHT))
    shouted = (F.upper("bare") == F.col("bare")) & F.col("bare").rlike(r"\p{L}")
    pattern = F.when(custom, given).when(shouted, body).otherwise(F.concat(F.lit("(?iu)"), body))
    rows = rows.select(*by, label.alias("label"), pattern.alias("pattern"), "ord", "heading")
    again = F.row_number().over(Window.partitionBy(*by, "label").orderBy("ord"))
    term = F.when(again > 1, F.concat("label", F.lit(" ("), again.cast("string"), F.lit(")"))).otherwise(F.col("label"))
    return rows.select(*by, term.alias("term"), "pattern", "ord", "heading")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """The terms of one text file, whose lines keep their order."""
    text = spark.read.option("wholetext", True).text(path)
    return terms_table(text.select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")))


def terms_of(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, line) for i, line in enumerate(text.splitlines())]
    return terms_table(spark.createDataFrame(rows, "ord int, line string"))
