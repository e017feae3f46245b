"""Codes gathered across readers, codebooks and what they were merged from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, name_key
from ..sources.folders import shared_folder
from .ranks import ranked


def gather_names(codings: DataFrame) -> DataFrame:
    """``codings(by, name, code)``: code names grouped ignoring case and white space, numbered ``n001`` ... by uses, then
    name: ``id, name`` (most common written form; tie: the form itself), ``uses, readers, codes``."""
    rows = codings.select("by", "code", collapse_ws(F.col("name")).alias("form")).withColumn("key", name_key(F.col("form")))
    forms = rows.groupBy("key", "form").agg(F.count("*").alias("n")).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("form"))).alias("m"))
    counts = rows.groupBy("key").agg(F.count("*").alias("uses"), F.countDistinct("by").alias("readers"), F.countDistinct("code").alias("codes"))
    ordered = ranked(counts.join(forms, "key"), [], [F.col("uses").desc(), F.col("key")]).withColumn("place", F.col("_rn") + 1)
    width = F.greatest(F.lit(3), F.length(F.col("_n").cast("string")))
    digits = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(F.col("place").cast("string")))), F.col("place").cast("string"))
    return ordered.select(F.concat(F.lit("n"), digits).alias("id"), "key", F.col("m.form").alias("name"), "uses", "readers", "codes")


def name_details(codings: DataFrame) -> DataFrame:
    """``codings(name, code_type, in_vivo_in_unit)``: per name its types with their counts, most used first (``a:3,b:1``), and
    how many of its codings quote a term that is not in the unit."""
    rows = codings.select(name_key(F.col("name")).alias("key"), "code_type", "in_vivo_in_unit")
    kinds = rows.groupBy("key", "code_type").agg(F.count("*").alias("n"), F.count_if(~F.col("in_vivo_in_unit")).alias("absent"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code_type")))
    said = F.transform("types", lambda x: F.concat(x["code_type"], F.lit(":"), (-x["n"]).cast("string")))
    return kinds.groupBy("key").agg(listed.alias("types"), F.sum("absent").alias("not_in_unit")).select("key", F.array_join(said, ",").alias("types"), "not_in_unit")


def uses_by_reader(codings: DataFrame) -> DataFrame:
    return codings.groupBy(name_key(F.col("name")).alias("key"), "by").agg(F.count("*").alias("uses"))


def account_names(pool: DataFrame, placed: DataFrame, left: DataFrame) -> DataFrame:
    """One row: names in ``pool(key)``, placed in codes, left out, in neither. A name both placed and left out is placed."""
    p, q = (df.select("key").distinct().withColumn(c, F.lit(True)) for df, c in ((placed, "placed"), (left, "left")))
    rows = pool.select("key").distinct().join(p, "key", "left").join(q, "key", "left")
    out = F.col("placed").isNull() & F.col("left").isNotNull()
    return rows.agg(F.count("*").alias("names"), F.count("placed").alias("placed"), F.count_if(out).alias("left_out"), F.count_if(F.col("placed").isNull() & F.col("left").isNull()).alias("unaccounted"))


def merge_lineage(codes: DataFrame, roots: DataFrame) -> DataFrame:
    """``codes(code, merges)`` and ``roots(root)``: under each root the codes that merge nothing, reached through ``merges``,
    each once. Steps are joins of a frontier; every step is written, so that lineage and loops end."""
    spark = codes.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    edges = codes.select(F.col("code").alias("from"), F.explode("merges").alias("to")).distinct()
    seen = roots.select("root", F.col("root").alias("code")).distinct().checkpoint()
    front = seen
    while not front.isEmpty():
        found = front.join(edges, F.col("code") == F.col("from")).select("root", F.col("to").alias("code")).distinct()
        front = found.join(seen, ["root", "code"], "left_anti").checkpoint()
        seen = seen.unionByName(front).checkpoint()
    leaves = codes.filter("merges is null or size(merges) = 0").select("code")
    return seen.join(leaves, "code", "left_semi")


def codebook_uses(lineage: DataFrame, codings: DataFrame) -> DataFrame:
    """Per codebook code (``root``) and first-pass code name merged under it: uses and readers. ``codings(by, name, code)``."""
    return lineage.join(codings, "code").groupBy("root", name_key(F.col("name")).alias("key")).agg(F.count("*").alias("uses"), F.countDistinct("by").alias("readers"))


def best_example(codings: DataFrame, size: int = 120) -> DataFrame:
    """``codings(key, id, exact, match)``: per key the quotation to show: exact matches first, then the length nearest
    ``size``, then text and id."""
    order = F.struct((F.col("match") != "exact").alias("a"), F.abs(F.length("exact") - size).alias("b"), F.col("exact"), F.col("id"))
    return codings.groupBy("key").agg(F.min(order).alias("m")).select("key", "m.exact", "m.id")


def two_definitions(definitions: DataFrame) -> DataFrame:
    """``definitions(key, definition, by)``: the longest definition of each key (tie: text), and the next one, from another
    reader if there is one."""
    rows = definitions.filter("definition <> ''").distinct()
    order = [F.length("definition").desc(), "definition", "by"]
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    first = ranked.filter("r = 1").select("key", F.col("definition").alias("first"), F.col("by").alias("first_by"))
    rest = ranked.filter("r > 1").join(first, "key").withColumn("s", F.row_number().over(Window.partitionBy("key").orderBy(F.col("by") == F.col("first_by"), "r")))
    return first.join(rest.filter("s = 1").select("key", F.col("definition").alias("second")), "key", "left").select("key", "first", "second")
