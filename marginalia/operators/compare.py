"""Readers compared: which records count, who read what, where readers agree and differ.

``activities(id, lens, type, status, used)``, ``records(id, activity, by, ...)``, ``codings(unit, code, by, activity, ...)``,
``readings(unit, lens)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, name_key


def finished(activities: DataFrame) -> DataFrame:
    """Finished readings as ``done, lens``."""
    return activities.filter("type = 'read' and status = 'ok'").select(F.col("id").alias("done"), F.col("lens").alias("its_lens"))


def finished_records(records: DataFrame, activities: DataFrame) -> DataFrame:
    """Records that count: made in a finished reading by that reading's own lens."""
    own = (F.col("activity") == F.col("done")) & (F.col("by") == F.col("its_lens"))
    return records.join(finished(activities), own, "left_semi")


def unfinished_records(records: DataFrame, activities: DataFrame, lenses: DataFrame) -> DataFrame:
    """Records of ``lenses(lens)`` that no finished reading of their own and no failed one made, by kind and lens."""
    failed = activities.filter("type = 'read' and status <> 'ok'").select(F.col("id").alias("failed"))
    own = (F.col("activity") == F.col("done")) & (F.col("by") == F.col("its_lens"))
    rest = records.join(lenses, F.col("by") == F.col("lens"), "left_semi").join(finished(activities), own, "left_anti")
    return rest.join(failed, F.col("activity") == F.col("failed"), "left_anti").groupBy("kind", "by").agg(F.count("*").alias("records"))


def readings(activities: DataFrame, codings: DataFrame | None = None) -> DataFrame:
    """Distinct ``unit, lens``: what finished readings name, and what their lens coded (``codings`` that count)."""
    read = activities.filter("type = 'read' and status = 'ok'").select(F.explode("used").alias("unit"), "lens")
    if codings is not None:
        read = read.unionByName(codings.select("unit", F.col("by").alias("lens")))
    return read.distinct()


def unread_units(units: DataFrame, activities: DataFrame, lenses: DataFrame) -> DataFrame:
    """Units that no finished reading of these lenses has named."""
    mine = activities.join(lenses, "lens", "left_semi")
    return units.join(readings(mine).select("unit").distinct(), "unit", "left_anti")


def same_reading(lenses: DataFrame) -> DataFrame:
    """``lenses(lens, model, requested, core, at)``: lenses with one core (everything but model, substitution and harness)
    that were asked of one model are one reading. ``reading`` is its first lens: asked lenses come before
    substitutes, then by time and id."""
    asked = F.coalesce("requested", "model")
    group = Window.partitionBy("core", "asked").orderBy(F.col("requested").isNotNull(), "at", "lens")
    rows = lenses.withColumn("asked", asked)
    return rows.withColumn("place", F.row_number().over(group)).withColumn("reading", F.first("lens").over(group)).select("lens", "asked", "reading", "place")


def reader_totals(read: DataFrame, codings: DataFrame, lost: DataFrame) -> DataFrame:
    """Per lens: units read, of those read by another lens too, codings, distinct unit and code, codes per unit,
    quotations not found. ``codings`` and ``lost`` hold only records that count."""
    several = read.groupBy("unit").agg(F.collect_set("lens").alias("lenses"))  # lenses are few
    units = several.select(F.explode("lenses").alias("lens"), F.size("lenses").alias("readers")).groupBy("lens").agg(F.count("*").alias("units_read"), F.count_if(F.col("readers") >= 2).alias("units_compared"))
    pairs = codings.groupBy("by", "unit", "code").agg(F.count("*").alias("n")).groupBy("by").agg(F.sum("n").alias("codings"), F.count("*").alias("codes_applied"))
    missed = lost.groupBy("by").agg(F.count("*").alias("quotes_not_found"))
    out = units.join(pairs.withColumnRenamed("by", "lens"), "lens", "left").join(missed.withColumnRenamed("by", "lens"), "lens", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("codings", "codes_applied", "quotes_not_found")}
    return out.withColumns(zero).withColumn("codes_per_unit", F.col("codes_applied") / F.col("units_read"))


def _applied(read: DataFrame, codings: DataFrame) -> DataFrame:
    """``unit, code, n, readers`` over units that two or more lenses read: how many of them applied the code."""
    several = read.groupBy("unit").agg(F.count("*").alias("readers")).filter("readers >= 2")
    return codings.select("unit", "code", "by").distinct().groupBy("unit", "code").agg(F.count("*").alias("n")).join(several, "unit")


def code_agreement(codes: DataFrame, read: DataFrame, codings: DataFrame) -> DataFrame:
    """Per code over units read by two or more: applied by all their readers, by some, by exactly one. Codes that
    nobody applied keep zeros."""
    rows = _applied(read, codings)
    one = rows.groupBy("code").agg(
        F.count_if(F.col("n") == F.col("readers")).alias("all_readers"), F.count_if(F.col("n") < F.col("readers")).alias("some"), F.count_if(F.col("n") == 1).alias("one"),
    )
    return codes.select("code").join(one, "code", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("all_readers", "some", "one")})


def unit_divergence(read: DataFrame, codings: DataFrame) -> DataFrame:
    """Per unit read by two or more: how many codes some but not all of its readers applied."""
    several = read.groupBy("unit").agg(F.count("*").alias("readers")).filter("readers >= 2")
    some = _applied(read, codings).filter("n < readers").groupBy("unit").agg(F.count("*").alias("divergence"))
    return several.join(some, "unit", "left").select("unit", "readers", F.coalesce("divergence", F.lit(0)).cast("long").alias("divergence"))


def pair_overlap(read: DataFrame, codings: DataFrame) -> DataFrame:
    """Per pair of lenses: units both read, each one's distinct units and codes over those, common ones, Jaccard (null
    where neither has any). Lenses are few: a unit's readers, and the lenses of each of its codes, are small sets, and
    pairs are counted from these, never by joining codings with codings."""
    readers = read.groupBy("unit").agg(F.collect_set("lens").alias("readers"))
    marks = codings.groupBy("unit", "code").agg(F.collect_set("by").alias("by")).groupBy("unit").agg(F.collect_list("by").alias("codes"))
    lenses = read.select("lens").distinct()
    none = lenses.select(F.col("lens").alias("a")).crossJoin(lenses.select(F.col("lens").alias("b"))).filter("a < b").select("a", "b", *[F.lit(0).cast("long").alias(c) for c in ("units", "a_pairs", "b_pairs", "both")])
    rows = readers.filter(F.size("readers") > 1).join(marks, "unit", "left").withColumn("codes", F.coalesce("codes", F.array().cast(marks.schema["codes"].dataType)))
    met = rows.select("codes", "readers", F.explode("readers").alias("a")).select("codes", "a", F.explode("readers").alias("b")).filter("a < b")

    def having(*sides: str) -> Column:
        found = lambda by: reduce(Column.__and__, [F.array_contains(by, F.col(s)) for s in sides])
        return F.size(F.filter("codes", found)).cast("long")

    counts = met.select("a", "b", F.lit(1).cast("long").alias("units"), having("a").alias("a_pairs"), having("b").alias("b_pairs"), having("a", "b").alias("both"))
    out = counts.unionByName(none).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("units", "a_pairs", "b_pairs", "both")])
    union = F.col("a_pairs") + F.col("b_pairs") - F.col("both")
    return out.withColumn("jaccard", F.when(union > 0, F.col("both") / union))


def suggested_names(unfit: DataFrame) -> DataFrame:
    """``unfit(by, suggested_name)``: names ignoring case and white space, with count, distinct lenses and the most common
    form (tie: the form itself)."""
    rows = unfit.select("by", collapse_ws(F.coalesce("suggested_name", F.lit(""))).alias("form")).filter("form <> ''")
    forms = rows.groupBy(name_key(F.col("form")).alias("key"), "form").agg(F.count("*").alias("n"))
    best = forms.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("form"))).alias("m"))
    counts = rows.groupBy(name_key(F.col("form")).alias("key")).agg(F.count("*").alias("count"), F.countDistinct("by").alias("readers"))
    return counts.join(best, "key").select(F.col("m.form").alias("name"), "count", "readers")


def most_divergent(divergence: DataFrame, units: DataFrame, k: int = 60) -> DataFrame:
    """The k units with the largest divergence, then first seen, then id. ``units(unit, time)``."""
    return divergence.filter("divergence > 0").join(units, "unit").orderBy(F.col("divergence").desc(), F.coalesce("time", F.lit("")), "unit").limit(k).select("unit", "divergence", "time")


def unit_detail(read: DataFrame, codings: DataFrame, lost: DataFrame) -> DataFrame:
    """Per unit and code that some but not all of the unit's readers applied, and per reader: whether it applied the code,
    with how many quotations, and how many of its quotations were lost. ``lost(unit, code, by)``."""
    some = _applied(read, codings).filter("n < readers").select("unit", "code")
    grid = some.join(read, "unit")
    quotes = codings.groupBy("unit", "code", F.col("by").alias("lens")).agg(F.count("*").alias("quotes"))
    gone = lost.groupBy("unit", "code", F.col("by").alias("lens")).agg(F.count("*").alias("lost"))
    out = grid.join(quotes, ["unit", "code", "lens"], "left").join(gone, ["unit", "code", "lens"], "left")
    return out.select("unit", "code", "lens", F.col("quotes").isNotNull().alias("applied"), F.coalesce("quotes", F.lit(0)).cast("long").alias("quotes"), F.coalesce("lost", F.lit(0)).cast("long").alias("lost"))


def coded_by_all(codings: DataFrame, lenses: DataFrame) -> DataFrame:
    """Units and codes that every lens of ``lenses(lens)`` applied, with the number of lenses."""
    n = lenses.select("lens").distinct().agg(F.count("*").alias("all"))
    marks = codings.join(lenses.select(F.col("lens").alias("wanted")).distinct(), F.col("by") == F.col("wanted"), "left_semi")
    counts = marks.select("unit", "code", "by").distinct().groupBy("unit", "code").agg(F.count("*").alias("n"))
    return counts.crossJoin(n).filter(F.col("n") == F.col("all")).select("unit", "code", "n")


def posts_uncoded(read: DataFrame, codings: DataFrame) -> DataFrame:
    """Units read and given no code, by lens."""
    return read.join(codings.select("unit", F.col("by").alias("lens")).distinct(), ["unit", "lens"], "left_anti")


def not_read_by(units: DataFrame, lenses: DataFrame, read: DataFrame) -> DataFrame:
    """Per unit the sorted lenses that have not read it; units that all have read are left out."""
    every = lenses.agg(F.collect_set("lens").alias("every"))  # lenses are few: one row
    have = read.join(lenses.distinct(), "lens", "left_semi").groupBy("unit").agg(F.collect_set("lens").alias("have"))
    missing = F.when(F.col("have").isNull(), F.col("every")).otherwise(F.array_except("every", "have"))
    out = units.select("unit").join(have, "unit", "left").crossJoin(every).select("unit", F.sort_array(missing).alias("lenses"))
    return out.filter(F.size("lenses") > 0)


def run_readers(activities: DataFrame, units: DataFrame, codings: DataFrame) -> DataFrame:
    """Per lens: finished and failed readings, units read, complete (all of ``units`` read), codings that count, units read
    and left uncoded."""
    acts = activities.filter("type = 'read'").groupBy("lens").agg(F.count_if(F.col("status") == "ok").alias("finished"), F.count_if(F.col("status") != "ok").alias("failed"))
    known = readings(activities).join(units.select("unit"), "unit", "left_semi")
    count = finished_records(codings, activities)
    total = units.agg(F.count("*").alias("total"))
    units_read = known.groupBy("lens").agg(F.count("*").alias("units_read"))
    coded = count.groupBy(F.col("by").alias("lens")).agg(F.count("*").alias("codings"))
    bare = posts_uncoded(known, count).groupBy("lens").agg(F.count("*").alias("uncoded"))
    out = acts.join(units_read, "lens", "left").join(coded, "lens", "left").join(bare, "lens", "left").crossJoin(total)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("units_read", "codings", "uncoded")})
    return out.withColumn("complete", (F.col("total") > 0) & (F.col("units_read") == F.col("total"))).drop("total")


def run_totals(activities: DataFrame) -> DataFrame:
    """Per lens: readings, failed ones, and the sums of every count that activities carry in ``counts`` (a map), as rows."""
    sums = activities.select("lens", F.explode("counts").alias("what", "n")).groupBy("lens", "what").agg(F.sum("n").alias("n"))
    base = activities.groupBy("lens").agg(F.count("*").alias("batches"), F.count_if(F.col("status") != "ok").alias("failed"))
    ends = base.select("lens", F.explode(F.create_map(F.lit("batches"), "batches", F.lit("failed batches"), "failed")).alias("what", "n"))
    return sums.unionByName(ends)


def code_names_by_reader(codings: DataFrame, k: int = 40) -> DataFrame:
    """``codings(by, name, batch)``: the k names that each lens used most, with uses and distinct batches."""
    rows = codings.groupBy("by", name_key(F.col("name")).alias("name")).agg(F.count("*").alias("uses"), F.countDistinct("batch").alias("batches"))
    order = Window.partitionBy("by").orderBy(F.col("uses").desc(), "name")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def reader_memos(memos: DataFrame, activities: DataFrame) -> DataFrame:
    """``memos(by, activity, memo_type, anchored, signed)`` that count, per lens: units that no code fits, those of them
    without a quotation that was found, and field notes."""
    rows = finished_records(memos, activities)
    unfit, note = F.col("memo_type") == "unfit", F.col("memo_type") == "field_note"
    return rows.groupBy(F.col("by").alias("lens")).agg(F.count_if(unfit).alias("unfit"), F.count_if(unfit & ~F.coalesce("anchored", F.lit(False))).alias("unfit_not_found"), F.count_if(note).alias("field_notes"))


def reader_signatures(memos: DataFrame, activities: DataFrame) -> DataFrame:
    """Per lens and signature (null: not signed) its field notes that count."""
    notes = finished_records(memos.filter("memo_type = 'field_note'"), activities)
    return notes.groupBy(F.col("by").alias("lens"), F.nullif("signed", F.lit("")).alias("signed")).agg(F.count("*").alias("notes"))


def reader_failures(failures: DataFrame, activities: DataFrame) -> DataFrame:
    """``failures(by, activity, reason)`` per lens and reason: those of a failed reading, whoever's, and those that count."""
    failed = activities.filter("type = 'read' and status <> 'ok'").select(F.col("id").alias("failed"))
    rows = failures.join(failed, F.col("activity") == F.col("failed"), "left_semi").unionByName(finished_records(failures, activities))
    return rows.groupBy(F.col("by").alias("lens"), "reason").agg(F.count("*").alias("failures"))


def unit_quotes(read: DataFrame, codings: DataFrame, lost: DataFrame) -> DataFrame:
    """What unit_detail() counts, in words: per unit, code that some but not all of its readers applied, and reader: its
    quotations with their notes, and its quotations that were not found. ``codings(unit, code, by, exact, note)``,
    ``lost(unit, code, by, quote)``; both lists are sorted."""
    some = _applied(read, codings).filter("n < readers").select("unit", "code")
    said = codings.groupBy("unit", "code", F.col("by").alias("lens")).agg(F.array_sort(F.collect_list(F.struct("exact", "note"))).alias("quotes"))
    gone = lost.groupBy("unit", "code", F.col("by").alias("lens")).agg(F.array_sort(F.collect_list("quote")).alias("lost"))
    out = some.join(read, "unit").join(said, ["unit", "code", "lens"], "left").join(gone, ["unit", "code", "lens"], "left")
    return out.select("unit", "code", "lens", *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("quotes", "lost")])
