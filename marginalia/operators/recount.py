"""A page of passages counted again from the raw ledger, as of what the page saw, by a road that shares nothing with the one that
made it."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written
from .ranks import ranked, running_max


class Page(NamedTuple):
    """What a page says: ``readers(reader, lenses, activities, entries)``, ``passages(passage, place, unit, source, start, end,
    text, tier, first_seen)`` with places from 0 in the order shown, ``entries(passage, id, reader, family, start, end, exact,
    words)``, ``tiers(tier, passages)`` and ``totals(entries, passages)``."""

    readers: DataFrame
    passages: DataFrame
    entries: DataFrame
    tiers: DataFrame
    totals: DataFrame


class Ledger(NamedTuple):
    """Raw records: ``lenses(lens, codebook, method, version, code_types)``, ``activities(id, lens, type, status, seq)``,
    ``records(id, by, activity, unit, start, end, words)`` of the kind that the page lists, ``sources(source, content)`` with the
    stored bytes."""

    lenses: DataFrame
    activities: DataFrame
    records: DataFrame
    sources: DataFrame


#: The lenses of a full run declare this method, version and types of code.
RUN = {"method": "focused-coding", "version": "1", "code_types": ["analytic"]}


def run_lenses(lenses: DataFrame, codebook: str) -> DataFrame:
    """``lens``: the lenses of a run, found by what they declare."""
    types = F.array(*map(F.lit, RUN["code_types"]))
    return lenses.filter((F.col("codebook") == codebook) & (F.col("method") == RUN["method"]) & (F.col("version") == RUN["version"]) & (F.col("code_types") == types)).select("lens").distinct()


def activities_seen(readers: DataFrame, activities: DataFrame) -> DataFrame:
    """``act, lens, reader``: the first finished read activities of each reader, in the order of the ledger, as many as the page
    saw. The ledger may have grown since. Readers are few and hold all activities, so places are found by ranges."""
    lenses = readers.select("reader", F.col("activities").alias("_saw"), F.explode("lenses").alias("lens"))
    done = activities.filter("type = 'read' and status = 'ok'").select(F.col("id").alias("act"), "lens", "seq").join(lenses, "lens")
    return ranked(done, ["reader"], ["seq", "act"]).filter(F.col("_rn") < F.col("_saw")).select("act", "lens", "reader")


def records_seen(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Records that an activity of their own lens made which the page saw, with ``reader``."""
    return records.join(seen, (F.col("activity") == F.col("act")) & (F.col("by") == F.col("lens"))).drop("act", "lens")


def broken_groups(passages: DataFrame, entries: DataFrame) -> DataFrame:
    """``passage, reason``: entries of a passage that do not chain by overlap (half open: touching is no overlap), a passage
    without a span with other than one entry, a passage that shares bytes with one before it in its unit and source."""
    spans = entries.join(passages.filter("start is not null").select("passage"), "passage").select("passage", "start", "end", "id")
    gaps = running_max(spans, ["passage"], ["start", "end", "id"], F.col("end"), "reach").filter("start is null or end is null or start >= reach")
    lone = passages.filter("start is null").select("passage").join(entries.select("passage", "id"), "passage", "left").groupBy("passage").agg(F.count("id").alias("n")).filter("n <> 1")
    placed = passages.filter("start is not null").select("passage", "unit", "source", "start", "end")
    shared = running_max(placed, ["unit", "source"], ["start", "end", "passage"], F.col("end"), "reach").filter("start < reach")
    rows = ((gaps, "entries do not chain"), (lone, "without a span, not alone"), (shared, "shares bytes"))
    return reduce(DataFrame.unionByName, [df.select("passage", F.lit(why).alias("reason")) for df, why in rows])


def source_bytes(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """``spans(source, start, end, ...)`` with ``held``, the stored bytes between the offsets; null if there is no such source, and
    short where it ends before. A source is shuffled once, whatever the number of its spans, and cut where it meets them."""
    kept = sources.select(F.col("source").alias("_source"), "content")
    met = spans.join(kept, F.col("source") == F.col("_source"), "left")
    cut = F.when((F.col("start") >= 0) & (F.col("end") >= F.col("start")), F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    return met.withColumn("held", cut).drop("_source", "content")


def _check(rows: DataFrame, check: str, ok: Column, detail: Column, about: Column | None = None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), (F.lit(None) if about is None else about).cast("string").alias("about"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))


def _said(**counts: Column) -> Column:
    """``page 3, ledger 4``"""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name} "), F.coalesce(c, F.lit(0)).cast("string")) for name, c in counts.items()])


def audit_page(page: Page, ledger: Ledger, codebook: str) -> DataFrame:
    """``check, about, ok, detail``: one row a check, and one a reader where each reader is counted.

    The lenses are those of the run; each reader has as many finished activities as the page saw; every listed entry says what
    its record says (unit, words and, where it quotes, offsets) and no record is missing; entries by reader and in all; passages
    by tier; tiers are numbers of families; passages stand by tier, then by first seen; entries chain by overlap and no two
    passages of a unit share a byte; passages and quotations are the stored bytes between their offsets. Whatever a page says, and
    whatever it leaves out, gives a row that is not ok rather than an error.
    """
    readers, tiers, totals = page.readers, page.tiers, page.totals
    seen = written(activities_seen(readers, ledger.activities), "seen")
    counted = written(records_seen(ledger.records, seen), "counted")
    passages = page.passages
    entries = page.entries.join(passages.select("passage", "unit", "source"), "passage", "left")
    n = F.count("*")
    out = []

    on_page = readers.select(F.explode("lenses").alias("lens")).distinct().withColumn("p", F.lit(1))
    lenses = on_page.join(run_lenses(ledger.lenses, codebook).withColumn("l", F.lit(1)), "lens", "full").agg(F.count("p").alias("p"), F.count("l").alias("l"), n.alias("n"))
    out.append(_check(lenses, "lenses of the run", (F.col("p") == F.col("n")) & (F.col("l") == F.col("n")), _said(page=F.col("p"), ledger=F.col("l"))))

    acts = readers.select("reader", "activities").join(seen.groupBy("reader").agg(n.alias("found")), "reader", "left")
    out.append(_check(acts, "finished activities", F.coalesce("found", F.lit(0)) == F.col("activities"), _said(page=F.col("activities"), ledger=F.col("found")), F.col("reader")))

    raw = counted.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("unit", "start", "end", "words")])
    both = entries.join(raw, F.col("id") == F.col("_id"), "full")
    offsets = F.col("exact").isNull() | (F.col("start").eqNullSafe(F.col("_start")) & F.col("end").eqNullSafe(F.col("_end")))
    same = F.col("_id").isNotNull() & F.col("unit").eqNullSafe(F.col("_unit")) & F.col("words").eqNullSafe(F.col("_words")) & offsets
    told = both.agg(F.count_if(F.col("id").isNotNull() & ~same).alias("differ"), F.count_if(F.col("id").isNull()).alias("missing"))
    out.append(_check(told, "entries say what records say", (F.col("differ") == 0) & (F.col("missing") == 0), _said(differ=F.col("differ"), missing=F.col("missing"))))

    by_reader = readers.select("reader", "entries").join(counted.groupBy("reader").agg(n.alias("found")), "reader", "left").join(entries.groupBy("reader").agg(n.alias("listed")), "reader", "left")
    equal = (F.coalesce("found", F.lit(0)) == F.col("entries")) & (F.coalesce("listed", F.lit(0)) == F.col("entries"))
    out.append(_check(by_reader, "entries of a reader", equal, _said(page=F.col("entries"), ledger=F.col("found"), listed=F.col("listed")), F.col("reader")))

    whole = totals.select("entries", F.col("passages").alias("in_all")).crossJoin(counted.agg(n.alias("found"))).crossJoin(passages.agg(n.alias("listed")))  # one row each
    out.append(_check(whole, "entries of all readers", F.col("entries") == F.col("found"), _said(page=F.col("entries"), ledger=F.col("found"))))
    out.append(_check(whole, "passages listed", F.col("in_all") == F.col("listed"), _said(page=F.col("in_all"), listed=F.col("listed"))))

    per_tier = tiers.select("tier", F.col("passages").alias("said")).join(passages.groupBy("tier").agg(n.alias("listed")), "tier", "full").agg(F.count_if(~F.col("said").eqNullSafe(F.col("listed"))).alias("differ"))
    out.append(_check(per_tier, "passages by tier", F.col("differ") == 0, _said(differ=F.col("differ"))))

    families = passages.select("passage", "tier").join(entries.groupBy("passage").agg(F.countDistinct("family").alias("families")), "passage", "left").agg(F.count_if(~F.col("tier").eqNullSafe(F.coalesce("families", F.lit(0)))).alias("differ"))
    out.append(_check(families, "tiers are numbers of families", F.col("differ") == 0, _said(differ=F.col("differ"))))

    here = passages.select("place", "tier", F.coalesce("first_seen", F.lit("")).alias("first"))
    after = here.select((F.col("place") - 1).alias("_place"), F.col("tier").alias("_tier"), F.col("first").alias("_first"))
    # every place but the last has a next one, which stands no earlier
    steps = here.join(after, F.col("place") == F.col("_place"), "left")
    fits = (F.col("_tier") < F.col("tier")) | ((F.col("_tier") == F.col("tier")) & (F.col("_first") >= F.col("first")))
    ordered = steps.agg(F.count_if(F.col("_place").isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("early"), F.count_if(F.col("_place").isNull()).alias("ends"), F.countDistinct("place").alias("places"), n.alias("n"))
    out.append(_check(ordered, "order of passages", (F.col("early") == 0) & (F.col("ends") <= 1) & (F.col("places") == F.col("n")), _said(early=F.col("early"), ends=F.col("ends"))))

    broken = broken_groups(passages, page.entries).agg(n.alias("broken"))
    out.append(_check(broken, "grouped by overlap", F.col("broken") == 0, _said(broken=F.col("broken"))))

    ends = page.entries.groupBy("passage").agg(F.min("start").alias("_start"), F.max("end").alias("_end"))
    held = source_bytes(passages.filter("start is not null").join(ends, "passage", "left"), ledger.sources)
    fits = F.col("held").eqNullSafe(F.encode("text", "utf-8")) & F.col("start").eqNullSafe(F.col("_start")) & F.col("end").eqNullSafe(F.col("_end"))
    out.append(_check(held.agg(n.alias("n"), F.count_if(~fits).alias("differ")), "passages are bytes of the source", F.col("differ") == 0, _said(passages=F.col("n"), differ=F.col("differ"))))

    held = source_bytes(entries.filter("exact is not null"), ledger.sources)
    fits = F.col("held").eqNullSafe(F.encode("exact", "utf-8"))
    out.append(_check(held.agg(n.alias("n"), F.count_if(~fits).alias("differ")), "quotations are bytes of the source", F.col("differ") == 0, _said(quotations=F.col("n"), differ=F.col("differ"))))
    return reduce(DataFrame.unionByName, out)
