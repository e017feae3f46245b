"""Revisions cut into statements, statements followed through revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import unit_id
from ..functions.text import LINE_BLANKS, classify_line, signature_of, signature_uncertain
from .ranks import carried, in_pieces


def repair_bytes(revisions: DataFrame) -> DataFrame:
    """``revisions(body, body_sha256, body_encoding, ...)`` whose body holds bytes read as latin-1: adds ``content`` (the
    bytes), ``ok`` (their digest is the recorded one) and ``utf8`` (text as UTF-8 bytes: latin-1 bodies are transcoded,
    the others kept where valid, else null)."""
    content = F.encode("body", "iso-8859-1")
    rows = revisions.withColumn("content", content).withColumn("ok", F.sha2("content", 256) == F.col("body_sha256"))
    latin = F.lower(F.coalesce("body_encoding", F.lit("utf-8"))).isin("latin-1", "latin1", "iso-8859-1")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.withColumn("utf8", F.when(latin, F.encode("body", "utf-8")).when(valid, F.col("content")))


def segment(sources: DataFrame) -> DataFrame:
    """``sources(source, text)`` to statements: ``source, start, end`` (UTF-8 bytes, end exclusive), ``kind`` (heading, list,
    post, text), ``lines, text, signature, uncertain``.

    Blank lines end blocks; a heading stands alone; list lines in a row are one list; a signed line closes a post that
    takes the prose lines directly above it, unless it opens with a bullet; the other prose is text. All that follows
    from each line's kind and the kinds beside it, so a running sum of breaks numbers the groups.
    """
    blanks = F.lit(LINE_BLANKS)
    rows = sources.select("source", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    at = Window.partitionBy("source").orderBy("no")
    before = F.coalesce(F.sum(F.octet_length("raw") + 1).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = F.btrim("raw", blanks)
    lead = F.octet_length("raw") - F.octet_length(F.ltrim("raw", blanks))
    rows = rows.select("source", "no", line.alias("line"), (before + lead).cast("long").alias("start")).withColumn("end", F.col("start") + F.octet_length("line"))
    kind = F.when(F.col("line") == "", "blank").otherwise(classify_line(F.col("line")))
    rows = rows.withColumn("line_kind", kind).withColumn("alone", (F.col("line_kind") == "signed") & F.left("line", F.lit(1)).isin("*", "#", ":"))
    last = F.lag("line_kind").over(at)
    joins = F.when(F.col("line_kind") == "list", last == "list").when(F.col("line_kind").isin("plain", "signed"), (last == "plain") & ~F.col("alone")).otherwise(False)
    rows = rows.withColumn("group", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(at))
    signed = F.max(F.when(F.col("line_kind") == "signed", F.col("line")))
    units = rows.filter("line_kind <> 'blank'").groupBy("source", "group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("lines"), F.max("line_kind").alias("top"), signed.alias("signed"),
    )
    shape = F.when(F.col("signed").isNotNull(), "post").when(F.col("top") == "plain", "text").otherwise(F.col("top"))
    units = units.select("source", "start", "end", shape.alias("kind"), "lines", signature_of(F.col("signed")).alias("signature"), F.coalesce(signature_uncertain(F.col("signed")), F.lit(False)).alias("uncertain"))
    return units


def with_text(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Each unit's exact text, cut from the bytes of its source."""
    bytes_ = sources.select("source", F.encode("text", "utf-8").alias("content"))
    cut = F.decode(F.expr("substring(content, cast(start + 1 as int), cast(end - start as int))"), "utf-8")
    return units.join(bytes_, "source").withColumn("text", cut).drop("content")


def follow(pieces: DataFrame, revisions: DataFrame) -> DataFrame:
    """``pieces(page, idx, kind, text)`` and ``revisions(page, idx)`` (``idx`` from 0 without gaps) to one row for each page,
    kind and exact text: ``first, last, revisions_present, first_absent`` (null if never), ``returned, gone_after`` (null if
    it is in the last revision), ``copies_at_first``. Texts are compared by digest, which also spreads a busy page."""
    key = ["page", "kind", "hash"]
    held = pieces.select("page", "idx", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("hash")).groupBy(*key, "idx").agg(F.count("*").alias("copies"))
    order = Window.partitionBy(*key).orderBy("idx")
    held = held.withColumn("next", F.lead("idx").over(order))
    gap = F.min(F.when(F.col("next") > F.col("idx") + 1, F.col("idx") + 1))
    rows = held.groupBy(*key).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("revisions_present"), gap.alias("gap"), F.min_by("copies", "idx").alias("copies_at_first"))
    total = revisions.groupBy("page").agg((F.max("idx") + 1).alias("total"))
    rows = rows.join(total, "page")
    after = F.when(F.col("last") + 1 < F.col("total"), F.col("last") + 1)
    absent = F.coalesce("gap", after)
    return rows.select(*key, "first", "last", "revisions_present", absent.alias("first_absent"), F.coalesce(F.col("last") > absent, F.lit(False)).alias("returned"), after.alias("gone_after"), "copies_at_first")


def deleted_after(units: DataFrame, deletions: DataFrame) -> DataFrame:
    """``units(unit, page, time)`` and ``deletions(page, time)``: the first deletion of the unit's page at or after its
    first time, or null. Both sides are merged by page and time in one sort, so a page of many units and many
    deletions costs no pairs; a busy page is scanned piece by piece."""
    both = units.select("page", "time", F.lit(0).alias("side"), "unit").unionByName(deletions.select("page", "time", F.lit(1).alias("side"), F.lit(None).alias("unit")))
    placed = in_pieces(both, ["page"], [F.col("time").desc(), F.col("side").desc()])
    found = carried(placed, ["page"], F.when(F.col("side") == 1, F.col("time")), "deleted", least=True).filter("side = 0")
    return found.select("unit", F.col("deleted").alias("page_deleted_after"))


def units_from_follow(followed: DataFrame, pieces: DataFrame, revisions: DataFrame, deletions: DataFrame) -> DataFrame:
    """Unit rows with their context. ``pieces(page, idx, kind, text, start, end, signature)``, ``revisions(page, idx, source,
    time, by)``: anchored at the first appearance, with who removed it first and at last, and a later deletion."""
    key = ["page", "kind", "hash"]
    hashed = pieces.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    first = hashed.groupBy(*key, "idx").agg(F.min(F.struct("start", "end", "signature")).alias("at")).withColumnRenamed("idx", "first")
    rev = revisions.select(F.col("page").alias("rp"), F.col("idx").alias("ri"), "source", "time", "by")

    def at(rows: DataFrame, idx: str, names: dict[str, str]) -> DataFrame:
        side = rev.select(F.col("rp").alias(f"p_{idx}"), F.col("ri").alias(f"i_{idx}"), *[F.col(c).alias(n) for c, n in names.items()])
        return rows.join(side, (F.col("page") == F.col(f"p_{idx}")) & (F.col(idx) == F.col(f"i_{idx}")), "left").drop(f"p_{idx}", f"i_{idx}")

    rows = followed.join(first, [*key, "first"])
    rows = at(rows, "first", {"source": "source", "time": "first_time", "by": "introduced_by"})
    rows = at(rows, "last", {"time": "last_time"})
    rows = at(rows, "first_absent", {"time": "removed_time", "by": "removed_by"})
    rows = at(rows, "gone_after", {"time": "gone_time", "by": "gone_by"})
    rows = rows.withColumns({"start": F.col("at.start"), "end": F.col("at.end"), "signature": F.col("at.signature")}).drop("at")
    rows = rows.withColumn("unit", unit_id(F.col("source").cast("string"), F.col("start"), F.col("end"), F.col("kind")))
    gone = deleted_after(rows.select("unit", "page", F.col("first_time").alias("time")), deletions)
    return rows.join(gone, "unit", "left")
