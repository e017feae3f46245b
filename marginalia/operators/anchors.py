"""Quotations resolved to byte spans, and spans checked against bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PYWS, byte_at, collapse_ws, find_matches, quoted

CONTEXT = 32


def resolve_quotes(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """``quotes(quote_id, unit, quote)`` and ``units(unit, text, start)`` (``start``: the unit's byte offset in its source) to
    ``quote_id, unit, start, end`` (bytes in the source), ``exact, match, occurrences`` (overlapping ones counted).

    The first exact occurrence counts; where there is none, the first one that differs in white space only
    (``ws-normalized``), and then ``exact`` holds the source's own words. Quotations found neither way, or blank, have
    nulls. One pass: texts with white space collapsed, which are made once a unit, tell what is worth a closer look."""
    flat_quotes = quotes.select("quote_id", "unit", "quote", collapse_ws(F.coalesce("quote", F.lit(""))).alias("flat_quote"))
    flat_units = units.select("unit", "text", F.col("start").alias("base"), collapse_ws(F.col("text")).alias("flat"))
    rows = flat_quotes.join(flat_units, "unit", "left").filter((F.col("flat_quote") == "") | F.col("text").isNotNull())
    near = (F.col("flat_quote") != "") & F.coalesce(F.contains("flat", "flat_quote"), F.lit(False))
    rows = rows.withColumn("at", F.when(near, F.expr("instr(text, quote)")))
    loose = F.array_join(F.transform(F.split("flat_quote", " "), quoted), PYWS + "+")
    rows = rows.withColumn("pattern", F.when(F.col("at") > 0, quoted(F.col("quote"))).when(F.col("at") == 0, loose))
    # the text before the first match; all of it where there is none
    rows = rows.withColumn("before", F.when(F.col("at") > 0, F.left("text", F.col("at") - 1)).when(F.col("at") == 0, F.get(F.split("text", F.col("pattern"), 2), 0)))
    exact = F.when(F.col("at") > 0, F.col("quote")).when(F.col("at") == 0, F.nullif(F.expr("regexp_extract(text, pattern, 0)"), F.lit("")))
    rows = rows.withColumn("exact", exact)
    found = F.col("exact").isNotNull()
    start = F.when(found, F.col("base") + F.octet_length("before"))
    searched = F.when(F.col("at") > 0, F.col("text")).otherwise(F.col("flat"))
    count = F.when(found, F.regexp_count(searched, F.concat(F.lit("(?="), F.col("pattern"), F.lit(")"))))
    return rows.select(
        "quote_id", "unit", start.cast("long").alias("start"), (start + F.octet_length("exact")).cast("long").alias("end"), "exact",
        F.when(found, F.when(F.col("at") > 0, "exact").otherwise("ws-normalized")).alias("match"), count.cast("long").alias("occurrences"),
    )


def with_context(anchors: DataFrame, sources: DataFrame, width: int = CONTEXT) -> DataFrame:
    """``prefix`` and ``suffix``: up to ``width`` characters of the source on either side. ``sources(source, text)``. Only as
    many bytes as that many characters can take are cut from the source, and cut again at the first whole character."""
    rows = anchors.join(sources.select("source", F.encode("text", "utf-8").alias("_bytes")), "source")
    low = F.greatest(F.lit(0), F.col("start") - 4 * width).cast("int")
    before = F.call_function("substring", F.col("_bytes"), low + 1, (F.col("start") - low).cast("int"))
    after = F.call_function("substring", F.col("_bytes"), (F.col("end") + 1).cast("int"), F.lit(4 * width))
    # a character cut at the far end shows as a replacement mark, which is further away than the characters wanted
    text = lambda b: F.make_valid_utf8(b.cast("string"))
    return rows.withColumn("prefix", F.right(text(before), F.lit(width))).withColumn("suffix", F.left(text(after), F.lit(width))).drop("_bytes")


def check_anchors(anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """``anchors(id, source, start, end, exact)`` with ``ok``: the bytes at the span are the exact words. ``sources(source,
    content)`` holds bytes."""
    rows = anchors.join(sources.select("source", "content"), "source", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.octet_length("content"))
    same = F.expr("substring(content, cast(start + 1 as int), cast(end - start as int))") == F.encode("exact", "utf-8")
    return rows.withColumn("ok", F.coalesce(inside & same, F.lit(False))).drop("content")


#: A word with something else on both sides, which is a whole word of every text that holds the passage.
INNER = r"(?<=[^A-Za-z0-9_])[A-Za-z0-9_]+(?=[^A-Za-z0-9_])"


def quotes_in_shown(passages: DataFrame, shown: DataFrame) -> DataFrame:
    """``passages(message, reader, passage)`` that occur in none of the texts ``shown(reader, text)`` to their reader.

    An index of the reader's texts by words: a passage is looked for only in texts that hold the one of its inner words that fewest
    of them hold. Only passages without such a word (two words at most) are looked for in all texts of their reader."""
    keys = ["message", "reader", "passage"]
    asked = passages.select(*keys).distinct().withColumn("words", F.array_distinct(F.regexp_extract_all("passage", F.lit(INNER), F.lit(0))))
    texts = shown.select("reader", F.sha2("text", 256).alias("id"), "text").filter("text is not null").dropDuplicates(["reader", "id"])
    wanted = asked.select(*keys, F.explode("words").alias("word"))
    held = texts.select("reader", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    held = held.join(wanted.select("reader", "word").distinct(), ["reader", "word"], "left_semi")
    spread = held.groupBy("reader", "word").agg(F.count("*").alias("n"))
    rarest = wanted.join(spread, ["reader", "word"], "left").groupBy(*keys).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("m")).filter("m.n > 0")
    near = rarest.select(*keys, F.col("m.word").alias("word")).join(held, ["reader", "word"]).join(texts, ["reader", "id"]).filter(F.contains("text", "passage"))
    few = asked.filter(F.size("words") == 0).join(texts, "reader").filter(F.contains("text", "passage"))
    found = near.select(*keys).unionByName(few.select(*keys)).distinct()
    seen = found.select(*[F.col(c).alias(f"_{c}") for c in keys])
    same = F.col("message").eqNullSafe(F.col("_message")) & (F.col("reader") == F.col("_reader")) & (F.col("passage") == F.col("_passage"))
    return passages.select(*keys).distinct().join(seen, same, "left_anti")


def evidence_check(evidence: DataFrame, shown: DataFrame) -> DataFrame:
    """``evidence(reading, id, quote)`` against ``shown(id, text)``: rows that fail, with the reason."""
    rows = evidence.join(shown, "id", "left")
    reason = F.when(F.col("text").isNull(), "no such record was shown").when(~F.contains("text", "quote"), "not in that record")
    return rows.withColumn("reason", reason).filter("reason is not null").select("reading", "id", "quote", "reason")


def term_anchor(units: DataFrame, pattern: str | Column) -> DataFrame:
    """The first match of a pattern, or of each unit's own, as a byte span of its source: ``unit``, the unit's other columns but
    text, ``start, end, exact``. A unit starts at ``start`` in its source."""
    others = [c for c in units.columns if c not in ("unit", "start", "end", "text", "exact")]
    rows = units.withColumn("m", F.get(find_matches(F.col("text"), pattern), F.lit(0))).filter("m is not null")
    start = F.col("start") + byte_at(F.col("text"), F.col("m.start"))
    return rows.select("unit", *others, start.alias("start"), (start + F.octet_length("m.said")).alias("end"), F.col("m.said").alias("exact"))
