"""Readers' answers landed in a ledger: codings, failures, memos, messages, and a codebook proposed from names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import quotations
from ..functions.text import collapse_ws, name_key
from .anchors import quotes_in_shown, resolve_quotes

NOT_FOUND = "quotation not found in the unit"


def _resolved(items: DataFrame, units: DataFrame) -> DataFrame:
    """Items with their quotation's anchor; ``unit_id`` must be known."""
    numbered = items.withColumn("quote_id", F.xxhash64("batch", "place"))
    found = resolve_quotes(numbered.select("quote_id", F.col("unit_id").alias("unit"), "quote"), units).drop("unit")
    return numbered.join(found, "quote_id", "left").drop("quote_id")


def land_answers(answers: DataFrame, shown: DataFrame, codes: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """``answers(batch, codings, unfit, field_note, signed)`` with ``codings array<struct<unit,code,quote,note>>`` and ``unfit
    array<struct<unit,quote,why,suggested_name>>``; ``shown(batch, unit, unit_id)`` says what a local name meant;
    ``codes(code, code_id)``; ``units(unit, text, start)``.

    Gives ``codings``, ``failures`` (unknown unit, unknown code, quotation not found), ``unfit`` (with or without an anchor),
    ``notes`` and ``counts`` per batch. A quotation that cannot be found is a failure, never a coding."""
    items = answers.select("batch", F.posexplode("codings").alias("place", "c")).select("batch", "place", "c.*")
    known = items.join(shown, ["batch", "unit"], "left").join(codes, "code", "left")
    unknown = known.filter("unit_id is null or code_id is null").select("batch", "place", F.when(F.col("unit_id").isNull(), "unknown unit").otherwise("unknown code").alias("reason"), "unit", "code", "quote")
    tried = _resolved(known.filter("unit_id is not null and code_id is not null"), units)
    codings = tried.filter("start is not null").select("batch", "unit_id", "code_id", "start", "end", "exact", "match", "occurrences", "note")
    lost = tried.filter("start is null").select("batch", "place", F.lit(NOT_FOUND).alias("reason"), "unit", "code", "quote")
    unfit = answers.select("batch", F.posexplode("unfit").alias("place", "c")).select("batch", "place", "c.*").join(shown, ["batch", "unit"], "left")
    placed = _resolved(unfit.filter("unit_id is not null"), units)
    unfit_rows = placed.select("batch", "unit_id", "why", "suggested_name", "start", "end", "exact", F.when(F.col("start").isNull(), F.col("quote")).alias("quote_not_found"))
    stray = unfit.filter("unit_id is null").select("batch", "place", F.lit("unknown unit").alias("reason"), "unit", F.lit(None).cast("string").alias("code"), "quote")
    failures = unknown.unionByName(lost).unionByName(stray)
    notes = answers.filter(collapse_ws(F.coalesce("field_note", F.lit(""))) != "").select("batch", F.col("field_note").alias("body"), F.nullif(F.trim(F.coalesce("signed", F.lit(""))), F.lit("")).alias("signed"))
    coded = shown.join(codings.select("batch", "unit_id").distinct(), ["batch", "unit_id"], "left_anti").groupBy("batch").agg(F.count("*").alias("units_uncoded"))
    counts = answers.select("batch")
    parts = (
        codings.groupBy("batch").agg(F.count("*").alias("codings"), F.count_if(F.col("match") == "ws-normalized").alias("ws_normalized")),
        failures.groupBy("batch").agg(F.count("*").alias("failures")),
        unfit_rows.groupBy("batch").agg(F.count("*").alias("unfit")),
        coded,
    )
    for part in parts:
        counts = counts.join(part, "batch", "left")
    counts = counts.fillna(0)
    return {"codings": codings, "failures": failures, "unfit": unfit_rows, "notes": notes, "counts": counts}


def land_open_codes(answers: DataFrame, shown: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """Open coding: ``answers(batch, codings array<struct<unit,quote,code,code_type,definition,note>>)``. Code names are
    collapsed, a code is its batch's own; an in-vivo term is looked for in its unit, exactly and then in any case."""
    items = answers.select("batch", F.posexplode("codings").alias("place", "c")).select("batch", "place", "c.*").withColumn("name", collapse_ws(F.col("code")))
    known = items.join(shown, ["batch", "unit"], "left")
    tried = _resolved(known.filter("unit_id is not null"), units)
    text = units.select(F.col("unit").alias("of"), "text")
    codings = tried.filter("start is not null").join(text, F.col("unit_id") == F.col("of"))
    inside = F.when(F.col("code_type") == "in_vivo", F.contains("text", "name") | F.contains(F.lower("text"), F.lower("name")))
    codings = codings.select("batch", "unit_id", "name", "code_type", "definition", "note", "start", "end", "exact", "match", "occurrences", inside.alias("in_vivo_in_unit"))
    unknown = known.filter("unit_id is null").select("batch", F.lit("unknown unit").alias("reason"), "unit", "quote")
    lost = tried.filter("start is null").select("batch", F.lit(NOT_FOUND).alias("reason"), "unit", "quote")
    codes = codings.select("batch", "name", "code_type").distinct()
    return {"codings": codings, "codes": codes, "failures": unknown.unionByName(lost)}


def land_board_answers(answers: DataFrame, threads: DataFrame, shown: DataFrame) -> dict[str, DataFrame]:
    """``answers(reader, replies array<struct<thread,to,message>>, look_again array<struct<thread,why>>, closing, signed)``,
    ``threads(thread)``, ``shown(reader, text)``: ``messages`` (reply, request, closing; blank ones dropped), ``failures`` for
    unknown threads, and ``lost``, quoted passages found in nothing the reader was shown. ``board`` is a thread of replies."""
    replies = answers.select("reader", F.posexplode("replies").alias("place", "r")).select("reader", "place", F.lit("reply").alias("kind"), F.col("r.thread").alias("thread"), F.col("r.message").alias("body"))
    asks = answers.select("reader", F.posexplode("look_again").alias("place", "r")).select("reader", "place", F.lit("request").alias("kind"), F.col("r.thread").alias("thread"), F.col("r.why").alias("body"))
    closing = answers.select("reader", F.lit(0).alias("place"), F.lit("closing").alias("kind"), F.lit(None).cast("string").alias("thread"), F.col("closing").alias("body"))
    rows = replies.unionByName(asks).unionByName(closing)
    rows = rows.filter((F.col("kind") == "request") | (collapse_ws(F.coalesce("body", F.lit(""))) != ""))
    known = threads.select(F.col("thread").alias("is"))
    rows = rows.join(known, F.col("thread") == F.col("is"), "left")
    fine = (F.col("kind") == "closing") | F.col("is").isNotNull() | ((F.col("kind") == "reply") & (F.col("thread") == "board"))
    messages = rows.filter(F.coalesce(fine, F.lit(False))).drop("is").withColumn("message", F.xxhash64("reader", "kind", "place"))
    failures = rows.filter(~F.coalesce(fine, F.lit(False))).select("reader", "kind", "thread", F.lit("unknown thread").alias("reason"))
    said = messages.filter("kind <> 'request'").select("message", "reader", F.explode(quotations(F.col("body"))).alias("passage"))
    return {"messages": messages, "failures": failures, "lost": quotes_in_shown(said, shown)}


def land_codebook(proposed: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """``proposed(place, key, name, merged array<string>)`` codes by local ids, ``names(id, code_ids array<string>)``: accepted
    codes with all first-pass codes they merge, and refused ones with the reason: no key or name, no known name, a key that
    an accepted code before it has."""
    found = proposed.select("place", F.explode("merged").alias("id")).join(names, "id").groupBy("place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("code_ids")))).alias("merges"))
    rows = proposed.join(found, "place", "left").withColumn("folded", name_key(F.coalesce("key", F.lit(""))))
    blank = (F.col("folded") == "") | (collapse_ws(F.coalesce("name", F.lit(""))) == "")
    rows = rows.withColumn("why", F.when(blank, "no key or name").when(F.col("merges").isNull(), "no known name"))
    again = F.row_number().over(Window.partitionBy("folded").orderBy("place"))
    good = rows.filter("why is null").withColumn("r", again)
    accepted = good.filter("r = 1").select("place", "key", "name", "merges")
    refused = rows.filter("why is not null").select("place", "key", F.col("why").alias("reason")).unionByName(good.filter("r > 1").select("place", "key", F.lit("repeated key").alias("reason")))
    return {"codes": accepted, "refused": refused}


def codebook_codes(memo: DataFrame, codes: DataFrame) -> DataFrame:
    """``memo(about array<string>)`` and ``codes(id, key)``: codes in the codebook's order; an unknown record, a code without
    key or a repeated key is an error."""
    rows = memo.select(F.posexplode("about").alias("place", "id")).join(codes.select(F.col("id").alias("found"), "key"), F.col("id") == F.col("found"), "left")
    n = F.count("*").over(Window.partitionBy("key"))
    wrong = F.when(F.col("found").isNull(), "unknown record").when(F.col("key").isNull(), "code without key").when(n > 1, "repeated key")
    checked = F.when(wrong.isNull(), F.col("key")).otherwise(F.raise_error(F.concat(wrong, F.lit(": "), "id")).cast("string"))
    return rows.select("place", "id", checked.alias("key"))


def run_lenses(lenses: DataFrame, codebook: str) -> DataFrame:
    """Lenses of a full run by what they declare: ``reader.codebook``, ``method.name, method.version, method.code_types``."""
    return lenses.filter((F.col("reader.codebook") == codebook) & (F.col("method.name") == "focused-coding") & (F.col("method.version") == "1") & (F.col("method.code_types") == F.array(F.lit("analytic"))))


def reader_name(lenses: DataFrame) -> DataFrame:
    """``lenses(lens, model, family, requested, framed)`` with ``label``: the model and family, what it answered in place of,
    and whether it had no frame."""
    place = F.when(F.col("requested").isNotNull(), F.concat(F.lit("answering in place of "), "requested"))
    label = F.concat_ws(", ", F.concat("model", F.coalesce(F.concat(F.lit(" ("), "family", F.lit(")")), F.lit(""))), place, F.when(~F.col("framed"), "no frame"))
    return lenses.select("lens", label.alias("label"))


def theory_readings(attempts: DataFrame, memos: DataFrame) -> DataFrame:
    """``attempts(activity, framework, lens, status)`` and ``memos(activity, framework, by)``: per framework the attempts, the
    finished ones, and the readings published (from a finished attempt of the same lens and framework)."""
    good = attempts.filter("status = 'ok'").select(F.col("activity").alias("a"), F.col("lens").alias("l"), F.col("framework").alias("f"))
    fine = memos.join(good, (F.col("activity") == F.col("a")) & (F.col("by") == F.col("l")) & (F.col("framework") == F.col("f")), "left_semi").groupBy("framework").agg(F.count("*").alias("published"))
    out = attempts.groupBy("framework").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "ok").alias("finished"))
    return out.join(fine, "framework", "left").fillna(0, ["published"])
