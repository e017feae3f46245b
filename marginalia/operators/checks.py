"""A ledger checked: identity, envelopes, references, bytes, spans, anchors, claims, calls; and a page recounted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import CONTENT_ADDRESSED, identity_of
from .anchors import check_anchors

#: The sentences below that say what is wrong with a record are the same wherever a ledger is checked.
#: Kinds of record that a reference field may name; a field without a row may name any.
REFS = (
    ("source", "derived_from", "source"), ("unit", "source", "source"), ("activity", "lens", "lens"), ("code", "lens", "lens"), ("code", "supersedes", "code"),
    ("code", "merges", "code"), ("coding", "unit", "unit"), ("coding", "code", "code"), ("claim", "rivals", "claim"),
)


def _problem(rows: DataFrame, reason: Column | str) -> DataFrame:
    return rows.select("id", (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def ledger_stats(records: DataFrame, by: str = "kind") -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("records"))


def ledger_conflicts(raw: DataFrame) -> DataFrame:
    """``raw(id, body)``: ids that occur more than once with different content."""
    return _problem(raw.groupBy("id").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b"), "id appears twice in the ledger with different content")


def check_identity(records: DataFrame) -> DataFrame:
    """``records(id, kind, body)`` with the body as JSON text: records of a content-addressed kind whose id is not what their
    content gives, a body that does not parse included. With a column ``expected`` ids are compared with that."""
    if "expected" not in records.columns:
        records = records.filter(F.col("kind").isin(*CONTENT_ADDRESSED)).withColumn("expected", identity_of(F.col("kind"), F.col("body")))
    return _problem(records.filter(~F.col("id").eqNullSafe(F.col("expected"))), "record id does not match its content")


def check_envelope(records: DataFrame, lenses: DataFrame, activities: DataFrame) -> DataFrame:
    """``records(id, kind, by, activity)``, ``lenses(lens)``, ``activities(act, lens)``: unknown author; activity never
    recorded; author differs from the activity's lens. The last two do not concern lenses."""
    known = lenses.select(F.col("lens").alias("author")).distinct()
    stranger = _problem(records.join(known, F.col("by") == F.col("author"), "left_anti"), F.concat(F.lit("author is not a known lens: "), F.col("by").cast("string")))
    rows = records.filter("kind <> 'lens'").join(activities.select(F.col("act"), F.col("lens").alias("its_lens")), F.col("activity") == F.col("act"), "left")
    missing = _problem(rows.filter("act is null"), F.concat(F.lit("activity never recorded: "), F.col("activity").cast("string")))
    other = _problem(rows.filter("act is not null and not (its_lens <=> by)"), "author differs from the lens of its activity")
    return stranger.unionByName(missing).unionByName(other)


def check_references(refs: DataFrame, records: DataFrame) -> DataFrame:
    """``refs(id, kind, field, ref)`` and ``records(id, kind)``: references to unknown records or to a kind that the field may
    not name."""
    spark = refs.sparkSession
    rules = spark.createDataFrame(REFS, "kind string, field string, allowed string")  # fixed and small
    found = refs.join(records.select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), F.col("ref") == F.col("target"), "left").join(F.broadcast(rules), ["kind", "field"], "left")
    unknown = F.when(F.col("target").isNull(), F.concat("field", F.lit(" names an unknown record: "), F.col("ref").cast("string")))
    wrong = F.when(F.col("allowed") != F.col("target_kind"), F.concat("field", F.lit(" names a "), "target_kind", F.lit(", not a "), "allowed", F.lit(": "), F.col("ref").cast("string")))
    return _problem(found.withColumn("why", F.coalesce(unknown, wrong)).filter("why is not null"), F.col("why"))


def check_code_author(codes: DataFrame) -> DataFrame:
    return _problem(codes.filter("lens is not null and lens <> by"), "code's lens differs from its author")


def check_blobs(sources: DataFrame, blobs: DataFrame) -> DataFrame:
    """``sources(id, blob)`` and ``blobs(sha, content)``: bytes missing, or not hashing to their name. Bytes are hashed where
    they lie; only names travel to the join."""
    good = blobs.select(F.col("sha"), (F.sha2("content", 256) == F.col("sha")).alias("same"))
    rows = sources.join(good, F.col("blob") == F.col("sha"), "left")
    return _problem(rows.filter("not coalesce(same, false)"), F.when(F.col("same").isNull(), "source bytes missing").otherwise("source bytes altered"))


def check_prompt_parts(lenses: DataFrame, blobs: DataFrame) -> DataFrame:
    """``lenses(id, stack array<struct<name,sha256>>)`` and ``blobs(sha, content)``: parts of a lens's prompt that are missing or
    do not hash to their name. Bytes are hashed where they lie."""
    good = blobs.select("sha", (F.sha2("content", 256) == F.col("sha")).alias("same"))
    parts = lenses.select("id", F.explode("stack").alias("p")).select("id", "p.name", "p.sha256")
    rows = parts.join(good, F.col("sha256") == F.col("sha"), "left").filter("not coalesce(same, false)")
    return _problem(rows, F.concat(F.when(F.col("same").isNull(), "prompt part missing: ").otherwise("prompt part altered: "), "name"))


def check_units(units: DataFrame, sources: DataFrame) -> DataFrame:
    """``units(id, source, start, end)`` and ``sources(source, content)``: span outside its source, or splitting a
    character."""
    rows = units.join(sources, "source", "left")
    cut = F.expr("substring(content, cast(start + 1 as int), cast(end - start as int))")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.octet_length("content"))
    reason = F.when(F.col("content").isNull(), "unit points at unusable source").when(~inside, "unit span outside source").when(~F.is_valid_utf8(cut.cast("string")), "unit span splits a character")
    return _problem(rows.withColumn("why", reason).filter("why is not null"), F.col("why"))


def check_all_anchors(anchors: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """``anchors(id, what, unit, source, start, end, exact)`` (unit null where there is none): in another source than the unit,
    outside it, or not the bytes it claims."""
    rows = check_anchors(anchors, sources).join(units.select(F.col("id").alias("u"), F.col("source").alias("us"), F.col("start").alias("ub"), F.col("end").alias("ue")), F.col("unit") == F.col("u"), "left")
    other = F.when(F.col("u").isNotNull() & (F.col("us") != F.col("source")), F.concat("what", F.lit(" and unit are in different sources")))
    outside = F.when(F.col("u").isNotNull() & ~((F.col("ub") <= F.col("start")) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("ue"))), F.concat("what", F.lit(" lies outside its unit")))
    text = F.when(~F.col("ok"), F.concat("what", F.lit(" text does not match source bytes")))
    whys = F.array_compact(F.array(F.coalesce(other, outside), text))
    return rows.select("id", F.explode(whys).alias("reason"))


def check_claims(claims: DataFrame) -> DataFrame:
    return _problem(claims.filter("supports is null or size(supports) = 0"), "claim has no supporting evidence")


def check_judgments(judgments: DataFrame, lenses: DataFrame) -> DataFrame:
    """``judgments(id, by)`` and ``lenses(lens, reader_kind)``."""
    rows = judgments.join(lenses, F.col("by") == F.col("lens"))
    return _problem(rows.filter("not (reader_kind <=> 'human')"), "judgment not authored by a human lens")


def check_calls(calls: DataFrame, files: DataFrame) -> DataFrame:
    """``calls(id, prompt_sha256, response_sha256)`` and ``files(act, system, user, response)`` as bytes: hashes that do not
    match. Calls without files are no problem here (see missing_calls)."""
    rows = calls.filter("prompt_sha256 is not null").join(files, F.col("id") == F.col("act"))
    prompt = F.sha2(F.concat("system", F.lit(b"\n\n"), "user"), 256) != F.col("prompt_sha256")
    answer = ~(F.sha2("response", 256).eqNullSafe(F.col("response_sha256")))
    whys = F.array_compact(F.array(F.when(prompt, "stored prompt does not match the recorded hash"), F.when(answer, "stored response does not match the recorded hash")))
    return rows.select("id", F.explode(whys).alias("reason"))


def missing_calls(calls: DataFrame, files: DataFrame) -> DataFrame:
    return _problem(calls.filter("prompt_sha256 is not null").join(files.select("act"), F.col("id") == F.col("act"), "left_anti"), "raw prompt and response are not present")


def verify(*problems: DataFrame) -> DataFrame:
    """All problems in one table, each once."""
    out = problems[0]
    for more in problems[1:]:
        out = out.unionByName(more)
    return out.distinct()


def ledger_digest(records: DataFrame) -> DataFrame:
    """``records(kind, id, body)``: one fingerprint a kind over its records, in no particular order: count, and sums of two
    64-bit halves of the records' digests. The digest of files has no meaning for tables."""
    sha = F.sha2(F.concat_ws("\x1f", F.col("id").cast("string"), "body").cast("binary"), 256)
    half = [F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in (0, 1)]
    return records.groupBy("kind").agg(F.count("*").alias("records"), F.sum(half[0]).alias("a"), F.sum(half[1]).alias("b")).select("kind", "records", F.sha2(F.concat_ws(":", F.col("records").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary"), 256).alias("digest"))


def reconcile(page: DataFrame, recount: DataFrame) -> DataFrame:
    """``page(name, value)`` against ``recount(name, value)``: one row a check, ``name, ok, detail``."""
    both = page.withColumnRenamed("value", "said").join(recount.withColumnRenamed("value", "found"), "name", "full")
    ok = F.col("said").eqNullSafe(F.col("found"))
    detail = F.concat(F.lit("page "), F.coalesce(F.col("said").cast("string"), F.lit("nothing")), F.lit(", ledger "), F.coalesce(F.col("found").cast("string"), F.lit("nothing")))
    return both.select("name", ok.alias("ok"), F.when(~ok, detail).alias("detail"))


def passage_spans(entries: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages of one unit and source that overlap, and entries that lie in none: ``unit, reason``."""
    from pyspark.sql import Window

    order = Window.partitionBy("unit", "source").orderBy("start", "end")
    overlap = passages.filter("start is not null").withColumn("before", F.lag("end").over(order)).filter("start < before").select("unit", F.lit("passages overlap").alias("reason"))
    inside = passages.select(F.col("unit").alias("pu"), F.col("source").alias("ps"), F.col("start").alias("pb"), F.col("end").alias("pe"))
    lone = entries.filter("start is not null").join(inside, (F.col("unit") == F.col("pu")) & (F.col("source") == F.col("ps")) & (F.col("start") >= F.col("pb")) & (F.col("end") <= F.col("pe")), "left_anti")
    return overlap.unionByName(lone.select("unit", F.lit("entry in no passage").alias("reason")))


def ledger_fingerprint(digests: DataFrame) -> DataFrame:
    """One row: a fingerprint over what ledger_digest() gives for each kind, kinds in order (they are few)."""
    said = F.concat_ws(":", "kind", F.col("records").cast("string"), "digest")
    whole = F.array_join(F.array_sort(F.collect_list(said)), "\n")
    return digests.agg(F.sum("records").alias("records"), F.sha2(whole.cast("binary"), 256).alias("digest"))


def recount_passages(entries: DataFrame) -> DataFrame:
    """``name, value`` counted from raw ``entries(id, unit, source, start, end, family)`` by a sweep along each source, not by
    merging: entries, units, families, entries without a span, passages, the longest passage."""
    from pyspark.sql import Window

    placed = entries.filter("start is not null and end is not null")
    event = lambda at, step: F.struct(F.col(at).alias("at"), F.lit(step).alias("step"))
    ends = F.when(F.col("start") == F.col("end"), F.array(event("start", 0))).otherwise(F.array(event("start", 1), event("end", -1)))
    along = Window.partitionBy("unit", "source").orderBy("at", "step")  # at one place spans end before others begin
    swept = placed.select("unit", "source", F.explode(ends).alias("e")).select("unit", "source", "e.*")
    swept = swept.withColumn("open", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # an empty span that no other one covers is a passage of its own
    swept = swept.withColumn("begins", ((F.col("open") == 1) & (F.col("step") == 1)) | ((F.col("open") == 0) & (F.col("step") == 0)))
    swept = swept.withColumn("since", F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = swept.agg(F.count_if("begins").alias("in_spans"), F.max(F.col("at") - F.col("since")).alias("longest"))
    lone = F.col("start").isNull() | F.col("end").isNull()
    base = entries.agg(F.count("*").alias("entries"), F.countDistinct("unit").alias("units"), F.countDistinct("family").alias("families"), F.count_if(lone).alias("without"), F.countDistinct(F.when(lone, F.struct("unit", "source", "id"))).alias("alone"))
    names = {"entries": "entries", "units": "units", "families": "families", "entries without a span": "without", "passages": F.col("alone") + F.col("in_spans"), "longest passage": F.coalesce("longest", F.lit(0))}
    rows = [F.struct(F.lit(k).alias("name"), (F.col(v) if isinstance(v, str) else v).cast("long").alias("value")) for k, v in names.items()]
    return base.crossJoin(whole).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def all_anchors(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Anchors of several kinds of record in one table for check_all_anchors(): each part names what it is and has ``id, unit,
    source, start, end, exact``; records without a span are left out."""
    tables = [df.filter("start is not null").select("id", F.lit(what).alias("what"), "unit", "source", "start", "end", "exact") for what, df in parts]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
