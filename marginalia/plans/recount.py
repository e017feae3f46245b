"""A page made from line items as of half of all events, with faults, counted again from the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages as P
from ..operators import recount as R
from ..operators.ranks import ranked
from ..sources.folders import written
from .tables import Plans, table

PLANS = Plans("""
total AS (SELECT count(*) AS n FROM events),
activity AS (SELECT event_id AS id, user_id % 8 AS k, CASE WHEN event_type = 'signup' THEN 'merge' ELSE 'read' END AS type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events),
line AS (SELECT *, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id FROM lineitem),
record AS (SELECT l.id AS id, a.id AS act, (a.k + CASE WHEN l.id % 11 = 5 THEN 1 ELSE 0 END) % 8 AS by_k, a.k, a.type, a.status, l_partkey AS unit,
             CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity * 4 AS BIGINT) END AS "start", CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity * 4 + l_linenumber * 3 AS BIGINT) END AS "end", l_returnflag || l_linestatus AS words
           FROM (SELECT DISTINCT ON (id) * FROM line ORDER BY id, l_quantity, l_returnflag, l_linestatus) l JOIN activity a ON a.id = l.id % (SELECT n FROM total)),
reader AS (SELECT r, (SELECT count(*) FROM activity WHERE k // 2 = r AND type = 'read' AND status = 'ok' AND id * 2 < (SELECT n FROM total)) AS saw FROM (SELECT unnest([0, 1, 2]) AS r)),
ranks AS (SELECT id, k // 2 AS r, row_number() OVER (PARTITION BY k // 2 ORDER BY id) AS rn FROM activity WHERE k < 6 AND type = 'read' AND status = 'ok'),
seen AS (SELECT ranks.id, r FROM ranks JOIN reader USING (r) WHERE rn <= saw),
counted AS (SELECT record.*, r FROM record JOIN seen ON seen.id = act WHERE by_k = k),
shown AS (SELECT *, k // 2 AS family FROM record WHERE act * 2 < (SELECT n FROM total) AND type = 'read' AND status = 'ok' AND k < 6 AND by_k = k),
reach AS (SELECT *, "start" IS NULL OR "start" >= coalesce(max("end") OVER (PARTITION BY unit ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS first FROM shown),
grouped AS (SELECT *, CASE WHEN "start" IS NULL THEN -id ELSE sum(first::INT) OVER (PARTITION BY unit, "start" IS NULL ORDER BY "start", "end", id) END AS g FROM reach),
named AS (SELECT *, min(id) OVER (PARTITION BY unit, g) AS passage FROM grouped),
content AS (SELECT p_partkey AS unit, repeat(p_name || ' ', 40) AS t FROM part),
made AS (SELECT passage, unit, min("start") AS "start", max("end") AS "end", count(DISTINCT family) AS tier, '2026-06-' || lpad(CAST(unit % 28 + 1 AS VARCHAR), 2, '0') AS first_seen FROM named GROUP BY passage, unit),
page_passage AS (SELECT passage, unit, "start", "end", first_seen, tier AS true_tier, tier + CASE WHEN passage % 70 = 13 THEN 1 ELSE 0 END AS tier, substr(t, "start" + 1, "end" - "start") AS held,
                   substr(t, "start" + 1, "end" - "start") || CASE WHEN passage % 50 = 3 THEN '!' ELSE '' END AS text, row_number() OVER (ORDER BY tier DESC, first_seen, passage) AS place FROM made JOIN content USING (unit)),
entry AS (SELECT passage, id, unit, family, "start", "end", substr(t, "start" + 1, "end" - "start") AS held, substr(t, "start" + 1, "end" - "start") || CASE WHEN id % 60 = 11 THEN '?' ELSE '' END AS exact, CASE WHEN id % 40 = 7 THEN 'XX' ELSE words END AS words
          FROM named JOIN content USING (unit) WHERE id % 90 <> 1),
gaps AS (SELECT "start" >= max("end") OVER (PARTITION BY passage ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM entry WHERE "start" IS NOT NULL),
lone AS (SELECT passage, count(id) AS n FROM (SELECT passage FROM page_passage WHERE "start" IS NULL) LEFT JOIN entry USING (passage) GROUP BY passage),
shared AS (SELECT "start" < max("end") OVER (PARTITION BY unit ORDER BY "start", "end", passage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM page_passage WHERE "start" IS NOT NULL),
ordering AS (SELECT tier > lag(tier) OVER (ORDER BY place) OR (tier = lag(tier) OVER (ORDER BY place) AND first_seen < lag(first_seen) OVER (ORDER BY place)) AS early FROM page_passage),
span AS (SELECT passage, min("start") AS s, max("end") AS e FROM entry GROUP BY passage),
numbers AS (SELECT
  (SELECT count(*) FROM entry LEFT JOIN counted USING (id) WHERE counted.id IS NULL OR entry.words <> counted.words OR entry.unit <> counted.unit) AS differ,
  (SELECT count(*) FROM counted LEFT JOIN entry USING (id) WHERE entry.id IS NULL) AS missing,
  (SELECT count(*) FROM counted) AS n_ledger, (SELECT count(*) FROM shown) AS n_page, (SELECT count(*) FROM page_passage) AS n_passages,
  (SELECT count(*) FROM (SELECT true_tier AS tier, count(*) AS n FROM page_passage GROUP BY 1) a FULL JOIN (SELECT tier, count(*) AS n FROM page_passage GROUP BY 1) b USING (tier) WHERE a.n IS DISTINCT FROM b.n) AS tiers,
  (SELECT count(*) FROM page_passage p LEFT JOIN (SELECT passage, count(DISTINCT family) AS f FROM entry GROUP BY 1) e USING (passage) WHERE p.tier <> coalesce(f, 0)) AS families,
  (SELECT count(*) FROM ordering WHERE early) AS early,
  (SELECT count(*) FROM gaps WHERE bad) + (SELECT count(*) FROM lone WHERE n <> 1) + (SELECT count(*) FROM shared WHERE bad) AS broken,
  (SELECT count(*) FROM page_passage WHERE "start" IS NOT NULL) AS spans,
  (SELECT count(*) FROM page_passage LEFT JOIN span USING (passage) WHERE "start" IS NOT NULL AND (text <> held OR "start" IS DISTINCT FROM s OR "end" IS DISTINCT FROM e)) AS texts,
  (SELECT count(*) FROM entry WHERE exact IS NOT NULL) AS quoted, (SELECT count(*) FROM entry WHERE exact <> held) AS quotes)
""")

AUDIT = """
SELECT 'lenses of the run' AS "check", CAST(NULL AS VARCHAR) AS about, TRUE AS ok, 'page 6, ledger 6' AS detail FROM numbers
UNION ALL SELECT 'finished activities', 'r' || r, saw = n, 'page ' || saw || ', ledger ' || n FROM (SELECT r, saw, (SELECT count(*) FROM seen WHERE seen.r = reader.r) AS n FROM reader)
UNION ALL SELECT 'entries say what records say', NULL, differ = 0 AND missing = 0, 'differ ' || differ || ', missing ' || missing FROM numbers
UNION ALL SELECT 'entries of a reader', 'r' || r, said = found AND said = listed, 'page ' || said || ', ledger ' || found || ', listed ' || listed FROM (
  SELECT r, (SELECT count(*) FROM shown WHERE family = r) + CASE WHEN r = 2 THEN 1 ELSE 0 END AS said, (SELECT count(*) FROM counted WHERE counted.r = reader.r) AS found, (SELECT count(*) FROM entry WHERE family = r) AS listed FROM reader)
UNION ALL SELECT 'entries of all readers', NULL, n_page = n_ledger, 'page ' || n_page || ', ledger ' || n_ledger FROM numbers
UNION ALL SELECT 'passages listed', NULL, TRUE, 'page ' || n_passages || ', listed ' || n_passages FROM numbers
UNION ALL SELECT 'passages by tier', NULL, tiers = 0, 'differ ' || tiers FROM numbers
UNION ALL SELECT 'tiers are numbers of families', NULL, families = 0, 'differ ' || families FROM numbers
UNION ALL SELECT 'order of passages', NULL, early = 0, 'early ' || early || ', ends ' || least(1, n_passages) FROM numbers
UNION ALL SELECT 'grouped by overlap', NULL, broken = 0, 'broken ' || broken FROM numbers
UNION ALL SELECT 'passages are bytes of the source', NULL, texts = 0, 'passages ' || spans || ', differ ' || texts FROM numbers
UNION ALL SELECT 'quotations are bytes of the source', NULL, quotes = 0, 'quotations ' || quoted || ', differ ' || quotes FROM numbers
"""


def ledger(spark, sf) -> R.Ledger:
    """Raw records, made by activities of all events; one in eleven is not of its activity's own lens."""
    e = table(spark, sf, "events")
    lens = F.concat(F.lit("l"), (F.col("user_id") % 8).cast("string"))
    kinds = F.when(F.col("event_type") == "signup", "merge").otherwise("read"), F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    activities = e.select(F.col("event_id").alias("id"), lens.alias("lens"), kinds[0].alias("type"), kinds[1].alias("status"), F.col("event_id").alias("seq"))
    k = F.substring("lens", 2, 1)
    lenses = activities.select("lens").distinct().select("lens", F.when(k == "6", "old").otherwise("cb").alias("codebook"), F.lit("focused-coding").alias("method"), F.when(k == "7", "2").otherwise("1").alias("version"), F.array(F.lit("analytic")).alias("code_types"))
    id_ = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    li = table(spark, sf, "lineitem").withColumn("id", id_).groupBy("id").agg(F.min(F.struct("l_quantity", "l_returnflag", "l_linestatus", "l_partkey", "l_linenumber")).alias("x")).select("id", "x.*")
    placed = F.col("l_partkey") % 9 != 0
    records = li.select(
        "id", (F.col("id") % e.count()).alias("activity"), F.col("l_partkey").alias("unit"), F.when(placed, (F.col("l_quantity") * 4).cast("long")).alias("start"),
        F.when(placed, (F.col("l_quantity") * 4 + F.col("l_linenumber") * 3).cast("long")).alias("end"), F.concat("l_returnflag", "l_linestatus").alias("words"),
    )
    other = F.concat(F.lit("l"), ((F.substring("of_lens", 2, 1).cast("int") + 1) % 8).cast("string"))
    records = records.join(activities.select(F.col("id").alias("of"), F.col("lens").alias("of_lens")), F.col("activity") == F.col("of"))
    records = records.select("id", F.when(F.col("id") % 11 == 5, other).otherwise(F.col("of_lens")).alias("by"), "activity", "unit", "start", "end", "words")
    sources = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.encode(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(40)), "utf-8").alias("content"))
    return R.Ledger(lenses, activities, records, sources)


def page(spark, sf, raw: R.Ledger) -> R.Page:
    """What a page says that saw the activities of the first half of events, and its faults: some texts, words, quotations and tiers
    are altered, some entries are left out, and one reader's number is off by one."""
    half = raw.activities.filter(F.col("id") * 2 < raw.activities.count()).filter("type = 'read' and status = 'ok'")
    number = F.floor(F.substring("lens", 2, 1).cast("int") / 2).cast("int")
    done = half.select(F.col("id").alias("act"), "lens", number.alias("family")).filter("family < 3")
    shown = written(raw.records.join(done, (F.col("activity") == F.col("act")) & (F.col("by") == F.col("lens"))).select("id", "unit", F.col("unit").alias("source"), "start", "end", "family", "words"), "shown")
    merged = P.merge_passages(shown)
    passages = written(P.passages(merged).withColumnRenamed("first_entry", "passage"), "passages")
    text = F.decode(F.col("held"), "utf-8")
    quoted = R.source_bytes(passages, raw.sources)
    seen = F.concat(F.lit("2026-06-"), F.lpad((F.col("unit") % 28 + 1).cast("string"), 2, "0"))
    ordered = ranked(quoted.select("passage", "unit", "source", "start", "end", "tier", text.alias("text"), seen.alias("first_seen")), [], [F.col("tier").desc(), F.col("first_seen"), F.col("passage")])
    shown_passages = ordered.select(
        "passage", F.col("_rn").alias("place"), "unit", "source", "start", "end", F.when(F.col("passage") % 50 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
        (F.col("tier") + F.when(F.col("passage") % 70 == 13, 1).otherwise(0)).alias("tier"), "first_seen",
    )
    ids = merged.groupBy("passage").agg(F.min("id").alias("first")).select(F.col("passage").alias("_p"), "first")
    listed = merged.join(ids, F.col("passage").eqNullSafe(F.col("_p"))).select(F.col("first").alias("passage"), "id", "family", "source", "start", "end", "words").filter("id % 90 <> 1")
    listed = R.source_bytes(listed, raw.sources).withColumn("text", text)
    entries = listed.select(
        "passage", "id", F.concat(F.lit("r"), F.col("family").cast("string")).alias("reader"), "family", "start", "end",
        F.when(F.col("id") % 60 == 11, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("exact"), F.when(F.col("id") % 40 == 7, "XX").otherwise(F.col("words")).alias("words"),
    )
    per_reader = done.groupBy("family").agg(F.count("*").alias("activities")).join(shown.groupBy("family").agg(F.count("*").alias("entries")), "family", "left")
    off = F.when(F.col("family") == 2, 1).otherwise(0)
    reader = F.concat(F.lit("r"), F.col("family").cast("string"))
    pair = F.array(*[F.concat(F.lit("l"), (F.col("family") * 2 + i).cast("string")) for i in (0, 1)])
    readers = per_reader.select(reader.alias("reader"), pair.alias("lenses"), "activities", (F.coalesce("entries", F.lit(0)) + off).alias("entries"))
    tiers = passages.groupBy("tier").agg(F.count("*").alias("passages"))
    totals = shown.agg(F.count("*").alias("entries")).crossJoin(passages.agg(F.count("*").alias("passages")))
    return R.Page(readers, written(shown_passages, "page"), written(entries, "entries"), tiers, totals)


@PLANS.query("v11_audit_page", AUDIT)
def v11_audit(spark, sf):
    raw = ledger(spark, sf)
    return R.audit_page(page(spark, sf, raw), raw, "cb")


@PLANS.query("v11_broken_groups", """SELECT reason, count(*) AS n FROM (SELECT 'entries do not chain' AS reason FROM gaps WHERE bad UNION ALL SELECT 'without a span, not alone' FROM lone WHERE n <> 1 UNION ALL SELECT 'shares bytes' FROM shared WHERE bad) GROUP BY reason""")
def v11_groups(spark, sf):
    shown = page(spark, sf, ledger(spark, sf))
    return R.broken_groups(shown.passages, shown.entries).groupBy("reason").agg(F.count("*").alias("n"))
