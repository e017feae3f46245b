"""Marked passages from line items, and codes merged from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coding as K
from ..operators import passages as P
from .tables import Plans, table

PLANS = Plans("""
entries AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS unit, l_partkey % 2 AS source, CAST(l_quantity * 4 AS BIGINT) AS "start", CAST(l_quantity * 4 + l_linenumber * 3 AS BIGINT) AS "end", CAST(l_suppkey % 3 AS INT) AS family,
            '2026-06-' || lpad(CAST(l_partkey % 28 + 1 AS VARCHAR), 2, '0') AS first_seen, l_partkey % 9 = 0 AS alone, l_shipdate FROM lineitem),
spans AS (SELECT * EXCLUDE ("start", "end"), CASE WHEN NOT alone THEN "start" END AS "start", CASE WHEN NOT alone THEN "end" END AS "end" FROM entries),
reach AS (SELECT *, "start" IS NULL OR "start" >= coalesce(max("end") OVER (PARTITION BY unit, source ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS first FROM spans),
grouped AS (SELECT *, CASE WHEN "start" IS NULL THEN -id ELSE sum(first::INT) OVER (PARTITION BY unit, source, "start" IS NULL ORDER BY "start", "end", id) END AS g FROM reach),
passages AS (SELECT unit, source, min("start") AS "start", max("end") AS "end", count(DISTINCT family) AS tier, count(*) AS entries, min(id) AS first_entry, any_value(first_seen) AS first_seen, unit % 5 AS page FROM grouped GROUP BY unit, source, g)
""")


def entries(spark, sf):
    li = table(spark, sf, "lineitem")
    placed = F.col("l_partkey") % 9 != 0
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("unit"), (F.col("l_partkey") % 2).alias("source"),
        F.when(placed, (F.col("l_quantity") * 4).cast("long")).alias("start"), F.when(placed, (F.col("l_quantity") * 4 + F.col("l_linenumber") * 3).cast("long")).alias("end"), (F.col("l_suppkey") % 3).cast("int").alias("family"),
    )


def passages(spark, sf):
    rows = P.passages(P.merge_passages(entries(spark, sf)))
    seen = F.concat(F.lit("2026-06-"), F.lpad((F.col("unit") % 28 + 1).cast("string"), 2, "0"))
    return rows.withColumn("first_seen", seen).withColumn("page", F.col("unit") % 5)


@PLANS.query("w5_merge_passages", 'SELECT unit, source, "start", "end", tier, entries, first_entry FROM passages')
def w5(spark, sf):
    return P.passages(P.merge_passages(entries(spark, sf)))


@PLANS.query("w6_number_passages", """SELECT unit, "start", first_entry, CAST(tier AS VARCHAR) || '.' || lpad(CAST(p AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS number FROM (
  SELECT *, row_number() OVER (PARTITION BY tier ORDER BY first_seen, CAST(page AS VARCHAR), CAST(unit AS VARCHAR), "start" IS NULL, coalesce("start", 0), first_entry) AS p, count(*) OVER (PARTITION BY tier) AS n FROM passages)""")
def w6(spark, sf):
    return P.number_passages(passages(spark, sf)).select("unit", "start", "first_entry", "number")


@PLANS.query("a31_passages_by_day", "SELECT coalesce(first_seen, 'all') AS day, tier, count(*) AS passages FROM passages GROUP BY GROUPING SETS ((first_seen, tier), (tier))")
def a31(spark, sf):
    return P.passages_by_day(passages(spark, sf).withColumnRenamed("first_seen", "day"))


@PLANS.query("a32_tier_table", "SELECT tier, count(*) AS passages, count(*) FILTER (unit % 4 <> 0) AS read_by_all FROM passages GROUP BY tier")
def a32(spark, sf):
    unread = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("unit"))
    return P.tier_table(passages(spark, sf), unread)


@PLANS.query("a32_tiers_by_reader", ", t AS (SELECT *, count(DISTINCT family) OVER (PARTITION BY unit, source, g) AS tier FROM grouped) SELECT family, tier, count(DISTINCT (unit, source, g)) AS passages FROM t GROUP BY ALL")
def a32_reader(spark, sf):
    return P.tiers_by_reader(P.merge_passages(entries(spark, sf)))


@PLANS.query("p10_day_of", "SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'unknown day' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day, count(*) AS n FROM lineitem GROUP BY ALL")
def p10(spark, sf):
    from ..functions.text import day_of

    time = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("l_linenumber") % 3 == 0, "+").when(F.col("l_linenumber") % 3 == 1, ".25Z").otherwise("Z"))
    return table(spark, sf, "lineitem").groupBy(day_of(time).alias("day")).agg(F.count("*").alias("n"))


def _unfit(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))


@PLANS.query("a23_wordings", "SELECT p_name AS exact, count(DISTINCT l_orderkey) AS units, count(*) AS marks, count(DISTINCT l_suppkey % 3) AS families FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name")
def a23(spark, sf):
    return P.wordings(_unfit(spark, sf).select(F.col("p_name").alias("exact"), F.col("l_orderkey").alias("unit"), (F.col("l_suppkey") % 3).alias("family")))


FAMILY = """, u AS (SELECT CAST(l_suppkey % 3 AS INT) AS family, CASE WHEN l_linenumber = 7 THEN '' ELSE lower(p_name) || ' ' || CAST(l_quantity % 5 AS INT)::VARCHAR END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT family, name, count(*) AS n FROM u WHERE name <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, name) AS place FROM c)"""


def _named(spark, sf):
    name = F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat(F.upper("p_name"), F.lit("  "), (F.col("l_quantity") % 5).cast("int").cast("string")))
    return _unfit(spark, sf).select((F.col("l_suppkey") % 3).cast("int").alias("family"), name.alias("suggested_name"))


@PLANS.query("a22_family_names", FAMILY + """ SELECT family, (SELECT count(*) FROM u WHERE u.family = r.family) AS records, (SELECT count(*) FROM u WHERE u.family = r.family AND name = '') AS unnamed, count(*) AS distinct_names, count(*) FILTER (n = 1) AS once,
  max(n) FILTER (place = 15 AND k > 15) AS cut_count, count(*) FILTER (place > 15 AND n = cut) AS tied FROM (SELECT *, count(*) OVER (PARTITION BY family) AS k, max(CASE WHEN place = 15 THEN n END) OVER (PARTITION BY family) AS cut FROM r) r GROUP BY family""")
def a22(spark, sf):
    return P.family_names(_named(spark, sf))


@PLANS.query("a22_top_names", FAMILY + " SELECT family, name, n, CAST(place AS INT) AS place FROM r WHERE place <= 15")
def a22_top(spark, sf):
    return P.top_names(_named(spark, sf))


NAMES = """, uses AS (SELECT CAST(l_suppkey % 3 AS INT) AS reader, l_partkey AS code, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS form, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _codings(spark, sf):
    form = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit(" \t")))
    return _unfit(spark, sf).select((F.col("l_suppkey") % 3).cast("int").alias("by"), F.col("l_partkey").alias("code"), form.alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@PLANS.query("a15_gather_names", NAMES + """, n AS (SELECT lower(form) AS key, form, row_number() OVER (PARTITION BY lower(form) ORDER BY count(*) DESC, form) AS r FROM uses GROUP BY form),
c AS (SELECT lower(form) AS key, count(*) AS uses, count(DISTINCT reader) AS readers, count(DISTINCT code) AS codes FROM uses GROUP BY lower(form))
SELECT 'n' || lpad(CAST(row_number() OVER (ORDER BY uses DESC, key) AS VARCHAR), 3, '0') AS id, key, n.form AS name, uses, readers, codes FROM c JOIN n USING (key) WHERE r = 1""")
def a15(spark, sf):
    return K.gather_names(_codings(spark, sf))


@PLANS.query("a16_account_names", ", p AS (SELECT DISTINCT lower(p_name) AS key FROM part), a AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_size < 3), l AS (SELECT DISTINCT lower(p_name) AS key FROM part WHERE p_size = 40) SELECT count(*) AS names, count(*) FILTER (key IN (FROM a)) AS placed, count(*) FILTER (key NOT IN (FROM a) AND key IN (FROM l)) AS left_out, count(*) FILTER (key NOT IN (FROM a) AND key NOT IN (FROM l)) AS unaccounted FROM p")
def a16(spark, sf):
    p = table(spark, sf, "part").select(F.lower("p_name").alias("key"), "p_size")
    return K.account_names(p, p.filter("p_size < 3"), p.filter("p_size = 40"))


LINEAGE = """WITH RECURSIVE down AS (SELECT p_partkey AS root, p_partkey AS code FROM part WHERE p_partkey BETWEEN 1 AND 9 UNION ALL SELECT root, p_partkey FROM down JOIN part ON p_partkey // 10 = code WHERE p_partkey > 0),
leaf AS (SELECT root, code FROM down WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey // 10 = code AND p_partkey > 0))"""


def _lineage(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("code"))
    kids = p.filter("code > 0").groupBy(F.floor(F.col("code") / 10).alias("up")).agg(F.collect_list("code").alias("merges"))
    codes = p.join(kids, F.col("code") == F.col("up"), "left").select("code", "merges")
    return K.merge_lineage(codes, p.filter("code between 1 and 9").select(F.col("code").alias("root")))


@PLANS.query("j11_merge_lineage", LINEAGE + " SELECT root, code FROM leaf")
def j11(spark, sf):
    return _lineage(spark, sf)


@PLANS.query("a37_codebook_uses", LINEAGE + ", u AS (SELECT l_suppkey % 3 AS reader, l_partkey AS code, lower(p_name) AS key FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT root, key, count(*) AS uses, count(DISTINCT reader) AS readers FROM leaf JOIN u USING (code) GROUP BY ALL")
def a37(spark, sf):
    return K.codebook_uses(_lineage(spark, sf), _codings(spark, sf))


@PLANS.query("w14_best_example", NAMES + " SELECT key, exact, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id % 4 <> 0, abs(length(exact) - 12), exact, id) AS r FROM (SELECT code AS key, id, repeat('x', CAST(id % 30 + 1 AS INT)) AS exact FROM uses)) WHERE r = 1")
def w14(spark, sf):
    rows = _codings(spark, sf).select(F.col("code").alias("key"), "id", F.expr("repeat('x', cast(id % 30 + 1 as int))").alias("exact"), F.when(F.col("id") % 4 == 0, "exact").otherwise("ws-normalized").alias("match"))
    return K.best_example(rows, 12)
