"""Readers compared on line items: a unit is an order, a lens one of three, a code a pair of flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from .tables import Plans, table

PLANS = Plans("""
codings AS (SELECT l_orderkey AS unit, CAST(l_suppkey % 3 AS INT) AS lens, l_returnflag || l_linestatus AS code, l_orderkey * 3 + l_suppkey % 3 AS activity, l_partkey, l_linenumber,
            l_partkey % 7 = 0 AS lost FROM lineitem),
acts AS (SELECT DISTINCT c.activity AS id, c.lens, c.unit, o.o_orderstatus <> 'P' AS ok FROM codings c JOIN orders o ON c.unit = o.o_orderkey),
good AS (SELECT c.* FROM codings c JOIN acts a ON c.activity = a.id WHERE a.ok),
marks AS (SELECT * FROM good WHERE NOT lost), gone AS (SELECT * FROM good WHERE lost),
readings AS (SELECT DISTINCT unit, lens FROM (SELECT unit, lens FROM acts WHERE ok UNION ALL SELECT unit + 1, lens FROM acts WHERE ok UNION ALL SELECT unit, lens FROM marks)),
several AS (SELECT unit, count(*) AS readers FROM readings GROUP BY unit HAVING count(*) >= 2),
applied AS (SELECT unit, code, count(DISTINCT lens) AS n, any_value(readers) AS readers FROM marks JOIN several USING (unit) GROUP BY unit, code),
divergence AS (SELECT s.unit, s.readers, (SELECT count(*) FROM applied a WHERE a.unit = s.unit AND n < a.readers) AS divergence FROM several s)
""")


def records(spark, sf):
    li = table(spark, sf, "lineitem")
    lens = (F.col("l_suppkey") % 3).cast("int")
    return li.select(F.col("l_orderkey").alias("unit"), lens.alias("by"), F.concat("l_returnflag", "l_linestatus").alias("code"), (F.col("l_orderkey") * 3 + lens).alias("activity"), (F.col("l_partkey") % 7 == 0).alias("lost"), F.lit("coding").alias("kind"), "l_partkey", F.col("l_linenumber").alias("batch"))


def activities(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    rows = records(spark, sf).select("activity", F.col("by").alias("lens"), "unit").distinct().join(o, F.col("unit") == F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") != "P", "ok").otherwise("failed")
    return rows.select(F.col("activity").alias("id"), "lens", F.lit("read").alias("type"), status.alias("status"), F.array("unit", F.col("unit") + 1).alias("used"))


def good(spark, sf):
    return C.finished_records(records(spark, sf), activities(spark, sf))


def marks(spark, sf):
    return good(spark, sf).filter("not lost")


def lost(spark, sf):
    return good(spark, sf).filter("lost")


def read(spark, sf):
    return C.readings(activities(spark, sf), marks(spark, sf))


@PLANS.query("j4_finished_records", "SELECT lens, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM good GROUP BY lens")
def j4(spark, sf):
    return good(spark, sf).groupBy(F.col("by").alias("lens")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s"))


@PLANS.query("j5_unfinished_records", "SELECT 'coding' AS kind, c.lens AS by, count(*) AS records FROM codings c JOIN acts a ON a.id = c.activity WHERE NOT ok AND c.lens < 2 AND c.unit % 2 = 0 GROUP BY ALL")
def j5(spark, sf):
    acts = activities(spark, sf).filter("status = 'ok' or id % 6 >= 3")  # odd units keep their failed reading, even ones have none yet
    lenses = table(spark, sf, "nation").select((F.col("n_nationkey") % 2).cast("int").alias("lens")).distinct()
    return C.unfinished_records(records(spark, sf), acts, lenses)


@PLANS.query("j6_unread_units", "SELECT o_orderkey AS unit FROM orders WHERE o_orderkey NOT IN (SELECT unit FROM acts WHERE ok AND lens = 1 UNION ALL SELECT unit + 1 FROM acts WHERE ok AND lens = 1)")
def j6(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"))
    one = table(spark, sf, "region").select(F.lit(1).alias("lens")).distinct()
    return C.unread_units(units, activities(spark, sf), one)


LENSES = """, lenses AS (SELECT s_suppkey AS lens, 'm' || CAST(s_suppkey % 4 AS VARCHAR) AS model, CASE WHEN s_suppkey % 5 = 0 THEN 'm' || CAST((s_suppkey // 5) % 4 AS VARCHAR) END AS requested,
  'core' || CAST(s_nationkey % 3 AS VARCHAR) AS core, s_suppkey * 7 % 11 AS since FROM supplier)"""


@PLANS.query("j7_same_reading", LENSES + """ SELECT lens, asked, first_value(lens) OVER w AS reading, CAST(row_number() OVER w AS INT) AS place FROM (SELECT *, coalesce(requested, model) AS asked FROM lenses)
  WINDOW w AS (PARTITION BY core, asked ORDER BY requested IS NOT NULL, since, lens)""")
def j7(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k.alias("lens"), F.concat(F.lit("m"), (k % 4).cast("string")).alias("model"), F.when(k % 5 == 0, F.concat(F.lit("m"), (F.floor(k / 5) % 4).cast("string"))).alias("requested"),
        F.concat(F.lit("core"), (F.col("s_nationkey") % 3).cast("string")).alias("core"), (k * 7 % 11).alias("at"),
    )
    return C.same_reading(rows)


@PLANS.query("a17_reader_totals", """SELECT lens, units_read, units_compared, coalesce(codings, 0) AS codings, coalesce(codes_applied, 0) AS codes_applied, coalesce(missed, 0) AS quotes_not_found, coalesce(codes_applied, 0) / units_read AS codes_per_unit
FROM (SELECT lens, count(*) AS units_read, count(*) FILTER (unit IN (SELECT unit FROM several)) AS units_compared FROM readings GROUP BY lens)
LEFT JOIN (SELECT lens, count(*) AS codings, count(DISTINCT (unit, code)) AS codes_applied FROM marks GROUP BY lens) USING (lens)
LEFT JOIN (SELECT lens, count(*) AS missed FROM gone GROUP BY lens) USING (lens)""")
def a17(spark, sf):
    return C.reader_totals(read(spark, sf), marks(spark, sf), lost(spark, sf))


@PLANS.query("a18_code_agreement", "SELECT c.code, count(*) FILTER (n = readers) AS all_readers, count(*) FILTER (n < readers) AS some, count(*) FILTER (n = 1) AS one FROM (SELECT DISTINCT code FROM codings UNION ALL SELECT 'never') c LEFT JOIN applied USING (code) GROUP BY c.code")
def a18(spark, sf):
    codes = records(spark, sf).select("code").distinct()
    codes = codes.unionByName(codes.limit(1).select(F.lit("never").alias("code")))
    return C.code_agreement(codes, read(spark, sf), marks(spark, sf))


@PLANS.query("a19_unit_divergence", "SELECT * FROM divergence")
def a19(spark, sf):
    return C.unit_divergence(read(spark, sf), marks(spark, sf))


@PLANS.query("a20_pair_overlap", """, pairs AS (SELECT x.a, y.b FROM (SELECT DISTINCT lens AS a FROM readings) x, (SELECT DISTINCT lens AS b FROM readings) y WHERE a < b),
units AS (SELECT p.lens AS a, q.lens AS b, p.unit FROM readings p JOIN readings q ON p.unit = q.unit AND p.lens < q.lens),
m AS (SELECT DISTINCT unit, code, lens FROM marks),
counts AS (SELECT a, b, (SELECT count(*) FROM units u WHERE u.a = pairs.a AND u.b = pairs.b) AS units,
  (SELECT count(*) FROM units u JOIN m ON m.unit = u.unit AND m.lens = u.a WHERE u.a = pairs.a AND u.b = pairs.b) AS a_pairs,
  (SELECT count(*) FROM units u JOIN m ON m.unit = u.unit AND m.lens = u.b WHERE u.a = pairs.a AND u.b = pairs.b) AS b_pairs,
  (SELECT count(*) FROM m x JOIN m y ON x.unit = y.unit AND x.code = y.code WHERE x.lens = pairs.a AND y.lens = pairs.b) AS both FROM pairs)
SELECT *, CASE WHEN a_pairs + b_pairs - both > 0 THEN both / (a_pairs + b_pairs - both) END AS jaccard FROM counts""".replace(" AS both FROM pairs", ' AS "both" FROM pairs').replace("- both", '- "both"').replace("THEN both", 'THEN "both"'))
def a20(spark, sf):
    return C.pair_overlap(read(spark, sf), marks(spark, sf))


@PLANS.query("a21_suggested_names", r""", f AS (SELECT CAST(p_size % 3 AS INT) AS reader, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS form FROM part),
n AS (SELECT lower(form) AS key, form, row_number() OVER (PARTITION BY lower(form) ORDER BY count(*) DESC, form) AS r FROM f GROUP BY form)
SELECT n.form AS name, count(*) AS count, count(DISTINCT reader) AS readers FROM f JOIN n ON lower(f.form) = key AND r = 1 GROUP BY n.form""")
def a21(spark, sf):
    p = table(spark, sf, "part")
    form = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.replace("p_name", F.lit(" "), F.lit("  ")))
    return C.suggested_names(p.select((F.col("p_size") % 3).cast("int").alias("by"), form.alias("suggested_name")))


@PLANS.query("t1_most_divergent", "SELECT unit, divergence, strftime(o_orderdate, '%Y-%m-%d') AS time FROM divergence JOIN orders ON unit = o_orderkey WHERE divergence > 0 ORDER BY divergence DESC, time, unit LIMIT 60")
def t1(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"))
    return C.most_divergent(C.unit_divergence(read(spark, sf), marks(spark, sf)), units)


DETAIL = """, grid AS (SELECT a.unit, a.code, r.lens FROM applied a JOIN readings r USING (unit) WHERE n < readers),
q AS (SELECT unit, code, lens, count(*) AS n FROM marks GROUP BY ALL), g AS (SELECT unit, code, lens, count(*) AS n FROM gone GROUP BY ALL)
SELECT unit, code, lens, q.n IS NOT NULL AS applied, coalesce(q.n, 0) AS quotes, coalesce(g.n, 0) AS lost FROM grid LEFT JOIN q USING (unit, code, lens) LEFT JOIN g USING (unit, code, lens)"""


@PLANS.query("a40_unit_detail", DETAIL)
def a40(spark, sf):
    return C.unit_detail(read(spark, sf), marks(spark, sf), lost(spark, sf))


@PLANS.query("u2_coded_by_all", "SELECT unit, code, count(DISTINCT lens) AS n FROM marks GROUP BY unit, code HAVING count(DISTINCT lens) = 3")
def u2(spark, sf):
    m = marks(spark, sf)
    return C.coded_by_all(m, records(spark, sf).select(F.col("by").alias("lens")))


@PLANS.query("u3_posts_uncoded", "SELECT unit, lens FROM readings EXCEPT SELECT unit, lens FROM marks")
def u3(spark, sf):
    return C.posts_uncoded(read(spark, sf), marks(spark, sf))


@PLANS.query("j12_not_read_by", "SELECT o_orderkey AS unit, array_to_string(list(lens ORDER BY lens), ',') AS lenses FROM orders, (SELECT unnest([0, 1, 2]) AS lens) WHERE (o_orderkey, lens) NOT IN (SELECT unit, lens FROM readings) GROUP BY o_orderkey")
def j12(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"))
    lenses = records(spark, sf).select(F.col("by").alias("lens"))
    out = C.not_read_by(units, lenses, read(spark, sf))
    return out.select("unit", F.array_join(F.transform("lenses", lambda x: x.cast("string")), ",").alias("lenses"))


@PLANS.query("a24_run_readers", """, known AS (SELECT DISTINCT u AS unit, lens FROM (SELECT unit AS u, lens FROM acts WHERE ok UNION ALL SELECT unit + 1, lens FROM acts WHERE ok) JOIN orders ON u = o_orderkey)
SELECT lens, count(*) FILTER (ok) AS finished, count(*) FILTER (NOT ok) AS failed, (SELECT count(*) FROM known k WHERE k.lens = a.lens) AS units_read, (SELECT count(*) FROM good g WHERE g.lens = a.lens) AS codings,
  (SELECT count(*) FROM (SELECT unit FROM known k WHERE k.lens = a.lens EXCEPT SELECT unit FROM good g WHERE g.lens = a.lens)) AS uncoded, (SELECT count(*) FROM known k WHERE k.lens = a.lens) = (SELECT count(*) FROM orders) AS complete FROM acts a GROUP BY lens""")
def a24(spark, sf):
    return C.run_readers(activities(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit")), records(spark, sf))


@PLANS.query("a26_code_names_by_reader", """SELECT lens AS "by", name, uses, batches, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY uses DESC, name) AS place FROM (SELECT lens, lower(code) AS name, count(*) AS uses, count(DISTINCT l_linenumber) AS batches FROM good GROUP BY lens, lower(code))) WHERE place <= 3""")
def a26(spark, sf):
    return C.code_names_by_reader(good(spark, sf).withColumnRenamed("code", "name"), 3)


@PLANS.query("a39_run_totals", """SELECT lens, 'batches' AS what, count(*) AS n FROM acts GROUP BY lens UNION ALL SELECT lens, 'failed batches', count(*) FILTER (NOT ok) FROM acts GROUP BY lens
UNION ALL SELECT lens, 'codings', count(*) FROM codings GROUP BY lens UNION ALL SELECT lens, 'parts', CAST(sum(l_partkey) AS BIGINT) FROM codings GROUP BY lens""")
def a39(spark, sf):
    sums = records(spark, sf).groupBy("activity").agg(F.count("*").alias("c"), F.sum("l_partkey").alias("p"))
    acts = activities(spark, sf).join(sums, F.col("id") == F.col("activity")).withColumn("counts", F.create_map(F.lit("codings"), "c", F.lit("parts"), "p"))
    return C.run_totals(acts)
