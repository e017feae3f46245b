"""Names composed from customers: how they are built, who signs as whom, and what goes with a kind of name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as FN
from ..functions.text import strip_signature
from ..operators import contingency as C
from ..operators import names as N
from .tables import Plans, table

FIRST = "Agent Our OpenAI Night Blue Team Scout Alpha".split()
MONTH = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
LAST = "Reader Police Link Sky Bot".split()


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_name(first, month, day, last):
    return f"{_sql_list(FIRST)}[{first} % 8 + 1] || {_sql_list(MONTH)}[{month} % 12 + 1] || lpad(CAST({day} % 40 AS VARCHAR), 2, '0') || {_sql_list(LAST)}[{last} % 5 + 1]"


def _sql_date(month, day):
    return f"CASE WHEN {day} % 40 BETWEEN 1 AND 31 THEN {_sql_list(MONTH)}[{month} % 12 + 1] || CAST({day} % 40 AS VARCHAR) END"


PLANS = Plans(rf"""
made AS (
  SELECT c_custkey AS k, c_nationkey AS n,
         {_sql_name('c_custkey', 'c_custkey', 'c_custkey', 'c_nationkey')} AS signature,
         {_sql_name('(c_custkey // 3)', '(c_custkey + (c_custkey % 3) // 2)', 'c_custkey', 'c_nationkey')} AS saved,
         {_sql_list(FIRST)}[c_custkey % 8 + 1] AS p1, {_sql_list(MONTH)}[c_custkey % 12 + 1] AS p2, lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') AS p3, {_sql_list(LAST)}[c_nationkey % 5 + 1] AS p4,
         {_sql_date('c_custkey', 'c_custkey')} AS own_date, {_sql_date('(c_custkey + (c_custkey % 3) // 2)', 'c_custkey')} AS saved_date,
         '2026-06-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS day, c_mktsegment AS item,
         {_sql_name('(c_custkey + 1)', '(c_custkey + 1)', '(c_custkey + 1)', '(c_nationkey + 1)')} AS named,
         {_sql_list(MONTH)}[(c_custkey + 5) % 12 + 1] AS said_month, c_custkey % 31 + 1 AS said_day,
         c_custkey % 3 = 0 AS one, c_custkey % 4 = 0 AS many FROM customer),
kinds AS (SELECT *, p1 = 'OpenAI' AS institution, p1 IN ('Agent', 'Scout') OR p4 IN ('Reader', 'Link', 'Bot') AS role, p1 IN ('Our', 'Team') AS collective, own_date IS NOT NULL AS dated FROM made),
first_saved AS (SELECT signature AS label, min(day) AS day, count(*) AS saves, any_value(institution) AS institution, any_value(role) AS role, any_value(collective) AS collective, any_value(dated) AS dated,
                any_value([p1, p2, p4]) AS parts FROM kinds GROUP BY signature),
features AS (
  SELECT k AS post, 'institution' AS feature FROM kinds WHERE institution UNION ALL SELECT k, 'institution:OpenAI' FROM kinds WHERE institution
  UNION ALL SELECT k, 'role' FROM kinds WHERE role UNION ALL SELECT k, 'role:' || p1 FROM kinds WHERE p1 IN ('Agent', 'Scout') UNION ALL SELECT k, 'role:' || p4 FROM kinds WHERE p4 IN ('Reader', 'Link', 'Bot')
  UNION ALL SELECT k, 'collective' FROM kinds WHERE collective UNION ALL SELECT k, 'collective:' || p1 FROM kinds WHERE collective
  UNION ALL SELECT k, 'date' FROM kinds WHERE dated UNION ALL SELECT k, 'part:Police' FROM kinds WHERE p4 = 'Police'),
items AS (SELECT k AS post, item FROM kinds UNION ALL SELECT k, 'nation' || CAST(n % 3 AS VARCHAR) FROM kinds)
""")


def _pick(words, i):
    return F.get(F.array(*map(F.lit, words)), (i % len(words)).cast("int"))


def _name(first, month, day, last):
    return F.concat(_pick(FIRST, first), _pick(MONTH, month), F.lpad((day % 40).cast("string"), 2, "0"), _pick(LAST, last))


def posts(spark, sf):
    c, k, n = table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    signature = _name(k, k, k, n)
    saved = _name(F.floor(k / 3), k + F.floor((k % 3) / 2), k, n)
    day = F.concat(F.lit("2026-06-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    said = F.concat(F.lit("see "), _name(k + 1, k + 1, k + 1, n + 1), F.lit(" on "), _pick(MONTH, k + 5), F.lit(" "), (k % 31 + 1).cast("string"), F.when(k % 3 == 0, " I say").otherwise(""), F.when(k % 4 == 0, " we go").otherwise(""))
    rows = c.select(k.alias("post"), signature.alias("signature"), saved.alias("saved"), day.alias("time"), day.alias("day"), F.concat(said, F.lit(" -- "), signature).alias("text"), F.col("c_mktsegment").alias("item"), n.alias("n"))
    return rows.withColumn("body", strip_signature(F.col("text"), F.col("signature")))


def saves(spark, sf):
    return posts(spark, sf).select(F.col("signature").alias("label"), "time", F.lit(False).alias("derived"))


def features(spark, sf):
    return posts(spark, sf).select("post", F.explode(FN.name_features(F.col("signature"), ("Police",))).alias("feature"))


def items(spark, sf):
    p = posts(spark, sf)
    return p.select("post", "item").unionByName(p.select("post", F.concat(F.lit("nation"), (F.col("n") % 3).cast("string")).alias("item")))


@PLANS.query("f1_name_parts", "SELECT k AS post, p1 || ' ' || p2 || ' ' || p3 || ' ' || p4 AS parts FROM made")
def f1(spark, sf):
    return posts(spark, sf).select("post", F.array_join(FN.name_parts(F.col("signature")), " ").alias("parts"))


@PLANS.query("f2_date_of", "SELECT k AS post, own_date AS date FROM made")
def f2(spark, sf):
    return posts(spark, sf).select("post", FN.date_of(F.col("signature")).alias("date"))


@PLANS.query("f3_kinds_of", "SELECT k AS post, concat_ws(' ', CASE WHEN institution THEN 'institution' END, CASE WHEN role THEN 'role' END, CASE WHEN collective THEN 'collective' END, CASE WHEN dated THEN 'date' END) AS kinds FROM kinds")
def f3(spark, sf):
    return posts(spark, sf).select("post", F.array_join(FN.kinds_of(F.col("signature")), " ").alias("kinds"))


@PLANS.query("f4_name_features", "SELECT post, feature FROM features")
def f4(spark, sf):
    return features(spark, sf)


@PLANS.query("f5_date_codes", "SELECT k AS post, said_month || CAST(said_day AS VARCHAR) AS codes FROM made")
def f5(spark, sf):
    return posts(spark, sf).select("post", F.array_join(FN.date_codes(F.col("body")), " ").alias("codes"))


@PLANS.query("p6_strip_signature", "SELECT k AS post, CAST(length('see ' || named || ' on ' || said_month || ' ' || CAST(said_day AS VARCHAR)) + CASE WHEN one THEN 6 ELSE 0 END + CASE WHEN many THEN 6 ELSE 0 END + 1 AS BIGINT) AS signature_at FROM made")
def p6(spark, sf):
    return posts(spark, sf).select("post", F.octet_length("body").cast("long").alias("signature_at"))


@PLANS.query("a4_names_by_day", "SELECT day, count(*) AS names, count(*) FILTER (institution) AS institution_names, count(*) FILTER (role) AS role_names, count(*) FILTER (dated) AS date_names, count(*) FILTER (collective) AS collective_names FROM first_saved GROUP BY day")
def a4(spark, sf):
    return N.names_by_day(saves(spark, sf))


@PLANS.query("a5_name_parts_usage", "SELECT part, count(*) AS names, min_by(label, (day, label)) AS first_name, min(day) AS first_time FROM (SELECT label, day, unnest(list_distinct(parts)) AS part FROM first_saved) GROUP BY part")
def a5(spark, sf):
    return N.name_parts_usage(saves(spark, sf))


@PLANS.query("a6_signed_as_another", "SELECT count(*) AS differs, count(*) FILTER (own_date = saved_date) AS same_date FROM made WHERE signature <> saved")
def a6(spark, sf):
    return N.signed_as_another(posts(spark, sf))


MENTIONS = "SELECT k AS post, named AS name FROM made WHERE named <> signature AND named IN (SELECT signature FROM made)"


@PLANS.query("j10_mentions", MENTIONS)
def j10(spark, sf):
    p = posts(spark, sf)
    return N.mentions(p, p.select(F.col("signature").alias("name")))


@PLANS.query("a7_addressing", f"SELECT 'name' AS kind, name AS said, count(*) AS posts FROM ({MENTIONS}) GROUP BY ALL UNION ALL SELECT 'date', said_month || CAST(said_day AS VARCHAR) AS said, count(*) FROM made WHERE said_month || CAST(said_day AS VARCHAR) IS DISTINCT FROM own_date GROUP BY ALL")
def a7(spark, sf):
    p = posts(spark, sf)
    return N.addressing(p, p.select(F.col("signature").alias("name")))


@PLANS.query("a8_savers", """, busy AS (SELECT saved, count(*) AS posts, count(DISTINCT signature) AS signatures FROM made WHERE saved <> signature GROUP BY saved)
SELECT count(*) AS savers, count(*) FILTER (signatures >= 5) AS five_or_more, count(*) FILTER (signatures = 1) AS exactly_one, CAST(sum(posts) AS BIGINT) AS posts,
       (SELECT sum(posts) FROM (SELECT posts FROM busy ORDER BY signatures DESC, posts DESC, saved LIMIT 10)) / sum(posts) AS top_share FROM busy""")
def a8(spark, sf):
    return N.savers(posts(spark, sf))


@PLANS.query("a9_voice_by_day", "SELECT coalesce(day, 'all') AS day, count(*) AS posts, count(*) FILTER (one) AS singular, count(*) FILTER (many) AS plural, count(*) FILTER (one AND many) AS both FROM made GROUP BY ROLLUP (day)")
def a9(spark, sf):
    return N.voice_by_day(posts(spark, sf))


@PLANS.query("a10_date_beside_clock", "SELECT count(*) AS posts, count(*) FILTER (said_month || CAST(said_day AS VARCHAR) = own_date) AS same, count(*) FILTER (said_month || CAST(said_day AS VARCHAR) <> own_date) AS different, count(*) FILTER (own_date IS NULL) AS undated FROM made WHERE one")
def a10(spark, sf):
    return N.date_beside_clock(posts(spark, sf), "I say")


@PLANS.query("a13_signature_features", "SELECT count(*) AS posts, count(*) FILTER (dated) AS with_date, count(*) FILTER (role) AS with_role, count(*) FILTER (institution) AS with_institution, count(*) FILTER (signature <> saved) AS differs FROM kinds")
def a13(spark, sf):
    return N.signature_features(posts(spark, sf))


@PLANS.query("a14_edits_by_day", "SELECT day, count(*) AS saves, count(*) FILTER (dated) AS dated FROM kinds GROUP BY day")
def a14(spark, sf):
    return N.edits_by_day(saves(spark, sf))


@PLANS.query("t5_busiest_names", "SELECT day, label, day AS first_time, n FROM (SELECT *, count(*) OVER (PARTITION BY day) AS n FROM first_saved) WHERE day = (SELECT day FROM first_saved GROUP BY day ORDER BY count(*) DESC, day LIMIT 1) ORDER BY label LIMIT 40")
def t5(spark, sf):
    return N.busiest_names(saves(spark, sf))


@PLANS.query("t5_top_parts", "SELECT part, count(*) AS names, min_by(label, (day, label)) AS first_name, min(day) AS first_time FROM (SELECT label, day, unnest(list_distinct(parts)) AS part FROM first_saved) GROUP BY part ORDER BY names DESC, part LIMIT 10")
def t5_parts(spark, sf):
    return N.top_parts(saves(spark, sf), 10)


CELLS = """
totals AS (SELECT {by0} count(*) AS posts FROM made {g0}),
wf AS (SELECT {by} feature, count(*) AS w FROM features JOIN made ON post = k GROUP BY ALL), wi AS (SELECT {by} item, count(*) AS posts_and FROM (SELECT post, i.item, made.n FROM items i JOIN made ON post = k) GROUP BY ALL),
jointly AS (SELECT {by} feature, item, count(*) AS b FROM features JOIN items USING (post) JOIN (SELECT k AS post, n FROM made) USING (post) GROUP BY ALL),
cells AS (SELECT {by} feature, item, posts, w AS "with", coalesce(b, 0) AS with_and, coalesce(b, 0) / w AS share, posts - w AS without, posts_and - coalesce(b, 0) AS without_and,
  (posts_and - coalesce(b, 0)) / (posts - w) AS share_without, posts_and, posts_and / posts AS base_rate, 100 * (coalesce(b, 0) / w - (posts_and - coalesce(b, 0)) / (posts - w)) AS points
  FROM wf {join} JOIN wi {using} LEFT JOIN jointly USING ({by} feature, item) WHERE w >= 20 AND posts - w >= 20 AND posts_and >= 20)
"""
ONE = CELLS.format(by="", by0="", g0="", join="CROSS JOIN totals", using="ON true")
EACH = CELLS.format(by="n % 3 AS lens,", by0="n % 3 AS lens,", g0="GROUP BY ALL", join="JOIN totals USING (lens)", using="USING (lens)").replace("cells AS (SELECT n % 3 AS lens,", "cells AS (SELECT lens,").replace("USING (n % 3 AS lens,", "USING (lens,")


def cells(spark, sf):
    return C.cross_features(posts(spark, sf), features(spark, sf), items(spark, sf), 20)


@PLANS.query("a27_cross_features", f", {ONE} SELECT * FROM cells")
def a27(spark, sf):
    return cells(spark, sf)


@PLANS.query("a27_held_back", "SELECT feature, count(*) AS posts, (SELECT count(*) FROM made) - count(*) AS without FROM features GROUP BY feature HAVING count(*) < 200 OR (SELECT count(*) FROM made) - count(*) < 200")
def a27_held(spark, sf):
    return C.held_back(posts(spark, sf), features(spark, sf), 200)


@PLANS.query("a28_cross_by_reader", f", {EACH} SELECT * FROM cells")
def a28(spark, sf):
    p = posts(spark, sf).withColumn("lens", F.col("n") % 3)
    lens = p.select("post", "lens")
    return C.cross_features(p, features(spark, sf).join(lens, "post"), items(spark, sf).join(lens, "post"), 20, ("lens",))


@PLANS.query("a29_features_by_day", "SELECT day, feature, count(*) AS posts FROM features JOIN made ON post = k WHERE feature IN (SELECT feature FROM features GROUP BY feature ORDER BY count(*) DESC, feature LIMIT 6) GROUP BY ALL")
def a29(spark, sf):
    return C.features_by_day(posts(spark, sf), features(spark, sf))


@PLANS.query("t3_extremes", f", {ONE} SELECT feature, item, points, sign, place FROM (SELECT *, row_number() OVER (PARTITION BY feature, sign ORDER BY abs(points) DESC, item) AS place FROM (SELECT *, sign(round_even(points, 1))::INT AS sign FROM cells) WHERE sign <> 0) WHERE place <= 2")
def t3(spark, sf):
    return C.extremes(cells(spark, sf), 2)


@PLANS.query("t4_largest_pairs", f""", {ONE}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(points) DESC, item) AS r FROM cells WHERE round_even(points, 1) <> 0) WHERE r = 1),
marked AS (SELECT o.feature, o.item, o.points, i.post, EXISTS (SELECT 1 FROM features f WHERE f.post = i.post AND f.feature = o.feature) AS has FROM one o JOIN items i USING (item)),
pools AS (SELECT feature, item, points, CASE WHEN bool_or(has) THEN list(post ORDER BY post) FILTER (has) ELSE list(post ORDER BY post) END AS pool FROM marked GROUP BY ALL)
SELECT feature, item, points FROM (SELECT *, row_number() OVER (PARTITION BY item, pool ORDER BY abs(points) DESC, feature) AS again FROM pools) WHERE again = 1 ORDER BY abs(points) DESC, feature, item LIMIT 5""")
def t4(spark, sf):
    return C.largest_pairs(cells(spark, sf), features(spark, sf), items(spark, sf), 5)
