"""Anchors of first uses, passages picked, definitions, signatures, calls and blobs, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as V
from ..operators import coding as K
from ..operators import contingency as C
from ..operators import lexicon as L
from ..operators import sampled as S
from ..sources import ledger
from ..sources.terms import terms_of
from . import words
from .streams import _folder
from .tables import Plans, table

PLANS = Plans()
WORDS = Plans(words.PLANS.shared)


@WORDS.query("w4_first_use_anchor", r"""SELECT term, unit, time, n, unit * 100000 + strlen(substr(text, 1, s)) AS "start", unit * 100000 + strlen(substr(text, 1, s)) + strlen(exact) AS "end", exact FROM (
  SELECT term, unit, time, n, text, CAST(length(regexp_extract(' ' || text || ' ', '(?s)^(.*?)' || pattern, 1)) AS INT) AS s, substr(regexp_extract(' ' || text || ' ', pattern), 2, length(regexp_extract(' ' || text || ' ', pattern)) - 2) AS exact
  FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY time, unit) AS r FROM hits) JOIN terms USING (term) JOIN (SELECT unit, text FROM units) USING (unit) WHERE r = 1)""")
def w4_anchor(spark, sf):
    """Units lie 100,000 bytes apart in one source."""
    units, terms = words.units(spark, sf), terms_of(spark, words.TERMS)
    placed = units.select("unit", (F.col("unit") * 100_000).alias("start"), "text")
    return L.first_use_anchors(L.term_hits(units, terms), placed, terms)


@PLANS.query("w13_picked_units", """, e AS (SELECT event_type AS term, event_id AS unit, epoch_us(ts) / 1e6 AS t FROM events), s AS (SELECT term, min(t) AS t0, max(t) AS t1 FROM e GROUP BY term),
near AS (SELECT term, j, unit, row_number() OVER (PARTITION BY term, j ORDER BY abs(t - (t0 + (t1 - t0) * j / 3)), t, unit) AS r FROM e JOIN s USING (term), (SELECT unnest([0, 1, 2, 3]) AS j)) SELECT DISTINCT term, unit FROM near WHERE r = 1""".replace(", e AS", "WITH e AS", 1))
def w13_units(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("term"), F.col("event_id").alias("unit"), "ts", F.concat(F.lit("passage "), F.col("event_id").cast("string")).alias("passage"))
    return S.pick_passages(e, 4).select("term", "unit")


@PLANS.query("a28_from_signature", """WITH f AS (SELECT l_suppkey % 3 AS lens, l_returnflag AS code, l_partkey AS post, min(l_quantity) AS s FROM lineitem GROUP BY ALL)
SELECT lens, code, count(*) FILTER (s >= p_size) AS posts, count(*) AS of_posts FROM f JOIN part ON post = p_partkey GROUP BY lens, code HAVING count(*) FILTER (s >= p_size) > 0""")
def a28_signature(spark, sf):
    codings = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("lens"), F.col("l_partkey").alias("post"), F.col("l_returnflag").alias("code"), F.col("l_quantity").alias("start"))
    return C.from_signature(codings, table(spark, sf, "part").select(F.col("p_partkey").alias("post"), F.col("p_size").alias("signature_at")))


@PLANS.query("w14_two_definitions", """WITH d AS (SELECT DISTINCT l_partkey AS key, repeat('x', CAST(l_quantity AS INT) % 9) || CASE WHEN l_quantity % 9 = 0 THEN '' ELSE l_returnflag END AS definition, l_suppkey % 3 AS "by" FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(definition) DESC, definition, "by") AS r FROM d WHERE definition <> ''),
f AS (SELECT key, definition AS first, "by" AS first_by FROM r WHERE r = 1),
s AS (SELECT key, definition AS second, row_number() OVER (PARTITION BY key ORDER BY "by" = first_by, r) AS s FROM r JOIN f USING (key) WHERE r > 1)
SELECT f.key, first, second FROM f LEFT JOIN (SELECT * FROM s WHERE s = 1) s ON s.key = f.key""")
def w14_two(spark, sf):
    size = F.col("l_quantity").cast("int") % 9
    said = F.concat(F.repeat(F.lit("x"), size), F.when(F.col("l_quantity") % 9 == 0, "").otherwise(F.col("l_returnflag")))
    return K.two_definitions(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), said.alias("definition"), (F.col("l_suppkey") % 3).alias("by")))


@PLANS.query("v7_check_all_anchors", """WITH d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'quotation' ELSE 'term anchor' END AS what FROM documents WHERE strlen(text) >= 12 AND length(text) >= 12)
SELECT 'a' || doc_id AS id, what || ' and unit are in different sources' AS reason FROM d WHERE doc_id % 7 = 1 UNION ALL SELECT 'a' || doc_id, what || ' lies outside its unit' FROM d WHERE doc_id % 7 IN (2, 5)
UNION ALL SELECT 'a' || doc_id, what || ' text does not match source bytes' FROM d WHERE doc_id % 7 IN (3, 5)""")
def v7_all(spark, sf):
    """Anchors of the first eight characters: some of a unit in another source, outside their unit, or with other words."""
    d = table(spark, sf, "documents").filter("octet_length(text) >= 12 and length(text) >= 12")
    n, of = F.octet_length(F.left("text", F.lit(8))).cast("long"), F.col("doc_id") % 7
    exact = F.when(of.isin(3, 5), "other words").otherwise(F.left("text", F.lit(8)))
    what = F.when(F.col("doc_id") % 2 == 0, "quotation").otherwise("term anchor")
    unit = F.when(of == 6, None).otherwise(F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    anchors = d.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"), what.alias("what"), unit.alias("unit"), F.col("doc_id").alias("source"), F.lit(0).cast("long").alias("start"), n.alias("end"), exact.alias("exact"))
    end = F.when(of.isin(2, 5), n - 1).otherwise(n)
    units = d.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("id"), F.when(of == 1, -1).otherwise(F.col("doc_id")).alias("source"), F.lit(0).cast("long").alias("start"), end.alias("end"))
    return V.check_all_anchors(anchors, units, d.select(F.col("doc_id").alias("source"), F.encode("text", "utf-8").alias("content")))


@PLANS.query("v9_missing_calls", "SELECT event_id AS id, 'raw prompt and response are not present' AS reason FROM events WHERE event_type <> 'view' AND event_id % 10 < 3")
def v9_missing(spark, sf):
    e = table(spark, sf, "events")
    calls = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "view", F.sha2("props", 256)).alias("prompt_sha256"))
    return V.missing_calls(calls, e.filter("event_id % 10 >= 3").select(F.col("event_id").alias("act")))


@PLANS.query("s5_read_blobs", """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)
SELECT doc_id AS id, CASE WHEN left(sha, 1) = 'a' THEN 'source bytes missing' ELSE 'source bytes altered' END AS reason FROM d WHERE left(sha, 1) IN ('a', 'b')""")
def s5(spark, sf):
    """Every text is a file by the name of its digest; those whose digest begins with a are missing, with b altered."""
    d = table(spark, sf, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")).withColumn("sha", F.sha2("content", 256))
    path, first = _folder(spark), F.left("sha", F.lit(1))
    altered = F.when(first == "b", F.concat(F.col("content"), F.lit(b"x"))).otherwise(F.col("content"))
    ledger.write_blobs(d.filter(first != "a").select("sha", altered.alias("content")), path)
    return V.check_blobs(d.select(F.col("doc_id").alias("id"), F.col("sha").alias("blob")), ledger.read_blobs(spark, path))


@PLANS.query("s6_append_others", "SELECT event_id AS id FROM events WHERE event_id % 3 = 0")
def s6_others(spark, sf):
    """Records that are not content-addressed, all of them new."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return ledger.append_records(e.filter("id % 3 = 0"), e.filter("id % 3 <> 0"), "activity")


PLANS.queries |= WORDS.queries
PLANS.sql |= WORDS.sql
