"""Documents as sources and revisions: statements cut from them, followed through them, quoted from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import content_id, unit_id
from ..operators import anchors as A
from ..operators import ingest as G
from .tables import Plans, table

BLANKS = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"
PLANS = Plans(rf"""
sources AS (SELECT doc_id AS source, array_to_string([CASE WHEN i % 4 = 3 THEN l || ' -- Writer' || CAST(i % 7 AS VARCHAR) || CASE WHEN i % 8 = 7 THEN '?' ELSE '' END WHEN i % 9 = 5 THEN '* ' || l WHEN i % 11 = 6 THEN '' WHEN i % 13 = 8 THEN '== ' || l || ' ==' ELSE l END
            FOR l, i IN string_split(coalesce(text, ''), chr(10))], chr(10)) AS text FROM (SELECT doc_id, text FROM documents)),
lines AS (SELECT source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS no FROM sources),
trimmed AS (SELECT source, no, trim(raw, {BLANKS}) AS line, sum(strlen(raw) + 1) OVER (PARTITION BY source ORDER BY no) - strlen(raw) - 1 + strlen(raw) - strlen(ltrim(raw, {BLANKS})) AS "start" FROM lines),
kinds AS (SELECT *, "start" + strlen(line) AS "end", CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^=+.*=+$') THEN 'heading'
  WHEN regexp_matches(line, '--\s*([A-Za-z][A-Za-z0-9_]{{2,47}})\s*(\?)?\s*$') AND NOT regexp_matches(line, '^(?:[*#:]+\s*)?\[?https?://|^\[\[[^\]]*\]\]$') THEN 'signed'
  WHEN regexp_matches(line, '^(?:[*#:]+\s*)?\[?https?://|^[*#]+\s|^\{{?\||^\[\[[^\]]*\]\]$') THEN 'list' ELSE 'plain' END AS k FROM trimmed),
broken AS (SELECT *, CASE WHEN k = 'list' AND lag(k) OVER w = 'list' THEN 0 WHEN k IN ('plain', 'signed') AND lag(k) OVER w = 'plain' AND NOT (k = 'signed' AND line[1] IN ('*', '#', ':')) THEN 0 ELSE 1 END AS b FROM kinds WINDOW w AS (PARTITION BY source ORDER BY no)),
groups AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY no) AS g FROM broken),
units AS (SELECT source, CAST(min("start") AS BIGINT) AS "start", CAST(max("end") AS BIGINT) AS "end", CASE WHEN count(*) FILTER (k = 'signed') > 0 THEN 'post' WHEN max(k) = 'plain' THEN 'text' ELSE max(k) END AS kind, count(*) AS lines,
  max(nullif(regexp_extract(line, '--\s*([A-Za-z][A-Za-z0-9_]{{2,47}})\s*(\?)?\s*$', 1), '')) FILTER (k = 'signed') AS signature FROM groups WHERE k <> 'blank' GROUP BY source, g),
revs AS (SELECT doc_id, source AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, text FROM documents),
pieces AS (SELECT page, idx, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM revs),
held AS (SELECT page, text, idx, count(*) AS copies, lead(idx) OVER (PARTITION BY page, text ORDER BY idx) AS nxt FROM pieces WHERE text <> '' GROUP BY page, text, idx),
total AS (SELECT page, max(idx) + 1 AS total FROM revs GROUP BY page),
followed AS (SELECT page, text, min(idx) AS first, max(idx) AS last, count(*) AS revisions_present, coalesce(min(CASE WHEN nxt > idx + 1 THEN idx + 1 END), CASE WHEN max(idx) + 1 < any_value(total) THEN max(idx) + 1 END) AS first_absent,
  CASE WHEN max(idx) + 1 < any_value(total) THEN max(idx) + 1 END AS gone_after, min_by(copies, idx) AS copies_at_first FROM held JOIN total USING (page) GROUP BY page, text)
""")


def sources(spark, sf):
    d = table(spark, sf, "documents")

    def one(line, i):
        signed = F.concat(line, F.lit(" -- Writer"), (i % 7).cast("string"), F.when(i % 8 == 7, "?").otherwise(""))
        return F.when(i % 4 == 3, signed).when(i % 9 == 5, F.concat(F.lit("* "), line)).when(i % 11 == 6, "").when(i % 13 == 8, F.concat(F.lit("== "), line, F.lit(" =="))).otherwise(line)

    # list positions count from 1 on the SQL side
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: one(x, i + 1))
    return d.select(F.col("doc_id").alias("source"), F.array_join(lines, "\n").alias("text"))


def units(spark, sf):
    return G.segment(sources(spark, sf))


@PLANS.query("w1_segment", 'SELECT source, "start", "end", kind, lines, signature FROM units')
def w1(spark, sf):
    return units(spark, sf).select("source", "start", "end", "kind", "lines", "signature")


@PLANS.query("p3_classify_line", "SELECT k AS kind, count(*) AS n FROM kinds WHERE k <> 'blank' GROUP BY k")
def p3(spark, sf):
    rows = sources(spark, sf).select(F.explode(F.split("text", "\n", -1)).alias("raw")).select(F.btrim("raw", F.lit(T.LINE_BLANKS)).alias("line")).filter("line <> ''")
    return rows.groupBy(T.classify_line(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@PLANS.query("p4_signature_of", "SELECT signature, count(*) AS n FROM units WHERE signature IS NOT NULL GROUP BY signature")
def p4(spark, sf):
    return units(spark, sf).filter("signature is not null").groupBy("signature").agg(F.count("*").alias("n"))


@PLANS.query("p5_unit_text", """SELECT u.source, u."start", CAST(u."end" - u."start" AS INT) AS bytes, sha256(unhex(substr(hex(encode(s.text)), CAST(u."start" * 2 + 1 AS BIGINT), CAST((u."end" - u."start") * 2 AS BIGINT)))) AS sha FROM units u JOIN sources s ON u.source = s.source""")
def p5(spark, sf):
    out = G.with_text(units(spark, sf), sources(spark, sf))
    return out.select("source", "start", F.octet_length("text").alias("bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha"))


@PLANS.query("a1_ledger_stats", "SELECT kind, count(*) AS units FROM units GROUP BY kind UNION ALL SELECT 'source', count(*) FROM sources")
def a1(spark, sf):
    from ..operators.checks import ledger_stats

    s = sources(spark, sf).select(F.lit("source").alias("kind"))
    return ledger_stats(units(spark, sf).select("kind").unionByName(s), "kind").withColumnRenamed("records", "units")


@PLANS.query("p1_unit_id", """SELECT 'unit:' || left(sha256('{"end":' || CAST("end" AS VARCHAR) || ',"source":"src:' || CAST(source AS VARCHAR) || '","start":' || CAST("start" AS VARCHAR) || ',"unit_kind":"' || kind || '"}'), 20) AS id FROM units""")
def p1(spark, sf):
    return units(spark, sf).select(unit_id(F.concat(F.lit("src:"), F.col("source").cast("string")), F.col("start"), F.col("end"), F.col("kind")).alias("id"))


@PLANS.query("p1_content_id", """SELECT 'code:' || left(sha256('{"lang":"' || lang || '","n":' || CAST(n_chars AS VARCHAR) || ',"source":"' || source || '"}'), 20) AS id FROM documents""")
def p1_open(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(content_id("code", F.to_json(F.struct("source", F.col("n_chars").alias("n"), "lang"))).alias("id"))


@PLANS.query("p2_repair_bytes", r"""SELECT doc_id, doc_id % 10 <> 3 AS ok, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 * strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) ELSE strlen(text) END AS INT) AS bytes FROM documents WHERE text IS NOT NULL""")
def p2(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    body = F.decode(F.encode("text", "utf-8"), "iso-8859-1")
    sha = F.when(F.col("doc_id") % 10 == 3, F.lit("0")).otherwise(F.sha2(F.encode("text", "utf-8"), 256))
    rows = d.select("doc_id", body.alias("body"), sha.alias("body_sha256"), F.when(F.col("doc_id") % 2 == 0, "latin-1").otherwise("utf-8").alias("body_encoding"))
    return G.repair_bytes(rows).select("doc_id", "ok", F.octet_length("utf8").alias("bytes"))


def pages(spark, sf):
    """Documents of a source are a page's revisions in order of id; ids alone are numbered, inside ranges, and meet the texts
    afterwards."""
    from ..operators.lexicon import ranked

    d = table(spark, sf, "documents")
    ids = ranked(d.select("doc_id", "source"), ["source"], ["doc_id"])
    return d.select("doc_id", F.col("source").alias("page"), "text").join(ids.select("doc_id", F.col("_rn").cast("long").alias("idx")), "doc_id").select("doc_id", "page", "idx", "text")


def pieces(spark, sf):
    rows = pages(spark, sf).select("page", "idx", F.lit("text").alias("kind"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("start", "text"))
    return rows.filter("text <> ''").withColumn("start", F.col("start").cast("long"))


@PLANS.query("w2_follow", """SELECT page, sha256(text) AS hash, first, last, revisions_present, first_absent, coalesce(last > first_absent, false) AS returned, gone_after, copies_at_first FROM followed""")
def w2(spark, sf):
    return G.follow(pieces(spark, sf), pages(spark, sf)).drop("kind")


@PLANS.query("w3_units_from_follow", """SELECT f.page, sha256(f.text) AS hash, a.doc_id AS source, a.doc_id AS first_time, l.doc_id AS last_time, r.doc_id AS removed_time, g.doc_id AS gone_time,
  (SELECT min(x.doc_id) FROM documents x WHERE x.source = f.page AND x.doc_id % 7 = 0 AND x.doc_id >= a.doc_id) AS page_deleted_after
FROM followed f JOIN revs a ON a.page = f.page AND a.idx = first JOIN revs l ON l.page = f.page AND l.idx = last LEFT JOIN revs r ON r.page = f.page AND r.idx = first_absent LEFT JOIN revs g ON g.page = f.page AND g.idx = gone_after""")
def w3(spark, sf):
    rows = pages(spark, sf)
    p = pieces(spark, sf).select("*", (F.col("start") + 1).alias("end"), F.lit(None).cast("string").alias("signature"))
    revs = rows.select("page", "idx", F.col("doc_id").alias("source"), F.col("doc_id").alias("time"), F.lit("x").alias("by"))
    gone = rows.filter("doc_id % 7 = 0").select("page", F.col("doc_id").alias("time"))
    out = G.units_from_follow(G.follow(p, rows), p, revs, gone)
    return out.select("page", "hash", "source", "first_time", "last_time", "removed_time", "gone_time", "page_deleted_after")


@PLANS.query("j8_deleted_after", "SELECT o_orderkey AS unit, (SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) AS page_deleted_after FROM orders")
def j8(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("time"))
    return G.deleted_after(u, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_shipdate").alias("time")))


def quotes(spark, sf):
    """Benchmark passages looked for in the documents that hold their first words; every third one with doubled blanks."""
    b = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("body", r"\s+"))).alias("w"))
    first = b.select("item_id", F.col("text").alias("q"), F.element_at(F.split("text", r"\s+"), 3).alias("w"))
    return words.join(first, "w").select((F.col("doc_id") * 1000 + F.col("item_id")).alias("quote_id"), F.col("doc_id").alias("unit"), F.when(F.col("item_id") % 3 == 0, F.replace("q", F.lit(" "), F.lit("  "))).otherwise(F.col("q")).alias("quote"))


@PLANS.query("j1_resolve_quotes", r"""SELECT doc_id * 1000 + item_id AS quote_id, doc_id AS unit, CAST(strlen(left(d.text, pos - 1)) AS BIGINT) AS "start", CAST(strlen(left(d.text, pos - 1)) + strlen(b.text) AS BIGINT) AS "end",
 CASE WHEN item_id % 3 = 0 THEN 'ws-normalized' ELSE 'exact' END AS match FROM (SELECT d.doc_id, d.text AS t, b.item_id, instr(d.text, b.text) AS pos FROM documents d, benchmark b) x JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE pos > 0
   AND list_contains(regexp_split_to_array(d.text, '\s+'), regexp_split_to_array(b.text, '\s+')[3])""")
def j1(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("start"))
    return A.resolve_quotes(quotes(spark, sf), d).filter("start is not null").select("quote_id", "unit", "start", "end", "match")


@PLANS.query("v7_check_anchors", """SELECT doc_id * 1000 + item_id AS id, doc_id % 2 = 0 AS ok FROM documents d, benchmark b WHERE instr(d.text, b.text) > 0 AND item_id % 3 <> 0
   AND list_contains(regexp_split_to_array(d.text, '\\s+'), regexp_split_to_array(b.text, '\\s+')[3])""")
def v7(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("start"))
    found = A.resolve_quotes(quotes(spark, sf), d).filter("match = 'exact'")
    shift = F.when(F.col("unit") % 2 == 0, 0).otherwise(1)
    rows = found.select(F.col("quote_id").alias("id"), F.col("unit").alias("source"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), "exact")
    return A.check_anchors(rows, d.select(F.col("unit").alias("source"), F.encode("text", "utf-8").alias("content"))).select("id", "ok")


@PLANS.query("p12_snippet", r"""SELECT doc_id, CASE WHEN pos > 21 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(pos - 20, 1), least(pos + 3 + 20, length(text) + 1) - greatest(pos - 20, 1)), '\s+', ' ', 'g')) || CASE WHEN pos + 2 + 20 < length(text) THEN '…' ELSE '' END AS snippet
FROM (SELECT doc_id, text, instr(text, 'the') AS pos FROM documents) WHERE pos > 0""")
def p12(spark, sf):
    d = table(spark, sf, "documents").withColumn("at", F.instr("text", "the")).filter("at > 0")
    return d.select("doc_id", T.snippet(F.col("text"), F.col("at") - 1, F.col("at") + 2, 20).alias("snippet"))


@PLANS.query("p7_body_of", "SELECT doc_id, sha256(rtrim(text, ' -')) AS sha FROM documents WHERE text IS NOT NULL")
def p7(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    signed = d.select("doc_id", F.concat("text", F.lit(" -- "), "source").alias("text"), F.col("source").alias("signature"))
    return signed.select("doc_id", F.sha2(F.encode(T.body_of(F.col("text"), F.col("signature")), "utf-8"), 256).alias("sha"))


@PLANS.query("f10_collapse_ws", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS sha FROM documents WHERE text IS NOT NULL")
def f10(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.sha2(F.encode(T.collapse_ws(F.col("text")), "utf-8"), 256).alias("sha"))


@PLANS.query("f9_find_matches", r"SELECT doc_id, count(*) AS matches, CAST(sum(length(x)) AS BIGINT) AS size FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS x FROM documents) GROUP BY doc_id")
def f9(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(T.find_matches(F.col("text"), "[0-9]+")).alias("m"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("matches"), F.sum(F.col("m.end") - F.col("m.start")).alias("size"))
