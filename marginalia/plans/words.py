"""Terms traced through documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..sources.terms import terms_of, terms_table
from .tables import Plans, table

TERMS = """# small words
the
THE
not
of the
# given
and = (?<![A-Za-z0-9])[Aa]nd(?![A-Za-z0-9])
# rare

zzyzx
the
"""

PLANS = Plans(r"""
units AS (
  SELECT doc_id AS unit, coalesce(text, '') AS text,
         '2026-06-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS time,
         source AS signer, lang AS page, doc_id % 5 = 0 AS removed,
         regexp_replace(' ' || coalesce(text, '') || ' ', '([^A-Za-z0-9])', '\1\1', 'g') AS wide FROM documents),
terms AS (SELECT * FROM (VALUES ('the', '(?i)[^A-Za-z0-9]the[^A-Za-z0-9]'), ('THE', '[^A-Za-z0-9]THE[^A-Za-z0-9]'),
  ('not', '(?i)[^A-Za-z0-9]not[^A-Za-z0-9]'), ('of the', '(?i)[^A-Za-z0-9]of[\s_-]+the[^A-Za-z0-9]'),
  ('and', '[^A-Za-z0-9][Aa]nd[^A-Za-z0-9]'), ('zzyzx', '(?i)[^A-Za-z0-9]zzyzx[^A-Za-z0-9]'), ('the (2)', '(?i)[^A-Za-z0-9]the[^A-Za-z0-9]')) t(term, pattern)),
hits AS (SELECT * FROM (SELECT units.* EXCLUDE (text, wide), term, CAST(len(regexp_extract_all(wide, '(?:' || pattern || ')')) AS INT) AS n FROM units, terms) WHERE n > 0),
uses AS (SELECT event_type AS term, user_id AS signer, ts, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM events)
""")


def units(spark, sf):
    d = table(spark, sf, "documents")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.concat(F.lit("2026-06-"), two(F.col("doc_id") % 28 + 1), F.lit("T"), two(F.col("doc_id") % 24), F.lit(":00:00Z"))
    return d.select(F.col("doc_id").alias("unit"), F.coalesce("text", F.lit("")).alias("text"), time.alias("time"), F.col("source").alias("signer"), F.col("lang").alias("page"), (F.col("doc_id") % 5 == 0).alias("removed"))


def hits(spark, sf):
    return L.term_hits(units(spark, sf), terms_of(spark, TERMS))


def uses(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("term"), F.col("user_id").alias("signer"), "ts", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))


@PLANS.query("s8_terms_table", """, l AS (SELECT p_partkey // 25 AS list, p_partkey, p_name, p_partkey % 25 AS line FROM part), t AS (SELECT list, p_partkey, CASE WHEN line % 5 = 3 THEN 'same' ELSE p_name END AS label FROM l WHERE line NOT IN (0, 10)),
n AS (SELECT *, row_number() OVER (PARTITION BY list, label ORDER BY p_partkey) AS again FROM t)
SELECT list, p_partkey AS ord, label || CASE WHEN again > 1 THEN ' (' || again || ')' ELSE '' END AS term, (SELECT max_by(p_name, p_partkey) FROM l WHERE l.list = n.list AND l.p_partkey < n.p_partkey AND line IN (0, 10)) AS heading FROM n""")
def s8(spark, sf):
    """Twenty-five parts are the lines of a list: two of them headings, some of one label, the others plain."""
    at = F.col("p_partkey") % 25
    line = F.when(at.isin(0, 10), F.concat(F.lit("# "), "p_name")).when(at % 5 == 3, F.concat(F.lit("same = "), "p_name")).otherwise(F.col("p_name"))
    lines = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 25).alias("list"), F.col("p_partkey").alias("ord"), line.alias("line"))
    return terms_table(lines, ["list"]).select("list", "ord", "term", "heading")


@PLANS.query("j9_term_hits", "SELECT unit, term, n FROM hits")
def j9(spark, sf):
    return hits(spark, sf).select("unit", "term", "n")


TRACE = """
SELECT t.term, coalesce(units, 0) AS units, coalesce(occurrences, 0) AS occurrences, coalesce(signers, 0) AS signers,
       coalesce(pages, 0) AS pages, first_use, last_use, coalesce(later_removed, 0) AS later_removed, peak_day, coalesce(peak_units, 0) AS peak_units
FROM terms t
LEFT JOIN (SELECT term, count(*) AS units, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT signer) AS signers, count(DISTINCT page) AS pages,
                  min(time) AS first_use, max(time) AS last_use, count(*) FILTER (removed) AS later_removed FROM hits GROUP BY term) h USING (term)
LEFT JOIN (SELECT term, day AS peak_day, units AS peak_units FROM (
             SELECT *, row_number() OVER (PARTITION BY term ORDER BY units DESC, day) AS r
             FROM (SELECT term, substr(time, 1, 10) AS day, count(*) AS units FROM hits GROUP BY ALL)) WHERE r = 1) p USING (term)
"""


@PLANS.query("a2_trace_terms", TRACE)
def a2(spark, sf):
    return L.trace_terms(hits(spark, sf), terms_of(spark, TERMS))


@PLANS.query("a3_term_by_day", "SELECT term, substr(time, 1, 10) AS day, count(*) AS units FROM hits GROUP BY ALL")
def a3(spark, sf):
    return L.term_by_day(hits(spark, sf))


@PLANS.query("u1_absent_terms", "SELECT term FROM terms WHERE term NOT IN (SELECT term FROM hits)")
def u1(spark, sf):
    return L.absent_terms(terms_of(spark, TERMS), hits(spark, sf))


@PLANS.query("w4_first_use", "SELECT term, unit, time, n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY time, unit) AS r FROM hits) WHERE r = 1")
def w4(spark, sf):
    return L.first_use(hits(spark, sf)).select("term", "unit", "time", "n")


@PLANS.query("a30_day_axis", "SELECT strftime(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM events")
def a30(spark, sf):
    return L.day_axis(table(spark, sf, "events").select(F.to_date("ts").alias("day")))


ADOPTION = """
, took AS (SELECT term, signer, min(ts) AS took FROM uses GROUP BY ALL), first AS (SELECT term, min(took) AS first FROM took GROUP BY ALL),
hours AS (SELECT unnest([1, 3, 6, 24, 48]) AS hours)
SELECT term, hours, count(*) FILTER (took <= first + to_hours(hours)) AS adopters,
       (SELECT count(DISTINCT user_id) FROM events e WHERE e.ts >= f.first AND e.ts <= f.first + to_hours(hours)) AS posting
FROM took JOIN first f USING (term), hours GROUP BY term, hours, f.first
"""


@PLANS.query("w10_adoption", ADOPTION)
def w10(spark, sf):
    rows = uses(spark, sf)
    return L.adoption(rows, rows.select("signer", "ts"))


@PLANS.query("w10_adoption_steps", """, took AS (SELECT term, signer, min(ts) AS took FROM uses GROUP BY ALL), first AS (SELECT term, min(took) AS first FROM took GROUP BY ALL),
by_hour AS (SELECT term, CAST(ceil((epoch_us(took) - epoch_us(first)) / 3.6e9) AS BIGINT) AS hour, count(*) AS new FROM took JOIN first USING (term) GROUP BY ALL)
SELECT term, hour, CAST(sum(new) OVER (PARTITION BY term ORDER BY hour) AS BIGINT) AS adopters FROM by_hour""")
def w10_steps(spark, sf):
    return L.adoption_steps(uses(spark, sf))


@PLANS.query("w10_first_adopters", "SELECT term, signer, place FROM (SELECT term, signer, row_number() OVER (PARTITION BY term ORDER BY min(ts), signer) AS place FROM uses GROUP BY term, signer) WHERE place <= 5")
def w10_first(spark, sf):
    return L.first_adopters(uses(spark, sf)).select("term", "signer", "place")


@PLANS.query("t2_fastest_spread", """, took AS (SELECT term, signer, min(ts) AS took FROM uses GROUP BY ALL), first AS (SELECT term, min(took) AS first FROM took GROUP BY ALL),
wide AS (SELECT term, count(*) FILTER (took <= first + INTERVAL 1 HOUR) AS h1, count(*) FILTER (took <= first + INTERVAL 3 HOUR) AS h3, min(first) AS first_use FROM took JOIN first USING (term) GROUP BY term),
ranked AS (SELECT *, row_number() OVER w AS place, coalesce(lead(h1) OVER w = h1 AND lead(h3) OVER w = h3, false) AS tied FROM wide WINDOW w AS (ORDER BY h1 DESC, h3 DESC, first_use, term))
SELECT place, term, h1, h3, first_use, tied FROM ranked WHERE place <= 3""")
def t2(spark, sf):
    rows = uses(spark, sf)
    first = rows.groupBy("term").agg(F.min("ts").alias("first_use"))
    return L.fastest_spread(L.adoption(rows, rows.select("signer", "ts")), first, 3)


THIN = """, numbered AS (SELECT term, event_id, row_number() OVER (PARTITION BY term ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY term) AS n FROM uses)
SELECT term, event_id FROM numbered WHERE n <= {k} OR rn IN (SELECT {f} FROM generate_series(0, {k} - 1) g(i))"""


@PLANS.query("w11_thin", THIN.format(k=60, f="CAST(round_even(i * (n - 1) / 59.0, 0) AS BIGINT)"))
def w11_thin(spark, sf):
    return L.thin(uses(spark, sf), ["term"], ["ts", "event_id"], 60).select("term", "event_id")


@PLANS.query("w12_spread_examples", THIN.format(k=9, f="(i * (n - 1)) // 8"))
def w12(spark, sf):
    return L.spread_examples(uses(spark, sf), ["term"], ["ts", "event_id"], 9).select("term", "event_id")


@PLANS.query("w11_concordance", r"""SELECT unit, CAST(use AS BIGINT) AS use, said FROM (SELECT unit, unnest(range(len(m))) AS use, substr(unnest(m), 2, 4) AS said
  FROM (SELECT unit, regexp_extract_all(wide, '(?i)[^A-Za-z0-9]with[^A-Za-z0-9]') AS m FROM units))""")
def w11(spark, sf):
    return L.concordance(units(spark, sf), r"(?iu)(?<![A-Za-z0-9])with(?![A-Za-z0-9])").select("unit", F.col("use").cast("long").alias("use"), "said")


@PLANS.query("a11_words_around", r""", p AS (SELECT text, unnest(generate_series(1, length(text) - 3)) AS p FROM units WHERE text LIKE '%with%'),
m AS (SELECT text, p FROM p WHERE substr(text, p, 4) = 'with' AND NOT regexp_matches(CASE WHEN p = 1 THEN '' ELSE substr(text, p - 1, 1) END, '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, p + 4, 1), '[A-Za-z0-9]'))
SELECT lower(trim(regexp_replace(substr(text, greatest(p - 28, 1), p + 31 - greatest(p - 29, 0)), '[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS context, count(*) AS uses FROM m GROUP BY ALL ORDER BY uses DESC, context LIMIT 5""")
def a11(spark, sf):
    return L.words_around(units(spark, sf), r"(?<![A-Za-z0-9])with(?![A-Za-z0-9])")


@PLANS.query("a12_probe_words", r"""SELECT word, page AS kind, count(*) FILTER (n > 0) AS units, CAST(sum(n) AS BIGINT) AS occurrences FROM (
  SELECT word, page, len(regexp_extract_all(wide, '(?i)[^A-Za-z0-9]' || word || '[^A-Za-z0-9]')) AS n FROM units, (VALUES ('the'), ('not'), ('with'), ('zzyzx')) v(word)) GROUP BY ALL""")
def a12(spark, sf):
    return L.probe_words(units(spark, sf), ["the", "not", "with", "zzyzx"], F.col("page"))


@PLANS.query("a12_longer_words", r"""SELECT word, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]*tion[a-z]*')) AS word FROM units)
  WHERE word <> 'tion' GROUP BY ALL ORDER BY uses DESC, word LIMIT 8""")
def a12_longer(spark, sf):
    return L.longer_words(units(spark, sf), "tion")
