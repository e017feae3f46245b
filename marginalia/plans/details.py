"""Details of readers, names, boards and ledgers: the operators that list what others count."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as FA
from ..functions import text as T
from ..operators import anchors as A
from ..operators import answers as AN
from ..operators import board as B
from ..operators import checks as V
from ..operators import coding as K
from ..operators import compare as C
from ..operators import contingency as G
from ..operators import lexicon as L
from ..operators import names as N
from ..operators import passages as P
from ..operators import sampled as S
from . import ledgers, named, readers, spans, words
from .tables import Plans, table

READERS, NAMED, SPANS, LEDGERS, WORDS = (Plans(m.PLANS.shared) for m in (readers, named, spans, ledgers, words))
PLANS = Plans()


# names
@NAMED.query("a13_signature_parts", """SELECT kind, part, posts, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY posts DESC, part) AS place FROM (
  SELECT split_part(x, ':', 1) AS kind, split_part(x, ':', 2) AS part, count(*) AS posts FROM (SELECT feature AS x FROM features WHERE feature LIKE 'role:%' OR feature LIKE 'institution:%' UNION ALL SELECT 'date:' || own_date FROM made WHERE own_date IS NOT NULL) GROUP BY ALL)) WHERE place <= 3""")
def a13_parts(spark, sf):
    return N.signature_parts(named.posts(spark, sf))


@NAMED.query("a12_loose_words", r"""SELECT word, count(*) AS uses FROM (SELECT unnest(regexp_extract_all('see ' || named || ' on ' || said_month || ' ' || CAST(said_day AS VARCHAR) || CASE WHEN one THEN ' I say' ELSE '' END || CASE WHEN many THEN ' we go' ELSE '' END || ' -- ' || signature, '(?i)[A-Za-z]*link[A-Za-z]*')) AS word FROM made
  UNION ALL SELECT w || ' (in a name)' FROM (SELECT unnest(list_distinct(regexp_extract_all(signature || ' ' || saved, '(?i)[A-Za-z]*link[A-Za-z]*'))) AS w FROM made)) GROUP BY word ORDER BY uses DESC, word LIMIT 8""")
def a12_loose(spark, sf):
    rows = named.posts(spark, sf).withColumn("names", F.concat_ws(" ", "signature", "saved"))
    return L.loose_words(rows, "link")


@NAMED.query("a29_feature_days", """SELECT feature, CAST(sum(n) AS BIGINT) AS posts, min(day) AS first_day, max(day) AS last_day, min_by(day, (-n, day)) AS peak_day, max(n) AS peak_posts FROM (SELECT feature, day, count(DISTINCT post) AS n FROM features JOIN kinds ON post = k GROUP BY ALL) GROUP BY feature""")
def a29_days(spark, sf):
    return G.feature_days(named.posts(spark, sf), named.features(spark, sf))


ODD = """, o AS (SELECT c_custkey AS k, list_extract(['Ann-Marie', 'Jo_Ann', 'O''Neil', 'Agent'], CAST(c_custkey % 4 + 1 AS INT)) || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END || 'Reader' || CAST(c_custkey % 50 AS VARCHAR) AS name FROM customer)"""


@NAMED.query("j10_odd_names", ODD + """, said AS (SELECT k, unnest([(SELECT any_value(name) FROM o y WHERE y.k = x.k + 1), (SELECT any_value(name) FROM o y WHERE y.k = x.k + 2)]) AS name FROM o x)
SELECT DISTINCT said.k AS post, said.name FROM said JOIN o ON o.k = said.k WHERE said.name IS NOT NULL AND said.name <> o.name AND length(said.name) >= 8""")
def j10_odd(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    first = F.get(F.array(*map(F.lit, ("Ann-Marie", "Jo_Ann", "O'Neil", "Agent"))), (k % 4).cast("int"))
    rows = c.select(k.alias("post"), F.concat(first, F.when(k % 3 == 0, "-").otherwise(""), F.lit("Reader"), (k % 50).cast("string")).alias("signature"))
    other = lambda n: rows.select((F.col("post") - n).alias("post"), F.col("signature").alias(f"s{n}"))
    body = F.concat(F.lit("Ask "), F.coalesce("s1", F.lit("no one")), F.lit(", or ("), F.coalesce("s2", F.lit("no one")), F.lit(")."))
    posts = rows.join(other(1), "post", "left").join(other(2), "post", "left").withColumn("body", body)
    return N.mentions(posts, rows.select(F.col("signature").alias("name")))


# ledgers
CANON = "'{\"code_type\":\"' || lang || '\",\"n\":' || doc_id || ',\"name\":\"' || source || '\"}'"


@LEDGERS.query("v1_content_identity", f"""SELECT CASE WHEN doc_id % 11 = 4 THEN 'code:' || doc_id ELSE 'code:' || substr(sha256({CANON}), 1, 20) END AS id, 'record id does not match its content' AS reason FROM documents
  WHERE CASE WHEN doc_id % 11 = 4 THEN 'code:' || doc_id ELSE 'code:' || substr(sha256({CANON}), 1, 20) END <> 'code:' || substr(sha256({CANON}), 1, 20)""")
def v1_content(spark, sf):
    from ..functions.ids import identity_of

    d = table(spark, sf, "documents")
    body = F.concat(F.lit('{"name": "'), "source", F.lit('", "code_type": "'), "lang", F.lit('", "n": '), F.col("doc_id").cast("string"), F.lit("}"))
    rows = d.select("doc_id", F.lit("code").alias("kind"), body.alias("body"))
    own = F.when(F.col("doc_id") % 11 == 4, F.concat(F.lit("code:"), F.col("doc_id").cast("string"))).otherwise(identity_of(F.col("kind"), F.col("body")))
    return V.check_identity(rows.select(own.alias("id"), "kind", "body"))


@PLANS.query("v5_prompt_parts", """SELECT s_suppkey AS id, CASE WHEN k % 5 = 1 THEN 'prompt part missing: p' || k ELSE 'prompt part altered: p' || k END AS reason FROM supplier, (SELECT s_suppkey AS k FROM supplier) WHERE (k = s_suppkey OR k = s_suppkey + 1) AND k % 5 IN (1, 2)
  UNION ALL SELECT s_suppkey, 'prompt part missing: p' || (s_suppkey + 1) FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier) AND (s_suppkey + 1) % 5 NOT IN (1, 2)
  UNION ALL SELECT s_suppkey, 'prompt part missing: p' || (s_suppkey + 1) FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier) AND (s_suppkey + 1) % 5 IN (1, 2)""")
def v5_parts(spark, sf):
    """A lens has the parts of its own number and the next; of the last number's next there is none."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    content = lambda c: F.concat(F.lit("part "), c.cast("string")).cast("binary")
    one = lambda c: F.struct(F.concat(F.lit("p"), c.cast("string")).alias("name"), F.sha2(content(c), 256).alias("sha256"))
    blobs = s.filter("s_suppkey % 5 <> 1").select(F.sha2(content(k), 256).alias("sha"), F.when(k % 5 == 2, F.lit(b"other")).otherwise(content(k)).alias("content"))
    return V.check_prompt_parts(s.select(k.alias("id"), F.array(one(k), one(k + 1)).alias("stack")), blobs)


HALVES = """, h AS (SELECT event_type AS kind, sha256(CAST(event_id AS VARCHAR) || chr(31) || CAST(user_id AS VARCHAR)) AS sha FROM events),
d AS (SELECT kind, count(*) AS records, sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(sha, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(sha, 16, 15) AS BIGINT)) AS VARCHAR)) AS digest FROM h GROUP BY kind)"""


def _digests(spark, sf):
    e = table(spark, sf, "events")
    return V.ledger_digest(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("body")))


@LEDGERS.query("v10_kind_digests", HALVES + " SELECT kind, records, digest FROM d")
def v10_kinds(spark, sf):
    return _digests(spark, sf)


@LEDGERS.query("v10_ledger_fingerprint", HALVES + " SELECT CAST(sum(records) AS BIGINT) AS records, sha256(string_agg(kind || ':' || CAST(records AS VARCHAR) || ':' || digest, chr(10) ORDER BY kind)) AS digest FROM d")
def v10_whole(spark, sf):
    return V.ledger_fingerprint(_digests(spark, sf))


COUNTS = """, n AS (SELECT unnest(['entries', 'units', 'families', 'entries without a span', 'passages', 'longest passage']) AS name,
  unnest([(SELECT count(*) FROM entries), (SELECT count(DISTINCT unit) FROM entries), (SELECT count(DISTINCT family) FROM entries), (SELECT count(*) FROM spans WHERE "start" IS NULL), (SELECT count(*) FROM passages), (SELECT coalesce(max("end" - "start"), 0) FROM passages)]) AS value)"""


@SPANS.query("v11_recount", COUNTS + " SELECT name, CAST(value AS BIGINT) AS value FROM n")
def v11_recount(spark, sf):
    return V.recount_passages(spans.entries(spark, sf))


@SPANS.query("v11_page_against_ledger", COUNTS + " SELECT name, name <> 'units' AS ok, CASE WHEN name = 'units' THEN 'page ' || CAST(value + 1 AS VARCHAR) || ', ledger ' || CAST(value AS VARCHAR) END AS detail FROM n")
def v11_page(spark, sf):
    """A page that merges passages, with one wrong number, against a count of the raw records."""
    rows = spans.entries(spark, sf)
    merged = P.passages(P.merge_passages(rows))
    one = rows.agg(F.count("*").alias("entries"), (F.countDistinct("unit") + 1).alias("units"), F.countDistinct("family").alias("families"), F.count_if(F.col("start").isNull()).alias("entries without a span"))
    two = merged.agg(F.count("*").alias("passages"), F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0)).alias("longest passage"))
    both = one.crossJoin(two)
    page = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("long").alias("value")) for c in both.columns])).alias("r")).select("r.*")
    return V.reconcile(page, V.recount_passages(rows))


@SPANS.query("u4_all_anchors", """SELECT id, CASE WHEN family = 0 THEN 'quotation' ELSE 'note' END AS what, unit, "start", "end" FROM spans WHERE "start" IS NOT NULL AND family < 2""")
def u4(spark, sf):
    rows = spans.entries(spark, sf).withColumn("exact", F.lit("x"))
    return V.all_anchors(("quotation", rows.filter("family = 0")), ("note", rows.filter("family = 1"))).select("id", "what", "unit", "start", "end")


@SPANS.query("a23_wordings_by_family", "SELECT p_name AS exact, CAST(l_suppkey % 3 AS INT) AS family, count(DISTINCT l_orderkey) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def a23_families(spark, sf):
    rows = spans._unfit(spark, sf).select(F.col("p_name").alias("exact"), F.col("l_orderkey").alias("unit"), (F.col("l_suppkey") % 3).cast("int").alias("family"))
    return P.wordings_by_family(rows)


DETAILS = """, t AS (SELECT lower(p_name) AS key, CASE WHEN l_linenumber % 3 = 0 THEN 'in_vivo' ELSE 'analytic' END AS kind, count(*) AS n, count(*) FILTER (l_linenumber % 6 = 0) AS absent FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT key, string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, kind) AS types, CAST(sum(absent) AS BIGINT) AS not_in_unit FROM t GROUP BY key"""


@SPANS.query("a15_name_details", DETAILS)
def a15_details(spark, sf):
    line = F.col("l_linenumber")
    rows = spans._unfit(spark, sf).select(F.upper("p_name").alias("name"), F.when(line % 3 == 0, "in_vivo").otherwise("analytic").alias("code_type"), F.when(line % 3 == 0, line % 6 != 0).alias("in_vivo_in_unit"))
    return K.name_details(rows)


@SPANS.query("a31_entries_by_day", """, made AS (SELECT first_seen AS day, family AS lens, count(*) AS entries FROM entries GROUP BY ALL),
had AS (SELECT '2026-06-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS day, lens, count(*) AS units_read FROM (SELECT DISTINCT l_partkey AS unit, CAST(l_suppkey % 3 AS INT) AS lens FROM lineitem WHERE l_linenumber < 4) JOIN part ON unit = p_partkey GROUP BY ALL),
b AS (SELECT day, lens, coalesce(entries, 0) AS entries, coalesce(units_read, 0) AS units_read FROM made FULL JOIN had USING (day, lens))
SELECT * FROM b UNION ALL SELECT 'all', lens, CAST(sum(entries) AS BIGINT), CAST(sum(units_read) AS BIGINT) FROM b GROUP BY lens""")
def a31_entries(spark, sf):
    day = lambda c: F.concat(F.lit("2026-06-"), F.lpad((c % 28 + 1).cast("string"), 2, "0"))
    made = spans.entries(spark, sf).select(day(F.col("unit")).alias("day"), F.col("family").alias("lens"))
    li = table(spark, sf, "lineitem").filter("l_linenumber < 4")
    had = li.select(F.col("l_partkey").alias("unit"), (F.col("l_suppkey") % 3).cast("int").alias("lens"))
    units = table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), day(F.col("p_partkey")).alias("day"))
    return P.entries_by_day(made, had, units)


# boards
@LEDGERS.query("a33_signatures", "SELECT role AS lens, 'R' || role AS signed, count(*) AS notes FROM conversations WHERE conv_id % 3 = 0 GROUP BY role")
def a33_signatures(spark, sf):
    return B.signatures_by_reader(ledgers.notes(spark, sf))


@LEDGERS.query("a35_board_reading", """, b AS (SELECT DISTINCT notebook FROM threaded), u AS (SELECT DISTINCT u1 AS unit FROM threaded UNION SELECT DISTINCT u2 FROM threaded),
lost AS (SELECT DISTINCT t.thread, b.notebook FROM threaded t, b WHERE NOT EXISTS (SELECT 1 FROM threaded x WHERE x.thread = t.thread AND x.notebook = b.notebook) AND (t.u1 % 3 <> b.notebook OR t.u2 % 3 <> b.notebook))
SELECT notebook, (SELECT count(*) FROM u WHERE unit % 3 = notebook) AS units_read, (SELECT count(*) FROM lost l WHERE l.notebook = b.notebook) AS threads_not_read FROM b""")
def a35_reading(spark, sf):
    threaded = ledgers.threaded(spark, sf)
    units = B.thread_units(threaded).select("unit").distinct()
    return B.board_reading(threaded, units.select((F.col("unit") % 3).cast("int").alias("notebook"), "unit"))


@LEDGERS.query("a36_shared_threads", "SELECT 't' || lpad(CAST(conv_id % 900 + 1 AS VARCHAR), 3, '0') AS thread, array_to_string(list(DISTINCT role ORDER BY role), ',') AS seats FROM conversations WHERE conv_id % 4 <> 1 GROUP BY ALL HAVING count(DISTINCT role) > 1")
def a36_shared(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select(F.when(F.col("conv_id") % 4 == 1, "closing").otherwise("reply").alias("kind"), F.concat(F.lit("t"), F.lpad((F.col("conv_id") % 900 + 1).cast("string"), 3, "0")).alias("thread"), F.col("role").alias("seat"))
    return B.shared_threads(rows).select("thread", F.array_join("seats", ",").alias("seats"))


# readers
def _memos(spark, sf):
    rows = readers.records(spark, sf).filter("l_partkey % 10 in (3, 5)")
    kind = F.when(F.col("l_partkey") % 10 == 3, "unfit").otherwise("field_note")
    signed = F.when(F.col("batch") % 3 == 0, "").otherwise(F.concat(F.lit("R"), (F.col("batch") % 3).cast("string")))
    return rows.select("by", "activity", kind.alias("memo_type"), (F.col("batch") % 2 == 1).alias("anchored"), signed.alias("signed"))


@READERS.query("a24_reader_memos", "SELECT lens, count(*) FILTER (l_partkey % 10 = 3) AS unfit, count(*) FILTER (l_partkey % 10 = 3 AND l_linenumber % 2 = 0) AS unfit_not_found, count(*) FILTER (l_partkey % 10 = 5) AS field_notes FROM good WHERE l_partkey % 10 IN (3, 5) GROUP BY lens")
def a24_memos(spark, sf):
    return C.reader_memos(_memos(spark, sf), readers.activities(spark, sf))


@READERS.query("a24_reader_signatures", "SELECT lens, CASE WHEN l_linenumber % 3 <> 0 THEN 'R' || CAST(l_linenumber % 3 AS VARCHAR) END AS signed, count(*) AS notes FROM good WHERE l_partkey % 10 = 5 GROUP BY ALL")
def a24_signatures(spark, sf):
    return C.reader_signatures(_memos(spark, sf), readers.activities(spark, sf))


@READERS.query("a24_reader_failures", "SELECT c.lens, code AS reason, count(*) AS failures FROM codings c JOIN acts a ON a.id = c.activity WHERE c.lost GROUP BY ALL")
def a24_failures(spark, sf):
    return C.reader_failures(readers.records(spark, sf).filter("lost").withColumnRenamed("code", "reason"), readers.activities(spark, sf))


@READERS.query("a40_unit_quotes", """, grid AS (SELECT a.unit, a.code, r.lens FROM applied a JOIN readings r USING (unit) WHERE n < readers),
q AS (SELECT unit, code, lens, string_agg('q' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR), ',' ORDER BY 'q' || CAST(l_partkey AS VARCHAR), l_linenumber) AS quotes FROM marks GROUP BY ALL),
g AS (SELECT unit, code, lens, string_agg('q' || CAST(l_partkey AS VARCHAR), ',' ORDER BY 'q' || CAST(l_partkey AS VARCHAR)) AS lost FROM gone GROUP BY ALL)
SELECT unit, code, lens, coalesce(quotes, '') AS quotes, coalesce(lost, '') AS lost FROM grid LEFT JOIN q USING (unit, code, lens) LEFT JOIN g USING (unit, code, lens)""")
def a40_quotes(spark, sf):
    said = F.concat(F.lit("q"), F.col("l_partkey").cast("string"))
    marks = readers.marks(spark, sf).select("unit", "code", "by", said.alias("exact"), F.col("batch").cast("string").alias("note"))
    lost = readers.lost(spark, sf).select("unit", "code", "by", said.alias("quote"))
    out = C.unit_quotes(readers.read(spark, sf), marks, lost)
    return out.select("unit", "code", "lens", F.array_join(F.transform("quotes", lambda q: F.concat_ws("/", q["exact"], q["note"])), ",").alias("quotes"), F.array_join("lost", ",").alias("lost"))


# words
@WORDS.query("w11_numbered_uses", r"""SELECT row_number() OVER (ORDER BY time, unit, use) AS n, unit, CAST(use AS BIGINT) AS use FROM (SELECT unit, time, unnest(range(len(m))) AS use FROM (SELECT unit, time, regexp_extract_all(wide, '(?i)[^A-Za-z0-9]with[^A-Za-z0-9]') AS m FROM units))""")
def w11_numbers(spark, sf):
    return L.concordance(words.units(spark, sf), r"(?iu)(?<![A-Za-z0-9])with(?![A-Za-z0-9])").select("n", "unit", F.col("use").cast("long").alias("use"))


@WORDS.query("w11_contexts", """SELECT unit, "left", said, "right" FROM (SELECT unit, 'with' AS said, p, trim(regexp_replace(substr(text, greatest(p - 20, 1), p - greatest(p - 20, 1)), '\\s+', ' ', 'g')) AS "left", trim(regexp_replace(substr(text, p + 4, 20), '\\s+', ' ', 'g')) AS "right"
  FROM (SELECT unit, text, strpos(text, 'with') AS p FROM (SELECT unit, regexp_replace(text, '[^ -~]', '.', 'g') AS text FROM units)) WHERE p > 0)""")
def w11_contexts(spark, sf):
    rows = words.units(spark, sf).withColumn("text", F.regexp_replace("text", r"[^ -~]", "."))
    return L.concordance(rows, "with", 20).filter("use = 0").select("unit", "left", "said", "right")


SNIPPET = r"""SELECT doc_id AS unit, regexp_replace(CASE WHEN low > 0 AND substr(t, CAST(low AS INT), 1) <> ' ' THEN regexp_replace(substr(t, CAST(low + 1 AS INT), CAST(s - low AS INT)), '^[^ ]*', '') ELSE substr(t, CAST(low + 1 AS INT), CAST(s - low AS INT)) END, '^ +', '') || 'with'
  || regexp_replace(CASE WHEN high < length(t) AND substr(t, CAST(high + 1 AS INT), 1) <> ' ' THEN regexp_replace(substr(t, CAST(s + 5 AS INT), CAST(high - s - 4 AS INT)), '[^ ]*$', '') ELSE substr(t, CAST(s + 5 AS INT), CAST(high - s - 4 AS INT)) END, ' +$', '') AS said
FROM (SELECT *, greatest(0, s - (36 - (high - s - 4))) AS low FROM (SELECT *, least(length(t), s + 4 + 36 - (s - greatest(0, s - 18))) AS high FROM (SELECT doc_id, t, strpos(t, 'with') - 1 AS s FROM (SELECT doc_id, regexp_replace(text, '[^!-~]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)) WHERE s >= 0))"""


@PLANS.query("p12_snippet_words", SNIPPET)
def p12_words(spark, sf):
    t = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", "[^!-~]", " ").alias("t"))
    at = F.instr("t", "with") - 1
    return t.filter(at >= 0).select(F.col("doc_id").alias("unit"), T.snippet_words(F.col("t"), at, at + 4, 40).alias("said"))


# answers
def _replies(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    body = F.concat(F.lit('{"n": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang", F.lit('", "items": ['), (F.col("doc_id") % 3).cast("string"), F.lit(", 2.0]}"))
    fence = F.lit("`" * 3)
    kind = F.col("doc_id") % 6
    reply = (
        F.when(kind == 0, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(kind == 1, F.concat(F.lit("Here it is:\n"), fence, F.lit("JSON x\n"), body, F.lit("\n"), fence, F.lit("\nDone.")))
        .when(kind == 2, F.concat(fence, F.lit("\n"), body, F.lit("\n"), fence, F.lit("\n"), fence, F.lit("\n{}\n"), fence))
        .when(kind == 3, F.concat(F.lit("I found "), body))
        .when(kind == 4, F.lit('{"n": NaN}'))
        .otherwise(F.lit("[1, 2]"))
    )
    return d.select("doc_id", body.alias("body"), reply.alias("reply"))


BODY = """'{"n": ' || doc_id || ', "lang": "' || lang || '", "items": [' || doc_id % 3 || ', 2.0]}'"""


@PLANS.query("f7_parse_answer", f"SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN {BODY} END AS answer FROM documents")
def f7(spark, sf):
    return _replies(spark, sf).select("doc_id", FA.parse_answer(F.col("reply")).alias("answer"))


@PLANS.query("f8_validate_answer", """SELECT doc_id, concat_ws('; ', CASE WHEN lang <> 'en' THEN '$.lang: not one of the allowed values' END, CASE WHEN doc_id % 3 = 1 THEN '$.items[0]: not one of the allowed values' END) AS problems FROM documents""")
def f8(spark, sf):
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "lang": {"enum": ["en"]}, "items": {"type": "array", "items": {"type": "integer", "enum": [0, 2]}}}, "additionalProperties": False}
    return _replies(spark, sf).select("doc_id", F.array_join(FA.validate_answer(F.col("body"), schema), "; ").alias("problems"))


@PLANS.query("f6_quotations", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || ' said these words' ELSE '' END AS said FROM conversations""")
def f6(spark, sf):
    c = table(spark, sf, "conversations")
    own = F.concat("role", F.lit(" said these words"))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("It's true: “"), own, F.lit('”, and "too short".'))).otherwise(F.concat(own, F.lit(", don't you think it's so")))
    return c.select("conv_id", "turn", F.array_join(FA.quotations(text), "|").alias("said"))


@PLANS.query("f11_reader_name", """SELECT s_suppkey AS lens, 'm' || s_suppkey % 4 || CASE WHEN s_suppkey % 3 > 0 THEN ' (f' || s_suppkey % 3 || ')' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN ', answering in place of m9' ELSE '' END || CASE WHEN s_suppkey % 7 = 0 THEN ', no frame' ELSE '' END AS label FROM supplier""")
def f11(spark, sf):
    k = F.col("s_suppkey")
    some = lambda on, *parts: F.when(on, F.concat(*parts))
    rows = table(spark, sf, "supplier").select(k.alias("lens"), F.concat(F.lit("m"), (k % 4).cast("string")).alias("model"), some(k % 3 > 0, F.lit("f"), (k % 3).cast("string")).alias("family"), some(k % 5 == 0, F.lit("m9")).alias("requested"), (k % 7 != 0).alias("framed"))
    return AN.reader_name(rows)


@PLANS.query("p9_run_lenses", "SELECT s_suppkey AS lens FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_nationkey % 4 <> 1")
def p9(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    reader = F.struct(F.when(k % 2 == 0, "book").otherwise("other").alias("codebook"))
    method = F.struct(F.when(k % 3 == 0, "open-coding").otherwise("focused-coding").alias("name"), F.lit("1").alias("version"), F.when(n % 4 == 1, F.array(F.lit("in_vivo"))).otherwise(F.array(F.lit("analytic"))).alias("code_types"))
    return AN.run_lenses(table(spark, sf, "supplier").select(k.alias("lens"), reader.alias("reader"), method.alias("method")), "book").select("lens")


@PLANS.query("p11_codebook_codes", "SELECT CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) - 1 AS INT) AS place, 'c' || p_partkey AS id, 'k' || p_partkey AS key FROM part")
def p11(spark, sf):
    p = table(spark, sf, "part")
    about = F.transform(F.sort_array(F.collect_list("p_partkey"), asc=False), lambda k: F.concat(F.lit("c"), k.cast("string")))
    return AN.codebook_codes(p.groupBy("p_size").agg(about.alias("about")), p.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key")))


LANDED = """WITH a AS (SELECT l_orderkey AS batch, l_linenumber - 1 AS place, l_partkey % 4 AS unit, l_suppkey % 5 AS code, l_partkey % 3 AS q FROM lineitem)"""


def _answers(spark, sf):
    """A batch an order; units u0 to u2 are shown, u3 is not; codes k0 to k3 are known; quotation 2 is in no unit."""
    li = table(spark, sf, "lineitem")
    quote = F.when(F.col("l_partkey") % 3 == 0, "a first saying").when(F.col("l_partkey") % 3 == 1, "a  second\tsaying").otherwise("no such words")
    one = F.struct(F.col("l_linenumber"), F.struct(F.concat(F.lit("u"), (F.col("l_partkey") % 4).cast("string")).alias("unit"), F.concat(F.lit("k"), (F.col("l_suppkey") % 5).cast("string")).alias("code"), quote.alias("quote"), F.lit("").alias("note")).alias("c"))
    rows = li.groupBy(F.col("l_orderkey").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("codings"))
    rows = rows.withColumn("unfit", F.array().cast("array<struct<unit:string,quote:string,why:string,suggested_name:string>>"))
    rows = rows.withColumn("field_note", F.when(F.col("batch") % 2 == 0, " ").otherwise("seen")).withColumn("signed", F.when(F.col("batch") % 3 == 0, " me ").otherwise(""))
    shown = rows.select("batch", F.explode(F.array(*[F.struct(F.lit(f"u{i}").alias("unit"), (F.col("batch") * 10 + i).alias("unit_id")) for i in range(3)])).alias("u")).select("batch", "u.*")
    units = shown.select(F.col("unit_id").alias("unit"), F.concat("unit", F.lit(" has a first saying and a second saying")).alias("text"), F.lit(5).cast("long").alias("start"))
    codes = table(spark, sf, "nation").filter("n_nationkey < 4").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_nationkey").alias("code_id"))
    return rows, shown, codes, units


@PLANS.query("j2_land_answers", LANDED + """SELECT batch, batch * 10 + unit AS unit_id, code AS code_id, CASE WHEN q = 0 THEN 12 ELSE 31 END::BIGINT AS "start", CASE WHEN q = 0 THEN 'exact' ELSE 'ws-normalized' END AS match, count(*) AS n FROM a WHERE unit < 3 AND code < 4 AND q < 2 GROUP BY ALL""")
def j2(spark, sf):
    return AN.land_answers(*_answers(spark, sf))["codings"].groupBy("batch", "unit_id", "code_id", "start", "match").agg(F.count("*").alias("n"))


@PLANS.query("j2_failures", LANDED + "SELECT batch, CASE WHEN unit = 3 THEN 'unknown unit' WHEN code = 4 THEN 'unknown code' ELSE 'quotation not found in the unit' END AS reason, count(*) AS n FROM a WHERE unit = 3 OR code = 4 OR q = 2 GROUP BY ALL")
def j2_failures(spark, sf):
    return AN.land_answers(*_answers(spark, sf))["failures"].groupBy("batch", "reason").agg(F.count("*").alias("n"))


@PLANS.query("j2_notes", "SELECT l_orderkey AS batch, 'seen' AS body, CASE WHEN l_orderkey % 3 = 0 THEN 'me' END AS signed FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey % 2 = 1")
def j2_notes(spark, sf):
    return AN.land_answers(*_answers(spark, sf))["notes"]


@PLANS.query("j3_land_open_codes", LANDED + "SELECT batch, 'code ' || code AS name, CASE WHEN code < 2 THEN 'in_vivo' ELSE 'analytic' END AS code_type, CASE WHEN code < 2 THEN false END AS in_vivo_in_unit, count(*) AS n FROM a WHERE unit < 3 AND q < 2 GROUP BY ALL")
def j3(spark, sf):
    rows, shown, _, units = _answers(spark, sf)
    kind = lambda c: F.when(c["code"].isin("k0", "k1"), "in_vivo").otherwise("analytic")
    item = lambda c: F.struct(c["unit"].alias("unit"), c["quote"].alias("quote"), F.concat(F.lit(" code\t"), F.right(c["code"], F.lit(1))).alias("code"), kind(c).alias("code_type"), F.lit("").alias("definition"), F.lit("").alias("note"))
    landed = AN.land_open_codes(rows.select("batch", F.transform("codings", item).alias("codings")), shown, units)
    return landed["codings"].groupBy("batch", "name", "code_type", "in_vivo_in_unit").agg(F.count("*").alias("n"))


@PLANS.query("j16_land_board_answers", """SELECT conv_id AS reader, kind, count(*) AS messages FROM (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'reply' ELSE 'request' END AS kind FROM conversations WHERE turn % 3 <> 2 UNION ALL SELECT DISTINCT conv_id, 'closing' FROM conversations WHERE conv_id % 2 = 0) GROUP BY ALL""")
def j16(spark, sf):
    return AN.land_board_answers(*_board(spark, sf))["messages"].groupBy("reader", "kind").agg(F.count("*").alias("messages"))


def _board(spark, sf):
    """Even turns reply, odd ones ask; every third names a thread that is not there; even conversations close."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("reader"), "turn", F.when(F.col("turn") % 3 == 2, "t999").when(F.col("turn") % 3 == 1, "t001").otherwise(F.when(F.col("turn") % 2 == 0, "board").otherwise("t001")).alias("thread"))
    said = F.lit('I read "words that nobody was shown" here')
    reply = F.when(F.col("turn") % 2 == 0, F.struct("turn", F.struct("thread", F.lit("").alias("to"), said.alias("message")).alias("r")))
    ask = F.when(F.col("turn") % 2 == 1, F.struct("turn", F.struct("thread", F.lit("why").alias("why")).alias("r")))
    rows = c.groupBy("reader").agg(F.transform(F.array_sort(F.collect_list(reply)), lambda x: x["r"]).alias("replies"), F.transform(F.array_sort(F.collect_list(ask)), lambda x: x["r"]).alias("look_again"))
    answers = rows.select("*", F.when(F.col("reader") % 2 == 0, "bye").otherwise(" ").alias("closing"), F.lit("").alias("signed"))
    threads = table(spark, sf, "region").select(F.concat(F.lit("t00"), F.col("r_regionkey").cast("string")).alias("thread"))
    return answers, threads, answers.select("reader", F.lit("some other text").alias("text"))


@PLANS.query("j16_failures", "SELECT conv_id AS reader, CASE WHEN turn % 2 = 0 THEN 'reply' ELSE 'request' END AS kind, count(*) AS n FROM conversations WHERE turn % 3 = 2 GROUP BY ALL")
def j16_failures(spark, sf):
    return AN.land_board_answers(*_board(spark, sf))["failures"].groupBy("reader", "kind").agg(F.count("*").alias("n"))


@PLANS.query("j13_quotes_not_shown", "SELECT conv_id AS reader, 'words that nobody was shown' AS passage, count(*) AS n FROM conversations WHERE turn % 2 = 0 AND turn % 3 <> 2 GROUP BY conv_id")
def j13(spark, sf):
    return AN.land_board_answers(*_board(spark, sf))["lost"].groupBy("reader", "passage").agg(F.count("*").alias("n"))


@PLANS.query("j20_land_codebook", "SELECT place, 'accepted' AS outcome, CAST(merges AS VARCHAR) AS said FROM (SELECT p_partkey AS place, 2 AS merges, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) WHERE r = 1 UNION ALL SELECT p_partkey, 'refused', CASE WHEN p_partkey % 7 = 0 THEN 'no key or name' ELSE 'no known name' END FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 UNION ALL SELECT place, 'refused', 'repeated key' FROM (SELECT p_partkey AS place, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0) WHERE r > 1")
def j20(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    merged = F.when(k % 5 == 0, F.array(F.lit("unknown"))).otherwise(F.array(name(k), F.lit("unknown")))
    proposed = p.select(k.alias("place"), F.concat(F.lit(" Key\t"), F.col("p_size").cast("string")).alias("key"), F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), merged.alias("merged"))
    names = p.select(name(k).alias("id"), F.array(name(k), name(k + 1), name(k)).alias("code_ids"))
    out = AN.land_codebook(proposed, names)
    done = out["codes"].select("place", F.lit("accepted").alias("outcome"), F.size("merges").cast("string").alias("said"))
    return done.unionByName(out["refused"].select("place", F.lit("refused").alias("outcome"), F.col("reason").alias("said")))


@PLANS.query("j14_evidence_check", "SELECT conv_id AS reading, turn AS id, CASE WHEN turn % 4 = 3 THEN 'no such record was shown' ELSE 'not in that record' END AS reason FROM conversations WHERE turn % 4 = 3 OR turn % 4 = 1")
def j14(spark, sf):
    c = table(spark, sf, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    quote = F.when(F.col("turn") % 4 == 1, "§ never said").otherwise(F.left("text", F.lit(5)))
    out = A.evidence_check(c.select(F.struct("conv_id", "turn").alias("reading"), key.alias("id"), quote.alias("quote")), c.filter("turn % 4 <> 3").select(key.alias("id"), "text"))
    return out.select("reading.conv_id", "reading.turn", "reason").select(F.col("conv_id").alias("reading"), F.col("turn").alias("id"), "reason")


@READERS.query("j18_side_by_side", """, s AS (SELECT o_orderkey AS unit FROM orders WHERE o_orderkey % 3 = 0)
SELECT s.unit, (SELECT count(*) FROM marks m WHERE m.unit = s.unit) AS codings, (SELECT count(*) FROM gone g WHERE g.unit = s.unit) AS lost, coalesce((SELECT string_agg(CAST(lens AS VARCHAR), ',' ORDER BY lens) FROM readings r WHERE r.unit = s.unit), '') AS readers FROM s""")
def j18(spark, sf):
    sample = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("unit"))
    said = F.col("l_partkey").cast("string")
    marks = readers.marks(spark, sf).select("unit", F.col("by").alias("lens"), F.col("batch").alias("start"), "code", said.alias("exact"), F.lit("").alias("note"))
    lost = readers.lost(spark, sf).select("unit", F.col("by").alias("lens"), "code", said.alias("quote"))
    hits = marks.select("unit", F.col("code").alias("term"))
    out = S.side_by_side(sample, marks, lost, readers.read(spark, sf), hits)
    return out.select("unit", F.size("codings").cast("long").alias("codings"), F.size("lost").cast("long").alias("lost"), F.array_join(F.transform("readers", lambda x: x.cast("string")), ",").alias("readers"))


@READERS.query("a25_sample_readers", """, s AS (SELECT o_orderkey AS unit FROM orders WHERE o_orderkey % 3 = 0), c AS (SELECT lens, count(*) AS codings, count(*) FILTER (l_partkey % 2 = 1) AS ws_normalized, count(*) FILTER (l_partkey % 5 = 0) AS in_vivo, count(*) FILTER (l_partkey % 10 = 0) AS in_vivo_absent, count(*) FILTER (l_linenumber = 1) AS loaded FROM marks WHERE unit IN (FROM s) GROUP BY lens),
b AS (SELECT lens, count(*) AS batches, count(*) FILTER (NOT ok) AS failed, CAST(sum(unit % 100) AS BIGINT) AS tokens_in, CAST(sum(7) AS BIGINT) AS tokens_out FROM acts WHERE unit IN (FROM s) OR unit + 1 IN (FROM s) GROUP BY lens)
SELECT lens, codings, ws_normalized, in_vivo, in_vivo_absent, loaded, batches, failed, tokens_in, tokens_out FROM c FULL JOIN b USING (lens)""")
def a25(spark, sf):
    sample = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("unit"))
    p = F.col("l_partkey")
    marks = readers.marks(spark, sf).select("unit", "by", F.when(p % 2 == 1, "ws-normalized").otherwise("exact").alias("match"), F.when(p % 5 == 0, "in_vivo").otherwise("analytic").alias("code_type"), F.when(p % 5 == 0, p % 10 != 0).alias("in_vivo_in_unit"), F.when(F.col("batch") == 1, "  Loaded: so").otherwise("plain").alias("note"))
    acts = readers.activities(spark, sf).withColumn("tokens_in", F.get("used", 0) % 100).withColumn("tokens_out", F.lit(7))
    return S.sample_readers(sample, marks, acts)


@READERS.query("a38_theory_readings", """SELECT code AS framework, count(*) AS attempts, count(*) FILTER (ok) AS finished, count(*) FILTER (ok AND l_linenumber <= 2) AS published FROM codings c JOIN acts a ON a.id = c.activity GROUP BY code""")
def a38(spark, sf):
    key = F.concat_ws(":", F.col("activity").cast("string"), F.col("batch").cast("string"))
    rows = readers.records(spark, sf).join(readers.activities(spark, sf).select(F.col("id").alias("a"), "status"), F.col("activity") == F.col("a"))
    tried = rows.select(key.alias("activity"), F.col("code").alias("framework"), F.col("by").alias("lens"), "status")
    memos = rows.filter("batch <= 2 or batch = 4").select(key.alias("activity"), F.col("code").alias("framework"), F.when(F.col("batch") == 4, 99).otherwise(F.col("by")).alias("by"))
    return AN.theory_readings(tried, memos)


@PLANS.query("j19_claim_evidence", """SELECT doc_id AS claim, CASE WHEN doc_id % 3 = 0 THEN 'anchor' WHEN doc_id % 3 = 1 THEN 'unit' ELSE 'other' END AS kind, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 WHEN doc_id % 3 = 1 THEN true END AS ok FROM documents WHERE text IS NOT NULL AND length(text) >= 8""")
def j19(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null and length(text) >= 8")
    n = F.octet_length(F.left("text", F.lit(8))).cast("long")
    exact = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(8))).otherwise("other words")
    anchor = F.when(F.col("doc_id") % 3 == 0, F.struct(F.col("doc_id").alias("source"), F.lit(0).cast("long").alias("start"), n.alias("end"), exact.alias("exact")))
    refs = d.select(F.col("doc_id").alias("claim"), F.lit("for").alias("side"), F.lit(0).alias("place"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("u"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 2, "nothing").otherwise("inline").alias("ref"), anchor.alias("anchor"))
    units = d.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("source"), F.lit(0).cast("long").alias("start"), n.alias("end"), F.left("text", F.lit(8)).alias("text"))
    none = units.limit(0).withColumnRenamed("text", "exact")
    return S.claim_evidence(refs, none, units, d.select(F.col("doc_id").alias("source"), F.encode("text", "utf-8").alias("content"))).select("claim", "kind", "ok")


@WORDS.query("w13_pick_passages", "SELECT event_type AS term, count(*) AS picked FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 4 GROUP BY event_type")
def w13(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("term"), F.col("event_id").alias("unit"), "ts", F.concat(F.lit("passage "), F.col("event_id").cast("string")).alias("passage"))
    return S.pick_passages(e, 4).groupBy("term").agg(F.count("*").alias("picked"))


for _plans in (READERS, NAMED, SPANS, LEDGERS, WORDS):
    PLANS.queries |= _plans.queries
    PLANS.sql |= _plans.sql
