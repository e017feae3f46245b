"""Notes, samples and ledger checks over conversations, documents, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board as B
from ..operators import checks as V
from ..operators import sampling as S
from ..sources import ledger as L
from .tables import Plans, table

PLANS = Plans(r"""
notes AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS notebook, turn AS since, conv_id % 40 AS u1, turn // 2 AS u2, text AS body, CASE WHEN conv_id % 3 = 0 THEN 'R' || role ELSE '' END AS signed FROM conversations),
made AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM (SELECT u1, u2, min((notebook, since, id)) AS first FROM notes GROUP BY u1, u2)),
threaded AS (SELECT notes.*, 't' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS thread, row_number() OVER (PARTITION BY u1, u2, notebook ORDER BY since, id) = 1 AS stands FROM notes JOIN made USING (u1, u2)),
pool AS (SELECT doc_id AS unit, CASE WHEN lang = 'en' THEN 'post' ELSE 'text' END AS unit_kind, n_chars, source AS grp, coalesce(text, 'unit ' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
placed AS (SELECT unit, row_number() OVER (ORDER BY sha256('7:' || CAST(unit AS VARCHAR))) - 1 AS place FROM pool)
""")


def notes(spark, sf):
    c = table(spark, sf, "conversations")
    signed = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("R"), "role")).otherwise("")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("notebook"), F.col("turn").alias("at"), F.array(F.col("conv_id") % 40, F.floor(F.col("turn") / 2)).alias("about"), F.col("text").alias("body"), signed.alias("signed"), F.col("role").alias("lens"))


def threaded(spark, sf):
    return B.threads(notes(spark, sf))


@PLANS.query("w9_threads", "SELECT id, notebook, thread, stands FROM threaded")
def w9(spark, sf):
    return threaded(spark, sf).select("id", "notebook", "thread", "stands")


@PLANS.query("j15_thread_units", "SELECT DISTINCT thread, unnest([1, 2]) AS place, unnest([u1, u2]) AS unit FROM threaded")
def j15(spark, sf):
    return B.thread_units(threaded(spark, sf))


@PLANS.query("w9_unread_threads", "SELECT DISTINCT t.thread, b.notebook FROM threaded t, (SELECT unnest([0, 1]) AS notebook) b WHERE NOT EXISTS (SELECT 1 FROM threaded x WHERE x.thread = t.thread AND x.notebook = b.notebook) AND (t.u1 % 3 <> b.notebook OR t.u2 % 3 <> b.notebook)")
def w9_unread(spark, sf):
    units = B.thread_units(threaded(spark, sf)).select("unit").distinct()
    read = units.select((F.col("unit") % 3).cast("int").alias("notebook"), "unit")
    return B.unread_threads(threaded(spark, sf), read)


@PLANS.query("a35_board_report", """SELECT notebook, count(*) FILTER (stands) AS notes, CAST(coalesce(sum(length(body)) FILTER (stands), 0) AS BIGINT) AS characters, count(*) FILTER (stands AND signed <> '') AS signed,
 (SELECT count(DISTINCT thread) FROM threaded) - count(*) FILTER (stands) AS without_note, count(*) FILTER (stands AND thread NOT IN (SELECT thread FROM threaded WHERE notebook = 0)) AS stray, count(*) FILTER (NOT stands) AS set_aside FROM threaded GROUP BY notebook""")
def a35(spark, sf):
    return B.board_report(threaded(spark, sf))


@PLANS.query("a33_field_notes_by_reader", """SELECT role AS lens, count(*) AS notes, count(*) FILTER (conv_id % 3 = 0) AS signed, count(DISTINCT CASE WHEN conv_id % 3 = 0 THEN role END) AS signatures, CAST(sum(length(text)) AS BIGINT) AS characters,
 array_to_string(list(conv_id * 1000 + turn ORDER BY length(text) DESC, conv_id * 1000 + turn)[1:2], ',') AS longest FROM conversations GROUP BY role""")
def a33(spark, sf):
    return B.field_notes_by_reader(notes(spark, sf))


@PLANS.query("a34_note_lenses", "SELECT role AS lens, count(*) AS notes, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY role")
def a34(spark, sf):
    return B.note_lenses(notes(spark, sf))


def _answers(spark, sf):
    """Fifty events are a round, so that rounds grow with the table; of the three seats some answer several times, some not
    at all."""
    e = table(spark, sf, "events")
    return e.select(F.floor(F.col("event_id") / 50).alias("round"), (F.col("user_id") % 3).alias("seat"), F.col("event_id").cast("string").alias("activity"), F.when((F.col("event_type") == "error") | (F.col("event_id") % 17 > 0), "failed").otherwise("ok").alias("status"))


ROUNDS = """, r AS (SELECT event_id // 50 AS round, user_id % 3 AS seat, CAST(event_id AS VARCHAR) AS activity, event_type <> 'error' AND event_id % 17 = 0 AS ok FROM events), n AS (SELECT round, seat, count(*) AS n, min(activity) AS activity FROM r WHERE ok GROUP BY ALL)"""


@PLANS.query("a36_round_status", ROUNDS + """ SELECT round, CAST(sum(n) AS BIGINT) AS answers, CAST(3 AS BIGINT) AS seats, sum(n) = 3 AND count(*) FILTER (n = 1) = 3 AS complete FROM n GROUP BY round""")
def a36(spark, sf):
    seats = table(spark, sf, "events").select((F.col("user_id") % 3).alias("seat")).distinct()
    return B.round_status(_answers(spark, sf), seats)


@PLANS.query("j17_round_answers", ROUNDS + """ SELECT g.round, s.seat, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN activity END AS activity, CASE WHEN n IS NULL THEN 'no finished answer' WHEN n > 1 THEN 'several finished answers' END AS problem
FROM (SELECT DISTINCT round FROM r) g, (SELECT DISTINCT seat FROM r) s LEFT JOIN n ON n.round = g.round AND n.seat = s.seat""")
def j17(spark, sf):
    answers = _answers(spark, sf)
    return B.refused_rounds(answers, answers.select("seat").distinct())


@PLANS.query("u5_later_round_threads", """, m AS (SELECT conv_id, turn, role FROM conversations) SELECT DISTINCT thread FROM threaded WHERE thread IN (SELECT 't' || lpad(CAST(conv_id % 900 + 1 AS VARCHAR), 3, '0') FROM m WHERE conv_id % 4 = 1 UNION ALL SELECT 't' || lpad(CAST(turn * 7 + 1 AS VARCHAR), 3, '0') FROM m WHERE conv_id % 4 = 2)""")
def u5(spark, sf):
    c = table(spark, sf, "conversations")
    thread = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("t"), F.lpad((F.col("conv_id") % 900 + 1).cast("string"), 3, "0")))
    body = F.when(F.col("conv_id") % 4 == 2, F.concat(F.lit("see t"), F.lpad((F.col("turn") * 7 + 1).cast("string"), 3, "0"), F.lit(".")))
    rows = c.select(F.when(thread.isNotNull(), "reply").otherwise("closing").alias("kind"), thread.alias("thread"), body.alias("body"))
    return B.later_round_threads(rows, threaded(spark, sf).select("thread").distinct())


@PLANS.query("u5_silent_seats", "SELECT DISTINCT conv_id AS round, role AS seat FROM conversations WHERE (conv_id, role) NOT IN (SELECT conv_id, role FROM conversations WHERE length(text) > 300)")
def u5_silent(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("round"), F.col("role").alias("seat"), "text")
    return B.silent_seats(c, c.filter(F.length("text") > 300))


def pool(spark, sf):
    d = table(spark, sf, "documents")
    time = F.concat(F.lit("2026-06-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    return d.select(F.col("doc_id").alias("unit"), F.when(F.col("lang") == "en", "post").otherwise("text").alias("unit_kind"), F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), time.alias("time"), F.col("source").alias("group"), F.col("text").alias("text_key"))


@PLANS.query("p8_in_stratum", "SELECT doc_id AS unit FROM documents WHERE lang = 'en' AND n_chars >= 500 AND doc_id % 28 + 1 BETWEEN 5 AND 19")
def p8(spark, sf):
    return pool(spark, sf).filter(S.in_stratum({"unit_kind": "post", "min_bytes": 500, "from": "2026-06-05", "before": "2026-06-20"})).select("unit")


STRATUM = """{name}p AS (SELECT * FROM (SELECT *, sha256('{seed}:' || CAST(unit AS VARCHAR)) AS o, row_number() OVER (PARTITION BY k ORDER BY sha256('{seed}:' || CAST(unit AS VARCHAR))) AS f FROM pool WHERE {where}) WHERE f = 1),
{name} AS (SELECT unit, k FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o) AS turn FROM {name}p) ORDER BY turn, sha256('{seed}:' || grp), o LIMIT 40)"""


@PLANS.query("w7_stratified_sample", ", " + STRATUM.format(name="a", seed="5:long", where="unit_kind = 'post' AND n_chars >= 1000") + ", " + STRATUM.format(name="b", seed="5:any", where="unit_kind = 'post' AND n_chars >= 0 AND k NOT IN (SELECT k FROM a)") + " SELECT 'long' AS stratum, unit FROM a UNION ALL SELECT 'any', unit FROM b")
def w7(spark, sf):
    strata = [{"label": "long", "unit_kind": "post", "min_bytes": 1000, "n": 40}, {"label": "any", "unit_kind": "post", "n": 40}]
    return S.stratified_sample(pool(spark, sf), strata, 5)


@PLANS.query("w8_deal_batches", "SELECT unit, place // 25 AS batch, place FROM placed")
def w8(spark, sf):
    return S.deal_batches(pool(spark, sf), 7, 25)


@PLANS.query("r4_resume", "SELECT unit, place // 25 AS batch, place FROM placed WHERE unit % 3 <> 0")
def r4(spark, sf):
    return S.unread_batches(S.deal_batches(pool(spark, sf), 7, 25), pool(spark, sf).filter("unit % 3 = 0"))


@PLANS.query("p13_units_of", "SELECT source AS sample, doc_id AS unit FROM documents")
def p13(spark, sf):
    samples = table(spark, sf, "documents").groupBy(F.col("source").alias("sample"), F.floor(F.col("doc_id") / 100)).agg(F.sort_array(F.collect_list("doc_id")).alias("about"))
    return S.units_of(samples).select("sample", "unit")


@PLANS.query("s2_ledger_conflicts", "SELECT user_id AS id, 'id appears twice in the ledger with different content' AS reason FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def s2(spark, sf):
    return V.ledger_conflicts(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("body")))


@PLANS.query("s1_first_written", "SELECT user_id AS id, min(event_id) AS event_id FROM events GROUP BY user_id")
def s1(spark, sf):
    return L.first_written(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_id")).select("id", "event_id")


@PLANS.query("s6_append_records", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def s6(spark, sf):
    have = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("id"))
    return L.append_records(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")), have, "unit")


@PLANS.query("v1_check_identity", "SELECT doc_id AS id, 'record id does not match its content' AS reason FROM documents WHERE doc_id % 11 = 4")
def v1(spark, sf):
    d = table(spark, sf, "documents")
    return V.check_identity(d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 == 4, 0 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("expected")))


@PLANS.query("v2_check_envelope", """, r AS (SELECT event_id AS id, event_type = 'error' AS lens, user_id AS by_, user_id * 10 + event_id % 3 AS act FROM events),
a AS (SELECT DISTINCT user_id * 10 + x AS act, CASE WHEN user_id % 13 = 0 THEN user_id + 1 ELSE user_id END AS its FROM events, (SELECT unnest([0, 1]) AS x))
SELECT id, 'author is not a known lens: ' || CAST(by_ AS VARCHAR) AS reason FROM r WHERE by_ % 10 = 7
UNION ALL SELECT id, 'activity never recorded: ' || CAST(act AS VARCHAR) FROM r WHERE NOT lens AND act NOT IN (SELECT act FROM a)
UNION ALL SELECT id, 'author differs from the lens of its activity' FROM r JOIN a USING (act) WHERE NOT lens AND its <> by_""")
def v2(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "lens").otherwise("coding").alias("kind"), F.col("user_id").alias("by"), (F.col("user_id") * 10 + F.col("event_id") % 3).alias("activity"))
    users = e.select("user_id").distinct()
    acts = users.select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).select((F.col("user_id") * 10 + F.col("x")).alias("act"), F.when(F.col("user_id") % 13 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("lens"))
    return V.check_envelope(rows, users.filter("user_id % 10 <> 7").select(F.col("user_id").alias("lens")), acts)


@PLANS.query("v3_check_references", """SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'unit names an unknown record: ' || CAST(o_custkey * 2 AS VARCHAR) ELSE 'unit names a code, not a unit: ' || CAST(o_custkey * 2 AS VARCHAR) END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 WHERE c_custkey IS NULL OR c_nationkey % 4 = 0""")
def v3(spark, sf):
    refs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("coding").alias("kind"), F.lit("unit").alias("field"), (F.col("o_custkey") * 2).alias("ref"))
    recs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 4 == 0, "code").otherwise("unit").alias("kind"))
    return V.check_references(refs, recs)


@PLANS.query("v4_check_code_author", "SELECT l_orderkey AS id, 'code''s lens differs from its author' AS reason FROM lineitem WHERE l_suppkey % 5 <> l_partkey % 5")
def v4(spark, sf):
    return V.check_code_author(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 5).alias("lens"), (F.col("l_partkey") % 5).alias("by")))


@PLANS.query("v5_check_blobs", "SELECT doc_id AS id, CASE WHEN doc_id % 19 = 1 THEN 'source bytes missing' ELSE 'source bytes altered' END AS reason FROM documents WHERE doc_id % 19 IN (1, 2)")
def v5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode(F.concat(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), "utf-8").alias("content"))
    sources = d.select(F.col("doc_id").alias("id"), F.sha2("content", 256).alias("blob"))
    blobs = d.filter("doc_id % 19 <> 1").select(F.sha2("content", 256).alias("sha"), F.when(F.col("doc_id") % 19 == 2, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")).alias("content"))
    return V.check_blobs(sources, blobs)


@PLANS.query("v6_check_units", """SELECT doc_id AS id, CASE WHEN n > strlen(text) THEN 'unit span outside source' ELSE 'unit span splits a character' END AS reason
FROM (SELECT *, 100 + doc_id * 37 % 400 AS n FROM documents WHERE text IS NOT NULL) WHERE n > strlen(text) OR substr(hex(encode(text)), n * 2 + 1, 2) BETWEEN '80' AND 'BF'""")
def v6(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    units = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source"), F.lit(0).cast("long").alias("start"), (100 + F.col("doc_id") * 37 % 400).alias("end"))
    return V.check_units(units, d.select(F.col("doc_id").alias("source"), F.encode("text", "utf-8").alias("content")))


@PLANS.query("v8_check_claims", "SELECT user_id AS id, 'claim has no supporting evidence' AS reason FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value > 95) AS n FROM events GROUP BY user_id) WHERE n = 0")
def v8(spark, sf):
    e = table(spark, sf, "events")
    claims = e.groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.when((F.col("event_type") == "purchase") & (F.col("value") > 95), F.col("event_id"))).alias("supports"))
    return V.check_claims(claims)


@PLANS.query("v8_check_judgments", "SELECT event_id AS id, 'judgment not authored by a human lens' AS reason FROM events WHERE user_id % 4 <> 1")
def v8_judgments(spark, sf):
    e = table(spark, sf, "events")
    lenses = e.select(F.col("user_id").alias("lens"), F.when(F.col("user_id") % 4 == 1, "human").otherwise("model").alias("reader_kind")).distinct()
    return V.check_judgments(e.select(F.col("event_id").alias("id"), F.col("user_id").alias("by")), lenses)


@PLANS.query("v9_check_calls", "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN 'stored prompt does not match the recorded hash' ELSE 'stored response does not match the recorded hash' END AS reason FROM conversations WHERE turn < 2")
def v9(spark, sf):
    c = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    files = c.select(F.col("id").alias("act"), F.encode("role", "utf-8").alias("system"), F.encode("text", "utf-8").alias("user"), F.encode("text", "utf-8").alias("response"))
    prompt, answer = F.sha2(F.encode(F.concat("role", F.lit("\n\n"), "text"), "utf-8"), 256), F.sha2(F.encode("text", "utf-8"), 256)
    calls = c.select("id", F.when(F.col("turn") == 0, "x").otherwise(prompt).alias("prompt_sha256"), F.when(F.col("turn") == 1, "x").otherwise(answer).alias("response_sha256"))
    return V.check_calls(calls, files)


@PLANS.query("v10_ledger_digest", """, h AS (SELECT event_type AS kind, sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), props)) AS sha FROM events)
SELECT kind, count(*) AS records, sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(sha, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(sha, 16, 15) AS BIGINT)) AS VARCHAR)) AS digest FROM h GROUP BY kind""")
def v10(spark, sf):
    e = table(spark, sf, "events")
    return V.ledger_digest(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "props").withColumnRenamed("props", "body"))


@PLANS.query("v11_reconcile", "SELECT event_type AS name, event_type <> 'view' AS ok FROM events GROUP BY event_type")
def v11(spark, sf):
    e = table(spark, sf, "events")
    page = e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    recount = e.filter("event_type <> 'view' or event_id % 2 = 0").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return V.reconcile(page, recount).select("name", "ok")
