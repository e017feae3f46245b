"""Ledgers written from events and followed: files read in order, streams worked through, pages written."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import ledger as L
from ..sources.folders import open_store, shared_folder
from ..streaming import ledger as R
from ..streaming.tail import files_under
from .tables import Plans, table

PLANS = Plans()

RECORD = T.StructType([*L.ENVELOPE.fields, T.StructField("status", T.StringType()), T.StructField("term", T.StringType())])


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def _records(spark, sf):
    """An event as a record: its id comes again in three events, its activity is the user's."""
    e = table(spark, sf, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(F.floor(F.col("event_id") / 3).cast("string").alias("id"), F.lit("coding").alias("kind"), F.lit("1").alias("v"), at.alias("at"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("by"), F.col("user_id").cast("string").alias("activity"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("term"))


def _written(spark, sf) -> str:
    """The records as JSON lines, in order over the files of a folder."""
    path = _folder(spark)
    rows = _records(spark, sf).withColumn("n", F.col("term").cast("long"))
    rows.repartitionByRange(4, "n").sortWithinPartitions("n").select(F.to_json(F.struct(*RECORD.fieldNames())).alias("value")).write.text(path)
    return path


@PLANS.query("s1_read_ledger", "SELECT CAST(event_id // 3 AS VARCHAR) AS id, CAST(min(event_id) AS VARCHAR) AS term FROM events GROUP BY event_id // 3")
def s1(spark, sf):
    return L.read_ledger(spark, _written(spark, sf), RECORD).select("id", "term")


@PLANS.query("s3_bad_lines", "SELECT event_type AS status, CAST(1 AS BIGINT) AS skipped FROM events GROUP BY event_type HAVING count(*) > 0")
def s3(spark, sf):
    """A file for each type of event, each with half a record as its last line."""
    path = _folder(spark)
    rows = _records(spark, sf).select("status", F.lit(0).alias("last"), F.col("term").cast("long").alias("n"), F.to_json(F.struct(*RECORD.fieldNames())).alias("value"))
    ends = rows.groupBy("status").agg(F.lit(1).alias("last"), F.lit(0).cast("long").alias("n"), F.left(F.min("value"), F.lit(20)).alias("value"))
    rows.unionByName(ends).repartition("status").sortWithinPartitions("status", "last", "n").select("status", "value").write.partitionBy("status").text(f"{path}/x")
    types = [r.status for r in rows.select("status").distinct().collect()]  # event types are few
    return L.bad_lines(L.parsed(L.raw_lines(spark, [f"{path}/x/status={t}" for t in sorted(types)]), RECORD)).select(F.regexp_extract("path", "status=([^/]+)/", 1).alias("status"), F.col("skipped").cast("long").alias("skipped"))


@PLANS.query("s4_read_export", "SELECT doc_id AS page_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def s4(spark, sf):
    path = _folder(spark)
    table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body")).write.option("compression", "gzip").json(path)
    return L.read_export(spark, path, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("body", T.StringType())])).select("page_id", F.length("body").cast("long").alias("n"))


@PLANS.query("s7_write_page_data", "SELECT source AS page, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def s7(spark, sf):
    path = _folder(spark)
    L.write_page_data(table(spark, sf, "documents").select(F.col("source").alias("page"), "doc_id", "n_chars"), path, by="page")
    back = spark.read.schema("doc_id long, n_chars long, page string").json(path)
    return back.groupBy("page").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


def _streamed(spark, stream, mode="append"):
    path = _folder(spark)
    R.run_available(stream, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@PLANS.query("r1_tail_ledger", "SELECT DISTINCT CAST(event_id // 3 AS VARCHAR) AS id FROM events")
def r1(spark, sf):
    return _streamed(spark, R.tail_ledger(spark, _written(spark, sf), RECORD)).select("id")


@PLANS.query("r1_finished_lines", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS status FROM events")
def r1_lines(spark, sf):
    """A ledger of four files, each of which ends inside a line when it is first read; the lines are finished before it is read again."""
    path, out = _folder(spark), _folder(spark)
    rows = _records(spark, sf).withColumns({"id": F.col("term"), "n": F.col("term").cast("long")}).withColumn("file", F.col("n") % 4)
    last = rows.groupBy("file").agg(F.max("n").alias("last"))  # a row a file
    rows = rows.join(F.broadcast(last), "file").select("file", "n", "last", F.to_json(F.struct(*RECORD.fieldNames())).alias("line"))
    rows.filter("n < last").repartition(4, "file").sortWithinPartitions("file", "n").select("file", "line").write.partitionBy("file").text(path)
    ends = {r.file: r.line.encode() for r in rows.filter("n = last").collect()}  # four lines
    for part in (slice(None, 25), slice(25, None)):
        for name, _ in files_under(path):
            with open_store(path)[0].open_append_stream(name) as f:
                line = ends[int(re.search(r"file=(\d+)", name)[1])]
                f.write(line[part] + (b"" if part.stop else b"\n"))
        R.run_available(R.tail_ledger(spark, path, RECORD), f"{out}/out", f"{out}/mark")
    return spark.read.schema("id string, status string").parquet(f"{out}/out")


@PLANS.query("r2_finished_stream", "SELECT CAST(event_id AS VARCHAR) AS term FROM events WHERE user_id % 2 = 0 AND user_id % 7 < 5")
def r2(spark, sf):
    """Activities of even users ended 400 days after each of their records; authors 5 and 6 are not theirs."""
    written, schema = _copied(spark, _records(spark, sf)), _records(spark, sf).schema
    e, done = (spark.readStream.schema(schema).parquet(written) for _ in range(2))
    rows = e.select(F.col("term").alias("id"), F.concat_ws("-", "activity", "term").alias("activity"), "by", F.to_timestamp("at").alias("at_time"))
    lens = F.when(F.col("by").isin("u5", "u6"), "other").otherwise(F.col("by"))
    ended = (F.to_timestamp("at") + F.expr("interval 400 days")).alias("at_time")
    acts = done.filter("cast(activity as long) % 2 = 0").select(F.concat_ws("-", "activity", "term").alias("id"), lens.alias("lens"), F.lit("ok").alias("status"), F.lit("read").alias("type"), ended)
    return _streamed(spark, R.finished_stream(rows, acts).select(F.col("id").alias("term"))).select("term")


def _copied(spark, rows) -> str:
    path = _folder(spark)
    rows.write.parquet(path)
    return path


@PLANS.query("r3_daily_terms_stream", "SELECT event_type AS term, strftime(ts, '%Y-%m-%d') AS day, count(*) AS units FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY ALL")
def r3(spark, sf):
    """Days that the watermark has closed: all that end a day before the last event or earlier."""
    e = _records(spark, sf)
    stream = spark.readStream.schema(e.schema).parquet(_copied(spark, e))
    rows = stream.select(F.col("status").alias("term"), F.col("term").alias("unit"), F.to_timestamp("at").alias("at_time"))
    return _streamed(spark, R.daily_terms_stream(rows))
