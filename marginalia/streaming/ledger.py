"""Records followed as they arrive: first per id, only from finished readings, counted by day."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.ledger import ENVELOPE
from .tail import Tail


def tail_ledger(spark: SparkSession, path: str, schema: T.StructType = ENVELOPE, within: str | None = None) -> DataFrame:
    """Records of JSON-lines files that are being written, in a folder or one file, the first per id; lines that do not parse are
    passed over. A file is followed by bytes: a line is read once its end is written, so a half-written one is read later and
    whole, and lines added to a file are read as well as new files.

    State holds one entry for each id for ever, unless ``within`` (such as ``2 days``) bounds it: then an id that comes
    again later than that after the watermark on ``at`` counts as new."""
    spark.dataSource.register(Tail)
    lines = spark.readStream.format(Tail.name()).load(path)
    rows = lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r"), F.col("value").alias("body_json")).select("r.*", "body_json").filter("id is not null")
    if not within:
        return rows.dropDuplicates(["id"])
    return rows.withColumn("at_time", F.to_timestamp("at")).withWatermark("at_time", within).dropDuplicatesWithinWatermark(["id"])


#: Times in waiting records keep their microseconds.
AS_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


#: Activities are held in so many buckets, by hash. A call for a group takes milliseconds whatever it holds, so groups are
#: bounded, not one for each activity. A checkpoint goes with this number.
BUCKETS = 1 << 13


def _gate(forgets: bool):
    """What waits for an activity is kept as text until it ends; then its lens is kept, for records that come later. Both for all
    activities of a bucket; a finished one is forgotten by itself."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, done = json.loads(zlib.decompress(state.get[0])) if state.exists else ({}, {})
        now, touched, own = state.getCurrentWatermarkMs() if forgets else 0, set(), []
        for batch in batches if not state.hasTimedOut else ():
            for activity, whose, ended, row in zip(batch["activity"], batch["whose"], batch["ended"], batch["row"], strict=True):
                touched.add(activity)
                if row is not None:
                    waiting.setdefault(activity, []).append([whose, row])
                elif whose is not None and activity not in done:
                    done[activity] = [whose, int(ended), 0]
        for activity in touched & done.keys():
            lens, ended, _ = found = done[activity]
            found[2] = max(ended // 1000, now) + 1
            own += [(activity, lens, ended, row) for whose, row in waiting.pop(activity, []) if whose == lens]
        if forgets:
            done = {activity: found for activity, found in done.items() if found[2] >= now}
        if waiting or done:
            state.update((zlib.compress(json.dumps([waiting, done], ensure_ascii=False).encode(), 1),))
            if forgets and done:
                state.setTimeoutTimestamp(min(until for _, _, until in done.values()))
        else:
            state.remove()
        if own:
            yield pd.DataFrame(own, columns=["done", "lens", "ended", "row"])

    return run


def finished_stream(records: DataFrame, activities: DataFrame, forget: str | None = None) -> DataFrame:
    """``records(id, activity, by, at_time, ...)`` once the finished activity ``activities(id, lens, status, type, at_time)`` of
    their own lens has arrived, never before, with ``done, lens, done_at``. Whichever of the two comes first, and however much
    later the other: records wait in the state of their activity, and a finished activity lets later ones pass at once. Records
    of no activity never pass, and are not kept.

    State has the records of open activities and the lens of each finished one. With ``forget`` (such as ``30 days``) an activity
    that ended so long before the newest row is dropped from it, and rows that come so late are left out. All records of an
    activity are held by one task; they are those of one batch of units.
    """
    kept = records.columns
    waits = records.select("activity", F.col("by").alias("whose"), F.lit(None).cast("string").alias("ended"), F.to_json(F.struct(*kept), AS_JSON).alias("row"), "at_time")
    ends = activities.filter("type = 'read' and status = 'ok'")
    ends = ends.select(F.col("id").alias("activity"), F.col("lens").alias("whose"), F.unix_micros("at_time").cast("string").alias("ended"), F.lit(None).cast("string").alias("row"), "at_time")
    both = waits.unionByName(ends).filter("activity is not null").withColumn("bucket", F.pmod(F.xxhash64("activity"), F.lit(BUCKETS)))
    both = both.withWatermark("at_time", forget) if forget else both.drop("at_time")
    timeout = GroupStateTimeout.EventTimeTimeout if forget else GroupStateTimeout.NoTimeout
    out = both.groupBy("bucket").applyInPandasWithState(_gate(bool(forget)), "done string, lens string, ended long, row string", "held binary", "append", timeout)
    return out.select(F.from_json("row", records.schema, AS_JSON).alias("r"), "done", "lens", F.timestamp_micros("ended").alias("done_at")).select("r.*", "done", "lens", "done_at")


def daily_terms_stream(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """``hits(term, unit, at_time)``: units per term per day, kept up to date; late rows count within the watermark."""
    rows = hits.withWatermark("at_time", late).groupBy("term", F.window("at_time", "1 day").alias("w")).agg(F.count("*").alias("units"))
    return rows.select("term", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "units")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work through what is there and stop; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
