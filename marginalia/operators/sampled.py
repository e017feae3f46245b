"""A sample read side by side, evidence of claims, passages chosen along time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws
from .anchors import check_anchors


def side_by_side(sample: DataFrame, codings: DataFrame, lost: DataFrame, read: DataFrame, hits: DataFrame) -> DataFrame:
    """Per unit of ``sample(unit)``: ``codings`` (structs lens, start, code, exact, note, sorted), ``lost`` (lens, code, quote),
    ``readers`` and ``terms``, each an array, empty where there is none."""

    def listed(rows: DataFrame, item, name: str) -> DataFrame:
        return rows.join(sample.select("unit"), "unit", "left_semi").groupBy("unit").agg(F.sort_array(F.collect_list(item)).alias(name))

    parts = (
        listed(codings, F.struct("lens", "start", "code", "exact", "note"), "codings"),
        listed(lost, F.struct("lens", "code", "quote"), "lost"),
        listed(read.select("unit", "lens").distinct(), F.col("lens"), "readers"),
        listed(hits.select("unit", "term").distinct(), F.col("term"), "terms"),
    )
    out = sample.select("unit").distinct()
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "unit", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def sample_readers(sample: DataFrame, codings: DataFrame, activities: DataFrame) -> DataFrame:
    """Per lens over a sample: codings, those matched but for white space, in vivo, in vivo and not in the unit, notes that
    open with ``loaded:``, batches that touched the sample, failed ones, tokens in and out. ``codings(unit, by, match,
    code_type, in_vivo_in_unit, note)``, ``activities(id, lens, status, used, tokens_in, tokens_out)``."""
    mine = codings.join(sample.select("unit"), "unit", "left_semi")
    counts = mine.groupBy(F.col("by").alias("lens")).agg(
        F.count("*").alias("codings"), F.count_if(F.col("match") != "exact").alias("ws_normalized"), F.count_if(F.col("code_type") == "in_vivo").alias("in_vivo"),
        F.count_if(~F.col("in_vivo_in_unit")).alias("in_vivo_absent"), F.count_if(F.lower(F.ltrim("note")).startswith("loaded:")).alias("loaded"),
    )
    touched = activities.select("id", F.explode("used").alias("unit")).join(sample.select("unit"), "unit", "left_semi").select("id").distinct()
    acts = activities.join(touched, "id", "left_semi").groupBy("lens").agg(F.count("*").alias("batches"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"))
    return counts.join(acts, "lens", "full").fillna(0)


def claim_evidence(refs: DataFrame, codings: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """``refs(claim, side, place, ref, anchor)`` - a record's id or an inline anchor ``struct<source,start,end,exact>`` - to the
    quoted words, where they are and whether the bytes still say so. ``codings(id, source, start, end, exact)``, ``units(id,
    source, start, end, text)``, ``sources(source, content)``; a record that is neither has nulls."""
    key = ["claim", "side", "place", "ref"]
    inline = refs.filter("anchor is not null").select(*key, "anchor.*", F.lit("anchor").alias("kind"))
    by_id = refs.filter("anchor is null").select(*key)
    coded = by_id.join(codings, F.col("ref") == F.col("id")).select(*key, "source", "start", "end", "exact", F.lit("coding").alias("kind"))
    whole = by_id.join(units, F.col("ref") == F.col("id")).select(*key, "source", "start", "end", F.col("text").alias("exact"), F.lit("unit").alias("kind"))
    quoted = inline.unionByName(coded).unionByName(whole)
    checked = check_anchors(quoted.withColumn("id", F.xxhash64(*key)), sources).drop("id")
    rest = by_id.join(coded.unionByName(whole).select("ref").distinct(), "ref", "left_anti")
    return checked.unionByName(rest.select(*key, F.lit("other").alias("kind")), allowMissingColumns=True)


def pick_passages(hits: DataFrame, k: int) -> DataFrame:
    """``hits(term, unit, ts, passage)``: per term at most k passages: the first use, then those nearest to k evenly spaced
    times up to the last; one that repeats a passage taken before gives way to its neighbour in time.

    The choice is greedy, so it ends in a helper, on few rows: equal passages are one candidate at their first use,
    and around each target only the k nearest candidates on either side can be chosen."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = hits.select("term", "unit", "passage", seconds.alias("t"), F.lower(collapse_ws(F.col("passage"))).alias("key"))
    span = rows.groupBy("term").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda j: F.col("t0") + (F.col("t1") - F.col("t0")) * j / max(k - 1, 1))
    aims = span.select("term", F.posexplode(steps).alias("j", "aim"))
    near = rows.join(aims, "term")
    side = F.col("t") < F.col("aim")
    # of one passage only the use nearest to a target can be its choice
    first = Window.partitionBy("term", "j", "key", side).orderBy(F.abs(F.col("t") - F.col("aim")), "t", "unit")
    near = near.withColumn("r", F.row_number().over(first)).filter("r = 1")
    place = Window.partitionBy("term", "j", side).orderBy(F.abs(F.col("t") - F.col("aim")), "t", "unit")
    near = near.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).select("term", "j", "aim", "unit", "t", "passage", "key")
    return near.groupBy("term").applyInPandas(_greedy, hits.select("term", "unit", "passage").schema)


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    chosen, seen = [], set()
    for _, group in rows.sort_values("j").groupby("j", sort=True):
        group = group.assign(d=(group["t"] - group["aim"]).abs()).sort_values(["d", "t", "unit"])
        for row in group.itertuples(index=False):
            if row.key not in seen:
                seen.add(row.key)
                chosen.append((row.t, row.term, row.unit, row.passage))
                break
    chosen.sort(key=lambda c: (c[0], c[2]))
    return pd.DataFrame([c[1:] for c in chosen], columns=["term", "unit", "passage"])


