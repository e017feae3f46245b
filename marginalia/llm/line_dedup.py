"""Line dedup: drop lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, with_columns

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() also changes letters beyond A-Z, so it serves only where there are none
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row a line whose key is long enough: ``_m_id, _m_row, _m_pos, _m_key`` (128-bit digest of the key)."""
    lines = rows.select("_m_id", "_m_row", F.posexplode("_m_lines").alias("_m_pos", "_m_line"))
    keys = lines.select("_m_id", "_m_row", "_m_pos", line_key(F.col("_m_line")).alias("_m_text"))
    return keys.filter(F.length("_m_text") >= min_chars).select("_m_id", "_m_row", "_m_pos", F.unhex(F.md5("_m_text")).alias("_m_key"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop every line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs``
    documents, except in the largest id that holds it. Adds ``n_lines`` and ``n_dropped``; ``text_col`` holds
    the remaining lines joined by newlines.

    Null or empty text: one empty line. Rows with the same id count as one document and are cut alike; rows with a
    null id count together as one document, smaller than all others. An empty table gives an empty result.

    Columns other than those added pass through, whatever their names. Lines travel as 128-bit digests, made once and
    kept in the shared folder until the positions to drop are known. A line common to very many documents costs one
    partially aggregated row per task when counted, and its rows are dealt anew by the skew handling of the join when
    dropped. Each text is shuffled once and split once to be cut, so a text of very many lines takes time in proportion.
    """
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(id_.alias("_m_id"), F.xxhash64(text).alias("_m_row"), F.split(text, "\n", -1).alias("_m_lines"))
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(_occurrences(slim, min_chars), "lines")
    holders = found.groupBy("_m_key", "_m_id").agg(F.lit(1).alias("_m_one"))
    common = (
        holders.groupBy("_m_key")
        .agg(F.count("_m_one").alias("_m_n"), F.max("_m_id").alias("_m_keep"))
        .filter(F.col("_m_n") >= min_docs)
        .select(F.col("_m_key").alias("_m_common"), "_m_keep")
    )
    common = scratch.write(common, "common-lines")  # joined from files, so that skewed partitions can be split
    dropped = (
        found.join(common, (F.col("_m_key") == F.col("_m_common")) & ~F.col("_m_id").eqNullSafe(F.col("_m_keep")))
        .groupBy("_m_id", "_m_row")
        .agg(F.collect_set("_m_pos").alias("_m_drop"))
        .select(F.col("_m_id").alias("_m_drop_id"), F.col("_m_row").alias("_m_drop_row"), "_m_drop")
    )
    dropped = scratch.keep(dropped, "dropped")
    rows = docs.withColumns({"_m_id": id_, "_m_row": F.xxhash64(text)})
    joined = rows.join(dropped, F.col("_m_id").eqNullSafe(F.col("_m_drop_id")) & (F.col("_m_row") == F.col("_m_drop_row")), "left")
    lines = F.split(text, "\n", -1)

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_m_drop"))
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    # as the variable of an outer function the lines are split once, not for every line that stays
    rest = F.get(F.transform(F.array(lines), left), 0)
    out = with_columns(
        joined,
        **{
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size("_m_drop"), F.lit(0)).cast("long"),
            text_col: F.when(F.col("_m_drop").isNull(), text).otherwise(rest),
        },
    )
    return out.drop("_m_id", "_m_row", "_m_drop_id", "_m_drop_row", "_m_drop")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM doc),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
common AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
