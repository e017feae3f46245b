"""A ledger of records: JSON lines read in order, appended once, exports and blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import CONTENT_ADDRESSED
from .folders import open_store

#: The envelope of every record; the body stays as JSON text beside it.
ENVELOPE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "kind", "v", "at", "by", "activity")])

#: Names that go in a batch, and bytes of blobs after which one is sent.
LISTED, READ = 10_000, 4 << 20


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, seq, value``: non-blank lines split at ``\\n`` only, numbered so that the order of the ledger is kept."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.filter(F.trim("value") != "").select("path", F.struct("path", "block", "n").alias("seq"), "value")


def parsed(lines: DataFrame, schema: T.StructType = ENVELOPE) -> DataFrame:
    """Lines with ``record`` (null where a line is not JSON of an object) and ``last`` (the file's last line)."""
    ok = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    ends = lines.groupBy("path").agg(F.max("seq").alias("end")).withColumnRenamed("path", "of")
    rows = lines.join(ends, F.col("path") == F.col("of")).withColumn("last", F.col("seq") == F.col("end"))
    return rows.select("path", "seq", "value", "last", F.when(ok, F.from_json("value", schema)).alias("record"))


def bad_lines(rows: DataFrame) -> DataFrame:
    """Per file the number of last lines that do not parse (one at most). Elsewhere such a line is an error."""
    wrong = F.raise_error(F.concat(F.lit("a line that is not a record: "), F.left("value", F.lit(80)))).cast("int")
    return rows.filter("record is null").select("path", F.when(F.col("last"), 1).otherwise(wrong).alias("skipped")).groupBy("path").agg(F.sum("skipped").alias("skipped"))


def read_ledger(spark: SparkSession, path: str, schema: T.StructType = ENVELOPE) -> DataFrame:
    """Records in the order written; the first one written under an id stands. A half-written last line is passed over, any
    other line that does not parse is an error."""
    rows = parsed(raw_lines(spark, path), schema)
    wrong = F.raise_error(F.concat(F.lit("a line that is not a record: "), F.left("value", F.lit(80)))).cast("boolean")
    rows = rows.filter(F.when(F.col("record").isNotNull(), True).when(F.col("last"), False).otherwise(wrong))
    return first_written(rows.select("record.*", F.col("value").alias("body_json"), "seq"))


def first_written(records: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy("seq")
    return records.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def append_records(new: DataFrame, existing: DataFrame, kind: str) -> DataFrame:
    """Rows of ``new`` to append: content-addressed kinds skip known ids, for the others a known id is an error."""
    if kind in CONTENT_ADDRESSED:
        return new.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")
    known = existing.select(F.col("id").alias("known"))
    rows = new.join(known, F.col("id") == F.col("known"), "left")
    wrong = F.raise_error(F.concat(F.lit("id is in the ledger already: "), F.col("id").cast("string"))).cast("boolean")
    return rows.filter(F.when(F.col("known").isNull(), True).otherwise(wrong)).drop("known")


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, gzipped or not; as gzip does not split, rows are dealt to tasks in turn at once, whatever page they are of."""
    return spark.read.schema(schema).json(path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_blobs(rows: DataFrame, path: str) -> None:
    """``rows(content)``, or with the names to give them ``rows(sha, content)``: a file each, in folders by the first two digits of its
    digest. A content that comes more than once is one file. Tasks write by themselves; a task that runs again writes the same."""
    named = rows if "sha" in rows.columns else rows.withColumn("sha", F.sha2("content", 256))
    top, place = open_store(path)
    top.create_dir(place, recursive=True)  # also where there is nothing to write

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(path)
        for batch in batches:
            for sha, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{at}/{sha[:2]}", recursive=True)
                with store.open_output_stream(f"{at}/{sha[:2]}/{sha}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    named.select("sha", "content").dropDuplicates(["sha"]).mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number


def _listed(root: str, deep: bool):
    """Rows ``at, folder`` to what is in these folders, at any depth if ``deep``; a file stays. Hidden names are left out, as Spark
    leaves them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root)
        for batch in batches:
            for at, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                under = store.get_file_info(fs.FileSelector(at, recursive=deep)) if folder else [store.get_file_info(at)]
                rows = [(f.path, not f.is_file) for f in under if (f.is_file or not deep) and not re.search(r"/[._]", f.path[len(at) :])]
                for i in range(0, len(rows), LISTED):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + LISTED], strict=True)], names=["at", "folder"])

    return run


def _contents(root: str):
    """Rows ``at, folder`` of files to ``sha, content``, some bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows]), pa.array([c for _, c in rows], pa.binary())], names=["sha", "content"])
        rows, size = [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with store.open_input_stream(at) as f:
                    rows.append((at.rsplit("/", 1)[-1], f.read()))
                size += len(rows[-1][1])
                if size >= READ or len(rows) >= LISTED:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``sha, content``: bytes kept in files named by their digest, in a folder and those in it. Tasks list the folders, one each, and
    read the files, dealt out by name: the driver knows none of them, as Spark's own reader has it hold every name and size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    try:
        store, top = open_store(root)
        there = store.get_file_info(top)
    except (OSError, ValueError):  # a store that only Spark opens
        return _blobs_by_spark(spark, path)
    if there.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    parts, row = int(spark.conf.get("spark.sql.shuffle.partitions")), "at string, folder boolean"
    start = spark.range(1, numPartitions=1).select(F.lit(top).alias("at"), F.lit(not there.is_file).alias("folder"))
    found = start.mapInArrow(_listed(root, False), row)
    files = found.repartition(parts, "at").mapInArrow(_listed(root, True), row)
    blobs = files.repartition(parts, "at").mapInArrow(_contents(root), "sha string, content binary")
    return blobs.hint("merge")  # Spark takes them for as few as the folders are, and would broadcast all of them in a join


def _blobs_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's reader, with all names on the driver. It passes over files without bytes, so the file of the empty
    content is looked for by its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("sha"), "content")
    nothing = hashlib.sha256().hexdigest()
    for at in (f"{path}/{nothing}", f"{path}/{nothing[:2]}/{nothing}"):
        file = spark._jvm.org.apache.hadoop.fs.Path(at)
        store = file.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(file) and not store.getFileStatus(file).getLen():
            return found.unionByName(spark.createDataFrame([(nothing, b"")], found.schema))
    return found


def write_page_data(rows: DataFrame, path: str, by: str | None = None) -> None:
    """The data behind a page, as JSON lines beside it, in folders by ``by`` if given."""
    out = rows.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)
