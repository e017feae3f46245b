"""Shared helpers of the training-data operators: tables, shared folder, word splitting, hashes.

Input rules that all operators keep:

* a null text counts as an empty text, a null id is an id of its own kind;
* an operator's output columns replace input columns of the same name, all other columns pass through;
* columns that an operator needs for itself are named ``_m_...`` and never clash with table columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.folders import shared_folder

#: Text bytes that a Python worker handles in one go.
BLOCK_BYTES = 3 << 20

_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_GAP = np.uint64(0xA0761D6478BD642F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder on the way to a result. A table that later steps no longer need is dropped;
    ``keep`` writes the table that the result is read from and drops all others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        for path in [p for p, df in self.paths.items() if df is not None and any(df is f for f in frames)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.paths[path] = None

    def keep_only(self, *frames: DataFrame) -> None:
        self.drop(*(x for x in self.paths.values() if x is not None and not any(x is f for f in frames)))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = self.write(df, name)
        self.keep_only(out)
        return out


def small_enough(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """df marked for broadcast if its rows, counted, stay under ``most`` bytes; else df, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns(df: DataFrame, **cols) -> DataFrame:
    """withColumns that also replaces columns differing only in case."""
    return df.drop(*[c for c in df.columns if c.lower() in {k.lower() for k in cols} and c not in cols]).withColumns(cols)


def text_blocks(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, each of at most ``most`` text bytes or one row; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column), "")
        batch = batch.set_column(column, pa.field(batch.schema.field(column).name, texts.type), texts)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts without nulls: indices into the distinct words, where each text's
    words start (one entry more than texts), and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    blank = pc.index(distinct, "").as_py()
    if blank >= 0:
        keep = index != blank
        before = np.concatenate(([0], np.cumsum(keep)))
        offsets, index = before[offsets], index[keep]
        index = index - (index > blank)
        distinct = distinct.filter(pc.not_equal(distinct, ""))
    return index, offsets, distinct


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * m) for m in _MUL]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(lane: int, n: int) -> np.ndarray:
    if len(_POWERS[lane]) < n:
        size = max(n, 1 << 12)
        _POWERS[lane] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _MUL[1 - lane], np.uint64))), dtype=np.uint64)
    return _POWERS[lane][:n]


def word_hashes(words: pa.Array, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each non-empty word; lanes are independent."""
    if not len(words):
        return np.empty(0, np.uint64)
    words = words.cast(pa.binary())
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(_BYTES[lane][data] * powers(lane, int(sizes.max()))[place], starts)
    return mix(sums + sizes.astype(np.uint64) * _GAP)


def run_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of every n consecutive word hashes, without regard to where texts end."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    end = len(words) - n + 1
    out, width = words, 1
    # doubling: a run of 2w words is run(i) * M^w + run(i + w)
    todo, acc, acc_width, power = n, None, 0, int(_MUL[lane])
    while True:
        factor = np.uint64(power)
        if todo & 1:
            if acc is None:
                acc, acc_width = out, width
            else:
                size = len(out) - acc_width
                acc = acc[:size] * factor + out[acc_width : acc_width + size]
                acc_width += width
        todo >>= 1
        if not todo:
            break
        out = out[:-width] * factor + out[width:]
        power = power * power % (1 << 64)
        width *= 2
    return mix(acc[:end] + np.uint64(n * int(_GAP) % (1 << 64)))


def id_column(df: DataFrame, name: str):
    return F.col(name).cast("long")
