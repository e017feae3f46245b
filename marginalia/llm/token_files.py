"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a folder with two Parquet tables, so that any file system Spark knows can hold it:

* ``ranks``: ``id, rank, n`` - each id that occurs, ranked by falling frequency (ties: smaller id first);
* ``blocks``: ``part, block, start`` (ids of this part before the block), ``docs`` and ``sizes`` (document ids and
  their numbers of tokens, in order), ``control`` and ``data``. Parts are ascending ranges of document ids.

Coding of a block: the ranks of its tokens, little-endian, in 1 to 4 bytes each, go to ``data``; two bits for each
(number of bytes less one, four tokens to a byte, low bits first) go to ``control``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.folders import shared_folder

from .bpe import default_tokenizer, encoder
from .common import BLOCK_BYTES, Scratch, partitions, table, text_blocks

#: Tokens that a block holds at most, unless a single document has more.
BLOCK_TOKENS = 1 << 18
END_ID = 2

_MASK = np.array([[j <= k for j in range(4)] for k in range(4)])
_SIZES = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_MASK[more]]
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = more
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() has packed; sizes come from a table of all control bytes."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for j in range(1, int(sizes.max()) if n else 0):
        here = np.flatnonzero(sizes > j)
        out[here] |= raw[at[here] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0, 2 * BLOCK_BYTES):
            ids, starts = encoder(path).encode(block.column(0))
            coded = [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            kind = np.uint16 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
            cols = [pa.array([len(x) for x in coded], pa.int64()), pa.array([x.astype(kind).tobytes() for x in coded], pa.binary())]
            yield pa.RecordBatch.from_arrays([*block.columns[1:], *cols], names=["id", "row", "n", "ids"])

    return run


def _ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.bincount(_ids(n, raw))
            if len(got) > len(total):
                total, got = got, total
            total[: len(got)] += got
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


def _pack(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, part, at, block = ranks.value, TaskContext.get().partitionId(), 0, 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal at, block
            control, data = pack(rank[np.concatenate([_ids(n, raw) for _, n, raw in rows])])
            sizes = [n for _, n, _ in rows]
            out = [[part], [block], [at], [[d for d, _, _ in rows]], [sizes], [control], [data]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            at, block = at + sum(sizes), block + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["part", "block", "start", "docs", "sizes", "control", "data"])

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if rows and held + row[1] > BLOCK_TOKENS:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[1]
        if rows:
            yield flush(rows)

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Encode every text, append the end id to each, and write the ids in ascending order of ``id_col`` (ties: by a
    hash of the text; null ids first).

    Null or empty texts hold the end id alone; an empty table gives empty files. Texts are encoded where they are read;
    their ids are kept in the shared folder, counted with one row for each id and task, ranked (a table no larger than
    the vocabulary), dealt by ranges of document ids and written.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    text = F.coalesce(F.col(text_col), F.lit(""))
    coded = docs.select(text.alias("_m_text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row")).mapInArrow(_encode(tokenizer), "id long, row long, n long, ids binary")
    scratch = Scratch(spark)
    coded = scratch.write(coded, "token-ids")
    counts = coded.select("n", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))  # at most a row for each id of the vocabulary
    rank = np.zeros(max((r["id"] for r in found), default=0) + 1, np.uint32)
    rank[[r["id"] for r in found]] = np.arange(len(found), dtype=np.uint32)
    spark.createDataFrame([(r["id"], k, r["n"]) for k, r in enumerate(found)], "id long, rank int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    dealt = coded.repartitionByRange(partitions(spark), "id", "row").sortWithinPartitions("id", "row").select("id", "n", "ids")
    blocks = "part int, block int, start long, docs array<long>, sizes array<long>, control binary, data binary"
    dealt.mapInArrow(_pack(spark.sparkContext.broadcast(rank)), blocks).write.parquet(f"{path}/blocks")
    scratch.drop(coded)


def _unpack(ids, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, size, out = [], [], [], []
            for base, docs, sizes, control, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                got = ids.value[unpack(control, data, sum(sizes))]
                at = 0
                for d, n in zip(docs, sizes, strict=True):
                    one = got[at : at + n]
                    doc.append(d)
                    start.append(base + at)
                    size.append(n)
                    out.append(zlib.crc32(one.astype("<u4").tobytes()) if digest else one.astype(np.int32))
                    at += n
            cols = [*(pa.array(x, pa.int64()) for x in (doc, start, size)), pa.array(out, pa.int64() if digest else pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row a document: ``doc_id, start`` (ids of all documents before it), ``n_tokens``, and ``ids`` or, with
    ``digest``, their ``ids_crc32``."""
    found = spark.read.parquet(f"{path}/ranks").select("id", "rank").collect()
    ids = np.zeros(len(found) + 1, np.uint32)
    ids[[r["rank"] for r in found]] = [r["id"] for r in found]
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row a part, as many as there are files
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, at = [], 0
    for r in sizes:
        before.append((r["part"], at))
        at += r["n"]
    bases = spark.createDataFrame(before, "part int, base long")
    placed = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start")).alias("base"), "docs", "sizes", "control", "data")
    kind = "ids_crc32 long" if digest else "ids array<int>"
    return placed.mapInArrow(_unpack(spark.sparkContext.broadcast(ids), digest), f"doc_id long, start long, n_tokens long, {kind}")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_token_files(spark, path, digest=True)
