"""Substring dedup: a sparse de Bruijn graph of word k-mers, compacted by joins, finds passages that repeat across documents.

Every window of ``window`` words picks the smallest hash among its k-mers, which depends on the window's words alone, so
equal windows pick the same k-mer at the same place. Neighbouring windows mostly pick the same one; such a run of windows
is an *edge* of the graph, told by all its words and by where its k-mer lies, and the edge that starts where it ends comes
next. Edges whose k-mer one document alone holds leave after the first aggregation.

An edge is straight if its k-mer has it in all places. A straight edge that is always followed by the same straight edge,
which always follows it, does not branch there: such pairs are linked, and links are compacted to whole paths by doubling
(each edge learns its path's first edge and how far from it it lies). A path stands in a document as one span of its source
coordinates, decided by one owner. Only at k-mers whose edges differ (at the borders of repeated passages) are single
windows compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, run_hashes, table, text_blocks, word_hashes, words_of

K = 8
_PATH = "array<struct<kmer:long,start:int,last:int,at:int>>"
_FOUND = "array<struct<kmer:long,start:int,last:int,at:int,edge:binary,next:binary,before:binary,windows:array<long>>>"


def first_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``size`` consecutive values."""
    at, width = np.arange(len(values)), 1

    def both(shift: int) -> np.ndarray:
        a, b = at[: len(at) - shift], at[shift:]
        return np.where(values[a] <= values[b], a, b)

    while width * 2 <= size:
        at = both(width)
        width *= 2
    return both(size - width) if width < size else at


def _paths(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            index, offsets, distinct = words_of(block.column(0))
            if len(index) < window:
                continue
            kmers = run_hashes(word_hashes(distinct)[index], k)
            at = first_minimum(kmers, window - k + 1)
            ends = np.repeat(offsets[1:], np.diff(offsets))
            starts = np.flatnonzero(np.arange(len(index)) + window <= ends)
            if not len(starts):
                continue
            at = at[starts]
            new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            last = starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
            first, at = starts[new], at[new]
            doc = np.searchsorted(offsets, first, side="right") - 1
            base = offsets[doc]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kmers[at].view(np.int64)), block.column(1).take(rows), block.column(2).take(rows), *(pa.array((x - base).astype(np.int32)) for x in (first, last, at))],
                names=["kmer", "id", "row", "start", "last", "at"],
            )

    return run


def _read_at(window: int, digest: bool):
    """Read documents at the coordinates of their repeated edges: a digest of each edge (its words, and where its k-mer lies),
    those of the edges that directly follow and precede it, and hashes of its windows. With ``digest``, a document without such edges keeps the digest of its words instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            out: list[tuple] = []
            for text, paths in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                words = text.encode().split()
                if not paths:
                    whole = b" ".join(words)
                    out.append((None if digest else whole.decode(), len(words), hashlib.sha256(whole).hexdigest() if digest else None, None))
                    continue
                index, _, distinct = words_of(pa.array([text]))
                lanes = [word_hashes(distinct, lane)[index] for lane in (0, 1)]
                both = np.stack(lanes, axis=1)
                windows = run_hashes(lanes[1], window, 1).view(np.int64)
                found = sorted(paths, key=lambda p: p["start"])
                for p in found:
                    said = both[p["start"] : p["last"] + window].tobytes() + (p["at"] - p["start"]).to_bytes(8, "little")
                    p |= {"edge": xxhash.xxh3_128_digest(said), "next": None, "before": None, "windows": windows[p["start"] : p["last"] + 1]}
                for p, q in zip(found, found[1:], strict=False):
                    if q["start"] == p["last"] + 1:
                        p["next"], q["before"] = q["edge"], p["edge"]
                out.append((text, len(words), None, found))
            edge = [(name, pa.binary()) for name in ("edge", "next", "before")]
            kind = pa.list_(pa.struct([("kmer", pa.int64()), ("start", pa.int32()), ("last", pa.int32()), ("at", pa.int32()), *edge, ("windows", pa.list_(pa.int64()))]))
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), kind))]
            yield pa.RecordBatch.from_arrays([*block.columns[2:], *cols], names=[*block.schema.names[2:], "_m_text", "_m_words", "_m_sha", "_m_found"])

    return run


def _cut(digest: bool):
    """Remove the words under the given ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, sha, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                merged: list[list[int]] = []
                if text is None:
                    out.append((None, sha, merged))
                    continue
                words = text.encode().split()
                for a, b in sorted((s["start"], s["end"]) for s in spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                rest = b" ".join(kept + words[at:])
                out.append((None if digest else rest.decode(), hashlib.sha256(rest).hexdigest() if digest else None, [{"start": a, "end": b} for a, b in merged]))
            kinds = (pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *cols], names=[*batch.schema.names[3:], "_m_text", "_m_sha", "_m_cut"])

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = K, digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` consecutive words whose word sequence also starts in a
    document with a smaller id. Words are runs of anything but ASCII blanks. ``text_col`` holds the kept words joined
    by one space; adds ``n_words``, ``n_removed`` and ``removed`` (word ranges). With ``digest``, ``kept_sha256``
    stands in place of the text.

    Null or empty texts and texts of fewer than ``window`` words lose nothing. A null id counts as smaller than all
    others; rows with one id count as one document and never cut each other. Columns other than those named pass through.
    An empty table gives an empty result. Edges are told apart by 128 bits of hash, windows by 128 bits as well.

    Shuffled are one row for about every 22 words (edge, id), then the texts once to be read at the coordinates of
    repeated edges, then only texts that hold such an edge. Edges and windows that very many documents share are
    aggregated before the shuffle and joined from written tables, so that skewed partitions can be split.
    """
    assert k < window
    scratch = Scratch(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() not in {text_col.lower(), "n_words", "n_removed", "removed", "kept_sha256"}]
    text, id_ = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select(text.alias("_m_text"), id_.alias("_m_id"), F.xxhash64(text).alias("_m_row"), *others)
    cells = scratch.write(keyed.select("_m_text", "_m_id", "_m_row").mapInArrow(_paths(window, k), "kmer long, id long, row long, start int, last int, at int"), "edges")
    shared = cells.groupBy("kmer").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select(F.col("kmer").alias("edge"))
    shared = scratch.write(shared, "shared-edges")
    paths = (
        cells.join(shared, F.col("kmer") == F.col("edge"))
        .groupBy("id", "row")
        .agg(F.collect_set(F.struct("kmer", "start", "last", "at")).alias("_m_paths"))
        .withColumnsRenamed({"id": "_m_path_id", "row": "_m_path_row"})
    )
    joined = keyed.join(paths, (F.col("_m_id") == F.col("_m_path_id")) & (F.col("_m_row") == F.col("_m_path_row")), "left")
    carried = ["_m_id", "_m_row", *others]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*carried).schema.fields)
    read = joined.select("_m_text", F.col("_m_paths").cast(_PATH), *carried).mapInArrow(_read_at(window, digest), f"{fields}, _m_text string, _m_words long, _m_sha string, _m_found {_FOUND}")
    read = scratch.write(read, "read-at")
    scratch.drop(cells, shared)

    found = read.filter("_m_found is not null").select(F.col("_m_id").alias("id"), F.col("_m_row").alias("row"), F.explode("_m_found").alias("f")).select("id", "row", "f.*")
    graph = scratch.write(_graph(found), "graph")
    named = graph.join(_compacted(graph, scratch).withColumnRenamed("edge", "linked"), F.col("edge") == F.col("linked"), "left")
    named = named.select(F.col("kmer").alias("of"), "owner", "straight", F.coalesce("head", "edge").alias("head"), F.coalesce("far", F.lit(0)).alias("far"))
    placed = found.join(scratch.write(named, "paths"), F.col("kmer") == F.col("of"))
    # a path in a document: edges that lie as far from one place as they lie from the path's head
    passages = placed.filter("straight and id > owner").groupBy("id", "row", "head", (F.col("start") - F.col("far")).alias("from"))
    compact = passages.agg(F.min("start").alias("start"), F.max("last").alias("last")).select("id", "row", "start", F.expr(f"last + {window}").alias("end"))
    single = placed.filter("not straight").select("id", "row", "kmer", "start", "at", F.posexplode("windows").alias("i", "hash"))
    single = single.select("id", "row", (F.col("start") + F.col("i")).alias("start"), "kmer", F.expr("at - start - i").alias("place"), "hash")
    single = scratch.write(single, "windows")
    same = ["kmer", "place", "hash"]
    owners = single.groupBy(*same).agg(F.min("id").alias("owner"), F.max("id").alias("high")).filter("owner < high").select("owner", *(F.col(c).alias(f"w_{c}") for c in same))
    owners = scratch.write(owners, "owners")
    branching = single.join(owners, [F.col(c) == F.col(f"w_{c}") for c in same]).filter("id > owner").select("id", "row", "start", F.expr(f"start + {window}").alias("end"))
    spans = compact.unionByName(branching).groupBy("id", "row").agg(F.collect_set(F.struct("start", "end")).alias("_m_spans"))
    spans = scratch.write(spans.withColumnsRenamed({"id": "_m_span_id", "row": "_m_span_row"}), "spans")
    scratch.keep_only(read, spans)
    touched = read.filter("_m_found is not null").join(spans, (F.col("_m_id") == F.col("_m_span_id")) & (F.col("_m_row") == F.col("_m_span_row")), "left")
    columns = ["_m_text", "_m_sha", "_m_spans", *others, "_m_words"]
    rest = read.filter("_m_found is null").withColumn("_m_spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*others, "_m_words").schema.fields)
    kinds = "_m_text string, _m_sha string, _m_cut array<struct<start:long,end:long>>"
    cut = touched.select(*columns).mapInArrow(_cut(digest), f"{fields}, {kinds}")
    same_text = rest.select(*others, "_m_words", "_m_text", "_m_sha", F.array().cast("array<struct<start:long,end:long>>").alias("_m_cut"))
    out = cut.unionByName(same_text)
    size = F.aggregate("_m_cut", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    kept = [F.col("_m_sha").alias("kept_sha256")] if digest else [F.col("_m_text").alias(text_col)]
    return out.select(*others, *kept, F.col("_m_words").alias("n_words"), size.alias("n_removed"), F.col("_m_cut").alias("removed"))


def _graph(found: DataFrame) -> DataFrame:
    """Each repeated k-mer: the smallest id that holds it, whether all its places have one edge, and then that edge, its size
    in windows, and the edges that follow and precede it in all places."""

    def only(side: str) -> Column:
        same = (F.count(side) == F.count("*")) & (F.min(side) == F.max(side)) & (F.min("edge") == F.max("edge"))
        return F.when(same, F.min(side))

    return found.groupBy("kmer").agg(
        F.min("id").alias("owner"), (F.min("edge") == F.max("edge")).alias("straight"), F.min("edge").alias("edge"), F.max(F.expr("last - start + 1")).alias("size"),
        only("next").alias("next"), only("before").alias("before"),
    )


def _compacted(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """``edge, head, far`` for every edge that follows another one without branching: the first edge of its path and how many
    windows it lies from it. Distances double each round, so a path of n edges takes log n joins."""
    ahead = graph.filter("next is not null").select(F.col("edge").alias("x"), F.col("next").alias("y"), "size")
    behind = graph.filter("straight and before is not null").select("edge", "before")
    jumps = scratch.write(ahead.join(behind, (F.col("y") == F.col("edge")) & (F.col("x") == F.col("before"))).select("edge", F.col("x").alias("head"), F.col("size").alias("far")), "links")
    while True:
        more = jumps.select(F.col("edge").alias("at"), F.col("head").alias("further"), F.col("far").alias("more"))
        both = jumps.join(more, F.col("head") == F.col("at"), "left")
        last, jumps = jumps, scratch.write(both.select("edge", F.coalesce("further", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("further").isNotNull().alias("moved")), "jumps")
        scratch.drop(last)
        if jumps.filter("moved").isEmpty():
            return jumps.drop("moved")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def brute_force(docs: list[tuple], window: int = 50) -> list[tuple]:
    """The result of op5 by comparing all windows as word tuples (for tests)."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
