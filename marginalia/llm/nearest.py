"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix, table

#: Distinct vectors of a shard, neighbours on the upper layers (twice as many on the lowest), width of a search and of
#: the searches that build a graph.
SHARD, M, WIDTH, BUILD = 8192, 16, 112, 64
#: Queries that are searched together, nodes that are inserted together, and candidates that a search expands at a time.
QUERY_BLOCK, INSERT, STEP = 512, 256, 4


class Graph:
    """Layers from the lowest up: ``nodes`` of a layer, ascending, and ``links``, their neighbours as places in ``nodes``,
    row by row, nearest first, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers

    def search(self, queries: np.ndarray, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """About the k nearest nodes of each query, nearest first, and their squared distances; -1 where there are fewer."""
        start = None
        for at, (nodes, links) in enumerate(reversed(self.layers)):
            lowest = at == len(self.layers) - 1
            v = self.vectors[nodes]
            if start is None:  # the top layer is entered at its first node
                start = np.zeros((len(queries), 1), np.int64)
            else:
                start = np.searchsorted(nodes, start)
            near, gaps = beam(v, links, queries, start, max(width, k) if lowest else 8)
            near, gaps = near[:, :k] if lowest else near[:, :2], gaps[:, :k]
            start = np.where(near >= 0, nodes[near], -1 if lowest else nodes[near[:, :1]])
        return start, gaps


def beam(v: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: the ``width`` best nodes found by following links, nearest first, with
    squared distances. A query is done when none of its best nodes is left to expand."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    square = np.einsum("ij,ij->i", v, v)
    own = np.einsum("ij,ij->i", queries, queries)

    def distance(of: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return square[nodes] + own[of, None] - 2 * np.matmul(v[nodes], queries[of, :, None])[:, :, 0]

    seen = np.zeros((n, len(v) + 1), bool)  # the last column stands for no node
    found = np.full((n, width), -1, np.int64)
    gaps = np.full((n, width), np.inf)
    open_ = np.zeros((n, width), bool)
    take = min(start.shape[1], width)
    first = start[:, :take].copy()
    repeated = np.zeros(first.shape, bool)
    for c in range(1, take):
        repeated[:, c] = (first[:, :c] == first[:, c : c + 1]).any(axis=1)
    found[:, :take] = np.where(repeated, -1, first)
    gaps[:, :take] = np.where(repeated, np.inf, distance(np.arange(n), first))
    open_[:, :take] = ~repeated
    seen[rows, first] = True
    order = np.argsort(gaps, axis=1, kind="stable")
    found, gaps, open_ = (np.take_along_axis(x, order, axis=1) for x in (found, gaps, open_))
    busy = np.arange(n)
    while len(busy):
        here = open_[busy]
        turn = here & (np.cumsum(here, axis=1) <= STEP)
        open_[busy] = here & ~turn
        place = np.argsort(~turn, axis=1, kind="stable")[:, :STEP]  # the nearest ones still to expand
        node = np.where(np.take_along_axis(turn, place, axis=1), np.take_along_axis(found[busy], place, axis=1), -1)
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(busy), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        known = seen[busy[:, None], near] | (near < 0)
        seen[busy[:, None], near] = True
        seen[:, -1] = False
        gap = np.where(known, np.inf, distance(busy, near))
        gap[gap >= gaps[busy, -1:]] = np.inf
        both = np.concatenate((gaps[busy], gap), axis=1)
        nodes = np.concatenate((found[busy], np.where(np.isinf(gap), -1, near)), axis=1)
        still = np.concatenate((open_[busy], ~np.isinf(gap)), axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :width]
        gaps[busy], found[busy], open_[busy] = (np.take_along_axis(x, order, axis=1) for x in (both, nodes, still))
        busy = busy[open_[busy].any(axis=1)]
    return found, gaps


def chosen(v: np.ndarray, near: np.ndarray, gaps: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first (-1 and infinite where there are fewer), those that are not nearer to one chosen
    before; what is left over fills free places."""
    size, take = near.shape
    kept, count = np.full((size, most), -1, np.int64), np.zeros(size, np.int64)
    square = np.einsum("ij,ij->i", v, v)
    spare = np.zeros((size, take), bool)
    for r in range(take):
        c = near[:, r]
        gap = square[c][:, None] + square[kept] - 2 * np.matmul(v[kept], v[c][:, :, None])[:, :, 0]
        covered = ((gap < gaps[:, r, None]) & (kept >= 0)).any(axis=1)
        good = ~covered & (count < most) & (c >= 0)
        kept[np.flatnonzero(good), count[good]] = c[good]
        count += good
        spare[:, r] = ~good & (c >= 0)
    place = count[:, None] + np.cumsum(spare, axis=1) - 1
    row, column = np.nonzero(spare & (place < most))
    kept[row, place[row, column]] = near[row, column]
    return kept


def build(vectors: np.ndarray, ids: np.ndarray, m: int = M, width: int = BUILD) -> Graph:
    """A node's top layer follows from a hash of its id. Layers are built from the top down, each by inserting nodes in
    batches: a batch searches the layer as far as it is built, entering where the layer above leads, adds what is near
    within the batch, chooses links, and is linked back by those it chose, which choose anew where they have too many."""
    v = vectors.astype(np.float32)
    uniform = (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    level = np.floor(-np.log(np.maximum(uniform, 1e-12)) / np.log(m)).astype(int)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(int(level.max()), -1, -1):
        nodes, most = np.flatnonzero(level >= k), 2 * m if k == 0 else m
        own, links = v[nodes], np.full((len(nodes), most + most // 2), -1, np.int32)  # room for links back, before a node chooses anew
        above = Graph(v, layers[::-1])
        # nodes of the layer above come first, so that it leads to where this one is built
        order = np.argsort(-level[nodes], kind="stable")
        for at in range(0, len(order), INSERT):
            batch, done = order[at : at + INSERT], order[:at]
            if layers:
                entry = above.search(own[batch], 2, 16)[0]
                entry = np.searchsorted(nodes, np.where(entry >= 0, entry, entry[:, :1]))
                built = np.isin(entry, done) if at else np.zeros(entry.shape, bool)
                entry = np.where(built, entry, order[0])
            else:
                entry = np.full((len(batch), 1), order[0])
            near, gaps = np.full((len(batch), 0), -1), np.full((len(batch), 0), np.inf)
            if at:
                near, gaps = beam(own, links, own[batch], entry, width)
            square = np.einsum("ij,ij->i", own[batch], own[batch])
            inside = square[:, None] + square[None] - 2 * own[batch] @ own[batch].T
            np.fill_diagonal(inside, np.inf)
            near = np.concatenate((near, np.where(np.isinf(inside), -1, batch[None])), axis=1)
            gaps = np.concatenate((gaps, inside), axis=1)
            best = np.argsort(gaps, axis=1, kind="stable")[:, :width]
            near, gaps = (np.take_along_axis(x, best, axis=1) for x in (near, gaps))
            links[batch, :most] = chosen(own, near, gaps, most)
            _link_back(own, links, batch, most)
        _choose_anew(own, links, np.flatnonzero(links[:, most] >= 0), most)
        layers.append((nodes.astype(np.int32), links[:, :most].copy()))
    return Graph(vectors, layers[::-1])


def _link_back(v: np.ndarray, links: np.ndarray, batch: np.ndarray, most: int) -> None:
    """Nodes that the batch has chosen get a link to it each; where there is no room left, they choose anew first, and of
    more than there is room for then the nearest are taken."""
    row, column = np.nonzero(links[batch] >= 0)
    source, target = batch[row], links[batch][row, column]
    known = (links[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    if not len(target):
        return
    of, count = np.unique(target, return_counts=True)
    _choose_anew(v, links, of[(links[of] >= 0).sum(axis=1) + count > links.shape[1]], most)
    order = np.lexsort((((v[source] - v[target]) ** 2).sum(axis=1), target))
    source, target = source[order], target[order]
    _, first, count = np.unique(target, return_index=True, return_counts=True)
    place = (links[of] >= 0).sum(axis=1).repeat(count) + np.arange(len(target)) - first.repeat(count)
    room = place < links.shape[1]
    links[target[room], place[room]] = source[room]


def _choose_anew(v: np.ndarray, links: np.ndarray, of: np.ndarray, most: int) -> None:
    """Leave the chosen ones of the links of some nodes."""
    if not len(of):
        return
    near = links[of].astype(np.int64)
    gaps = np.where(near >= 0, ((v[near] - v[of][:, None]) ** 2).sum(axis=2), np.inf)
    order = np.argsort(gaps, axis=1, kind="stable")
    near, gaps = (np.take_along_axis(x, order, axis=1) for x in (near, gaps))
    links[of] = -1
    links[of, :most] = chosen(v, near, gaps, most)


def _index(key: tuple, group: pa.Table) -> pa.Table:
    ids = group["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    v = np.stack(group["vec"].to_pylist())[order].astype(np.float64)
    layers = build(v, ids).layers
    row = {
        "dim": [v.shape[1]], "shard": [key[1].as_py()], "ids": [ids.tolist()], "vectors": [v.tobytes()],
        "nodes": [[a.tobytes() for a, _ in layers]], "links": [[b.tobytes() for _, b in layers]],
    }
    return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))


def _searcher(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                layers = []
                for nodes, links in zip(row["nodes"], row["links"], strict=True):
                    nodes = np.frombuffer(nodes, np.int32)
                    layers.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
                queries = np.frombuffer(row["queries"]).reshape(-1, row["dim"])
                near, gaps = Graph(v, layers).search(queries, k, width)
                got = near >= 0
                query = np.repeat(row["query_ids"], got.sum(axis=1))
                rep = np.array(row["ids"])[near[got]]
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(rep, pa.int64()), pa.array(gaps[got], pa.float64())], names=["query_id", "rep", "d"])

    return run


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with their vectors as bytes."""
    for batch in batches:
        flat = [np.array(x, np.float64).tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(flat, pa.binary())], names=["its_dim", "query_ids", "queries"])


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, shard: int = SHARD, width: int = WIDTH) -> DataFrame:
    """For each row of ``queries`` (same columns) about the ``k`` nearest other rows of ``vectors`` by Euclidean
    distance: ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id.

    Rows without id, vectors that are null, empty, zero or hold null or non-finite components take no part; vectors are
    compared with those of their own length. Of a repeated id with the same vector one row counts; with different
    vectors, each is a candidate of its own, and each query row finds its own neighbours but never its own id: the nearest
    ``k`` of both together are its result. Columns other than the two named are not looked at. Empty tables give an empty
    result.

    Equal vectors are one node of the graph; of its ids the ``k + 1`` smallest can matter and are kept by a limited
    ranking, so copies cost nothing. Shards hold about ``shard`` nodes each, by a hash of the id. A shard's graph is one
    row of flat arrays; the queries, dealt over blocks, are the smaller side and go to every shard; shard results are
    merged by rank. The work is that of all queries in all shards, each by the logarithm of the shard, so shards should be
    as large as a worker's memory allows.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
        odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return out.filter(~odd & F.exists("vec", lambda x: x != 0))

    place = Window.partitionBy("vec").orderBy("vec_id")
    ranked = usable(vectors).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).distinct().withColumn("place", F.row_number().over(place)).filter(f"place <= {k + 1}")
    scratch = Scratch(spark)
    ranked = scratch.write(ranked.withColumn("rep", F.min("vec_id").over(Window.partitionBy("vec"))), "ranked")
    nodes = ranked.filter("place = 1").select("vec_id", "vec", F.size("vec").alias("dim"))
    shards = max(1, -(-nodes.count() // shard))
    index = nodes.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(shards)).cast("long")).groupBy("dim", "shard").applyInArrow(_index, "dim int, shard long, ids array<long>, vectors binary, nodes array<binary>, links array<binary>")
    index = scratch.write(index, "graphs")
    asked = usable(queries).distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("long")).groupBy(F.size("vec").alias("its_dim"), "block").agg(F.collect_list(F.struct("vec_id", "vec")).alias("q"))
    block = block.select("its_dim", F.col("q.vec_id").alias("query_ids"), F.col("q.vec").alias("queries")).mapInArrow(_flat, "its_dim int, query_ids array<long>, queries binary")
    block = scratch.write(block, "query-blocks")
    asks = block.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("its_shard"))
    meet = index.hint("merge").join(asks, (F.col("dim") == F.col("its_dim")) & (F.col("shard") == F.col("its_shard")))
    hits = meet.select("dim", "ids", "vectors", "nodes", "links", "query_ids", "queries").mapInArrow(_searcher(k + 1, width), "query_id long, rep long, d double")
    few = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "rep"))).filter(f"r <= {k + 1}")
    few = scratch.write(few.select("query_id", F.col("rep").alias("hit"), "d"), "hits")
    scratch.keep_only(ranked, few)
    members = ranked.select("rep", "vec_id", "vec")
    near = few.join(members, F.col("hit") == F.col("rep")).filter("vec_id <> query_id")
    own = asked.select(F.col("vec_id").alias("own_id"), F.col("vec").alias("own"))
    near = near.join(own, F.col("query_id") == F.col("own_id"))
    score = F.sqrt(F.aggregate(F.zip_with("vec", "own", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    near = near.select("query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
