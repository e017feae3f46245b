"""Near-duplicate detection with HyperMinHash registers.

A document's set is its distinct 5-word shingles. Shingle hashes are dealt to buckets; a bucket's register keeps the
leading-zero count and the first mantissa bits of its smallest hash, empty buckets borrow a register from another bucket
of the document. Bands of registers propose pairs, the collision-corrected Jaccard estimate of the registers sorts
out hopeless ones unless a set is small, and the full sets confirm the rest.

Only connectivity is asked for, so a band never emits its pairs. First each member meets leaders of its bands, the ones
with most company: that links nearly all of a family of copies at the cost of one or two comparisons a member. Bands that
still hold several components are then compared block by block, all members against those outside the band's largest
component: a block pair is one group of a few hundred sets, compares each pair in the first band it shares, and hands on
at most one link for each member. So no link is lost but those that share no band or fall 6 standard deviations below
the threshold by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, run_hashes, small_enough, table, text_blocks, with_columns, word_hashes, words_of

WORDS = 5
REGISTERS = 384
#: Most registers of a band, and the probability at most that a pair at the threshold shares no band.
ROWS, MISS = 8, 3e-7
#: Registers kept for the estimate, and the bits of a mantissa.
SAMPLE, MANTISSA = 128, 10
#: Chance that registers of different minima agree: equal leading-zero counts (about 1/3) and equal mantissas.
COLLISION = 2.0**-MANTISSA / 3
#: Standard deviations of the estimate that a pair may lie below the threshold and still be compared.
SLACK = 6.0
#: Sets under so many shingles skip the estimate: most of their registers are borrowed and agree or differ together.
FEW = 64
#: Leaders that a member is compared with first, and members of a block.
LEADERS, BLOCK = 2, 192
NULL_ID = -(2**63)

_STEPS = 48
_DONOR = (mix(np.arange(1, REGISTERS * _STEPS + 1, dtype=np.uint64)) % np.uint64(REGISTERS)).astype(np.int64).reshape(_STEPS, REGISTERS)


def bands_of(percent: int) -> tuple[int, int]:
    """Bands and registers of each, as many as keep a pair of that similarity from sharing no band: 48 of 8 at 85 (2e-7),
    64 of 6 at 80 (4e-9)."""
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    raise ValueError(f"registers are too few to find pairs of {percent} percent")


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are lower-cased in A-Z, fewer than n are one shingle."""
    index, offsets, distinct = words_of(pc.ascii_lower(texts))
    words = word_hashes(distinct)[index]
    runs = run_hashes(words, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            got = np.sort(runs[a : b - n + 1])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))])
        else:
            out.append(run_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty sorted sets, one row a set."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    high = flat >> np.uint64(32)
    bucket = doc * REGISTERS + (high * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    new = np.concatenate(([True], bucket[1:] != bucket[:-1])) if len(flat) else np.empty(0, bool)
    place = bucket[new]
    # the hash's place inside its bucket, spread over 64 bits again
    rest = mix_order(flat[new], (place % REGISTERS).astype(np.uint64))
    zeros = np.zeros(len(rest), np.int64)
    seek = rest.copy()
    for bits in (32, 16, 8, 4, 2, 1):
        small = seek < np.uint64(1) << np.uint64(64 - bits)
        zeros[small] += bits
        seek[small] <<= np.uint64(bits)
    mantissa = (seek << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    filled = np.zeros(len(sets) * REGISTERS, bool)
    out[place] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    filled[place] = True
    empty = np.flatnonzero(~filled)
    for step in range(_STEPS):
        if not len(empty):
            break
        slot = empty % REGISTERS
        donor = empty - slot + _DONOR[step, slot]
        has = filled[donor]
        out[empty[has]] = out[donor[has]]
        empty = empty[~has]
    if len(empty):  # sets of very few shingles: the next filled bucket round the circle
        at = np.flatnonzero(filled)
        base = empty - empty % REGISTERS
        first = np.searchsorted(at, base)
        nxt = np.searchsorted(at, empty)
        wrap = (nxt >= len(at)) | (at[np.minimum(nxt, len(at) - 1)] >= base + REGISTERS)
        out[empty] = out[at[np.where(wrap, first, np.minimum(nxt, len(at) - 1))]]
    return out.reshape(-1, REGISTERS)


def mix_order(values: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Scale hashes inside their bucket to the whole 64-bit range, keeping their order (up to rounding)."""
    low = (bucket << np.uint64(32)) // np.uint64(REGISTERS)
    inside = values - (low << np.uint64(32))
    return inside * np.uint64(REGISTERS)


def _bands(regs: np.ndarray, percent: int) -> np.ndarray:
    """A hash of the registers of each band, different for different bands."""
    count, rows = bands_of(percent)
    padded = np.zeros((len(regs), count, ROWS), np.uint16)
    padded[:, :, :rows] = regs[:, : count * rows].reshape(len(regs), count, rows)
    parts = padded.view(np.uint64)
    return mix(mix(parts[:, :, 0] + np.arange(1, count + 1, dtype=np.uint64)) + parts[:, :, 1]).view(np.int64)


def _sign(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            sets = shingle_sets(block.column(0))
            bands = iter(_bands(registers([s for s in sets if len(s)]), percent))
            cols = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([block.column(1), block.column(2), *cols], names=["id", "row", "n", "node", "bands"])

    return run


def _sets(percent: int):
    """Full sets with their bands and the registers for the estimate, where the text is one of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            sets = shingle_sets(block.column(0))
            keep = np.flatnonzero([xxhash.xxh3_128_digest(s.tobytes()) == node for s, node in zip(sets, block.column(1).to_pylist(), strict=True)])
            sets = [sets[i] for i in keep]
            regs = registers(sets)
            sample = np.ascontiguousarray(regs[:, :: REGISTERS // SAMPLE])
            cols = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (_bands(regs, percent), sample, sets)]
            yield pa.RecordBatch.from_arrays([block.column(1).take(pa.array(keep)), *cols], names=["node", "bands", "sig", "shingles"])

    return run


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance collisions."""
    return ((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION)


def _floor(percent: int) -> float:
    least = percent / 100
    return least - SLACK * (least * (1 - least) / SAMPLE) ** 0.5


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Pairs ``node, leader`` with the registers and full sets of both: estimate, then confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SAMPLE) for i in (2, 3)]
            hopeful = estimate(*sigs) >= _floor(percent)
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                keep.append((bool(hopeful[i]) or min(len(a), len(b)) < FEW) and _linked(a, b, percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    """Members outside a band's largest component against a block of all its members: at most one link for each member
    and component it reaches."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, comp = group["node"].to_pylist(), group["comp"].to_pylist()
        side = group["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        bands = np.frombuffer(b"".join(group["bands"].to_pylist()), np.int64).reshape(len(node), -1)
        sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(len(node), SAMPLE)
        _, part = np.unique(np.array(comp, object), return_inverse=True)
        root = list(range(int(part.max()) + 1)) if len(part) else []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        here, band = np.flatnonzero(side == 1), key[0].as_py()
        out = []
        for i in np.flatnonzero(side == 0).tolist():
            able = (part[here] != part[i]) & (np.minimum(size[here], size[i]) * 100 >= percent * np.maximum(size[here], size[i]))
            can = here[able]
            same = bands[can] == bands[i]  # a pair is looked at in the first band that it shares
            can = can[(bands[i][same.argmax(axis=1)] == band) & same.any(axis=1)] if len(can) else can
            few = np.minimum(size[can], size[i]) < FEW
            can = can[few | (estimate(sigs[can], sigs[i][None]) >= _floor(percent))]
            for j in can.tolist():
                x, y = find(part[i]), find(part[j])
                if x != y and _linked(sets[i], sets[j], percent):
                    root[y] = x
                    out.append((node[i], node[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, comp`` for every node of edges ``a, b`` that has a neighbour; comp is one node of its component, the same
    for all. Each round sends every node to the neighbour (or itself) that is first in an order of the round's own and
    joins what now goes by one name, so even a long chain shrinks by a share each time. Two tables are written a round;
    as joins read written tables, a node of very many edges can be split."""
    steps: list[DataFrame] = []
    now = scratch.write(edges.select("a", "b").filter("a <> b"), "edges")
    while not now.isEmpty():
        level = F.lit(len(steps))
        order = lambda c: F.struct(F.xxhash64(c, level).alias("h"), F.col(c).alias("to"))
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        step = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("node"), F.least(order("u"), F.col("m"))["to"].alias("comp"))
        steps.append(scratch.write(step, "step"))
        left, right = (steps[-1].select(F.col("node").alias(f"{s}_of"), F.col("comp").alias(s)) for s in ("x", "y"))
        met = now.join(left, F.col("a") == F.col("x_of")).select("x", "b").join(right, F.col("b") == F.col("y_of")).filter("x <> y")
        last, now = now, scratch.write(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(last)
    scratch.drop(now)
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    out = steps.pop()
    while steps:
        out = _follow(steps.pop(), out)
    return out


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """Names of ``first`` renamed once more by ``then`` where it knows them."""
    more = then.select(F.col("node").alias("_m_then"), F.col("comp").alias("_m_comp"))
    return first.join(more, F.col("comp") == F.col("_m_then"), "left").select("node", F.coalesce("_m_comp", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Group documents that links connect: pairs whose shingle sets have ``100 * intersection >= percent * union``.
    Adds ``n_shingles``, ``component_id`` (smallest id reachable, itself included) and ``kept`` (id = component).

    Null, empty or blank texts have no shingles and no links. Rows with one id count as one document with several texts;
    a null id is smaller than all others. Output columns replace input columns of the same name, others pass through.
    An empty table gives an empty result. Shingles are 64-bit hashes, sets are told apart by 128 bits.

    Documents with equal sets form a class of which only one member goes on, whatever the number of copies. Band rows are
    counted before the shuffle, and joins read written tables on the narrow side, so that a band or a leader of very many
    members can be split. The texts are read twice: to sign them, and for the full sets of those that share a band.
    """
    scratch = Scratch(docs.sparkSession)
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID).cast("long"))
    keyed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_m_text"), id_.alias("_m_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_m_row"))
    signed = scratch.write(keyed.mapInArrow(_sign(percent), "id long, row long, n long, node binary, bands array<long>"), "signed")
    # an id with several texts ties their classes together
    several = signed.filter("node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select(F.col("id").alias("of"), "a")
    ties = signed.filter("node is not null").join(scratch.write(several, "several"), F.col("id") == F.col("of")).select("a", F.col("node").alias("b"))
    classes = scratch.write(signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "row", "bands")).alias("first"), F.count("*").alias("copies")).select("node", "first.*", "copies"), "classes")
    comps = _components(keyed, classes, ties, percent, scratch)

    linked = classes.select("node", "copies").join(comps.select(F.col("node").alias("of"), "comp"), F.col("node") == F.col("of"), "left")
    grouped = scratch.write(linked.filter("copies > 1 or comp is not null").select(F.col("node").alias("of"), F.coalesce("comp", "node").alias("comp")), "grouped")
    members = scratch.write(signed.join(grouped, F.col("node") == F.col("of")).select("id", "comp"), "members")
    lowest = scratch.write(members.groupBy("comp").agg(F.min("id").alias("low")).withColumnRenamed("comp", "its"), "lowest")
    groups = members.join(lowest, F.col("comp") == F.col("its")).groupBy("id").agg(F.min("low").alias("low"))
    sizes = signed.groupBy("id").agg(F.max("n").alias("_m_n"))
    found = sizes.join(groups.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select(F.col("id").alias("_m_of"), "_m_n", F.coalesce("low", "id").alias("_m_comp"))
    found = scratch.keep(found, "found")
    out = docs.withColumn("_m_id", id_).join(found, F.col("_m_id") == F.col("_m_of"))
    out = with_columns(out, n_shingles=F.col("_m_n"), component_id=F.nullif("_m_comp", F.lit(NULL_ID).cast("long")), kept=F.col("_m_comp") == F.col("_m_id"))
    return out.drop("_m_id", "_m_of", "_m_n", "_m_comp")


def _components(keyed: DataFrame, classes: DataFrame, ties: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``node, comp`` of all classes that links or ties connect with others."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = scratch.write(rows.groupBy("band").agg(F.count("*").alias("company")).filter("company > 1").withColumnRenamed("band", "bucket"), "buckets")
    placed = scratch.write(rows.join(shared, F.col("band") == F.col("bucket")).select("node", "bucket", "company"), "placed")
    # the node with most company leads a bucket; an order of the bucket's own gives a second leader
    central = scratch.write(placed.groupBy(F.col("node").alias("member")).agg(F.sum("company").alias("central")), "central")
    order = F.struct(F.xxhash64("node", "bucket").alias("h"), "node")
    heads = placed.join(central, F.col("node") == F.col("member")).groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("first"), F.min(order).alias("second"))
    heads = scratch.write(heads.select(F.col("bucket").alias("headed"), F.array_distinct(F.array("first.node", "second.node")).alias("heads")), "heads")
    met = placed.join(heads, F.col("bucket") == F.col("headed")).select("node", F.explode("heads").alias("leader")).filter("node <> leader")
    best = met.groupBy("node", "leader").agg(F.count("*").alias("n")).groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "leader")), False), 1, LEADERS).alias("best"))
    best = scratch.write(best.select("node", F.explode("best.leader").alias("leader")), "best")

    # full sets of what shares a band: texts of the first documents of those classes
    wanted = central.join(classes.select("node", "id", "row"), F.col("member") == F.col("node")).select("id", "row", "node")
    wanted = small_enough(scratch.write(wanted, "wanted"), 176)  # measured: that much a row once it is broadcast
    found = keyed.join(wanted, (F.col("_m_id") == F.col("id")) & (F.col("_m_row") == F.col("row"))).select("_m_text", "node")
    found = found.mapInArrow(_sets(percent), "node binary, bands binary, sig binary, shingles binary")
    sets = scratch.write(found.dropDuplicates(["node"]), "sets")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("shingles").alias(f"set_{s}"))
    pairs = best.join(side("l"), F.col("node") == F.col("l")).join(side("r"), F.col("leader") == F.col("r"))
    links = pairs.select("node", "leader", "sig_l", "sig_r", "set_l", "set_r").mapInArrow(_confirm(percent), "a binary, b binary")
    comps = scratch.write(components(links.unionByName(ties), scratch), "first-components")

    labelled = placed.join(comps.select(F.col("node").alias("of"), "comp"), F.col("node") == F.col("of"), "left").select("node", "bucket", F.coalesce("comp", "node").alias("comp"))
    labelled = scratch.write(labelled, "labelled")
    shares = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all")).filter("main.n < all")
    mixed = scratch.write(mixed.select(F.col("bucket").alias("band"), F.col("main.comp").alias("main"), "all", (F.col("all") - F.col("main.n")).alias("others")), "mixed")
    rest = labelled.join(mixed, F.col("bucket") == F.col("band"))
    rows, columns = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("others", "all"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = rest.filter("comp <> main").select("band", "node", "comp", F.lit(0).alias("side"), own(rows).alias("i"), cells(columns).alias("j"))
    inside = rest.select("band", "node", "comp", F.lit(1).alias("side"), own(columns).alias("j"), cells(rows).alias("i")).select(outside.columns)
    asked = outside.unionByName(inside).join(sets.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
    more = asked.groupBy("band", "i", "j").applyInArrow(_compare(percent), "a binary, b binary")
    comp_of = lambda s: comps.select(F.col("node").alias(f"of_{s}"), F.col("comp").alias(f"comp_{s}"))
    across = more.distinct().join(comp_of("a"), F.col("a") == F.col("of_a"), "left").join(comp_of("b"), F.col("b") == F.col("of_b"), "left")
    later = components(across.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")), scratch)
    later = scratch.write(later, "later-components")
    # components joined later get their new name; nodes that stood alone until then are in the later ones only
    alone = later.join(comps.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_anti")
    return _follow(comps, later).unionByName(alone)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def brute_force(docs: list[tuple], percent: int = 85) -> list[tuple]:
    """The result of op2 by comparing all pairs that share a shingle (for tests)."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = {}, {}
    for d, text in docs:
        w = (text or "").translate(upper).encode().split()
        sets[d] = frozenset(tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))) if w else frozenset()
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, own in sets.items():
        for e in {e for s in own for e in holders[s] if e < d}:
            both = len(own & sets[e])
            if 100 * both >= percent * (len(own) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]
