"""Language-model scores: a hidden Markov model trained by Baum-Welch over all training text, texts scored by its exact likelihood.

Words are dealt to ``CLASSES`` classes by hash. In state s a word w has probability base(w) * P(class of w | s) / base(class of w),
where base is the smoothed share of w in all training tokens, counted exactly. So the words of any vocabulary keep probabilities
of their own, which sum to one in each state, while what is trained and broadcast has a size of its own: states times classes.
Words unseen in training are one class, as likely in every state as in base.

Work is dealt in blocks of documents. A block is written once: the tokens as places in its list of distinct words, and 96-bit
hashes of those words. From this table all else is read. Each round of Baum-Welch adds up expected counts inside a task, then
over tasks in two steps. Word counts meet the blocks by one shuffle of distinct words a block, summed in a window by word, and come
back to their block by another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_blocks, word_hashes, words_of
from .markov import Chain, Sequences

STATES, ROUNDS = 8, 5
CLASSES = 1 << 15
#: The classes of the end of a text and of words unseen in training; words of the training text have the others.
END, UNSEEN, WORDS = 0, 1, 2
#: Tokens that base's share of a class counts for in each state.
PRIOR = 2000.0
#: Moves that are added to each count of moves between states.
MOVES = 0.5
BLOCK = 8 << 20
NULL_ID = -(2**63)

_KINDS = {k: np.dtype(v) for k, v in {"ids": "<i8", "held": "?", "sizes": "<i4", "tokens": "<u4", "high": "<u8", "low": "<u4", "trained": "<u4"}.items()}
_CODED = "block long, ids binary, held binary, sizes binary, tokens binary, high binary, low binary, trained binary"


def held_out(id_: Column) -> Column:
    """crc32 of the decimal id, modulo 5, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _packed(values: np.ndarray) -> bytes:
    """The number of values and their bytes, compressed."""
    return np.int64(len(values)).tobytes() + (pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little") * kind.itemsize
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, whether held out, tokens a document, tokens, hashes of the distinct words, and how often each
    stands in training text. Distinct word 0 is the end."""
    number = TaskContext.get().partitionId() << 32
    for block in text_blocks(batches, 0, BLOCK):
        index, offsets, distinct = words_of(pc.ascii_lower(block.column(0)))
        n = len(distinct) + 1
        tokens = np.insert(index.astype(np.int64) + 1, offsets[1:], 0)
        sizes = np.diff(offsets) + 1
        held = block.column(2).to_numpy(zero_copy_only=False)
        trained = np.bincount(tokens[~np.repeat(held, sizes)], minlength=n)
        high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        high[1:], low[1:] = word_hashes(distinct, 0), word_hashes(distinct, 1).astype(np.uint32)
        ids = block.column(1).to_numpy(zero_copy_only=False)
        values = {"ids": ids, "held": held, "sizes": sizes, "tokens": tokens, "high": high, "low": low, "trained": trained}
        packed = [pa.array([_packed(values[c].astype(k))], pa.binary()) for c, k in _KINDS.items()]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *packed], names=["block", *_KINDS])
        number += 1


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, one at a time."""
    for i in range(batch.num_rows):
        out = {}
        for name in batch.schema.names:
            value = batch.column(name)[i].as_py()
            out[name] = _unpacked(value, _KINDS[name]) if name in _KINDS else value
        yield out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a block."""
    for batch in batches:
        for b in _read(batch):
            n = len(b["high"])
            cols = [pa.array(np.full(n, b["block"]), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(b["high"].view(np.int64)), pa.array(b["low"].view(np.int32)), pa.array(b["trained"].astype(np.int64))]
            for a in range(0, n, 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 50_000) for c in cols], names=["block", "place", "high", "low", "n"])


def class_of(high: np.ndarray) -> np.ndarray:
    """Classes of distinct words of a block, the first of which is the end."""
    out = WORDS + (high % np.uint64(CLASSES - WORDS)).astype(np.int64)
    out[:1] = END
    return out


def _trained(b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a block's training texts, and where each starts."""
    ends = np.cumsum(b["sizes"])
    mine = np.repeat(~b["held"], b["sizes"])
    return class_of(b["high"])[b["tokens"][mine]], np.concatenate(([0], np.cumsum(b["sizes"][~b["held"]]))) if len(ends) else np.zeros(1, np.int64)


def _expected(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in _read(batch):
                symbols, offsets = _trained(b)
                if len(symbols):
                    c = Sequences(symbols, offsets).counts(chain.value)
                    flat = np.concatenate(([c.log], c.start, c.move.ravel(), c.emit.ravel()))
                    total = flat if total is None else total + flat
        if total is not None:
            # a task's counts travel in single precision, sums in double
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["counts"])

    return run


def _summed(kind: type):
    """Vectors of numbers, added up in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                flat = np.frombuffer(x, kind).astype(np.float64)
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def add_up(vectors: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of one vector a task: over about as many tasks as the square root of their number, then over those."""
    width = max(1, math.isqrt(tasks))
    once = vectors.repartition(width).mapInArrow(_summed(np.float32), "counts binary")
    found = once.repartition(1).mapInArrow(_summed(np.float64), "counts binary").collect()  # one row
    return np.frombuffer(found[0].counts) if found else None


class Base(NamedTuple):
    """Training tokens, distinct ones, and the share of each class of words, of the end, and of all unseen words together."""

    tokens: int
    distinct: int
    shares: np.ndarray

    @property
    def scale(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def logs(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the share of words that occur so often."""
        return np.log10((counts + 0.5) / self.scale)


def base_of(by_class: list[tuple[int, int, int]]) -> Base:
    """From class, tokens and distinct tokens."""
    tokens, distinct, sums = sum(t for _, t, _ in by_class), sum(d for _, _, d in by_class), np.zeros(CLASSES)
    for c, t, d in by_class:
        sums[c] = t + 0.5 * d
    sums[UNSEEN] = 0.5
    return Base(tokens, distinct, sums / (tokens + 0.5 * (distinct + 1)))


def maximised(counts: np.ndarray, states: int, base: Base, prior: float = PRIOR) -> Chain:
    """The model that expected counts and prior call for. Emissions are ratios to base: 1 for unseen words and for classes
    without words; so in each state base times ratio sums to one over all words."""
    start, move, emit = counts[1 : 1 + states], counts[1 + states : 1 + states + states**2].reshape(states, states), counts[1 + states + states**2 :].reshape(states, -1)
    known = base.shares.copy()
    known[UNSEEN] = 0
    seen = 1 - base.shares[UNSEEN]
    share = seen * (emit + prior * known / seen) / (emit.sum(1, keepdims=True) + prior)
    ratio = np.ones_like(share)
    np.divide(share, known, out=ratio, where=known > 0)
    return Chain((start + MOVES) / (start + MOVES).sum(), (move + MOVES) / (move + MOVES).sum(1, keepdims=True), np.ascontiguousarray(ratio.T))


def first_model(states: int, base: Base, seed: int = 1) -> Chain:
    """States that mostly stay and differ from base by chance."""
    noise = np.exp(np.random.default_rng(seed).normal(size=(states, CLASSES)))
    noise[:, UNSEEN] = 1
    known = base.shares.copy()
    known[UNSEEN] = 0
    if known.any():
        noise /= (noise @ known / known.sum())[:, None]
    noise[:, UNSEEN] = 1
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, np.ascontiguousarray(noise.T))


class LanguageModel(NamedTuple):
    """Trained states, what the words counted to, and the training text's log likelihood ratio before each round."""

    chain: Chain
    base: Base
    logs: list[float]


def _scored(model):
    def run(blocks: pa.Table, words: pa.Table) -> pa.Table:
        chain, base = model.value.chain, model.value.base
        out = []
        places, found = words.column("place").to_numpy(), words.column("count").to_numpy()
        for b in (b for batch in blocks.to_batches() for b in _read(batch)):
            counts = np.zeros(len(b["high"]), np.int64)
            counts[places] = found
            tokens, sizes = b["tokens"], b["sizes"]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            symbols = np.where(counts > 0, class_of(b["high"]), UNSEEN)[tokens]
            base_score = np.add.reduceat(base.logs(counts)[tokens], offsets[:-1])
            known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), offsets[:-1])
            score = base_score + Sequences(symbols, offsets).logs(chain) / math.log(10)
            out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (b["ids"], b["held"], sizes.astype(np.int64), known, np.full(len(sizes), base.tokens), base_score, score)], names=_OUT))
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], k) for n, k in zip(_OUT, _OUT_KINDS, strict=True)})

    return run


_OUT = ["_m_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_OUT_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, prior: float = PRIOR, fitted: list | None = None) -> DataFrame:
    """Train on all rows that are not held out and score every row: ``id_col, held_out, n_tokens, n_known, train_tokens,
    base_score, score``, one row for each row of ``docs``.

    Tokens are the words of a text, A-Z lower-cased, and one end. ``base_score`` takes each token by its smoothed count alone;
    ``score`` is log10 of the probability of the whole text under the model, summed over all ways through the states. Null and
    empty texts are one end; rows that share an id, or have none, are texts of their own. Other columns are left out, whatever
    their names. Without training text every score is 0, and an empty table gives an empty result. ``fitted``, if given, gets
    the LanguageModel.

    A task holds one block of documents (8 MB of text, or one text) at a time; a text of any length is worked through in
    stretches. What is broadcast has states times classes numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text, id_ = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(text.alias("text"), F.coalesce(id_, F.lit(NULL_ID).cast("long")).alias("id"), held_out(id_).alias("held"))
    coded = scratch.write(rows.mapInArrow(_code, _CODED), "blocks")

    words = coded.select("block", "high", "low", "trained").mapInArrow(_words, "block long, place int, high long, low int, n long")
    same = Window.partitionBy("high", "low")
    counted = words.withColumns({"count": F.sum("n").over(same), "first": F.row_number().over(same.orderBy("block", "place")) == 1})
    # the remainder of the unsigned number; the end has the first place of a block
    rest = F.pmod(F.col("high") % (CLASSES - WORDS) + F.when(F.col("high") < 0, 2**64 % (CLASSES - WORDS)).otherwise(0), F.lit(CLASSES - WORDS))
    kind = F.when(F.col("place") == 0, END).otherwise(WORDS + rest).cast("int").alias("c")
    counted = scratch.write(counted.select("block", "place", kind, "n", "count", "first"), "counted")
    by_class = counted.groupBy("c").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("first") & (F.col("count") > 0), 1).otherwise(0)).alias("d"))
    base = base_of([(r.c, r.t, r.d) for r in by_class.collect()])  # a row a class

    chain, logs = first_model(states, base), []
    read = coded.select("sizes", "held", "tokens", "high")
    tasks = read.rdd.getNumPartitions()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(chain)
        counts = add_up(read.mapInArrow(_expected(sent), "counts binary"), tasks)
        sent.unpersist()
        if counts is None:
            break
        logs.append(float(counts[0]))
        chain = maximised(counts, states, base, prior)
    model = LanguageModel(chain, base, logs)
    if fitted is not None:
        fitted.append(model)
    sent = spark.sparkContext.broadcast(model)
    kinds = "_m_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    tokens, places = coded.select("block", "ids", "held", "sizes", "tokens", "high").groupBy("block"), counted.select("block", "place", "count").groupBy("block")
    out = tokens.cogroup(places).applyInArrow(_scored(sent), kinds)
    out = scratch.keep(out, "scores")
    return out.select(F.nullif("_m_id", F.lit(NULL_ID).cast("long")).alias(id_col), *_OUT[1:])


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
