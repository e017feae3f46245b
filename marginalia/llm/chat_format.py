"""Chat formatting: whole transcripts are parsed by a hidden Markov model and Viterbi, then written in chat markup.

A transcript is all lines of a conversation, turn by turn. The hidden state of a line is who speaks and whether the line
opens a message; seen are a speaker label at its start, its size, a question mark, and the role that the table gives its
turn, which may be missing or unknown. Sizes, question marks and the order of speakers are counted over all turns whose
role is known; labels and given roles have fixed odds. A turn opens at least one message; one that holds a pasted
transcript is cut into several.

Viterbi is a product of matrices in which sums are maxima and products are sums, and such products can be grouped: lines
are folded to a matrix a turn, turns to one a chunk of turn numbers, chunks to the best way through the conversation. So a
conversation of any length is dealt over tasks and still decoded as a whole; texts are shuffled once, to be written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators.ranks import ranked
from marginalia.sources.folders import dropped

from .common import Scratch, table, text_blocks

ROLES = ("system", "user", "assistant")
ALIASES = {
    "system": ("system", "developer"),
    "user": ("user", "human", "prompter", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a"),
}
_ROLE_OF = {word: i for i, role in enumerate(ROLES) for word in ALIASES[role]}
_WORDS = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
LABEL = rf"(?i)^[ \t]*(?:<\|im_start\|>[ \t]*({_WORDS})[ \t\r]*$|[\[<(#*_ \t]*({_WORDS})[\])>*_ \t]*:[*_]*[ \t]?)"
_LABEL = re.compile(LABEL)
_CLOSE = re.compile(r"\s*<\|im_end\|>\s*$")
UNKNOWN, START = 3, 3
#: Numbers of turns that are folded in one go.
CHUNK = 128
NULL_ID = -(2**63)
_SIZES = 12
_CODES = 2 * _SIZES


def _odds(none: float, own: float, other: float) -> np.ndarray:
    """Logarithms for a speaker (row) of no label, then of each speaker's label."""
    return np.log(np.array([[none, *(own if i == j else other for j in range(3))] for i in range(3)]))


#: Labels where a turn opens, where a message opens inside a turn, and where a message goes on.
_AT_TURN, _INSIDE, _GOING_ON = _odds(0.9, 0.0998, 0.0001), _odds(0.02, 0.9798, 0.0001), _odds(0.9999, 0.00003, 0.00003)
#: A given role (row; the last one is no or an unknown role) under each speaker, and a message that goes on or ends.
_GIVEN = np.log(np.array([[0.999 if i == j else 0.0005 for j in range(3)] for i in range(3)] + [[1.0] * 3]))
_STAY, _LEAVE = np.log(0.98), np.log(0.02)


class Model(NamedTuple):
    """Logarithms: speaker after speaker or start (4 x 3), and codes of lines under each speaker (3 x codes)."""

    order: np.ndarray
    turn: np.ndarray
    inside: np.ndarray
    going_on: np.ndarray


def _log_share(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum(axis=-1, keepdims=True))


#: What speakers after speakers (system, user, assistant, start) count for before any is seen: a system speaks first or not at all,
#: a user opens, user and assistant take turns.
_ORDER_PRIOR = np.array([[0.1, 9.0, 0.9], [0.1, 2.0, 7.9], [0.1, 7.9, 2.0], [2.0, 7.5, 0.5]])
#: What a size of a line counts for before any is seen: users ask, assistants write longer lines.
_SIZE = np.repeat(np.arange(_SIZES), 2)
_ASKS = np.tile([False, True], _SIZES)
_SAID_PRIOR = 0.5 * np.stack([np.ones(_CODES), np.where(_ASKS, 2.0, 1.0), np.where(_SIZE > 6, 1.5, 1.0)])


def model_of(order: np.ndarray, opening: np.ndarray, going_on: np.ndarray) -> Model:
    """From counts of speakers after speakers (4 x 3), and of size codes by speaker (3 x 24 each)."""
    order, said, on = order + _ORDER_PRIOR, _log_share(opening + _SAID_PRIOR), _log_share(going_on)
    with_label = lambda odds, codes: (odds[:, :, None] + codes[:, None, :]).reshape(3, -1)
    return Model(_log_share(order), with_label(_AT_TURN, said), with_label(_INSIDE, said), with_label(_GOING_ON, on))


def line_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A code for each line of texts without nulls, where each text's lines start, and the lines."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    size = np.minimum(np.frexp(pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.float64))[1], _SIZES - 1)
    asks = pc.match_substring(lines, "?").to_numpy(zero_copy_only=False)
    codes = (size * 2 + asks).astype(np.uint8)
    for i in np.flatnonzero(pc.match_substring_regex(lines, LABEL).to_numpy(zero_copy_only=False)).tolist():
        found = _LABEL.match(lines[i].as_py())
        if found:
            codes[i] += _CODES * (1 + _ROLE_OF[(found[1] or found[2]).lower()])
    return codes, offsets - offsets[0], lines


def chain(sizes: np.ndarray, first: np.ndarray, step: Callable) -> np.ndarray:
    """Best scores from each state before to each state at the end; sizes fall, ``step(i, m)`` has the i-th matrices of
    the first m chains."""
    out = first.copy()
    for i in range(1, int(sizes[0])):
        m = int(np.searchsorted(-sizes, -i))
        out[:m] = (out[:m, :, :, None] + step(i, m)[:, None]).max(axis=2)
    return out


def trace(sizes: np.ndarray, first: np.ndarray, step: Callable, last: np.ndarray) -> np.ndarray:
    """The best states of each chain (a row, as long as the longest) that starts with scores first and ends in last."""
    score, back = first.copy(), []
    for i in range(1, int(sizes[0])):
        m = int(np.searchsorted(-sizes, -i))
        both = score[:m, :, None] + step(i, m)
        back.append(both.argmax(axis=1).astype(np.uint8))
        score[:m] = both.max(axis=1)
    out = np.zeros((len(sizes), int(sizes[0])), np.uint8)
    out[np.arange(len(sizes)), sizes - 1] = last
    for i in range(len(back), 0, -1):
        m = len(back[i - 1])
        out[:m, i - 1] = back[i - 1][np.arange(m), out[:m, i]]
    return out


class _Turns:
    """The lines of several turns as chains, longest first."""

    def __init__(self, model: Model, codes: np.ndarray, offsets: np.ndarray, given: np.ndarray):
        self.sizes = np.diff(offsets)
        self.by_size = np.argsort(-self.sizes, kind="stable")
        self.sizes, self.start, given = self.sizes[self.by_size], offsets[:-1][self.by_size], given[self.by_size]
        self.model, self.codes, self.given = model, codes, _GIVEN[given]
        self.first = model.order[None] + (model.turn[:, codes[self.start]].T + self.given)[:, None]

    def moves(self, i: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of opening a message after each speaker (3 x 3), and of going on."""
        code = self.codes[self.start[:m] + i]
        opened = _LEAVE + self.model.order[None, :3] + (self.model.inside[:, code].T + self.given[:m])[:, None]
        return opened, _STAY + self.model.going_on[:, code].T + self.given[:m]

    def step(self, i: int, m: int) -> np.ndarray:
        out, on = self.moves(i, m)
        for r in range(3):
            out[:, r, r] = np.maximum(out[:, r, r], on[:, r])
        return out

    def matrices(self) -> np.ndarray:
        out = np.empty((len(self.sizes), 4, 3))
        out[self.by_size] = chain(self.sizes, self.first, self.step)
        return out

    def speakers(self, before: np.ndarray, after: np.ndarray) -> tuple[list, list]:
        """Speaker of each line and whether it opens a message, a list a turn."""
        before, after = before[self.by_size], after[self.by_size]
        who = trace(self.sizes, self.first[np.arange(len(before)), before], self.step, after)
        opens = np.ones(who.shape, bool)
        for i in range(1, who.shape[1]):
            m = int(np.searchsorted(-self.sizes, -i))
            at, now = np.arange(m), who[:m, i]
            opened, on = self.moves(i, m)
            opens[:m, i] = (who[:m, i - 1] != now) | (opened[at, now, now] > on[at, now])
        place = np.argsort(self.by_size)
        return [who[p, : self.sizes[p]] for p in place], [opens[p, : self.sizes[p]] for p in place]


def _given(role: pa.Array) -> np.ndarray:
    return np.array([_ROLE_OF.get((r or "").strip().lower(), UNKNOWN) for r in role.to_pylist()], np.int8)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, 0):
        codes, offsets, _ = line_codes(block.column(0))
        whole = codes.tobytes()
        seen = pa.array([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*block.columns[2:], pa.array(_given(block.column(1)).astype(np.int32)), seen], names=["conv", "at", "tie", "given", "seen"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((3, 2, _CODES), np.int64)
    for batch in batches:
        for given, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = np.frombuffer(seen, np.uint8) % _CODES
            sums[given, 0, codes[0]] += 1
            sums[given, 1] += np.bincount(codes[1:], minlength=_CODES)
    yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names=["sums"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Sizes of lists of structs, and the flat fields."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().flatten()


def _doubles(values: pa.Array, modes: int, mode: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, modes, 4, 3)[:, mode]


class _Chains:
    """Matrices of several lists as chains, longest first."""

    def __init__(self, sizes: np.ndarray, matrices: np.ndarray):
        self.by_size = np.argsort(-sizes, kind="stable")
        self.sizes, self.start, self.matrices = sizes[self.by_size], (np.cumsum(sizes) - sizes)[self.by_size], matrices
        self.first = matrices[self.start]

    def step(self, i: int, m: int) -> np.ndarray:
        return self.matrices[self.start[:m] + i, :3]

    def products(self) -> np.ndarray:
        out = np.empty((len(self.sizes), 4, 3))
        out[self.by_size] = chain(self.sizes, self.first, self.step)
        return out

    def states(self, before: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The state before and the state at the end of each member, flat."""
        before = before[self.by_size]
        if after is None:
            after = self.products()[self.by_size, before].argmax(axis=1)
        else:
            after = after[self.by_size]
        path = trace(self.sizes, self.first[np.arange(len(before)), before], self.step, after)
        out = np.empty((2, len(self.matrices)), np.int32)
        for p, (a, n) in enumerate(zip(self.start.tolist(), self.sizes.tolist(), strict=True)):
            out[1, a : a + n] = path[p, :n]
            out[0, a], out[0, a + 1 : a + n] = before[p], path[p, : n - 1]
        return out[0], out[1]


def _fold(model: Model, modes: int):
    """Turns of a chunk: their matrices, and the product; in a second mode as if no role were given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, (at, tie, given, seen) = _lists(batch.column(2))
            lines = np.concatenate(([0], np.cumsum(pc.binary_length(seen).to_numpy(zero_copy_only=False).astype(np.int64))))
            codes = np.frombuffer(b"".join(seen.to_pylist()), np.uint8)
            known = given.to_numpy(zero_copy_only=False)
            matrices = [_Turns(model, codes, lines, g).matrices() for g in (known, np.full_like(known, UNKNOWN))[:modes]]
            products = [_Chains(sizes, m).products() for m in matrices]
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            turns = pa.StructArray.from_arrays([at, tie, _listed(matrices)], names=["at", "tie", "scores"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, turns), _listed(products)], names=["conv", "chunk", "turns", "product"])

    return run


def _listed(modes: list[np.ndarray]) -> pa.ListArray:
    """A list of all modes' scores for each member."""
    flat = np.stack(modes, 1).reshape(len(modes[0]), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _ends(modes: int):
    """Chunks of a conversation: for each mode the speakers before and at the end of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes, (chunk, product) = _lists(batch.column(1))
                found = [x for m in range(modes) for x in _Chains(sizes, _doubles(product, modes, m)).states(np.full(len(sizes), START))]
                conv = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))
                yield pa.RecordBatch.from_arrays([conv, chunk, *map(pa.array, found)], names=["of", "part", *_END_NAMES[: 2 * modes]])

    return run


def _decode(modes: int):
    """Turns of a chunk: for each mode the speakers before and at the end of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes, (at, tie, scores) = _lists(batch.column(1))
                ends = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 2 + 2 * modes)]
                found = [x for m in range(modes) for x in _Chains(sizes, _doubles(scores, modes, m)).states(*ends[2 * m : 2 * m + 2])]
                conv = pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))
                yield pa.RecordBatch.from_arrays([conv, at, tie, *map(pa.array, found)], names=["of", "of_at", "of_tie", *_END_NAMES[: 2 * modes]])

    return run


_END_NAMES = ("before", "after", "before_unseen", "after_unseen")


def markup(role: str, said: str) -> str:
    """A message in chat markup; what could be taken for markup is escaped, and ``<\\`` with it, so that it can be undone."""
    return f"<|im_start|>{role}\n" + said.replace("<\\", "<\\\\").replace("<|", "<\\|") + "<|im_end|>\n"


def _write(model: Model, modes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            codes, offsets, lines = line_codes(block.column(0))
            given = _given(block.column(1))
            ends = [block.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)]
            who, opens = _Turns(model, codes, offsets, given).speakers(*ends)
            unseen = who
            if modes == 2:
                unseen, _ = _Turns(model, codes, offsets, np.full_like(given, UNKNOWN)).speakers(*[block.column(i).to_numpy(zero_copy_only=False) for i in (6, 7)])
            said, out = lines.to_pylist(), []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                cuts = [*np.flatnonzero(opens[k]).tolist(), b - a]
                for part, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    role, mine = int(who[k][i]), said[a + i : a + j]
                    if given[k] == UNKNOWN and codes[a + i] // _CODES == role + 1:
                        marked = _LABEL.match(mine[0])
                        mine = mine[1:] if marked[1] else [mine[0][marked.end() :], *mine[1:]]
                        text = _CLOSE.sub("", "\n".join(mine)) if marked[1] else "\n".join(mine)
                    else:
                        text = "\n".join(mine)
                    out.append((k, part, ROLES[role], j - i, text, markup(ROLES[role], text), ROLES[role] == "assistant", ROLES[unseen[k][i]]))
            k, part, role, n, text, chat, learned, other = zip(*out, strict=True)
            k = pa.array(k)
            yield pa.RecordBatch.from_arrays(
                [block.column(2).take(k), block.column(3).take(k), pa.array(part, pa.int32()), pa.array(role), pa.array(n, pa.int32()), pa.array(text), pa.array(chat), pa.array(learned), pa.array(other)],
                names=["conv_id", "turn", "part", "role", "n_lines", "text", "chat", "learned", "role_unseen"],
            )

    return run


def _learn(observed: DataFrame, grouped: DataFrame) -> Model:
    """Counts over all turns of known role; speakers are counted after their neighbour in order, whatever the chunk."""
    sums = np.zeros((3, 2, _CODES))
    # a row a task, added up before it is collected
    counted = observed.filter(F.col("given") < UNKNOWN).select("given", "seen").mapInArrow(_count, "sums array<long>")
    for r in counted.select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        sums[np.unravel_index(r.i, sums.shape)] = r.n
    along = Window.partitionBy("conv").orderBy("chunk")
    roles = grouped.select("conv", "chunk", F.col("turns.given").alias("g"))
    roles = roles.withColumn("before", F.coalesce(F.lag(F.element_at("g", -1)).over(along), F.lit(START + 1)))
    pairs = roles.select(F.explode(F.zip_with(F.concat(F.array("before"), F.slice("g", 1, F.size("g") - 1)), "g", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    order = np.zeros((4, 3))
    for r in pairs.groupBy("p.a", "p.b").count().collect():  # at most twenty rows
        if r.b != UNKNOWN and r.a != UNKNOWN:
            order[min(r.a, START), r.b] = r["count"]
    return model_of(order, sums[:, 0], sums[:, 1])


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK, unseen: bool = False) -> DataFrame:
    """Messages ``conv_id, turn, part, role, n_lines, text, chat, learned``, in order of turn and part: ``chat`` is the
    message in markup, ``learned`` says whether a model should learn to write it (the assistant's). With ``unseen`` a second
    decoding withholds every given role: ``role_unseen`` is the role that the lines and their order alone give a message.

    Null texts are empty, null ids and turns sort before all others, rows that are equal in all four columns count once;
    rows that share a turn follow each other in the order of a hash. Labels are taken off messages they open, where the
    table gives no known role; a turn of known role keeps its text byte for byte. Columns other than those four are left
    out, whatever their names. An empty table gives an empty result.

    Turns are ranked by a prefix sum and folded ``chunk`` at a time, so a conversation of any length, and any number of rows without
    id or turn, spreads over tasks.
    """
    low, modes = F.lit(NULL_ID).cast("long"), 1 + unseen
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.col(role_col).cast("string")
    keyed = rows.select(text.alias("text"), role.alias("role"), F.coalesce(F.col(id_col).cast("long"), low).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), low).alias("at"), F.xxhash64(text, role).alias("tie"))
    scratch = Scratch(rows.sparkSession)
    observed = scratch.write(keyed.mapInArrow(_observe, "conv long, at long, tie long, given int, seen binary"), "observed").dropDuplicates(["conv", "at", "tie"])
    placed = ranked(observed, ["conv"], ["at", "tie"])
    piece = F.floor(F.col("_rn") / chunk).cast("long").alias("chunk")
    grouped = placed.groupBy("conv", piece).agg(F.array_sort(F.collect_list(F.struct("at", "tie", "given", "seen"))).alias("turns"))
    grouped = scratch.write(grouped, "transcripts")
    dropped(placed)
    model = _learn(observed, grouped)
    ends = ", ".join(f"{c} int" for c in _END_NAMES[: 2 * modes])
    names = _END_NAMES[: 2 * modes]
    chunks = scratch.write(grouped.mapInArrow(_fold(model, modes), "conv long, chunk long, turns array<struct<at:long,tie:long,scores:array<double>>>, product array<double>"), "folded")
    whole = chunks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "product"))).alias("chunks"))
    met = scratch.write(whole.mapInArrow(_ends(modes), f"of long, part long, {ends}"), "ends")
    met = chunks.join(met, (F.col("conv") == F.col("of")) & (F.col("chunk") == F.col("part"))).select("conv", "turns", *names)
    speakers = scratch.keep(met.mapInArrow(_decode(modes), f"of long, of_at long, of_tie long, {ends}"), "speakers")
    once = keyed.dropDuplicates(["conv", "at", "tie"])
    placed = once.join(speakers.hint("merge"), (F.col("conv") == F.col("of")) & (F.col("at") == F.col("of_at")) & (F.col("tie") == F.col("of_tie"))).select("text", "role", "conv", "at", *names)
    out = placed.mapInArrow(_write(model, modes), "conv_id long, turn long, part int, role string, n_lines int, text string, chat string, learned boolean, role_unseen string")
    return out.withColumns({c: F.nullif(F.col(c), low) for c in ("conv_id", "turn")}).drop(*([] if unseen else ["role_unseen"]))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), unseen=True)
    digest = F.sha2(F.encode("chat", "utf-8"), 256).alias("chat_sha256")
    return found.select("conv_id", "turn", "part", "role", "n_lines", F.length("text").alias("n_chars"), digest, "learned", "role_unseen", (F.col("role") == F.col("role_unseen")).alias("agrees"))
