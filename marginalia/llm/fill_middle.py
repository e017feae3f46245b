"""Fill-in-the-middle: documents as piece tables whose pieces are cut and rearranged while the text itself stays put.

A document is a list of descriptors (buffer, start, size) over immutable buffers: buffer 0 holds the texts of a block, buffer
1 the sentinels. Cutting splits the descriptor that covers a position, an arrangement permutes the parts and puts sentinel
descriptors between them, and the inverse permutation brings them back. Bytes are read only when a digest streams over the
descriptors or a text is written out, so no arrangement copies text.

To restore a text, the same is done over the arranged text: its sentinels are found, descriptors of the parts between them
are put into the order of the inverse permutation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_blocks, with_columns

#: What marks the start of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Order of the parts prefix (0), suffix (1) and middle (2) in each form.
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
#: Order of the parts in the text itself.
IN_TEXT = (0, 2, 1)
PLAIN = "plain"
SEED = 7


class Piece(NamedTuple):
    buffer: int
    start: int
    size: int


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``at`` bytes of a document, and the rest; the descriptor that covers the place becomes two."""
    left = []
    for k, p in enumerate(pieces):
        if at <= p.size:
            first, second = Piece(p.buffer, p.start, at), Piece(p.buffer, p.start + at, p.size - at)
            return [*left, *([first] if first.size else [])], [*([second] if second.size else []), *pieces[k + 1 :]]
        left.append(p)
        at -= p.size
    if at:
        raise ValueError("cut beyond the end of a document")
    return left, []


def arrange(parts: list[list[Piece]], order: tuple[int, ...], marks: list[Piece]) -> list[Piece]:
    """The parts in the given order, each behind its mark."""
    return [p for k in order for p in (marks[k], *parts[k])]


def inverse(order: tuple[int, ...]) -> list[int]:
    """Where each part stands in the order."""
    return [order.index(k) for k in range(len(order))]


def runs(pieces: Iterable[Piece], buffers: tuple[memoryview, ...]) -> Iterator[memoryview]:
    return (buffers[p.buffer][p.start : p.start + p.size] for p in pieces)


def digest(pieces: Iterable[Piece], buffers: tuple[memoryview, ...]) -> str:
    """SHA-256 of a document, streamed over its descriptors."""
    out = hashlib.sha256()
    for run in runs(pieces, buffers):
        out.update(run)
    return out.hexdigest()


class Marks:
    """The sentinel buffer and its descriptors."""

    def __init__(self, sentinels: tuple[str, ...]):
        self.bytes = [s.encode() for s in sentinels]
        if len(set(sentinels)) != 3 or not all(self.bytes) or any(a in b for a in sentinels for b in sentinels if a != b):
            raise ValueError(f"three different sentinels, none part of another, are needed: {sentinels}")
        if any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"sentinels must not overlap: {sentinels}")
        ends = np.cumsum([len(b) for b in self.bytes]).tolist()
        self.buffer = memoryview(b"".join(self.bytes))
        self.pieces = [Piece(1, e - len(b), len(b)) for e, b in zip(ends, self.bytes, strict=True)]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The bytes of texts without nulls, and where each text starts in them (one entry more than texts). Texts may be a slice of a
    batch, whose other bytes are left alone."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).tolist()


def _holds(texts: pa.Array, marks: Marks) -> list[bool]:
    """Whether a text holds a sentinel."""
    found = [pc.match_substring(texts, b.decode()) for b in marks.bytes]
    return pc.or_(pc.or_(found[0], found[1]), found[2]).to_pylist()


def _arranged(sentinels: tuple[str, ...], rate: int, spm: int, as_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(sentinels)
        for block in text_blocks(batches, 0):
            texts = block.column(0)
            data, at = _bytes(texts)
            buffers = (memoryview(data), marks.buffer)
            ends = np.flatnonzero(data == 10) + 1  # of lines; no byte of a longer character is 10
            chars = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            out = []
            draws = zip(*(block.column(i).to_pylist() for i in range(1, 5)), strict=True)
            for a, b, held, (h1, h2, h3, h4) in zip(at[:-1], at[1:], _holds(texts, marks), draws, strict=True):
                i, j = np.searchsorted(ends, (a, b), side="right").tolist()
                n = j - i + (b > a and data[b - 1] != 10)
                pieces = [Piece(0, a, b - a)] if b > a else []
                if not pieces or held or h3 % 100 >= rate:
                    out.append((n, PLAIN, None, None, pieces))
                    continue
                # where that many lines end
                first, second = sorted(a if not k else b if i + k > j else int(ends[i + k - 1]) for k in (h1 % (n + 1), h2 % (n + 1)))
                prefix, rest = split(pieces, first - a)
                middle, suffix = split(rest, second - first)
                form = "spm" if h4 % 100 < spm else "psm"
                out.append((n, form, int(chars[first] - chars[a]), int(chars[second] - chars[first]), arrange([prefix, suffix, middle], FORMS[form], marks.pieces)))
            n, form, before, between, tables = zip(*out, strict=True)
            kinds = ((n, pa.int64()), (form, pa.string()), (before, pa.int64()), (between, pa.int64()))
            cols = [pa.array(v, k) for v, k in kinds]
            cols.append(pa.array([b"".join(runs(p, buffers)) for p in tables], pa.binary()).cast(pa.string()))
            if as_digest:
                cols.append(pa.array([digest(p, buffers) for p in tables]))
            names = ["_m_n", "_m_form", "_m_prefix", "_m_middle", "_m_output", "_m_sha"][: len(cols)]
            yield pa.RecordBatch.from_arrays([*block.columns[5:], *cols], names=[*block.schema.names[5:], *names])

    return run


def parts_of(output: memoryview, start: int, size: int, form: str, marks: Marks) -> list[Piece]:
    """Descriptors of an arranged document in the order of its text, over the buffer that holds the arranged one."""
    if form == PLAIN:
        return [Piece(0, start, size)] if size else []
    if form not in FORMS:
        raise ValueError(f"no such form: {form}")
    order, whole, at, found = FORMS[form], bytes(output[start : start + size]), 0, []
    for k in order:
        place = whole.find(marks.bytes[k], at)
        if place < 0 or not found and place:
            raise ValueError(f"a text in form {form} without its marks")
        found.append((place, at := place + len(marks.bytes[k])))
    cuts = [*(p for p, _ in found[1:]), size]
    given = [Piece(0, start + a, b - a) for (_, a), b in zip(found, cuts, strict=True)]
    back = inverse(order)
    return [given[back[k]] for k in IN_TEXT]


def _restored(sentinels: tuple[str, ...], as_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(sentinels)
        for block in text_blocks(batches, 0):
            data, at = _bytes(block.column(0))
            buffer = memoryview(data)
            forms = block.column(1).to_pylist()
            tables = [parts_of(buffer, a, b - a, form or PLAIN, marks) for a, b, form in zip(at[:-1], at[1:], forms, strict=True)]
            if as_digest:
                out = pa.array([digest(p, (buffer,)) for p in tables])
            else:
                out = pa.array([b"".join(runs(p, (buffer,))) for p in tables], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns[2:], out], names=[*block.schema.names[2:], "_m_text"])

    return run


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 that depend on nothing but the id; a null id draws like an empty one."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[f"`{c}`" for c in cols]).schema.fields)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, as_digest: bool = False
) -> DataFrame:
    """Replace ``text_col`` by ``output``, the text cut at two line ends and rearranged, with ``n`` (lines), ``form`` (``psm``,
    ``spm`` or ``plain``), ``prefix_chars`` and ``middle_chars`` (code points, null if plain), and, if asked,
    ``output_sha256``.

    ``rate`` percent of the documents are rearranged, ``spm`` percent of those with the suffix in front; cuts and forms are
    drawn from a hash of seed and id. Empty and null texts and those that hold a sentinel stay plain. Rows that share an id
    draw alike, null ids draw like an empty one. All other columns pass through, but that added ones replace those of the
    same name; an empty table gives an empty result. Nothing is shuffled; a task holds one block of texts at a time.
    """
    Marks(sentinels)  # raises here rather than in a task
    added = ["n", "form", "prefix_chars", "middle_chars", "output", *(["output_sha256"] if as_digest else [])]
    others = [c for c in docs.columns if c != text_col and c.lower() not in added]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_m_text"), *[d.alias(f"_m_draw{k}") for k, d in enumerate(draws(F.col(id_col), seed))], *[f"`{c}`" for c in others])
    kinds = f"{_kinds(docs, others)}_m_n long, _m_form string, _m_prefix long, _m_middle long, _m_output string" + ", _m_sha string" * as_digest
    out = rows.mapInArrow(_arranged(sentinels, rate, spm, as_digest), kinds)
    made = ["_m_n", "_m_form", "_m_prefix", "_m_middle", "_m_output", "_m_sha"]
    return out.select(*[f"`{c}`" for c in others], *[F.col(m).alias(c) for m, c in zip(made, added, strict=False)])


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, as_digest: bool = False) -> DataFrame:
    """Replace ``output_col`` by ``text_col``, the exact text before it was rearranged (or ``restored_sha256``, if asked), read
    from the output and its form alone. A null form counts as plain, a null output as empty; a form without its marks is an
    error. Other columns pass through."""
    name = "restored_sha256" if as_digest else text_col
    others = [c for c in rows.columns if c != output_col]
    slim = rows.select(F.coalesce(F.col(output_col), F.lit("")).alias("_m_output"), F.col(form_col).alias("_m_form"), *[f"`{c}`" for c in others])
    out = slim.mapInArrow(_restored(sentinels, as_digest), f"{_kinds(rows, others)}_m_text string")
    return with_columns(out, **{name: F.col("_m_text")}).drop("_m_text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = restore(fill_in_middle(docs, as_digest=True), as_digest=True)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS lines,
         length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 0 ELSE 1 END AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM drawn),
cut AS (
  SELECT *, CASE WHEN k1 = 0 THEN 0 ELSE least(length(t), length(array_to_string(lines[1:k1], chr(10))) + 1) END AS a,
         CASE WHEN k2 = 0 THEN 0 ELSE least(length(t), length(array_to_string(lines[1:k2], chr(10))) + 1) END AS b FROM placed),
made AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM made
"""
