"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash of their bytes says so, which is at the same places wherever the same passage
stands. A chunk that occurs more than once is encoded once, by the document that owns it, and its ids travel to the
other documents. A chunk's ends usually lie inside words, so its middle is reused: whole words, each with the blanks
before it. Every join of a middle with what stands beside it is checked: the last words before it and the first ones
after it are encoded together, and where that does not agree with the ids on both sides, twice as many words are encoded
together, until the outer ones agree exactly or the whole text has been encoded anew.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, table, text_blocks, with_columns, words_of

#: Pieces whose ids a worker keeps; beyond that the pieces of the last block stay.
CACHE_PIECES = 200_000
#: Bytes that decide about a cut; a cut falls after one byte in ``CHUNK`` on average.
ROLL, CHUNK = 16, 1024
#: Middles shorter than this are not worth sharing.
LEAST = 64

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters alone (no apostrophe, no ``<``) split into letters, single digits and the rest, whatever
#: stands around them; composing and white space change nothing in them.
_SIMPLE = "^[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
_NO_LETTERS = "[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u017f]+"


def pieces_of(words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of words one after another, and where each word's pieces start (one entry more than words). A simple word
    is cut where it can be encoded piece by piece and lower-cased; any other word is one piece, as it is."""
    cut = pc.replace_substring_regex(pc.utf8_lower(words), _NO_LETTERS, r" \0 ")
    cut = pc.if_else(pc.match_substring_regex(words, _SIMPLE), pc.ascii_trim_whitespace(cut), words)
    lists = pc.ascii_split_whitespace(cut)
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy()


def runs_of(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat one after another, and where each of them starts there (one entry more than runs)."""
    to = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    kind = np.int32 if max(len(flat), int(to[-1])) < 1 << 31 else np.int64
    at = np.repeat((starts - to[:-1]).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return flat[at], to


#: The pre-tokenizer and normalizer for which that holds.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others,
    in order, for those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class TextEncoder:
    """Encodes texts as the tokenizers library does, whatever the tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def together(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start (one entry more than texts)."""
        coded = self.together(texts.to_pylist())
        starts = np.concatenate(([0], np.cumsum([len(x) for x in coded], dtype=np.int64)))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(starts[-1])), starts


def splits_words(tokenizer) -> bool:
    """Whether the tokenizer drops white space and splits words as ``_SPLIT`` says, so that words can be encoded one by one."""
    told = json.loads(tokenizer.to_str())
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    return bool(split) and (told.get("normalizer") or {}).get("normalizers") == _NORMAL and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in told.get("added_tokens") or [])


class WordEncoder(TextEncoder):
    """Encodes texts with a tokenizer of which splits_words() holds: each distinct word of a block is put together from
    pieces, and each distinct piece is encoded once."""

    def __init__(self, path: str):
        super().__init__(load_tokenizer(path))
        if not splits_words(self.tokenizer):
            raise ValueError("tokens of this tokenizer may cross white space; use TextEncoder")
        self.shown = byte_characters()
        self.known: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Pieces of simple words go to the model alone, other words through the whole tokenizer."""
        simple = pc.match_substring_regex(pa.array(pieces, pa.string()), _SIMPLE).to_numpy(zero_copy_only=False).tolist()
        rest = iter(self.together([p for p, own in zip(pieces, simple, strict=True) if not own]))
        tokens, sizes, flat = self.tokenizer.model.tokenize, [], []
        for piece, own in zip(pieces, simple, strict=True):
            if own:
                said = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
                got = [t.id for t in tokens(said)]
            else:
                got = next(rest)
            sizes.append(len(got))
            flat += got
        self._add(pieces, np.array(sizes, np.int32), np.array(flat, np.uint32))

    def _add(self, pieces: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        at = len(self.known)
        while len(self.ids) < self.n_ids + len(flat):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while len(self.starts) < at + len(pieces):
            self.starts, self.sizes = np.concatenate((self.starts, self.starts)), np.concatenate((self.sizes, self.sizes))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.starts[at : at + len(pieces)] = self.n_ids + np.cumsum(sizes, dtype=np.int64) - sizes
        self.sizes[at : at + len(pieces)] = sizes
        self.known.update(zip(pieces, range(at, at + len(pieces)), strict=True))
        self.n_ids += len(flat)

    def keep_only(self, pieces: list[str], place: np.ndarray) -> None:
        sizes = self.sizes[place]
        flat, _ = runs_of(self.ids, self.starts[place], sizes)
        self.known, self.n_ids = {}, 0
        self._add(pieces, sizes, flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and walking millions of small objects takes longer than the encoding
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        index, offsets, words = words_of(texts)
        coded, firsts = pieces_of(words)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = list(map(self.known.get, pieces))
        new = [p for p, place in zip(pieces, places, strict=True) if place is None]
        if new:
            fresh = iter(range(len(self.known), len(self.known) + len(new)))
            self.learn(new)
            places = [next(fresh) if place is None else place for place in places]
        place = np.array(places, np.int64)
        at = place[coded.indices.to_numpy(zero_copy_only=False)]
        flat, to = runs_of(self.ids, self.starts[at], self.sizes[at])  # of the distinct words
        starts = to[firsts]
        ids, to = runs_of(flat, starts[:-1][index], np.diff(starts)[index])
        if len(self.known) > CACHE_PIECES:
            self.keep_only(pieces, place)
        return ids, to[offsets]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        try:
            _encoders[path] = WordEncoder(path)
        except ValueError:
            _encoders[path] = TextEncoder(load_tokenizer(path))
    return _encoders[path]


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks end in UTF-8 bytes: the last ``ROLL`` bytes decide, never inside a character; the end of the
    text always ends a chunk."""
    if not len(data):
        return np.empty(0, np.int64)
    roll, width, factor = _GEAR[data], 1, 0x9E3779B1
    while width < ROLL and len(roll) > width:
        roll = roll[:-width] * np.uint32(factor) + roll[width:]
        factor = factor * factor & 0xFFFFFFFF
        width *= 2
    cut = np.flatnonzero(roll < (1 << 32) // CHUNK) + ROLL if width == ROLL else np.empty(0, np.int64)
    cut = cut[cut < len(data)]
    cut = cut[(data[cut] & 0xC0) != 0x80]
    return np.append(cut, len(data))


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Where a blank follows something else: words begin there, with the blanks before them."""
    blank = _BLANK[data]
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def middles(data: np.ndarray, cuts: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Chunks with a middle worth sharing: number, and the middle's start and end, between words."""
    ends = chunk_ends(data)
    cuts = word_cuts(data) if cuts is None else cuts
    if not len(ends) or not len(cuts):
        return []
    starts = np.concatenate(([0], ends[:-1]))
    a, b = np.searchsorted(cuts, starts, side="right"), np.searchsorted(cuts, ends) - 1
    good = np.flatnonzero(b > a)
    first, last = cuts[a[good]], cuts[b[good]]
    return [(int(k), int(s), int(e)) for k, s, e in zip(good, first, last, strict=True) if e - s >= LEAST]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, 0):
        doc, no, digest = [], [], []
        for i, text in enumerate(block.column(0).to_pylist()):
            raw = text.encode()
            for k, s, e in middles(np.frombuffer(raw, np.uint8)):
                doc.append(i)
                no.append(k)
                digest.append(xxhash.xxh3_128_digest(raw[s:e]))
        at = pa.array(doc, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), block.column(1).take(at), block.column(2).take(at), pa.array(no, pa.int32())], names=["chunk", "id", "row", "no"])


def _kind(path: str) -> type:
    """Ids of shared chunks travel in two bytes where the vocabulary allows it."""
    return np.uint16 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else np.uint32


def _encode_owned(path: str):
    """Encode the chunks that a document owns: ``chunk, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            chunks, parts = [], []
            for text, owned in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                raw = text.encode()
                at = {k: (s, e) for k, s, e in middles(np.frombuffer(raw, np.uint8))}
                for x in owned:
                    s, e = at[x["no"]]
                    chunks.append(x["chunk"])
                    parts.append(raw[s:e].decode())
            ids, starts = encoder(path).encode(pa.array(parts, pa.string()))
            ids = ids.astype(_kind(path))
            coded = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(coded, pa.binary())], names=["chunk", "ids"])

    return run


class _Joined:
    """A text in parts, given by the byte each ends at, with the ids of each part as if it stood alone."""

    def __init__(self, raw: bytes, ends: list[int], parts: list[np.ndarray], cuts: np.ndarray):
        self.raw, self.ends, self.parts, self.cuts = raw, ends, parts, cuts

    def words(self, join: int, n: int) -> tuple[int, int, int, int] | None:
        """Bytes where the last n words before a join begin, where the first of them and the last but one of the n words
        after it end, and where the last ends; nothing where these words are not all in the two parts."""
        low, at, high = (0, *self.ends)[join], self.ends[join], self.ends[join + 1]
        k = int(np.searchsorted(self.cuts, at))
        marks = [0, *self.cuts[max(0, k - n) : k + n + 1].tolist(), len(self.raw)] if k < n else [*self.cuts[k - n : k + n + 1].tolist(), len(self.raw)]
        here = marks.index(at)
        if here < n or len(marks) <= here + n or marks[here - n] < low or marks[here + n] > high:
            return None
        return marks[here - n], marks[here - n + 1], marks[here + n - 1], marks[here + n]

    def repair(self, join: int, coder: TextEncoder) -> bool:
        """Encode ever more words around a join together until the outer ones agree with both sides."""
        n, at = 2, self.ends[join]
        while (found := self.words(join, n)) is not None:
            a, a_end, b_start, b = found
            said = [self.raw[x:y].decode() for x, y in ((a, b), (a, at), (at, b), (a, a_end), (b_start, b))]
            both, left, right, first, last = coder.together(said)
            x, y = self.parts[join], self.parts[join + 1]
            agrees = x[len(x) - len(left) :].tolist() == left and y[: len(right)].tolist() == right
            outer = first and last and both[: len(first)] == left[: len(first)] == first and both[-len(last) :] == right[-len(last) :] == last
            if agrees and outer:
                self.parts[join] = np.concatenate((x[: len(x) - len(left)], np.array(both, np.uint32)))
                self.parts[join + 1] = y[len(right) :]
                return True
            n *= 2
        return False


def join_ids(texts: list[bytes], ends: list[list[int]], parts: list[list[np.ndarray]], coder: TextEncoder) -> list[list[np.ndarray]]:
    """Ids of texts whose parts were encoded alone. At each join the word before it and the one after it are encoded
    together; where that is not what both sides have, repair() widens, and if it finds no agreement inside the two parts
    the whole text is encoded."""
    todo, asked, sides = [], [], []
    joined = []
    for i, (raw, at, have) in enumerate(zip(texts, ends, parts, strict=True)):
        text = _Joined(raw, at, have, word_cuts(np.frombuffer(raw, np.uint8)) if len(at) > 1 else np.empty(0, np.int64))
        joined.append(text)
        for k in range(len(at) - 1):
            found = text.words(k, 1)
            if found is None:
                todo.append((i, k, False))
                continue
            a, _, _, b = found
            todo.append((i, k, True))
            asked.append(raw[a:b].decode())
            sides += [raw[a : at[k]].decode(), raw[at[k] : b].decode()]
    both = iter(coder.together(asked))
    ids, starts = coder.encode(pa.array(sides, pa.string()))
    alone = iter([ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
    bad: dict[int, list[int]] = {}
    for i, k, known in todo:
        agrees = False
        if known:
            left, right, together = next(alone), next(alone), next(both)
            x, y = joined[i].parts[k], joined[i].parts[k + 1]
            agrees = x[len(x) - len(left) :].tolist() + y[: len(right)].tolist() == together == left.tolist() + right.tolist()
        if not agrees:
            bad.setdefault(i, []).append(k)
    for i, joins in bad.items():
        if not all(joined[i].repair(k, coder) for k in joins):
            joined[i].parts = [np.array(coder.together([texts[i].decode()])[0], np.uint32)]
    return [x.parts for x in joined]


def _assemble(path: str, digest: bool):
    """Ids of whole texts, or their digests, from shared middles and from what lies between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 0):
            texts, coder = [t.encode() for t in block.column(0).to_pylist()], encoder(path)
            said: list[str] = []  # what is encoded here
            ends: list[list[int]] = []
            plans: list[list] = []  # for each text: number of a part, or the ids of a shared middle
            for raw, known in zip(texts, block.column(1).to_pylist(), strict=True):
                plan, cut, done = [], [], 0
                have = {x["no"]: x["ids"] for x in known or ()}
                for k, s, e in middles(np.frombuffer(raw, np.uint8)) if have else ():
                    if k in have:
                        plan += [len(said), np.frombuffer(have[k], _kind(path)).astype(np.uint32)]
                        said.append(raw[done:s].decode())
                        cut += [s, e]
                        done = e
                plans.append([*plan, len(said)])
                ends.append([*cut, len(raw)])
                said.append(raw[done:].decode())
            ids, starts = coder.encode(pa.array(said, pa.string()))
            out = join_ids(texts, ends, [[ids[starts[x] : starts[x + 1]] if isinstance(x, int) else x for x in plan] for plan in plans], coder)
            if digest:
                said = [_digest(np.concatenate(plan).tolist(), *_strings(path)) for plan in out]
                cols = [pa.array([x[k] for x in said], t) for k, t in enumerate(_DIGEST)]
                yield pa.RecordBatch.from_arrays([*block.columns[2:], *cols], names=[*block.schema.names[2:], "_m_n", "_m_ids_sha", "_m_text_sha"])
                continue
            sizes = [sum(map(len, x)) for x in out]
            flat = np.concatenate([x for plan in out for x in plan]) if out else np.empty(0, np.uint32)
            offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.columns[2:], lists], names=[*block.schema.names[2:], "_m_ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digest: bool = False) -> DataFrame:
    """Add ``ids``, the token ids of each whole text without special tokens around it, in place of the text. With
    ``digest``, what digests() gives stands in place of the ids, made where they are.

    Null or empty texts have no ids; repeated rows are encoded alike; rows may share an id or have none; an empty table
    gives an empty result; other columns pass through, whatever their names. Any tokenizer of the tokenizers library will
    do; its file must be there on every worker. Words are encoded one by one only where splits_words() holds.

    Shuffled are a digest for each chunk, the texts once (both readings of them share the exchange), and the
    ids of chunks that occur more than once. A chunk held by very many documents is found by partial aggregation, and its ids
    reach them by joins whose skewed partitions can be split.
    """
    path, spark = path or default_tokenizer(), docs.sparkSession
    made = {"n_tokens": "_m_n", "ids_sha256": "_m_ids_sha", "decoded_sha256": "_m_text_sha"} if digest else {"ids": "_m_ids"}
    others = [c for c in docs.columns if c.lower() not in {text_col.lower(), *made}]
    text, id_ = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = docs.select(text.alias("_m_text"), id_.alias("_m_id"), F.xxhash64(text).alias("_m_row"), *others)
    chunks = keyed.select("_m_text", "_m_id", "_m_row").mapInArrow(_chunk_rows, "chunk binary, id long, row long, no int")
    scratch = Scratch(spark)
    chunks = scratch.write(chunks, "chunks")
    place = F.struct("id", "row", "no")
    shared = chunks.groupBy("chunk").agg(F.min(place).alias("owner"), F.count("*").alias("times")).filter("times > 1").select(F.col("chunk").alias("shared"), "owner")
    shared = scratch.write(shared, "shared-chunks")
    dealt = keyed.repartition(partitions(spark), "_m_id", "_m_row")

    def of_document(rows: DataFrame, item) -> DataFrame:
        return rows.groupBy("id", "row").agg(F.collect_set(item).alias("_m_list")).withColumnsRenamed({"id": "_m_list_id", "row": "_m_list_row"})

    same = (F.col("_m_id") == F.col("_m_list_id")) & (F.col("_m_row") == F.col("_m_list_row"))
    owned = of_document(shared.select("owner.*", F.col("shared").alias("chunk")), F.struct("no", "chunk"))
    # the same columns as below, so that the exchange is the same
    coded = dealt.join(owned, same).select("_m_text", "_m_list", *others).mapInArrow(_encode_owned(path), "chunk binary, ids binary")
    coded = coded.withColumnRenamed("chunk", "shared")  # one plan with the rest, so that both readings share one exchange
    known = of_document(chunks.join(coded, F.col("chunk") == F.col("shared")).select("id", "row", "no", "ids"), F.struct("no", "ids"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*others).schema.fields)
    joined = dealt.join(known, same, "left").select("_m_text", "_m_list", *others)
    kinds = "_m_n long, _m_ids_sha string, _m_text_sha string" if digest else "_m_ids array<int>"
    out = joined.mapInArrow(_assemble(path, digest), f"{fields + ', ' if fields else ''}{kinds}")
    return with_columns(out, **{k: F.col(v) for k, v in made.items()}).drop(*made.values())


def token_strings(tokenizer) -> list[str | None]:
    size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    return [tokenizer.id_to_token(i) for i in range(size)]


_DIGEST = (pa.int64(), pa.string(), pa.string())
_known_strings: dict[str, tuple] = {}


def _strings(path: str) -> tuple:
    """What _text_of() needs, and the decimal numbers of all ids."""
    if path not in _known_strings:
        tokenizer = encoder(path).tokenizer
        token = token_strings(tokenizer)
        number = [str(i) for i in range(len(token))]
        _known_strings[path] = (token if tokenizer.decoder is None else lambda ids: tokenizer.decode(ids, skip_special_tokens=False)), number
    return _known_strings[path]


def _text_of(ids: list[int], token) -> str:
    """As the library's decode(): a tokenizer without a decoder puts blanks between tokens, else the decoder is asked."""
    return token(ids) if callable(token) else " ".join([token[i] for i in ids if token[i] is not None])


def _digest(ids: list[int], token, number: list) -> tuple[int, str, str]:
    said = " ".join([number[i] for i in ids])
    return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(_text_of(ids, token).encode()).hexdigest()


def _decode(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, number = _strings(path)
        for batch in batches:
            out = []
            for ids in batch.column(0):
                ids = ids.values.to_pylist() if ids.is_valid else []
                out.append(_digest(ids, token, number) if digest else (_text_of(ids, token),))
            kinds, names = (_DIGEST, ["_m_n", "_m_ids_sha", "_m_text_sha"]) if digest else ((pa.string(),), ["_m_text"])
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *names])

    return run


def decode(coded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Replace ``ids_col`` by ``decoded``, as the library's decode() with special tokens kept. Null ids decode to an empty
    text; ids without a token are left out."""
    return _from_ids(coded, ids_col, path, False, {"decoded": "_m_text"})


def digests(coded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Replace ``ids_col`` by ``n_tokens`` and the digests of the ids and of the decoded text."""
    return _from_ids(coded, ids_col, path, True, {"n_tokens": "_m_n", "ids_sha256": "_m_ids_sha", "decoded_sha256": "_m_text_sha"})


def _from_ids(coded: DataFrame, ids_col: str, path: str | None, digest: bool, names: dict[str, str]) -> DataFrame:
    others = [c for c in coded.columns if c != ids_col]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in coded.select(*others).schema.fields)
    kinds = "_m_n long, _m_ids_sha string, _m_text_sha string" if digest else "_m_text string"
    out = coded.select(ids_col, *others).mapInArrow(_decode(path or default_tokenizer(), digest), fields + kinds)
    return with_columns(out, **{k: F.col(v) for k, v in names.items()}).drop(*names.values())


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
