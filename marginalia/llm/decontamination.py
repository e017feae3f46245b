"""Benchmark decontamination with an Aho-Corasick automaton over the normalised words of benchmark texts.

A window of n words always holds one of the blocks of n // 2 words that start at every (n - n // 2 + 1)-th word of its
item, so the automaton needs only those blocks (and items shorter than a window whole): its size is below that of the
benchmark in words, not ten times as much. Where a block occurs, the windows around it are looked up by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, run_hashes, table, text_blocks, with_columns

#: Letters A-Z become a-z; digits, letters and all bytes of characters beyond ASCII stay; the rest separates words.
NORMAL = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Benchmark bytes that one automaton holds at most (some 80 MB in a worker); a larger one is dealt over several automata.
BLOCK = 8 << 20

_built: dict[str, "Windows"] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Windows:
    """All windows of all items: the automaton of their blocks, and a table of window hashes with their items."""

    def __init__(self, items: list[tuple], n: int):
        self.n, self.size = n, max(1, n // 2)
        self.word: dict[bytes, int] = {}
        whole, blocks = defaultdict(set), set()
        hashes, owners = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)]], [np.empty(0, np.int64)]
        for item, text in items:
            words = [self.word.setdefault(w, len(self.word) + 1) for w in normal_words(text)]
            if len(words) < n:
                if words:
                    whole[tuple(words)].add(item)
                continue
            blocks.update(tuple(words[i : i + self.size]) for i in range(0, len(words) - self.size + 1, n - self.size + 1))
            for lane in (0, 1):
                hashes[lane].append(self.hashes(np.array(words), lane))
            owners.append(np.full(len(words) - n + 1, item, np.int64))
        first, second, owner = np.concatenate(hashes[0]), np.concatenate(hashes[1]), np.concatenate(owners)
        order = np.lexsort((owner, second, first))
        self.first, self.second, self.owner = first[order], second[order], owner[order]
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in blocks | whole.keys():  # length of a whole item and its ids; whether the key is a block of windows
            self.found.add_word(key, (len(key), tuple(whole.get(key, ())), key in blocks))
        if len(self.found):
            self.found.make_automaton()

    def hashes(self, words: np.ndarray, lane: int) -> np.ndarray:
        return run_hashes(mix(words.astype(np.uint64) + np.uint64(1 + lane << 40)), self.n, lane)

    def items_at(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, set]:
        """Those of the starts where a window begins, and the items it belongs to."""
        first, second = (self.hashes(words, lane)[starts] for lane in (0, 1))
        low, high = np.searchsorted(self.first, first), np.searchsorted(self.first, first, side="right")
        good, items = [], set()
        for i in np.flatnonzero(high > low).tolist():
            a, b = low[i], high[i]
            same = self.owner[a:b][self.second[a:b] == second[i]]
            if len(same):
                good.append(i)
                items.update(same.tolist())
        return starts[good], items


def scan(text: str, windows: Windows) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged ranges of hit words (end exclusive), items that occur."""
    words = normal_words(text)
    if not len(windows.found) or not words:
        return len(words), [], set()
    known = tuple(map(windows.word.get, words, repeat(0)))
    ranges, items, starts = [], set(), set()
    for end, (size, whole, block) in windows.found.iter(known):
        if whole:
            ranges.append((end - size + 1, end + 1))
            items.update(whole)
        if block:
            starts.update(range(max(0, end - windows.n + 1), min(end - size + 1, len(words) - windows.n) + 1))
    if starts:
        good, more = windows.items_at(np.array(known), np.array(sorted(starts)))
        ranges += [(a, a + windows.n) for a in good.tolist()]
        items |= more
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return len(words), [tuple(s) for s in spans], items


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code points of the original text, from the first word's start to the last word's end."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(NORMAL, np.uint8)[raw] != 32
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in spans]


def _scanner(name: str, items, n: int, keep_text: bool):
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Windows(items.value, n)
        for block in text_blocks(batches, 0):
            out = []
            for text in block.column(0).to_pylist():
                n_words, spans, ids = scan(text, _built[name])
                out.append((n_words, spans, original_spans(text, spans) if spans else [], sorted(ids)))
            cols = [
                pa.array([x[0] for x in out], pa.int64()),
                *(pa.array([[{"start": a, "end": b} for a, b in x[k]] for x in out], found) for k in (1, 2)),
                pa.array([x[3] for x in out], pa.list_(pa.int64())),
            ]
            first = 0 if keep_text else 1
            yield pa.RecordBatch.from_arrays([*block.columns[first:], *cols], names=[*block.schema.names[first:], "_m_words", "_m_hit", "_m_spans", "_m_items"])

    return run


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = BLOCK, keep_text: bool = True) -> DataFrame:
    """Find windows of ``n`` consecutive benchmark words (a shorter item is one window) in texts.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``, ``items`` (sorted ids), ``hit_spans``
    (code points of the original text) and ``contaminated``; ``keep_text=False`` leaves the text out of the result.
    Null or empty texts have no words and no hits, and come back empty; items without words match nothing; items of
    a null id are left out; repeated items and rows count as they stand; an empty table gives an empty result.

    Other columns pass through, whatever their names; a text of any length is scanned in one go, in time and memory in
    proportion. All windows form one automaton and each text is scanned once, without a shuffle. The benchmark's size is checked
    before it is broadcast: beyond ``block_bytes`` its items are dealt over several automata, which scan one after
    another and whose hits are united, so that no worker holds more than a block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter("id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = ("_m_words", "_m_hit", "_m_spans", "_m_items")
    out = docs.select(F.col(text_col).alias("_m_text"), *(c for c in docs.columns if c != text_col))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        stays = keep_text or k < blocks - 1
        run = _scanner(f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}-{n}", shared, n, stays)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[0 if stays else 1 :]]
        kinds = ("long", *["array<struct<start:long,end:long>>"] * 2, "array<long>")
        out = out.mapInArrow(run, ", ".join([*fields, *(f"{c} {t}" for c, t in zip(names, kinds, strict=True))]))
        if k:  # unite with what earlier blocks found
            out = out.withColumns({c: F.concat(f"_m_old{c}", c) for c in names[1:]}).drop(*(f"_m_old{c}" for c in names[1:]))
        if k < blocks - 1:
            out = out.drop("_m_words").withColumnsRenamed({c: f"_m_old{c}" for c in names[1:]})
    if blocks > 1:
        out = out.withColumns({"_m_hit": _united(F.col("_m_hit")), "_m_spans": _united(F.col("_m_spans")), "_m_items": F.array_sort(F.array_distinct("_m_items"))})
    out = out.withColumnRenamed("_m_text", text_col)
    out = out.select(*(c for c in docs.columns if c in out.columns), *names)
    size = F.aggregate("_m_hit", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    done = with_columns(out, n_words=F.col("_m_words"), n_hit=size, n_items=F.size("_m_items").cast("long"), items=F.col("_m_items"), hit_spans=F.col("_m_spans"), contaminated=F.size("_m_hit") > 0)
    return done.drop(*names)


def _united(spans):
    """Overlapping ranges merged, in order."""
    def add(acc, x):
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        meets = (F.size(acc) > 0) & (x["start"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)))
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    kind = "array<struct<start:long,end:long>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda acc, x: add(acc, x).cast(kind))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mark_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(ids, "utf-8"), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The result of op3 by comparing every window of every document (for tests)."""
    want = defaultdict(set)
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - n + 1)) if words else []:
            want[tuple(words[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        words, hit, ids = normal_words(text), set(), set()
        for size in {len(w) for w in want}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in want:
                    hit |= set(range(i, i + size))
                    ids |= want[w]
        said = ",".join(sorted(map(str, ids)))
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(said.encode()).hexdigest(), bool(hit)))
    return out
