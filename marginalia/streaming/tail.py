"""A streaming source of whole lines: files that are still being written are followed by the bytes read so far."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.folders import open_store

#: Bytes that one task reads, and that are looked at together for line ends.
PIECE, CHUNK = 64 << 20, 1 << 20


def files_under(path: str) -> list[tuple[str, int]]:
    """Files and sizes: the path itself, or all in the folder; those that begin with a dot or an underscore are left out."""
    store, at = open_store(path)
    there = store.get_file_info(at)
    found = [there] if there.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not re.match(r"[._]", f.base_name))


def end_of_lines(store: fs.FileSystem, path: str, start: int, size: int) -> int:
    """Where the last whole line ends, at ``start`` or behind it."""
    with store.open_input_file(path) as f:
        stop = size
        while stop > start:
            begin = max(start, stop - CHUNK)
            found = f.read_at(stop - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            stop = begin
    return start


def lines_of(store: fs.FileSystem, path: str, start: int, end: int, first: bool) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lines that start in a range of bytes, some at a time, and where each starts. If the range is not the first, the line that
    lies across its start belongs to the one before."""
    with store.open_input_file(path) as f:
        at, rest, size = start if first else start - 1, b"", f.size()
        skip = not first
        while at < size:
            data = rest + f.read_at(CHUNK, at + len(rest))
            cut = data.rfind(b"\n") + 1
            if not cut:
                if at + len(data) >= size:
                    return  # a line that is not finished
                rest = data
                continue
            starts, lines, place = [], [], at
            for line in data[:cut].split(b"\n")[:-1]:
                if place >= end:
                    break
                if skip:
                    skip = False
                else:
                    starts.append(place)
                    lines.append(line)
                place += len(line) + 1
            if lines:
                yield starts, lines
            if place >= end:
                return
            at, rest = at + cut, data[cut:]


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool):
        self.path, self.start, self.end, self.first = path, start, end, first


class TailReader(DataSourceStreamReader):
    """Offsets are bytes of whole lines per file; what follows the last line end stays for a later batch. A batch is cut into pieces
    of bounded size whatever the size of a file, and is the same whenever it is read again."""

    def __init__(self, path: str):
        self.path, self.ends = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = open_store(self.path)
        for path, size in files_under(self.path):
            known = self.ends.get(path, 0)
            if size > known:
                self.ends[path] = end_of_lines(store, path, known, size)
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            self.ends[path] = max(stop, self.ends.get(path, 0))
            out += [Piece(path, a, min(a + PIECE, stop), a == begin) for a in range(begin, stop, PIECE)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        for starts, lines in lines_of(store, piece.path, piece.start, piece.end, piece.first):
            values = [line.decode("utf-8", "replace") for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array([piece.path] * len(lines)), pa.array(starts, pa.int64()), pa.array(values)], names=["path", "start", "value"])


class Tail(DataSource):
    """``spark.readStream.format("marginalia_tail").load(path)``: ``path, start, value``, a row a line."""

    @classmethod
    def name(cls) -> str:
        return "marginalia_tail"

    def schema(self) -> str:
        return "path string, start long, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"])
