"""A streaming source of lines that are added to growing files.

The offset of a file is the place after its last whole line, so each trigger reads only what was added since. A file that has become
shorter than its offset was replaced and is read from its start. Folders are any that ``pyarrow.fs`` opens (a mounted path, or a
URI of a store); new files are found at every trigger, files that have gone are forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20
BLOCK = 4 << 20
BACK = 1 << 16


def open_folder(folder: str):
    """(file system, path) of a folder given as a path or URI."""
    from pyarrow.fs import FileSystem

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return FileSystem.from_uri(folder)


def log_files(folder: str) -> dict[str, int]:
    """Sizes of the files under a folder, by path. Names that begin with ``_`` or ``.`` are not logs."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = open_folder(folder)
    found = fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True))
    return {f.path: f.size for f in found if f.type == FileType.File and not f.base_name.startswith(("_", "."))}


def whole_lines(folder: str, path: str, size: int) -> int:
    """The place after the last line feed among the first ``size`` bytes, sought from the end."""
    fs, _ = open_folder(folder)
    with fs.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - BACK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin at bytes ``begin`` to ``stop`` (not included); whole lines are known to reach from ``first`` to ``last``."""

    source: str
    folder: str
    path: str
    first: int
    begin: int
    stop: int
    last: int


def line_ranges(folders: dict[str, str], start: dict, end: dict) -> list[LineRange]:
    """What was added between two offsets, in ranges of at most ``SPLIT`` bytes."""
    out = []
    for source, files in end.items():
        for path, last in files.items():
            first = start.get(source, {}).get(path, 0)
            first = first if first <= last else 0
            out += [LineRange(source, folders[source], path, first, a, min(a + SPLIT, last), last) for a in range(first, last, SPLIT)]
    return out


def read_lines(part: LineRange) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first line, lines) of a range, in blocks. A line belongs to the range it begins in."""
    fs, _ = open_folder(part.folder)
    with fs.open_input_file(part.path) as f:
        at, rest = part.begin, b""
        if part.begin > part.first:  # the line that reaches in from before is another range's
            at = None
            seek = part.begin - 1
            while seek < part.last and at is None:
                found = f.read_at(min(BLOCK, part.last - seek), seek)
                if not found:
                    return
                line_feed = found.find(b"\n")
                at = seek + line_feed + 1 if line_feed >= 0 else None
                seek += len(found)
        place = at
        while place is not None and at < part.stop:
            block = f.read_at(min(BLOCK, part.last - place), place)
            if not block:
                return
            place += len(block)
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            kept, next_at = [], at
            for line in lines:
                if next_at >= part.stop:
                    break
                kept.append(line)
                next_at += len(line) + 1
            yield at, kept
            at = next_at
            if place >= part.last:
                return


class TailReader(DataSourceStreamReader):
    def __init__(self, folders: dict[str, str]):
        self.folders = folders
        self.ends: dict[tuple[str, str], tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {name: {} for name in self.folders}

    def latestOffset(self) -> dict:
        out = {}
        for name, folder in self.folders.items():
            out[name] = {}
            for path, size in sorted(log_files(folder).items()):
                known = self.ends.get((name, path))
                if known is None or known[0] != size:
                    self.ends[name, path] = known = (size, whole_lines(folder, path, size))
                out[name][path] = known[1]
        return out

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        return line_ranges(self.folders, start, end)

    def read(self, part: LineRange) -> Iterator[pa.RecordBatch]:
        for at, lines in read_lines(part):
            places = [at]
            for line in lines:
                places.append(places[-1] + len(line) + 1)
            raw = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.source] * len(raw)), pa.array([part.path] * len(raw)), pa.array(places[:-1], pa.int64()), pa.array(raw, pa.string())],
                ["source", "path", "offset", "raw"],
            )


class TailedLines(DataSource):
    """``spark.readStream.format("tailed_lines").option("folders", json)``: rows (source, path, offset, raw); json maps names to folders."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return "source string, path string, offset long, raw string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(json.loads(self.options["folders"]))
