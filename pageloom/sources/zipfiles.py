"""Zip files as a data source that reads central directories and heads, and never a whole archive.

    spark.dataSource.register(ZipEntries)
    spark.read.format("zip_entries").load(folder)

Rows are those of ``archives.archive_entries``, for archives of any size: each partition opens its files where they lie, seeks to
the directory and reads the first bytes of the entries of its own. Small files share a partition, a large one is split by
the place of its entries. A filter on the beginning of ``filename`` or on the ``archive`` is pushed, for which ``session.prepare`` sets ``spark.sql.python.filterPushdown.enabled``, so
other entries' heads are not read. The folder must be one that pyarrow can open from every executor.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from pageloom.schemas import ENTRIES
from pageloom.sources.archives import HEAD_BYTES

SPLIT_BYTES = 128 * 1024 * 1024


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("//", "/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Part(InputPartition):
    """Files (path, name, from, to): the entries whose place is in that range of bytes."""

    files: list[tuple[str, str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.prefixes: list[str] = []
        self.names: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for told in filters:
            if isinstance(told, StringStartsWith) and told.attribute == ("filename",):
                self.prefixes.append(told.value)
            elif isinstance(told, EqualTo) and told.attribute == ("archive",):
                self.names.append(told.value)
            else:
                yield told

    def partitions(self) -> list[_Part]:
        files, root = _opened(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True))
        parts: list[_Part] = []
        room = 0
        for info in sorted(found, key=lambda x: x.path):
            name = info.path.removeprefix(root).lstrip("/")
            if not info.is_file or any(x[0] in "._" for x in name.split("/")) or any(name != n for n in self.names):
                continue
            if info.size > self.split:
                parts += [_Part([(info.path, name, low, low + self.split)]) for low in range(0, info.size, self.split)]
            elif room >= info.size and parts:
                parts[-1].files.append((info.path, name, 0, self.split + 1))
                room -= info.size
            else:
                parts.append(_Part([(info.path, name, 0, self.split + 1)]))
                room = self.split - info.size
            if info.size > self.split:
                room = 0
        return parts or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        for path, name, low, high in partition.files:
            with files.open_input_file(path) as stored:
                yield from self._entries(stored, name, low, high)

    def _entries(self, stored, name: str, low: int, high: int) -> Iterator[tuple]:
        try:
            opened = zipfile.ZipFile(stored)
        except (zipfile.BadZipFile, OSError, ValueError):
            if low == 0 and not self.prefixes:  # told once, by the part that has the file's beginning
                yield (name, None, None, None, None, None, "ZIP-01")
            return
        with opened:
            for idx, info in enumerate(opened.infolist()):
                if not low <= info.header_offset < high or not all(info.filename.startswith(p) for p in self.prefixes):
                    continue
                head = b""
                if not info.is_dir():
                    try:
                        with opened.open(info) as member:
                            head = member.read(HEAD_BYTES)
                    except Exception:  # a damaged or locked member has no readable head: "not an image"
                        head = b""
                yield (name, idx, info.filename, info.is_dir(), info.file_size, head, None)


class ZipEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> StructType:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({key.lower(): value for key, value in self.options.items()})
