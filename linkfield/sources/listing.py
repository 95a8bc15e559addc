"""Input files as a data source: batch and stream, dealt to tasks by bytes.

    spark.dataSource.register(PageFiles)
    spark.read.format("page_files").option("path", folder).option("content", "true").load()

An engine's time follows the bytes that it reads, and folders of scans hold files of very unlike sizes; a reader that
deals files by number, or packs small ones by a fixed size, leaves a few tasks with most of the work.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import IMAGE_EXTENSIONS

SCHEMA = "path string, length long, kind string"


@dataclass
class Files(InputPartition):
    """What one task reads: paths and lengths."""

    files: tuple[tuple[str, int], ...] = ()


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change in ns) of all files below path, but hidden ones."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    below = lambda f: f.path.removeprefix(root).strip("/").split("/")
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return sorted((prefix + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" and p for p in below(f)))


def dealt(files: Sequence[tuple[str, int]], bytes_per_task: int, least: int = 1) -> list[Files]:
    """Files in tasks of about as many bytes each: large ones first, each to the task that has least."""
    n = min(len(files), max(least, math.ceil(sum(size for _, size in files) / bytes_per_task)))
    tasks = [(0, k, []) for k in range(n)]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        have, k, own = heapq.heappop(tasks)
        own.append((path, size))
        heapq.heappush(tasks, (have + size, k, own))
    return [Files(tuple(own)) for _, _, own in sorted(tasks, key=lambda t: t[1])]


class _Reading:
    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"], options.get("content", "false").lower() == "true"
        self.bytes_per_task, self.least = int(options.get("bytespertask", 64 << 20)), int(options.get("tasks", 1))

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        for path, size in partition.files:
            dot = path.rfind(".")
            kind = "image" if dot > path.rfind("/") and path[dot:].lower() in IMAGE_EXTENSIONS else "document"
            if not self.content:
                yield path, size, kind
                continue
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with store.open_input_file(at) as f:
                yield path, size, kind, f.read()


class _Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt([(p, n) for p, n, _ in listed(self.path)], self.bytes_per_task, self.least) or [Files()]


class _StreamReader(_Reading, DataSourceStreamReader):
    """Batches by time of change: a batch has the files that changed since the one before, up to its own listing."""

    def initialOffset(self) -> dict:
        return {"at": -1}

    def latestOffset(self) -> dict:
        return {"at": max((t for _, _, t in listed(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [(p, n) for p, n, t in listed(self.path) if start["at"] < t <= end["at"]]
        return dealt(new, self.bytes_per_task, self.least) or [Files()]

    def commit(self, end: dict) -> None:
        pass


class PageFiles(DataSource):
    """path, length, kind of the files below option path, and their content where option content is true.  Options
    bytesPerTask and tasks (at least so many, if there are files) decide how many tasks there are."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def _lower(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._lower())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._lower())
