"""Source trees as a Spark format: `spark.read.format("source_tree").load(folder)`.

Options:
    repo        name of the one repository (default: the folder's own name)
    repos       "true": every folder in the given one is a repository of its own
    suffixes    endings of wanted files, comma-separated; default those of the registered
                languages, empty for all
    split_bytes size of a task's share

Filters on `repo` and `path` (equality, lists, beginnings and endings) are pushed down: folders that
can't hold a wanted file are not listed, files that are not wanted are not opened. Only names and
sizes are listed while the query is planned; shares are cut as the listing goes on, by bytes with a
charge per file, so one folder of very many files spans many tasks. For trees whose listing
itself has to be spread, `read_tree` lists on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
    StringEndsWith, StringStartsWith)

from ..operators.extract import languages
from ..schemas import FILES
from .tree import _ARROW_FILES, _OUTPUT_BYTES, SPLIT_BYTES, _content, _entries

FORMAT = "source_tree"
FILE_BYTES = 32 << 10  # what opening a file costs, in bytes read
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.dataSource.register(SourceTree)
    spark.conf.set(_PUSHDOWN, "true")


@dataclass
class Share(InputPartition):
    """Files of one task: (repo, path within it) each."""
    files: list[tuple[str, str]]

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(None)
        self.files = files


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file:").rstrip("/") or "/"
        self.root = "/" + self.root.lstrip("/") if self.root.startswith("/") else self.root
        self.many = options.get("repos", "false").lower() == "true"
        self.repo = options.get("repo", os.path.basename(self.root))
        named = options.get("suffixes")
        self.suffixes = tuple(languages()) if named is None else tuple(
            s for s in named.split(",") if s)
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: dict[str, list[Callable[[str], bool]]] = {"repo": [], "path": []}
        self.begins: list[str] = []  # one of these each path or folder has to agree with

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep the filters that names can answer; give the others back."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column not in self.tests or value is None:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests[column].append(lambda name, v=value: name == v)
                self._begin(column, value)
            elif isinstance(f, In):
                self.tests[column].append(lambda name, v=frozenset(value): name in v)
            elif isinstance(f, StringStartsWith):
                self.tests[column].append(lambda name, v=value: name.startswith(v))
                self._begin(column, value)
            elif isinstance(f, StringEndsWith):
                self.tests[column].append(lambda name, v=value: name.endswith(v))
            else:
                yield f

    def _begin(self, column: str, value: str) -> None:
        if column == "path":
            self.begins.append(value)

    def _wanted(self, column: str, name: str) -> bool:
        return all(test(name) for test in self.tests[column])

    def _repos(self) -> Iterator[tuple[str, str]]:
        """(name, folder) of the wanted repositories."""
        if not self.many:
            found = [(self.repo, self.root)]
        else:
            found = ((os.path.basename(path), path) for folder, path, _ in _entries(
                self.root, ("/",)) if folder)
        return ((name, path) for name, path in found if self._wanted("repo", name))

    def listed(self) -> Iterator[tuple[str, str, int]]:
        """(repo, path, bytes) of every wanted file."""
        for repo, top in self._repos():
            waiting = [top]
            while waiting:
                for is_folder, full, size in _entries(waiting.pop(), self.suffixes):
                    path = os.path.relpath(full, top).replace(os.sep, "/")
                    if is_folder:
                        here = f"{path}/"
                        if all(here.startswith(b) or b.startswith(here) for b in self.begins):
                            waiting.append(full)
                    elif self._wanted("path", path):
                        yield repo, path, size

    def partitions(self) -> list[InputPartition]:
        shares, files, held = [], [], 0
        for repo, path, size in self.listed():
            files.append((repo, path))
            held += size + FILE_BYTES
            if held >= self.split_bytes:
                shares.append(Share(files))
                files, held = [], 0
        if files or not shares:
            shares.append(Share(files))
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for repo, path in partition.files:
            content = _content(os.path.join(self.root, repo, path) if self.many
                               else os.path.join(self.root, path))
            rows.append((repo, path, content))
            held += len(content or b"")
            if held > _OUTPUT_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_FILES.types)], schema=_ARROW_FILES)
