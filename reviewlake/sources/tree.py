"""Scan of a source tree in a folder every executor can reach.

The built-in file sources skip names that start with `_` or `.`, so `__init__.py` would be lost.
Here executors list the tree, one job per level, and then read the files, dealt out by bytes; the
driver sees nothing but the number of folders and bytes.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import CALL_GRAPH_IGNORED
from ..operators.extract import languages
from ..schemas import FILES
from ..session import materialize

SPLIT_BYTES = 64 << 20
_OUTPUT_BYTES = 8 << 20
_LISTED = "folder boolean, path string, size long"
_ARROW_FILES = pa.schema([("repo", pa.string()), ("path", pa.string()), ("content", pa.binary())])


def _entries(folder: str, suffixes: tuple[str, ...]) -> Iterator[tuple[bool, str, int]]:
    """Folders to enter and wanted files of `folder`; pipes, devices and the like are left out."""
    try:
        entries = os.scandir(folder)
    except OSError:  # a folder that may not be read costs only itself
        return
    with entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if not e.name.startswith(".") and e.name not in CALL_GRAPH_IGNORED:
                    yield True, e.path, 0
            elif not suffixes or e.name.endswith(suffixes):
                try:
                    if e.is_file():
                        yield False, e.path, e.stat().st_size
                    elif e.is_symlink() and not os.path.exists(e.path):
                        yield False, e.path, 0
                except OSError:
                    yield False, e.path, 0


def _content(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def read_tree(spark: SparkSession, root: str, repo: str, suffixes: Sequence[str] | None = None,
              split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """files(repo, path, content) of one tree.

    Of files with the given suffixes: None for those of the languages registered now, () for all.
    Folders ignored by every walk are not entered. A broken link or a file that can't be read is a
    row without content, which later steps pass over as they do blank files.
    """
    wanted = tuple(languages() if suffixes is None else suffixes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = list(_entries(folder, wanted))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                        (pa.bool_(), pa.string(), pa.int64()))], names=["folder", "path", "size"])

    level = spark.createDataFrame([(root,)], "path string")
    levels = []
    while True:
        found = materialize(level.repartition("path").mapInArrow(listed, _LISTED), "tree")
        levels.append(found.where("not folder").select("path", "size"))
        level = found.where("folder").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.union, levels)
    size = files.agg(F.sum("size")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content = _content(path)
                rows.append((repo, os.path.relpath(path, root).replace(os.sep, "/"), content))
                held += len(content or b"")
                if held > _OUTPUT_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_FILES.types)],
                        schema=_ARROW_FILES)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_FILES.types)],
                schema=_ARROW_FILES)

    return (files.repartition(max(1, math.ceil(size / split_bytes)), "path")
            .mapInArrow(read, FILES))
