"""``lakepaths``: a Python Data Source that lists a directory tree as a ``paths`` table.

Spark's file sources hide names starting with ``_`` or ``.``, so ``_delta_log`` folders and
placeholder files never show in a ``binaryFile`` listing. This reader shows everything.

Planning lists only directory names of a few levels on the driver to cut the tree into
subtrees (going deeper while there are fewer subtrees than wanted) and deals them into at
most ``partitions`` partitions; each task then walks its subtrees with ``os.scandir``. A symbolic link
is reported as a shortcut and never followed. Local and mounted paths only (``file:`` or
plain absolute paths); object stores need a storage-inventory export read as Parquet.

Options: ``path`` (root), ``directory`` (sub-folder of the root to list, default the
root), ``recursive`` (default ``true``), ``partitions`` (wanted number of partitions).
``name`` is the path relative to the root, with ``/`` separators.
"""

from __future__ import annotations

import os
import stat
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("name string, contentLength bigint, lastModified timestamp, creationTime timestamp, "
          "permissions string, isDirectory boolean, isShortcut boolean, accountType string")


def _local(path: str) -> str:
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    if "://" in path:
        raise ValueError(f"lakepaths lists local or mounted paths only, not {path!r}")
    return path


class _Part(InputPartition):
    """A list of ``(directory, recursive)`` units walked by one task."""

    def __init__(self, units):
        super().__init__(units)
        self.units = units


def _row(root: str, entry: os.DirEntry):
    st = entry.stat(follow_symlinks=False)
    link = entry.is_symlink()
    is_dir = entry.is_dir(follow_symlinks=False)
    rel = os.path.relpath(entry.path, root).replace(os.sep, "/")
    return (rel, None if is_dir else int(st.st_size),
            datetime.fromtimestamp(st.st_mtime, tz=timezone.utc),
            None,  # the file system does not tell when an entry was created
            stat.filemode(st.st_mode)[1:], is_dir, link, None)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(_local(options["path"]))
        sub = options.get("directory") or ""
        self.start = os.path.join(self.root, sub) if sub else self.root
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.wanted = int(options.get("partitions", 64))

    def partitions(self):
        if not self.recursive:
            return [_Part([(self.start, False)])]
        # Cut the tree: replace a recursive subtree by its own level plus its child subtrees,
        # breadth-first, until there are enough subtrees, however deep they lie. Only
        # directory names are listed here; files are listed by the tasks.
        units, frontier = [], [self.start]
        while frontier and len(units) + len(frontier) < self.wanted:
            d = frontier.pop(0)
            units.append((d, False))
            with os.scandir(d) as it:
                frontier += [e.path for e in it if e.is_dir(follow_symlinks=False)]
        units += [(d, True) for d in frontier]
        # At most `wanted` partitions, however wide a directory is: deal units round-robin.
        n = max(1, min(self.wanted, len(units)))
        return [_Part(units[i::n]) for i in range(n)]

    def read(self, partition):
        for directory, recursive in partition.units:
            stack = [directory]
            while stack:
                d = stack.pop()
                with os.scandir(d) as it:
                    for e in it:
                        yield _row(self.root, e)
                        if recursive and e.is_dir(follow_symlinks=False):
                            stack.append(e.path)


class LakePathsSource(DataSource):
    @classmethod
    def name(cls):
        return "lakepaths"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
