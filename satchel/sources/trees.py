"""The ``fstree`` data source: files and folders below roots, empty folders included."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "root_ord long, path string, full_path string, kind string, size long"


class Root(InputPartition):
    def __init__(self, number: int, path: str, deep: bool) -> None:
        self.number, self.path, self.deep = number, path, deep


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str]) -> None:
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        """One for each root and one for each folder directly in it."""
        out = []
        for k, root in enumerate(self.roots):
            if not os.path.lexists(root):
                raise FileNotFoundError(root)
            out.append(Root(k, root, False))
            if os.path.isdir(root):
                out += [Root(k, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, part: Root) -> Iterator[tuple]:
        root = self.roots[part.number]
        base = os.path.dirname(os.path.abspath(root))
        todo = [part.path]
        while todo:
            path = todo.pop()
            name = os.path.relpath(os.path.abspath(path), base)
            if os.path.islink(path) and os.path.isdir(path) and path != root:
                yield part.number, name, path, "dirlink", 0
            elif os.path.isfile(path):
                yield part.number, name, path, "file", os.path.getsize(path)
            elif os.path.isdir(path):
                yield part.number, name, path, "dir", 0
                inside = os.scandir(path)
                if part.deep:
                    todo += [e.path for e in inside]
                else:  # folders of the root are partitions of their own
                    todo += [e.path for e in inside if not e.is_dir(follow_symlinks=False)]
            elif os.path.islink(path):
                yield part.number, name, path, "link", 0
            # Anything else (sockets, devices) is no entry.


class TreeSource(DataSource):
    """``spark.read.format("fstree").option("roots", "a\\nb").load()``"""

    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        roots = self.options.get("roots") or self.options.get("path") or ""
        return TreeReader([r for r in roots.split("\n") if r])
