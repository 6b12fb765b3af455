"""The ``satchel`` data source: archives as tables, and the sink that writes one.

``table`` is ``header``, ``entries`` or ``blocks``.  Headers and entries are read by a task for
each archive; blocks are split into partitions by file, whose places follow from the sizes in the
directory, and files above ``PART_BYTES`` by block, whose places follow from the frames' lengths.
A directory is one chain of names and counts, so it is read as a whole: a few dozen bytes a file.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from satchel.functions.formats import DATA_BLOCK, FRAME, HEADER, SEPARATED, ArchiveError, Entry, read_directory, safe_name, unpack_header
from satchel.plans.modes import cipher_of, learn, resolve

TABLES = {
    "header": "archive string, magic1 long, strategy short, version short, header_offset short, directory_offset long, magic2 long",
    "entries": "archive string, entry_ord long, dir_block long, kind string, name string, path string, size long, stored long, child_count long, iv binary",
    "blocks": "archive string, entry_ord long, block_no long, path string, raw binary",
}
PART_BYTES = 64 << 20  #: stored bytes of a partition of blocks


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Files(InputPartition):
    path: str
    strategy: int
    files: list[tuple[int, str, int, int, int, int]]  # number, path, offset, first block, bytes from there on, stored


def directory(path: str, password: str | None) -> tuple[dict, list[tuple[int, bytes, Entry, str, int]]]:
    """Header, and (block, IV, entry, path, parent's number) in order.

    The first directory whose children are not complete owns the next entry, whatever the cut
    into blocks is."""
    with open(path, "rb") as f:
        header = unpack_header(f.read(HEADER.size))
        raw = f.read(header["directory_offset"] - HEADER.size)
    mode, _, key = resolve(header["strategy"], password)

    def decrypt(iv: bytes, data: bytes) -> bytes:
        if key is None:
            raise ArchiveError("an encrypted directory block in a mode without cipher")
        return cipher_of(mode).decrypt(iv + data, key)

    out, owners, at, left = [], [], -1, 0
    for block, iv, entry in read_directory(raw, decrypt):
        if entry.kind == "root":
            if out:
                raise ArchiveError("a second logical root")
            full, parent = entry.name, -1
        else:
            while left == 0:
                at += 1
                if at >= len(owners):
                    raise ArchiveError("an entry without a parent")
                left = owners[at][1]
            left -= 1
            parent, full = owners[at][0], safe_name(entry.name)
            above = out[parent][3] if out[parent][2].kind != "root" else ""
            full = f"{above}/{full}" if above else full
        if entry.kind != "file":
            owners.append((len(out), entry.children))
        out.append((block, iv, entry, full, parent))
    if left or any(n for _, n in owners[at + 1 :]):
        raise ArchiveError("the directory ends before all children are there")
    return header, out


class ArchiveReader(DataSourceReader):
    def __init__(self, table: str, paths: list[str], password: str | None, block_size: int, modes: str = "") -> None:
        self.table, self.paths, self.password, self.block_size, self.modes, self.only = table, paths, password, block_size, modes, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and self.table == "blocks":
                self.only = f.value
            yield f  # Spark checks it again

    def partitions(self) -> list[InputPartition]:
        if self.table != "blocks":
            return [Archive(p) for p in self.paths]
        learn(self.modes)
        out: list[InputPartition] = []
        for path in self.paths:
            header, entries = directory(path, self.password)
            offset, group, weight = header["directory_offset"], [], 0
            for k, (_, _, e, full, _) in enumerate(entries):
                if e.kind != "file":
                    continue
                n = -(-e.size // self.block_size)
                if e.size and (self.only is None or self.only == full):
                    if e.stored > PART_BYTES and n > 1:
                        out += [Files(path, header["strategy"], [cut]) for cut in self.cuts(path, k, full, offset, e, n)]
                    else:
                        group.append((k, full, offset, 0, e.size, e.stored))
                        weight += e.stored
                offset += e.stored + 2 * n * FRAME.size
                if weight >= PART_BYTES:
                    out.append(Files(path, header["strategy"], group))
                    group, weight = [], 0
            if group:
                out.append(Files(path, header["strategy"], group))
        return out or [Archive("")]

    def cuts(self, path: str, number: int, full: str, offset: int, entry: Entry, n: int) -> Iterator[tuple[int, str, int, int, int, int]]:
        """A long file in parts of whole blocks; only the frames' heads are read."""
        with open(path, "rb") as f:
            at, first, begin, stored, rest = offset, 0, offset, 0, entry.stored
            for block_no in range(n):
                for _ in range(2):
                    f.seek(at)
                    head = f.read(FRAME.size)
                    if len(head) < FRAME.size or head[:1] != SEPARATED:
                        raise ArchiveError("data block is broken")
                    size = FRAME.unpack(head)[1]
                    at, stored = at + FRAME.size + size, stored + size
                if stored >= PART_BYTES or block_no == n - 1:
                    end = min((block_no + 1) * self.block_size, entry.size)
                    yield number, full, begin, first, end - first * self.block_size, stored
                    first, begin, rest, stored = block_no + 1, at, rest - stored, 0
            if rest:
                raise ArchiveError(f"{full} has not the size that the directory says")

    def read(self, part: InputPartition) -> Iterator[tuple]:
        learn(self.modes)
        if isinstance(part, Files):
            yield from self.read_blocks(part)
        elif part.path and self.table == "header":
            with open(part.path, "rb") as f:
                yield (part.path, *unpack_header(f.read(HEADER.size)).values())
        elif part.path:
            _, entries = directory(part.path, self.password)
            for k, (block, iv, e, full, _) in enumerate(entries):
                yield part.path, k, block, e.kind, e.name, full, e.size, e.stored, e.children, iv

    def read_blocks(self, part: Files) -> Iterator[tuple]:
        mode, codec, key = resolve(part.strategy, self.password)
        with open(part.path, "rb") as f:

            def framed() -> bytes:
                head = f.read(FRAME.size)
                if len(head) < FRAME.size or head[:1] != SEPARATED:
                    raise ArchiveError("data block is broken")
                data = f.read(size := FRAME.unpack(head)[1])
                if len(data) < size:
                    raise ArchiveError("data block is cut short")
                return data

            for number, full, offset, first, size, stored in part.files:
                f.seek(offset)
                left = size
                for block_no in range(first, first + -(-size // self.block_size)):
                    metadata, payload = framed(), framed()
                    stored -= len(metadata) + len(payload)
                    if key is not None:
                        metadata, payload = cipher_of(mode).decrypt(metadata, key), cipher_of(mode).decrypt(payload, key)
                    raw = codec.decompress(metadata, payload, left)
                    left -= len(raw)
                    yield part.path, number, block_no, full, raw
                if left or stored:
                    raise ArchiveError(f"{full} has not the size that the directory says")


@dataclass
class Written(WriterCommitMessage):
    n: int  # bytes written
    end: int  # where the last of them ends


class ArchiveWriter(DataSourceWriter):
    """Writes rows (part, ord, offset, bytes) to one new file, each at its offset.

    All tasks write to one file beside the archive's place, which is renamed when every byte is
    there.  A task that runs again writes the same bytes to the same places.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        self.part = f"{path}.{uuid.uuid4().hex}.part"

    def write(self, rows: Iterator) -> Written:
        n = end = 0
        f = None
        try:
            for row in rows:
                if f is None:
                    f = os.open(self.part, os.O_RDWR | os.O_CREAT, 0o666)
                data, at = memoryview(row["bytes"]), row["offset"]
                while len(data):
                    done = os.pwrite(f, data, at)
                    data, at, n = data[done:], at + done, n + done
                end = max(end, at)
        finally:
            if f is not None:
                os.close(f)
        return Written(n, end)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        if not sum(m.n for m in done) or sum(m.n for m in done) != max(m.end for m in done):
            self.abort(messages)
            raise ArchiveError("pieces of an archive leave gaps or overlap")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class ArchiveSource(DataSource):
    """``spark.read.format("satchel").option("table", "entries").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "satchel"

    def schema(self) -> str:
        table = self.options.get("table", "entries")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> ArchiveReader:
        paths = sorted(glob.glob(self.options["path"])) or [self.options["path"]]
        return ArchiveReader(self.options.get("table", "entries"), paths, self.options.get("password"), int(self.options.get("blockSize", DATA_BLOCK)), self.options.get("modes", ""))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark) -> None:
    """Make both sources known to a session; reading filters are pushed into archives."""
    from satchel.plans.staging import ship
    from satchel.sources.trees import TreeSource

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(TreeSource)
