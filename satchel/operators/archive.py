"""Packing trees or binary columns into an archive, and restoring them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from satchel.functions.formats import DATA_BLOCK, FRAME, HEADER, MAGIC, NO_IV, SEPARATED, SEPARATOR, VERSION, ArchiveError, Entry, pack_header, pack_separator
from satchel.functions.udfs import encode_with, encrypt
from satchel.operators import manifest
from satchel.operators.blocks import block_count, split_blocks
from satchel.plans.modes import cipher_of, own_modes, resolve, seal
from satchel.plans.ordering import number_rows, running_sum
from satchel.plans.staging import stage
from satchel.sources.archives import register

FRAME_BYTES = 2 * FRAME.size  #: of metadata and payload together


def encode_blocks(blocks: DataFrame, keys: list[str], mode: int | str, password: str | None = None, iv: str | None = None) -> DataFrame:
    """(keys, metadata, payload): blocks under a mode, as stored but for the frames.

    ``iv`` names a column of 16-byte IVs (tests); without it each part draws its own.
    """
    found, codec, key = resolve(mode, password)
    out = blocks.withColumn("__e", encode_with(codec)("raw")).select(*blocks.columns, "__e.metadata", "__e.payload")
    if key is not None:
        ivs = None if iv is None else F.col(iv)
        out = out.withColumn("metadata", encrypt(F.col("metadata"), key, ivs, cipher_of(found))).withColumn("payload", encrypt(F.col("payload"), key, ivs, cipher_of(found)))
    return out.select(*keys, "metadata", "payload")


def pieces(files: DataFrame, folders: DataFrame | None, root: str, mode: int | str, password: str | None = None, block_size: int = DATA_BLOCK, version: int = VERSION) -> DataFrame:
    """The archive of ``files`` (path, raw), see ``assemble``."""
    sizes = files.select("path", F.coalesce(F.octet_length("raw"), F.lit(0)).alias("size"))
    blocks = split_blocks(files.select("path", "raw"), ["path"], "raw", block_size)
    return assemble(sizes, blocks, folders, root, mode, password, version)


def assemble(sizes: DataFrame, blocks: DataFrame, folders: DataFrame | None, root: str, mode: int | str, password: str | None = None, version: int = VERSION) -> DataFrame:
    """The archive of files (path, size) and their ``blocks`` (path, block_no, raw) as rows (part,
    ord, offset, bytes): header and directory in part 0, data in part 1.

    Encoding runs on all blocks in parallel; offsets and stored sizes are sums, so nothing is
    written twice or filled in later, and rows can be written in any order.
    """
    found, _, key = resolve(mode, password)
    cipher = cipher_of(found)
    pack_header(found.mode_id, HEADER.size + 4, version)  # an unknown version fails here
    entries = stage(manifest.ordered(manifest.tree(sizes, folders), root), "entries")
    encoded = stage(encode_blocks(blocks, ["path", "block_no"], mode, password), "encoded")
    framed = F.octet_length("metadata") + F.octet_length("payload")
    stored = encoded.groupBy("path").agg(F.sum(framed).alias("stored"))
    placed = manifest.layout(entries).select("entry_ord", "entry_offset")
    full = stage(entries.join(stored, "path", "left").join(manifest.blocks_of_directory(entries), "entry_ord").join(placed, "entry_ord"), "full")
    last = full.agg(F.max("dir_block").alias("b"), F.sum(F.octet_length("name") + F.when(F.col("kind") == "file", 21).otherwise(9)).alias("n")).first()
    offset = HEADER.size + (last.b + 1) * SEPARATOR.size + last.n + 4
    count, head_bytes, separator_bytes = last.b, HEADER.size, SEPARATOR.size

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entry_ord")
        data = b"".join(Entry(r.kind, r.name, int(r.child_count), int(r.size), int(r.stored)).pack() for r in rows.itertuples(index=False))
        block, iv = int(rows.dir_block.iloc[0]), NO_IV
        at = head_bytes + block * separator_bytes + int(rows.entry_offset.iloc[0]) if block else 0
        size = 0 if block == count else len(data)
        if key is not None:
            sealed = seal(cipher, data, key)
            iv, data = sealed[:16], sealed[16:]
        head = pack_header(found.mode_id, offset, version) if block == 0 else b""
        tail = MAGIC.to_bytes(4, "little") if block == count else b""
        return pd.DataFrame({"part": [0], "ord": [block], "offset": [at], "bytes": [head + pack_separator(size, iv) + data + tail]})

    rows = full.select("entry_ord", "kind", "name", "child_count", "size", F.coalesce("stored", F.lit(0)).alias("stored"), "dir_block", "entry_offset")
    # IVs are drawn once, so that a part that is written again is the same.
    directory = stage(rows.groupBy("dir_block").applyInPandas(pack, "part int, ord long, offset long, bytes binary"), "directory")
    # Frames have the length in eight little-endian bytes.
    frame = lambda c: F.concat(F.lit(SEPARATED).cast("binary"), little_endian(F.octet_length(c)), F.col(c))
    lengths = encoded.select("path", "block_no", (framed + 2 * FRAME.size).cast("long").alias("n")).join(entries.select("path", "entry_ord"), "path")
    lengths = number_rows(lengths.select("path", "block_no", "n", (F.shiftleft("entry_ord", 32) + F.col("block_no")).alias("ord")), F.col("ord"), name="k")
    places = running_sum(lengths, "k", F.col("n"), "before").select("path", "block_no", "ord", (F.col("before") + offset).cast("long").alias("offset"))
    data = encoded.join(places, ["path", "block_no"]).select(F.lit(1).alias("part"), "ord", "offset", F.concat(frame("metadata"), frame("payload")).alias("bytes"))
    return directory.unionByName(data)


def little_endian(n: Column) -> Column:
    """Eight bytes of a number, the least first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def write_archive(pieces_: DataFrame, path: str, overwrite: bool = False) -> None:
    """One file, on a file system that all executors mount: every task writes its rows at their
    offsets, so nothing passes through one task."""
    register(pieces_.sparkSession)
    pieces_.write.format("satchel").mode("overwrite" if overwrite else "append").save(path)


def scan(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, folders) below roots: files has path, full_path and the size at the time of the
    scan.  Roots of one name collide; dangling links and links to folders are an error."""
    register(spark)
    seen = stage(spark.read.format("fstree").option("roots", "\n".join(dict.fromkeys(roots))).load(), "scan")
    if (link := seen.where("kind = 'link'").limit(1).collect()):
        raise ArchiveError(f"{link[0].full_path} is a symbolic link to nothing, which the format cannot hold")

    if (link := seen.where("kind = 'dirlink'").limit(1).collect()):
        raise ArchiveError(f"{link[0].full_path} is a symbolic link to a folder, which is not followed; name the folder as a root")
    return seen.where("kind = 'file'").select("path", "full_path", "size"), seen.where("kind = 'dir'").select("path")


def file_blocks(files: DataFrame, block_size: int = DATA_BLOCK) -> DataFrame:
    """(path, block_no, raw) of ``files`` (path, full_path, size): every block is a ranged read of
    its own, so memory does not grow with a file.

    What a file has gained since the scan is left out; a file that has lost bytes is an error.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                at = int(r.block_no) * block_size
                with open(r.full_path, "rb") as f:
                    f.seek(at)
                    raw = f.read(n := min(block_size, int(r.size) - at))
                if len(raw) < n:
                    raise ArchiveError(f"{r.full_path} is shorter than it was when it was found")
                yield pd.DataFrame({"path": [r.path], "block_no": [r.block_no], "raw": [raw]})

    n = block_count(F.col("size"), block_size)
    numbered = files.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return numbered.select("path", "full_path", "size", "block_no").repartition("path", "block_no").mapInPandas(load, "path string, block_no long, raw binary")


def compress(spark: SparkSession, roots: list[str], out: str, mode: int | str = 1, password: str | None = None, root: str | None = None, overwrite: bool = False, version: int = VERSION, block_size: int = DATA_BLOCK) -> None:
    """Pack files and folders into the archive ``out``; an existing one is an error.

    Sizes and numbers of blocks are those of the scan, whatever a file becomes afterwards.
    """
    if os.path.exists(out) and not overwrite:
        raise FileExistsError(out)
    resolve(mode, password)
    files, folders = scan(spark, roots)
    name = root if root is not None else os.path.splitext(os.path.basename(out))[0]
    write_archive(assemble(files.select("path", "size"), file_blocks(files, block_size), folders, name, mode, password, version), out, overwrite)


def table(spark: SparkSession, path: str, name: str, password: str | None = None, block_size: int = DATA_BLOCK) -> DataFrame:
    """The header, entries or blocks of an archive (or of all that a pattern matches)."""
    register(spark)
    reader = spark.read.format("satchel").option("table", name).option("blockSize", block_size).option("modes", own_modes())
    return (reader.option("password", password) if password else reader).load(path)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(archive, mode_id, name, needs_password): what a header alone says."""
    from satchel.plans.modes import MODES

    modes = spark.createDataFrame([(m.mode_id, m.name, m.cipher != "null") for m in MODES.values()], "strategy short, mode string, needs_password boolean")
    return table(spark, path, "header").join(F.broadcast(modes), "strategy", "left").select("archive", F.col("strategy").alias("mode_id"), F.coalesce("mode", F.raise_error(F.lit("unknown mode"))).alias("mode"), "needs_password")


def restore(spark: SparkSession, path: str, out: str | None = None, password: str | None = None, policy: str = "error", block_size: int = DATA_BLOCK) -> DataFrame:
    """Write an archive's files below ``out`` (the archive's own folder, if none is named) and
    return (path, size) of those written.

    ``policy`` says what happens to files that exist: ``error``, ``skip`` or ``overwrite``.  Each
    file is written beside its place and renamed when it is complete.  Names that would leave
    ``out`` are rejected when the directory is read.
    """
    if policy not in ("error", "skip", "overwrite"):
        raise ValueError("policy is error, skip or overwrite")
    out = os.path.dirname(os.path.abspath(path)) if out is None else out
    entries = stage(table(spark, path, "entries", password), "entries")
    root = entries.where("kind = 'root'").first()
    base = os.path.join(out, root.name) if root.name else out
    for row in entries.where("kind != 'file'").select("path", "kind").toLocalIterator():
        os.makedirs(base if row.kind == "root" else os.path.join(base, row.path), exist_ok=True)

    def existing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[[os.path.lexists(os.path.join(base, p)) for p in rows.path]]

    files = entries.where("kind = 'file'").select("path", "size")
    there = stage(files.select("path").mapInPandas(existing, "path string"), "existing")
    if policy == "error" and (first := there.limit(1).collect()):
        raise FileExistsError(os.path.join(base, first[0].path))
    if policy == "skip":
        files = files.join(there, "path", "left_anti")
    blocks = table(spark, path, "blocks", password, block_size).select("path", "block_no", "raw")
    todo = files.join(blocks, "path", "left").repartition("path").sortWithinPartitions("path", "block_no")

    def write(rows: Iterator[Row]) -> None:
        current, f, part = None, None, ""

        def finish() -> None:
            if f is not None:
                f.close()
                os.replace(part, os.path.join(base, current))

        for row in rows:
            if row.path != current:
                finish()
                current = row.path
                part = os.path.join(base, f"{current}.{uuid.uuid4().hex}.part")
                f = open(part, "wb")  # noqa: SIM115
            if row.raw is not None:
                f.write(row.raw)
        finish()

    todo.foreachPartition(write)
    return files
