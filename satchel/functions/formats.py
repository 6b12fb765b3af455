"""The archive container: field layout, packing and unpacking.

Everything is little-endian.  A container is a 19-byte header, directory blocks (a 25-byte
separator and entries), a magic number, and framed data blocks in the order of the file entries.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the container format.
MAGIC = 0xDEADBEEF
VERSION = 0
HEADER = struct.Struct("<IBBBQI")  # magic, strategy, version, header length, data offset, magic
SEPARATOR = struct.Struct("<cQ16s")  # '2', length of the block (0: up to the closing magic), IV
FRAME = struct.Struct("<cQ")  # '2', length
DIRECTORY, FILE, SEPARATED, ROOT, LINK = b"0", b"1", b"2", b"3", b"4"
DATA_BLOCK = 8 << 20
DIRECTORY_BLOCK = 16 << 10
NO_IV = bytes(16)
KINDS = {DIRECTORY: "dir", FILE: "file", ROOT: "root"}
FLAGS = {kind: flag for flag, kind in KINDS.items()}


class ArchiveError(ValueError):
    """Bytes that are not a readable archive."""


@dataclass(frozen=True)
class Entry:
    """One directory entry.  ``children`` is for directories, sizes are for files."""

    kind: str
    name: str
    children: int = 0
    size: int = 0
    stored: int = 0

    def pack(self) -> bytes:
        name = self.name.encode()
        head = FLAGS[self.kind] + struct.pack("<I", len(name)) + name
        return head + (struct.pack("<QQ", self.size, self.stored) if self.kind == "file" else struct.pack("<I", self.children))


def entry_length(kind: str, name_bytes: int) -> int:
    return name_bytes + (21 if kind == "file" else 9)


#: Layouts by version.  Readers know what writers can write; a further version adds its own here.
HEADERS = {VERSION: HEADER}


def pack_header(strategy: int, data_offset: int, version: int = VERSION) -> bytes:
    if version not in HEADERS:
        raise ArchiveError(f"no header of version {version} can be written")
    layout = HEADERS[version]
    return layout.pack(MAGIC, strategy, version, layout.size, data_offset, MAGIC)


def pack_separator(size: int, iv: bytes = NO_IV) -> bytes:
    return SEPARATOR.pack(SEPARATED, size, iv)


def unpack_header(raw: bytes) -> dict:
    """Fields of a header; raises if the magic numbers, version or length are wrong."""
    if len(raw) < HEADER.size:
        raise ArchiveError("header is cut short")
    first, strategy, version, length, offset, last = HEADER.unpack_from(raw)
    if first != MAGIC or last != MAGIC:
        raise ArchiveError("magic number is missing")
    if version not in HEADERS or length != HEADERS[version].size:
        raise ArchiveError(f"version {version} with a header of {length} bytes is unknown")
    if offset >= 1 << 63 or offset < HEADER.size + 4:
        raise ArchiveError("data offset is out of range")
    return {"magic1": first, "strategy": strategy, "version": version, "header_offset": length, "directory_offset": offset, "magic2": last}


def unpack_entries(raw: bytes) -> Iterator[Entry]:
    """The entries of a decrypted directory block."""
    at = 0

    def take(fmt: str) -> tuple:
        nonlocal at
        end = at + struct.calcsize(fmt)
        if end > len(raw):
            raise ArchiveError("directory block is cut short")
        found, at = struct.unpack_from(fmt, raw, at), end
        return found

    while at < len(raw):
        flag, size = take("<cI")
        if flag == LINK:
            raise ArchiveError("symbolic links are not readable in this format")
        if flag not in KINDS:
            raise ArchiveError(f"unknown entry flag {flag!r}")
        (name,) = take(f"<{size}s")
        try:
            text = name.decode()
        except UnicodeDecodeError as e:
            raise ArchiveError("an entry's name is not UTF-8") from e
        if flag == FILE:
            yield Entry("file", text, size=(pair := take("<QQ"))[0], stored=pair[1])
        else:
            yield Entry(KINDS[flag], text, children=take("<I")[0])


def directory_blocks(sizes: list[int], first_flush: int) -> list[int]:
    """The block of each entry: a block ends after the entry that brings it to 16 KiB.  Entries
    before number ``first_flush`` (the logical root and the roots) never end a block."""
    out, block, filled = [], 0, 0
    for k, size in enumerate(sizes):
        out.append(block)
        filled += size
        if k >= first_flush and filled >= DIRECTORY_BLOCK:
            block, filled = block + 1, 0
    return out


def read_directory(raw: bytes, decrypt) -> Iterator[tuple[int, bytes, Entry]]:
    """(block, IV, entry) of the directory in ``raw``, which starts after the header and ends with
    the closing magic number.  ``decrypt(iv, data)`` is called for blocks with an IV."""
    end = len(raw) - 4
    if end < 0 or struct.unpack_from("<I", raw, end)[0] != MAGIC:
        raise ArchiveError("magic number after the directory is missing")
    at = block = 0
    while at < end:
        if at + SEPARATOR.size > end:
            raise ArchiveError("separator is cut short")
        flag, size, iv = SEPARATOR.unpack_from(raw, at)
        at += SEPARATOR.size
        size = size or end - at
        if flag != SEPARATED or at + size > end:
            raise ArchiveError("directory block is broken")
        data = raw[at : at + size]
        for entry in unpack_entries(decrypt(iv, data) if iv != NO_IV else data):
            yield block, iv, entry
        at, block = at + size, block + 1


def safe_name(name: str) -> str:
    """The name, if it is one path component that stays where it is put."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or "\0" in name or name[1:2] == ":":
        raise ArchiveError(f"unsafe name {name!r}")
    return name
