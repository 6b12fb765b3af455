"""The registry of storage modes: which codec and which cipher a strategy id stands for."""

from __future__ import annotations

import base64
import os
import struct
from dataclasses import dataclass
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions import cipher as rows_cipher
from satchel.functions import huffman
from satchel.functions.formats import ArchiveError


class Codec(Protocol):
    """A block codec; callers never look into the metadata."""

    def compress(self, block: bytes) -> tuple[bytes, bytes]: ...

    def decompress(self, metadata: bytes, payload: bytes, most: int | None = None) -> bytes: ...


class Cipher(Protocol):
    """A cipher of blocks.  A sealed block is a 16-byte IV and what ``encrypt_many`` gives, which
    is as long as the block; ``decrypt`` takes both."""

    def key_of(self, password: str) -> bytes: ...

    def encrypt_many(self, parts: list[bytes], key: bytes, ivs: list[bytes]) -> list[bytes]: ...

    def decrypt(self, data: bytes, key: bytes) -> bytes: ...


def seal(cipher: Cipher, data: bytes, key: bytes) -> bytes:
    """IV and ciphertext under an IV of its own."""
    iv = os.urandom(16)
    return iv + cipher.encrypt_many([data], key, [iv])[0]


class Null:
    """Stores a block as it is; the metadata has a zero byte and the length."""

    @staticmethod
    def compress(block: bytes) -> tuple[bytes, bytes]:
        return struct.pack("<BQ", 0, len(block)), bytes(block)

    @staticmethod
    def decompress(metadata: bytes, payload: bytes, most: int | None = None) -> bytes:
        if len(metadata) != 9 or metadata[0] != 0:
            raise ArchiveError("null metadata is broken")
        return payload[: min(struct.unpack("<Q", metadata[1:])[0], len(payload) if most is None else most)]


@dataclass(frozen=True)
class Mode:
    mode_id: int
    name: str
    codec: str
    cipher: str


CODECS: dict[str, Codec] = {"huffman": huffman, "null": Null}
CIPHERS: dict[str, Cipher | None] = {"rows": rows_cipher, "null": None}  #: "rows" is the container's own cipher
MODES = {m.mode_id: m for m in (Mode(0, "HuffmanAES", "huffman", "rows"), Mode(1, "HuffmanOnly", "huffman", "null"), Mode(2, "AESOnly", "null", "rows"), Mode(3, "PackOnly", "null", "null"))}
OWN_MODES = 128  #: ids from here on are free for modes of one's own


def register_cipher(name: str, cipher: Cipher) -> None:
    """Add a cipher that modes of one's own can name."""
    if name in ("rows", "null"):
        raise ValueError("the format's ciphers are fixed")
    CIPHERS[name] = cipher


def register_mode(mode_id: int, name: str, codec_name: str, codec: Codec | None = None, cipher: str = "null") -> Mode:
    """Add a mode with an own codec or a registered cipher; ids under 128 are the format's."""
    if not OWN_MODES <= mode_id <= 255:
        raise ValueError("own modes have ids from 128 to 255")
    if codec is not None:
        CODECS[codec_name] = codec
    if codec_name not in CODECS or cipher not in CIPHERS:
        raise ValueError("unknown codec or cipher")
    MODES[mode_id] = Mode(mode_id, name, codec_name, cipher)
    return MODES[mode_id]


def own_modes() -> str:
    """The registered modes as text, for readers in other processes; empty if there are none."""
    own = [(m, CODECS[m.codec], CIPHERS[m.cipher]) for m in MODES.values() if m.mode_id >= OWN_MODES]
    return base64.b64encode(cloudpickle.dumps(own)).decode() if own else ""


def learn(text: str) -> None:
    """Register what ``own_modes`` says."""
    for mode, codec, cipher in cloudpickle.loads(base64.b64decode(text)) if text else []:
        MODES[mode.mode_id], CODECS[mode.codec], CIPHERS[mode.cipher] = mode, codec, cipher


def resolve(mode: int | str, password: str | None = None) -> tuple[Mode, Codec, bytes | None]:
    """(mode, codec, key).  Unknown modes raise, and so do ciphers without a password."""
    found = MODES.get(mode) if isinstance(mode, int) else next((m for m in MODES.values() if m.name == mode), None)
    if found is None:
        raise ArchiveError(f"unknown mode {mode!r}")
    if found.cipher != "null" and not password:
        raise ValueError(f"mode {found.name} needs a password")
    return found, CODECS[found.codec], CIPHERS[found.cipher].key_of(password) if found.cipher != "null" else None


def cipher_of(mode: Mode) -> Cipher | None:
    return CIPHERS[mode.cipher]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.mode_id, m.name, m.codec, m.cipher) for m in MODES.values()], "mode_id smallint, name string, codec string, cipher string")


def dispatch(mode_id: Column, strict: bool = False) -> Column:
    """The name of a mode id; unknown ids are null, or an error if ``strict``."""
    unknown = F.raise_error(F.concat(F.lit("unknown mode "), F.coalesce(mode_id.cast("string"), F.lit("null"))))
    out = unknown if strict else F.lit(None).cast("string")
    for m in MODES.values():
        out = F.when(mode_id == m.mode_id, m.name).otherwise(out)
    return out
