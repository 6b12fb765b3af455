"""Container format, Huffman and cipher: golden bytes, properties and broken input."""

import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from satchel.functions import cipher, formats, huffman
from satchel.plans import modes

GOLDEN = [
    (b"aaaabbc", "46720072006c636c626c61", "06f500"),
    (b"zzzzz", "466c7a", "0300"),
    (b"zzzzzzzz", "466c7a", "0000"),
    (b"abracadabra", "4672006c6172006c7272006c6272006c636c64", "0169cf68"),
]


@pytest.mark.parametrize("block,metadata,payload", GOLDEN)
def test_huffman_golden(block, metadata, payload):
    assert huffman.compress(block) == (bytes.fromhex(metadata), bytes.fromhex(payload))


@given(st.binary(min_size=1, max_size=3000))
@settings(max_examples=150, deadline=None)
def test_huffman_round_trip_and_size_law(block):
    metadata, payload = huffman.compress(block)
    assert huffman.decompress(metadata, payload) == block
    assert huffman.decompress(metadata, payload, len(block) // 2) == block[: len(block) // 2]
    weights, bits = sorted(block.count(b) for b in set(block)), 0
    if len(weights) == 1:
        bits = weights[0]
    while len(weights) > 1:
        two = weights[0] + weights[1]
        weights, bits = sorted([*weights[2:], two]), bits + two
    assert len(metadata) == 4 * len(set(block)) - 1 and len(payload) == 1 + -(-bits // 8)


@pytest.mark.parametrize("limit", [None, 0, 1, 50_000, 69_999])
def test_huffman_large_block(limit):
    rng = np.random.default_rng(1)
    block = bytes(rng.choice(256, 70_000, p=rng.dirichlet(np.full(256, 0.05))).astype(np.uint8)) + bytes(range(256))
    assert huffman.decompress(*huffman.compress(block), limit) == block[:limit]


def test_huffman_long_codes():
    a, b, block = 1, 1, b""
    for k in range(26):
        block += bytes([k]) * a
        a, b = b, a + b
    assert huffman.decompress(*huffman.compress(block)) == block


@pytest.mark.parametrize("metadata,payload", [(b"", b"\0a"), (b"Gla", b"\0a"), (b"Fxa", b"\0a"), (b"Fr\0la", b"\0a"), (b"Flalb", b"\0a"), (b"Fla", b""), (b"Fla", b"\x08a"), (b"Fr\0lalb", b"")])
def test_huffman_broken(metadata, payload):
    with pytest.raises(formats.ArchiveError):
        huffman.decompress(metadata, payload)


def test_null_codec():
    assert modes.Null.compress(b"hello") == (bytes.fromhex("000500000000000000"), b"hello")
    assert modes.Null.decompress(*modes.Null.compress(b"hello")) == b"hello" and modes.Null.decompress(*modes.Null.compress(b"hello"), 2) == b"he"
    with pytest.raises(formats.ArchiveError):
        modes.Null.decompress(b"\1" * 9, b"x")


def test_cipher_golden():
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]
    assert cipher.encrypt_blocks(block, cipher.expand(bytes(range(16)))).tobytes().hex() == "2774ce70906be5cda5bfd0c0da400478"
    key = cipher.key_of("password")
    assert key.hex() == "5e884898da28047151d0e56f8dc62927"
    sealed = cipher.encrypt(b"The quick brown fox jumps over the lazy dog", key, bytes(range(16)))
    assert sealed[16:].hex() == "7b80429399342df932c9516910052c108f86e98c3f6c4ca40262d82570da7df86f7560b38af2f894fdc0d6"


@given(st.lists(st.binary(max_size=200), max_size=6), st.binary(min_size=16, max_size=16))
@settings(max_examples=60, deadline=None)
def test_cipher_round_trip(parts, key):
    ivs = [os.urandom(16) for _ in parts]
    sealed = cipher.encrypt_many(parts, key, ivs)
    assert [cipher.decrypt(i + s, key) for i, s in zip(ivs, sealed, strict=True)] == parts


def test_header():
    raw = formats.pack_header(3, 86)
    assert raw.hex() == "efbeadde0300135600000000000000efbeadde"
    assert formats.unpack_header(raw)["directory_offset"] == 86
    for broken in (raw[:-1], b"\0" + raw[1:], raw[:-1] + b"\0", raw[:5] + b"\1" + raw[6:], struct.pack("<IBBBQI", formats.MAGIC, 0, 0, 19, 1 << 63, formats.MAGIC)):
        with pytest.raises(formats.ArchiveError):
            formats.unpack_header(broken)


def test_entries():
    entries = [formats.Entry("root", "out", 2), formats.Entry("dir", "日本", 0), formats.Entry("file", "😀.txt", size=5, stored=14)]
    raw = b"".join(e.pack() for e in entries)
    assert list(formats.unpack_entries(raw)) == entries
    assert [formats.entry_length(e.kind, len(e.name.encode())) for e in entries] == [len(e.pack()) for e in entries]
    for broken in (raw[:-1], b"9" + raw[1:], b"4" + raw[1:], b"0\1\0\0\0\xff\0\0\0\0"):
        with pytest.raises(formats.ArchiveError):
            list(formats.unpack_entries(broken))


def test_directory_blocks():
    assert formats.directory_blocks([9, 9000, 9000, 100, 20_000, 5], 1) == [0, 0, 0, 1, 1, 2]
    assert formats.directory_blocks([9, 20_000, 20_000, 5, 5], 3) == [0, 0, 0, 0, 1]


@pytest.mark.parametrize("name", ["", ".", "..", "a/b", "a\\b", "C:x", "a\0b"])
def test_unsafe_names(name):
    with pytest.raises(formats.ArchiveError):
        formats.safe_name(name)


def test_modes():
    assert modes.resolve("PackOnly")[0].mode_id == 3 and modes.resolve(0, "x")[2] == cipher.key_of("x")
    with pytest.raises(ValueError):
        modes.resolve(0)
    with pytest.raises(formats.ArchiveError):
        modes.resolve(9)
    with pytest.raises(ValueError):
        modes.register_mode(5, "own", "null")
    import zlib

    class Deflate:
        compress = staticmethod(lambda b: (b"", zlib.compress(b)))
        decompress = staticmethod(lambda m, p, most=None: zlib.decompress(p)[:most])

    own = modes.register_mode(130, "Deflate", "deflate", Deflate)
    assert modes.resolve(130)[0] == own and modes.resolve(130)[1].decompress(*modes.resolve(130)[1].compress(b"abc")) == b"abc"
